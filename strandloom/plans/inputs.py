"""Inputs of the queries, derived from the given tables; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import codes
from strandloom.session import table

TREE = "((a:0.1,b:0.2):0.05,c:0.3);"
LEAVES = ("a", "b", "c")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, conv_id, turn, seq): the RNA letters of each turn of the conversations, eight at least."""
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"), "conv_id", "turn", codes.rna(codes.dna_only(F.col("text"))).alias("seq")).filter(F.length("seq") >= 8)


SEQ = """seqs AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS seq_id, conv_id, turn,
  translate(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 'T', 'U') AS seq FROM conversations) WHERE length(seq) >= 8)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, l, r): each sequence against its reverse, every seventh left base a gap."""
    return sequences(spark, sf_dir).select("seq_id", F.regexp_replace("seq", "(.{6}).", "$1-").alias("l"), F.reverse("seq").alias("r"))


PATHS = SEQ + r""", paths AS (SELECT seq_id, regexp_replace(seq, '(.{6}).', '\1-', 'g') AS l, reverse(seq) AS r FROM seqs)"""


def helix_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, l, r): each sequence fully paired: A with U, C with G, G with U, U with A."""
    return sequences(spark, sf_dir).select("seq_id", F.col("seq").alias("l"), F.translate("seq", "ACGU", "UGUA").alias("r"))


HELIX = SEQ + """, helix AS (SELECT seq_id, seq AS l, translate(seq, 'ACGU', 'UGUA') AS r FROM seqs)"""


def documents_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codes.dna_only(F.col("text")).alias("seq")).filter(F.length("seq") >= 30)


DNA = "dna AS (SELECT * FROM (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents) WHERE length(seq) >= 30)"


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(blk, chr, pos, size, ref, s1, s2): three turns each of a conversation as species a, b, c, every turn in one block.

    Shorter ones are filled up with gaps; every seventh reference column is a gap; a turn without bases, or that there is
    not, is an absent species, and a block without a reference is none. Four conversations make a chromosome, the third
    of them after a hole.
    """
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 3)).alias("blk"), "conv_id", (F.col("turn") % 3).alias("k"), F.nullif(codes.dna_only(F.col("text")), F.lit("")).alias("s"))
    w = t.groupBy("blk", "conv_id").agg(*(F.max(F.when(F.col("k") == k, F.col("s"))).alias(f"s{k}") for k in range(3))).filter("s0 is not null")
    w = w.withColumn("ref", F.regexp_replace("s0", "(.{6}).", "$1-"))
    wide = F.greatest(*(F.coalesce(F.length(c), F.lit(0)) for c in ("ref", "s1", "s2")))
    fill = lambda c: F.concat(F.col(c), F.repeat(F.lit("-"), F.col("n") - F.length(c))).alias(c)
    w = w.withColumn("n", wide).select("blk", "conv_id", fill("ref"), fill("s1"), fill("s2"))
    w = w.withColumns({"size": F.length(F.replace("ref", F.lit("-"), F.lit(""))).cast("long"), "chr": F.concat(F.lit("chr"), F.floor(F.col("conv_id") / 4).cast("string"))})
    order = Window.partitionBy("chr").orderBy("blk")
    hole = F.sum(F.when((F.col("conv_id") % 4 == 2) & (F.col("blk") % 1000 == 0), 1000).otherwise(0)).over(order)
    return w.withColumn("pos", F.sum("size").over(order) - F.col("size") + hole).select("blk", "chr", "pos", "size", "ref", "s1", "s2")


ALN = r"""turns AS (SELECT conv_id * 1000 + turn // 3 AS blk, conv_id, turn % 3 AS k, nullif(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), '') AS s FROM conversations),
wide AS (SELECT blk, conv_id, max(CASE WHEN k = 0 THEN s END) AS s0, max(CASE WHEN k = 1 THEN s END) AS s1, max(CASE WHEN k = 2 THEN s END) AS s2 FROM turns GROUP BY blk, conv_id),
sized AS (SELECT *, regexp_replace(s0, '(.{6}).', '\1-', 'g') AS r, greatest(length(s0), coalesce(length(s1), 0), coalesce(length(s2), 0))::INTEGER AS n FROM wide WHERE s0 IS NOT NULL),
placed AS (SELECT blk, conv_id, rpad(r, n, '-') AS ref, rpad(s1, n, '-') AS s1, rpad(s2, n, '-') AS s2, length(replace(r, '-', '')) AS size, 'chr' || (conv_id // 4) AS chr FROM sized),
aln AS (SELECT blk, chr, CAST(sum(size) OVER w - size + sum(CASE WHEN conv_id % 4 = 2 AND blk % 1000 = 0 THEN 1000 ELSE 0 END) OVER w AS BIGINT) AS pos, CAST(size AS BIGINT) AS size, ref, s1, s2
  FROM placed WINDOW w AS (PARTITION BY chr ORDER BY blk))"""


def maf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): each alignment as a MAF block; a species only where there is a turn for it."""
    line = lambda name, seq: F.concat_ws(" ", F.lit("s"), F.concat(F.lit(f"{name}."), F.col("chr")), F.col("pos").cast("string"), F.length(F.replace(seq, F.lit("-"), F.lit(""))).cast("string"), F.lit("+"), F.lit("1000000"), seq)
    head = F.concat(F.lit("a score="), F.col("size").cast("string"))
    return alignment_rows(spark, sf_dir).select(F.concat_ws("\n", head, line("a", F.col("ref")), *(F.when(F.col(c).isNotNull(), line(x, F.col(c))) for x, c in (("b", "s1"), ("c", "s2")))).alias("value"))


def duplexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seqname, strand, f_first .. l_last, energy, n_pairs): one for each different line item."""
    t = table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long")
    base = t.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("seqname"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (F.col("l_partkey") + 1).alias("f_first"), (F.col("l_partkey") + n).alias("f_last"),
        (F.col("l_partkey") + n + 1 + F.col("l_linenumber").cast("long") * 20).alias("l_first"), (F.col("l_partkey") + 2 * n + F.col("l_linenumber").cast("long") * 20).alias("l_last"),
        (-F.round(F.col("l_extendedprice")).cast("long")).alias("cents"), n.alias("n_pairs"),
    ).distinct()
    return base.select(F.concat_ws("|", "seqname", "strand", *(F.col(c).cast("string") for c in ("f_first", "f_last", "l_first", "l_last", "cents"))).alias("key"), "*", (F.col("cents") / 1000.0).alias("energy"))


IV = """iv AS (SELECT concat_ws('|', seqname, strand, f_first, f_last, l_first, l_last, cents) AS key, *, cents / 1000.0 AS energy FROM (SELECT DISTINCT 's' || l_suppkey AS seqname,
  CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey + 1 AS f_first, l_partkey + CAST(l_quantity AS BIGINT) AS f_last, l_partkey + CAST(l_quantity AS BIGINT) + 1 + l_linenumber * 20 AS l_first,
  l_partkey + 2 * CAST(l_quantity AS BIGINT) + l_linenumber * 20 AS l_last, -CAST(round(l_extendedprice) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS n_pairs FROM lineitem))"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seqname, first, last) from part: a gene for each, on a hundred sequences."""
    t = table(spark, sf_dir, "part")
    return t.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("s"), (F.col("p_partkey") % 100 + 1).cast("string")).alias("seqname"), F.col("p_partkey").alias("first"), (F.col("p_partkey") + F.col("p_size")).alias("last"))


GENES = "genes AS (SELECT 'g' || p_partkey AS name, 's' || (p_partkey % 100 + 1) AS seqname, p_partkey AS first, p_partkey + p_size AS last FROM part)"


def conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqname, first, last, score) from orders."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.concat(F.lit("s"), (F.col("o_custkey") % 100 + 1).cast("string")).alias("seqname"), (F.col("o_orderkey") % 2000).alias("first"), (F.col("o_orderkey") % 2000 + 5).alias("last"), (F.col("o_orderkey") % 100).cast("double").alias("score"))


CONS = "cons AS (SELECT 's' || (o_custkey % 100 + 1) AS seqname, o_orderkey % 2000 AS first, o_orderkey % 2000 + 5 AS last, CAST(o_orderkey % 100 AS DOUBLE) AS score FROM orders)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows for each event: (event_id, dist, cons, deltag, npairs, entropy, covariance)."""
    t = table(spark, sf_dir, "events")
    v = F.col("value")
    return t.select("event_id", (F.col("event_id") * 7919 % 12000).alias("dist"), (v / 10).alias("cons"), (-v).alias("deltag"), (F.col("event_id") % 24 + 5).cast("double").alias("npairs"), (F.col("user_id") % 16 / 4.0).alias("entropy"), (F.col("event_id") % 10 / 10.0).alias("covariance"))


FEAT = """feat AS (SELECT event_id, event_id * 7919 % 12000 AS dist, value / 10 AS cons, -value AS deltag, CAST(event_id % 24 + 5 AS DOUBLE) AS npairs, user_id % 16 / 4.0 AS entropy, event_id % 10 / 10.0 AS covariance FROM events)"""
