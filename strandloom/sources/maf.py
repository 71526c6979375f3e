"""Multiple alignment blocks (MAF): scan, filters, reference gaps, merging of adjacent blocks, missing species."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

S_LINE = r"^ ?s\s+(\S+)\s+(\d+)\s+(\d+)\s+([+-])\s+(\d+)\s+([ATGCNatgcn-]+)\s*$"
SPECIES = "struct<name:string,chr:string,position:bigint,strand:string,seq:string>"


#: Lines are told apart, and a block from the next one, whatever ends the lines.
LINE, NEXT = r"\r?\n", r"\n(?= ?a[ \t])"
HEAD = r"^ ?a\s+score=(-?[0-9.]+(?:[eE][-+]?\d+)?)"


def blocks_of(text: DataFrame) -> DataFrame:
    """One row a block (value), from texts that were divided where a line begins with ``a``, which went with the division."""
    whole = F.when(F.col("value").rlike(r"^[ \t]+score="), F.concat(F.lit("a"), "value")).otherwise(F.col("value"))
    return text.select(F.explode(F.split(whole, NEXT)).alias("value")).filter(F.col("value").rlike(r"(?m)^ ?[a-z]\s"))


def read_text(spark: SparkSession, path: str | Sequence[str], chromosomes: Sequence[str] | None = None) -> DataFrame:
    """One row a block (value), of plain or .gz files.

    A block begins at a line with ``a``, so lines may end in CRLF and blank lines may hold spaces; files are divided at any
    byte, as Spark's own reader does. With ``chromosomes`` the path is a folder with a file for each (``<chromosome>.maf``, also
    ``.gz``), and other files are never opened.
    """
    reader = spark.read.option("lineSep", "\na")
    if chromosomes is not None:
        # a name stands for itself in the filter, whatever it holds
        plain = lambda c: "".join(f"\\{x}" if x in "\\{}[]*?," else x for x in c)
        names = sorted({plain(c) for c in chromosomes})
        if not names:
            return spark.createDataFrame([], "value string")
        reader = reader.option("pathGlobFilter", "{" + ",".join(f"{n}.maf,{n}.maf.gz" for n in names) + "}")
    return blocks_of(reader.text(path if isinstance(path, str) else list(path)))


def _lines(blocks: DataFrame) -> DataFrame:
    """Adds lines (no blank ones and no comments), tokens (those of each line after the first) and head (the score's text)."""
    lines = F.filter(F.split("value", LINE), lambda x: ~x.rlike(r"^\s*$|^.?#"))
    rows = blocks.withColumn("lines", lines)
    tokens = F.transform(F.slice("lines", 2, 1_000_000), lambda x: F.split(F.trim(F.when(x.rlike(S_LINE), x)), r"\s+"))
    return rows.withColumns({"tokens": tokens, "score": F.regexp_extract(F.try_element_at("lines", F.lit(1)), HEAD, 1).try_cast("double")})


def rejected(blocks: DataFrame) -> DataFrame:
    """(reason, n): how many blocks ``parse`` drops for what they are, not for what is asked of them."""
    size = F.try_element_at("tokens", F.lit(1))[3].try_cast("bigint")
    reason = F.when(F.col("score").isNull(), "no score").when(F.size("tokens") < 1, "no sequence").when(F.exists("tokens", lambda t: t.isNull()), "another kind of line").when(size.isNull(), "no size")
    return _lines(blocks).select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def parse(blocks: DataFrame, minlength: int = 1, minscore: float = float("-inf"), keepname: bool = False) -> DataFrame:
    """(block_id, score, species): from text blocks (column value). species: its ``s`` lines in order, the first the reference.

    Comment lines (``#`` as first or second character) are dropped. A block goes if it has another kind of line, if its
    score or its reference's size does not parse, or if either is under its minimum (``rejected`` counts the former).
    Bases are upper-cased. A name is ``organism.chromosome``; with ``keepname`` it is kept whole.
    """

    def one(t: Column) -> Column:
        # s, name, position, size, strand, length of the source, bases
        bits = F.split(t[1], r"\.")
        return F.struct(
            (t[1] if keepname else bits[0]).alias("name"), F.try_element_at(bits, F.lit(2)).alias("chr"),
            t[2].try_cast("bigint").alias("position"), t[4].alias("strand"), F.upper(t[6]).alias("seq"),
        )

    size = F.try_element_at("tokens", F.lit(1))[3].try_cast("bigint")
    ok = (F.size("tokens") >= 1) & F.forall("tokens", lambda t: t.isNotNull())
    rows = _lines(blocks).filter(ok).filter((F.col("score") >= minscore) & (size >= minlength))
    return rows.select(F.xxhash64("lines").alias("block_id"), "score", F.transform("tokens", one).alias("species"))


def without_reference_gaps(blocks: DataFrame) -> DataFrame:
    """Drops every alignment column where the first species has a gap, from all species."""
    ref = F.split(F.col("species")[0]["seq"], "")

    def cut(s: Column) -> Column:
        letters = F.zip_with(ref, F.split(s["seq"], ""), lambda r, x: F.when(r == "-", "").otherwise(x))
        return s.withField("seq", F.array_join(letters, ""))

    return blocks.withColumn("species", F.transform("species", cut))


SPAN = 1 << 20


def _islands(blocks: DataFrame) -> DataFrame:
    """(block_id, chr, position, n) with island: where the run of blocks that each begin where the one before ends begins."""
    stretch = ["chr", "stretch"]
    rows = blocks.withColumns({"stretch": F.floor(F.col("position") / SPAN), "end": F.col("position") + F.col("n")})
    w, over = Window.partitionBy(*stretch).orderBy("position", "block_id"), Window.partitionBy("chr").orderBy("stretch")
    # a row for each stretch: how the one before it ends
    ends = rows.groupBy(*stretch).agg(F.max_by("end", F.struct("position", "block_id")).alias("end")).select(*stretch, F.lag("end").over(over).alias("before"))
    rows = rows.join(ends, stretch)
    starts = F.coalesce(F.coalesce(F.lag("end").over(w), "before") != F.col("position"), F.lit(True))
    rows = rows.withColumn("start", F.when(starts, F.struct("position", "block_id")))
    last = rows.groupBy(*stretch).agg(F.max("start").alias("start"))
    carried = last.select(*stretch, F.max("start").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = F.coalesce(F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0)), "carried")
    return rows.join(carried, stretch).select("block_id", "chr", "position", "n", whole.alias("island"))


def merge_adjacent(blocks: DataFrame, order: Sequence[str], minspecies: int = 2, minlength: int = 18) -> DataFrame:
    """Joins blocks whose reference follows the one before without a gap; (block_id, chr, position, species).

    Only blocks with ``minspecies`` species count, and of the results only those longer than ``minlength``. Species come in
    the ``order`` of the tree, others are dropped; one that a block lacks has gaps there. Each keeps the position of its
    first block. A block that comes twice counts once. Islands are found from (position, length) alone, in stretches of
    SPAN positions, and the last block of each stretch is told to the next; the sequences move once, by island.
    """
    ref = F.col("species")[0]
    rows = blocks.filter(F.size("species") >= minspecies).select("block_id", "species", ref["chr"].alias("chr"), ref["position"].alias("position"), F.length(ref["seq"]).alias("n")).dropDuplicates(["block_id"])
    islands = _islands(rows.select("block_id", "chr", "position", "n"))
    place = F.create_map(*(F.lit(x) for i, s in enumerate(order) for x in (s, i)))
    each = rows.select("block_id", F.explode("species").alias("s")).withColumn("rank", F.try_element_at(place, F.col("s.name"))).filter("rank is not null")
    parts = each.join(islands, "block_id")
    present = parts.select("chr", "island", "rank").distinct()
    frame = islands.select("chr", "island", "block_id", "position", "n").join(present, ["chr", "island"])
    filled = frame.join(each.select("block_id", "rank", "s"), ["block_id", "rank"], "left")
    piece = F.struct("position", F.coalesce(F.col("s.seq"), F.repeat(F.lit("-"), F.col("n"))).alias("seq"))
    whole = filled.groupBy("chr", "island", "rank").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["seq"]), "").alias("seq"),
        F.min_by(F.struct("s.chr", "s.position", "s.strand"), F.when(F.col("s").isNotNull(), F.col("position"))).alias("at"), F.min("position").alias("position"),
    )
    names = F.array(*map(F.lit, order))
    species = F.struct("rank", F.struct(names[F.col("rank")].alias("name"), F.col("at.chr").alias("chr"), F.col("at.position").alias("position"), F.col("at.strand").alias("strand"), "seq").alias("s"))
    out = whole.groupBy("chr", "island").agg(F.min("position").alias("position"), F.transform(F.sort_array(F.collect_list(species)), lambda x: x["s"]).alias("species"))
    return out.filter(F.length(F.col("species")[0]["seq"]) > minlength).select(F.xxhash64("chr", "position").alias("block_id"), "chr", "position", "species")


def same_species(a: Column, b: Column) -> Column:
    """Whether two species of blocks are the same: name, position, strand and bases, whatever the chromosome."""
    same = F.lit(True)
    for f in ("name", "position", "strand", "seq"):
        same &= a[f].eqNullSafe(b[f])
    return same


def fill_species(blocks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every block with one sequence for each leaf in ``order``; a missing one is all gaps. Adds ``alignment``, an array of strings."""
    by = F.map_from_entries(F.transform("species", lambda s: F.struct(s["name"], s["seq"])))
    gaps = F.repeat(F.lit("-"), F.length(F.col("species")[0]["seq"]))
    return blocks.withColumn("_by", by).withColumn("alignment", F.array(*(F.coalesce(F.try_element_at("_by", F.lit(s)), gaps) for s in order))).drop("_by")


def reverse_complement(blocks: DataFrame, flip: bool = True) -> DataFrame:
    """Every sequence reversed and complemented; with ``flip`` the strands change too."""

    def one(s: Column) -> Column:
        s = s.withField("seq", F.reverse(F.translate(s["seq"], "ACGT", "TGCA")))
        return s.withField("strand", F.when(s["strand"] == "+", "-").otherwise("+")) if flip else s

    return blocks.withColumn("species", F.transform("species", one))


def reverse(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("species", F.transform("species", lambda s: s.withField("seq", F.reverse(s["seq"]))))
