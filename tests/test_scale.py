"""What lets operators grow: bands, bounds, sweeps and equality joins give what the plain rules give."""

import math
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import codes
from strandloom.functions import energy as E
from strandloom.operators import anomaly, folding, intervals, search, stitching
from strandloom.plans import catalog
from strandloom.sources import maf
from strandloom.streaming import maf_stream
from tests.walk import traverse as plain_walk

PAIRS = set(E.PAIRS)


def random_sequences(seed, sizes, letters="ACGU"):
    rng = np.random.default_rng(seed)
    return [(k, "".join(rng.choice(list(letters), n))) for k, n in enumerate(sizes)]


@pytest.mark.parametrize("lo,hi", [(0, 0), (3, 3), (3, 10), (2, 37), (3, 10**9)])
def test_banded_pairs_and_helices(spark, monkeypatch, lo, hi):
    rows = random_sequences(1, (1, 2, 40, 90, 131))
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    b = folding.bases(df)
    cells = folding.pair_join(b, b, lo=lo, hi=hi)
    want = sorted((s, i + 1, k + 1) for s, t in rows for i in range(len(t)) for k in range(len(t)) if lo <= k - i - 1 <= hi and t[i] + t[k] in PAIRS)
    assert sorted((r["key_a"], r["i"], r["k"]) for r in cells.select("key_a", "i", "k").collect()) == want
    found = sorted((r["key_a"], r["i"], r["k"], r["n_pairs"], round(r["energy"], 6)) for r in folding.helices(cells).collect())
    for size in (1 << 12, 7):
        monkeypatch.setattr(folding.diagonal_bands, "__defaults__", (size,))
        got = folding.helices_of(df, ["seq_id"], lo=lo, hi=hi, below=99.0).collect()
        assert sorted((r["seq_id"], r["i"], r["k"], r["n_pairs"], round(r["energy"], 6)) for r in got) == found


def test_all_sequences_against_all(spark):
    """200 sequences: the helices of every pair, and no pair without a stem."""
    rows = random_sequences(4, [int(n) for n in np.random.default_rng(4).integers(1, 40, 198)]) + [(500, "N" * 30), (501, "GGGGCCCCAUNGGGGCCCC")]
    code = {s: search.CODE[np.frombuffer(t.encode(), np.uint8)] for s, t in rows}
    df = spark.createDataFrame([*rows, (600, ""), (601, None)], "seq_id long, seq string")
    for below in (-6.0, -9.5):
        want, stems, k = set(), set(), folding.least_pairs(below)
        for x in range(len(rows)):
            for y in range(x + 1, len(rows)):
                a, b = rows[x][0], rows[y][0]
                found = [(a, b, int(i), int(k_), int(n), round(float(e), 6)) for part in folding._helix_rows(code[a], code[b], False, 3, 2000, 99.0) for i, k_, n, e in zip(*part, strict=True)]
                stems |= {(a, b) for f in found if f[4] >= k}
                want |= {f for f in found if f[5] < below}
        got = {(r["key_a"], r["key_b"], r["i"], r["k"], r["n_pairs"], round(r["energy"], 6)) for r in folding.fold_all(df, below).collect()}
        assert got == want and want
        assert {tuple(r)[:2] for r in folding.stem_pairs(df, below).collect()} == stems
        assert len(stems) < len(rows) * (len(rows) - 1) / 2
    assert folding.fold_all(df.limit(0), -6.0).count() == 0


def test_bands_of_a_long_sequence_are_short(spark):
    df = spark.createDataFrame([(1, "ACGU" * 50_000)], "seq_id long, seq string")
    r = folding.diagonal_bands(df, ["seq_id"], "seq", 100).agg(F.max(F.length("x")), F.sum(F.length("x")), F.count("*")).first()
    assert r[0] <= folding.DIAGONALS // 2 + 110 and r[1] <= 1.1 * 200_000 and r[2] == -(-399_999 // folding.DIAGONALS)


def test_bounded_search_equals_the_plain_walk_under_any_limit():
    """Stems on a random ground, so that limits far below the usual one still leave duplexes; with loops of each kind."""
    rng = np.random.default_rng(11)
    seen = 0
    for n in range(12):
        stem = "".join(rng.choice(list("ACGU"), 14))
        back = list(stem[::-1].translate(str.maketrans("ACGU", "UGCA")))
        at = int(rng.integers(3, 10))
        back[at : at + n % 3] = rng.choice(list("ACGU"), (n // 3) % 4)
        s = "".join(rng.choice(list("ACGU"), 20)) + stem + "".join(rng.choice(list("ACGU"), 9)) + "".join(back) + "".join(rng.choice(list("ACGU"), 12))
        for minfold in (-3.0, -8.0, -12.0, -15.5):
            o = folding.FoldOptions(20, 3, 2000, n % 4, (n + 1) % 4, minfold)
            want = plain_walk(s, o)
            got = folding.traverse(s, o)
            assert sorted(got) == sorted(want)
            seen += len(got) * (minfold < -10)
    assert seen > 50


def test_bound_is_never_above_what_is_found():
    """Of every duplex found: the bound at its outer pair is at most its energy."""
    s = random_sequences(3, (70,))[0][1]
    o = folding.FoldOptions(20, 3, 2000, 3, 3, 4.0)
    code = search.CODE[np.frombuffer(s.encode(), np.uint8)]
    tile = search.Tile(code, code[::-1], len(s), len(s), 0, len(s) - 1, o, True, E.Loops())
    first = {}
    for i, k, _, _, e in folding.traverse(s, o):
        first[i, k] = min(e, first.get((i, k), 99.0))
    assert len(first) > 100
    for (i, k), e in first.items():
        a, c = i - 1, len(s) - k
        assert search.ENDS[tile.pair[a, c]] + tile.reach[2][a, c] + E.INITIATION <= e + search.SLACK


def maximal(found, s, o):
    """Of all duplexes those that no pair goes on from."""
    pairs = lambda i, k: 1 <= min(i, k) and max(i, k) <= len(s) and s[i - 1] + s[k - 1] in PAIRS
    out = []
    for i, k, l, r, e in found:  # noqa: E741
        n, m = len(l.replace("-", "")), len(r.replace("-", ""))
        more = pairs(i + n, k - m) and n < o.depth and m < o.depth and k - m - i - 1 >= o.lo
        if not pairs(i - 1, k + 1) and not more:
            out.append((i, k, l, r, e))
    return out


def test_maximal_duplexes(spark):
    """Those of all duplexes that no pair goes on from, in one tile and over the edges of many; few where bases repeat."""
    rows = random_sequences(9, (30, 75, 140)) + [(7, "GGGACGUAGCAAAAGCUACGUCCC" * 4), (8, "AU" * 60)]
    o = folding.FoldOptions(12, 3, 60, 2, 2, -2.0)
    want = sorted((s, *d) for s, t in rows for d in maximal(folding.traverse(t, o), t, o))
    short = replace(o, maximal=True)
    assert sorted((s, *d) for s, t in rows for d in folding.traverse(t, short)) == want and len(want) > 100
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    for size in (12, 31, 256):
        got = folding.fold(df, short, size=size).collect()
        assert sorted((r["seq_id"], r["i"], r["k"], r["l"], r["r"], r["energy"]) for r in got) == want
    count = lambda x: len(folding.traverse("AU" * 60, x))
    assert count(short) * 10 < count(o)


def test_intervals_of_all_lengths(spark, monkeypatch):
    """Against every pair; a very long interval is a few rows, and cells into which many look are salted."""
    rng = np.random.default_rng(6)
    mk = lambda n: [(i, f"c{rng.integers(2)}", int(x := rng.integers(-50, 5000)), int(x + rng.choice([-3, 0, 1, 30, 200, 3000, 10**9]))) for i in range(n)]
    a, b = mk(150), mk(120)
    x, y = (spark.createDataFrame(r, "id long, seqname string, first long, last long") for r in (a, b))
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    for hot in (intervals.HOT, 5):
        monkeypatch.setattr(intervals, "HOT", hot)
        assert sorted((r["id"], r["b_id"]) for r in intervals.overlap_join(x, y, 16).collect()) == want
        assert sorted(r["id"] for r in intervals.overlaps(x, [y], "id", 16).collect()) == sorted({p for p, _ in want})
    one = spark.createDataFrame([(1, "c0", 5, 10**9)], "id long, seqname string, first long, last long")
    for p, q in ((one, y), (y, one)):
        q = q.select(*(F.col(c).alias(f"b_{c}") for c in q.columns))
        for left, right, _ in intervals._meetings(p, q, 16, "seqname", "first", "last"):
            assert left.filter("id = 1 and last = 1000000000").count() <= 3 * 31 and right.filter("b_id = 1 and b_last = 1000000000").count() <= 3 * 31
    assert intervals.overlap_join(x, y.limit(0)).count() == 0 == intervals.overlap_join(x.limit(0), y).count()
    assert intervals.overlaps(x, [y, y.limit(0)], "id").count() == 0


def test_error_function(spark):
    x = [k / 37 for k in range(-300, 301)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", anomaly.erf(F.col("x")).alias("y")).collect()
    assert max(abs(r["y"] - math.erf(r["x"])) for r in got) < 1.5e-7


def test_packed_elements_and_the_order_of_a_collection(spark):
    rows = [(a, b) for a in "ACGU-" for b in "ACGU-"]
    df = spark.createDataFrame(rows, "l string, r string").withColumn("code", codes.packed(F.col("l"), F.col("r")))
    back = codes.unpacked(F.col("code"))
    got = df.select("l", "r", "code", back[0].alias("a"), back[1].alias("b")).collect()
    assert all((r["l"], r["r"]) == (r["a"], r["b"]) for r in got) and len({r["code"] for r in got}) == 25
    assert {(r["l"], r["r"]): r["code"] for r in got}["A", "U"] == 0x18 and {(r["l"], r["r"]): r["code"] for r in got}["-", "G"] == 4
    rng = np.random.default_rng(1)
    some = [(f"k{i}", f"c{i % 2}", int(a := rng.integers(0, 9)), int(a + rng.integers(0, 3)), int(b := a + 60 + rng.integers(0, 3)), int(b + rng.integers(0, 3)), -9.0) for i in range(90)]
    out = intervals.collect(spark.createDataFrame(some, COLS).repartition(4).withColumn("n_pairs", F.lit(9)), 5, -5.0).collect()
    order = [(r["seqname"], r["f_first"] // 50, r["f_first"], r["f_last"], r["l_first"], r["l_last"]) for r in out]
    assert len(order) == 90 and order == sorted(order)


def dominated(rows, identity, same_bin):
    over = lambda a, b, f, l: (min(a[l], b[l]) - max(a[f], b[f]) + 1) / min(a[l] - a[f] + 1, b[l] - b[f] + 1) >= identity  # noqa: E731, E741
    out = set()
    for a in rows:
        for b in rows:
            if b[1] == a[1] and (b[6], b[0]) < (a[6], a[0]) and (not same_bin or a[2] // 50 == b[2] // 50) and over(a, b, 2, 3) and over(a, b, 4, 5):
                out.add(a[0])
                break
    return out


COLS = "key string, seqname string, f_first long, f_last long, l_first long, l_last long, energy double"


@pytest.mark.parametrize("most", [1 << 13, 6])
def test_sweep_equals_the_rule(spark, most):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        f, n, g = int(rng.integers(0, 260)), int(rng.choice([4, 9, 20, 90])), int(rng.integers(0, 60))
        rows.append((f"k{i:03d}", f"c{i % 2}", f, f + n + int(rng.integers(3)), f + 100 + g, f + 100 + g + n, -float(rng.integers(0, 12))))
    rows += [(f"x{i:03d}", *rows[i][1:6], rows[i][6] + (i % 2)) for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, COLS).repartition(3)
    for everywhere in (False, True):
        lost = dominated(rows, 0.8, not everywhere)
        got = intervals.undominated(df, "key", 0.8, everywhere=everywhere, most=most)
        assert sorted(r["key"] for r in got.collect()) == sorted(r[0] for r in rows if r[0] not in lost)
        assert lost and len(lost) < len(rows)


def test_sweep_of_a_hot_bin_makes_no_pairs(spark):
    """A bin of 100 000 equal arms, and one of as many arms that mostly overlap."""
    n = F.col("id")
    equal = spark.range(100_000).select(n.cast("string").alias("key"), F.lit("s").alias("seqname"), F.lit(5).cast("long").alias("f_first"), F.lit(40).cast("long").alias("f_last"), F.lit(90).cast("long").alias("l_first"), F.lit(120).cast("long").alias("l_last"), (-(n % 977)).cast("double").alias("energy"))
    got = intervals.undominated(equal, "key", 0.9).collect()
    assert [(r["energy"], r["key"]) for r in got] == [(-976.0, min(str(k) for k in range(976, 100_000, 977)))]
    n = F.col("key").cast("long")
    near = equal.withColumns({"f_first": n % 40, "f_last": n % 40 + 60 + n % 7, "l_first": 200 + n % 97, "l_last": 700 + n % 89})
    assert 0 < intervals.undominated(near, "key", 0.9).count() < 100


def test_stitching_equals_all_pairs(spark):
    """Against joining every two duplexes of a bin by themselves."""
    seqs = [(1, "AAATGATGCCGCAGGGGGGGGGGTGCGGCAATCATTT".replace("T", "U")), (2, "GGGACGUAGCAAAAGCUACGUCCC"), (3, "GGGACGAUAGCAAAAAGCUACUGUCCC")]
    df = folding.arms(folding.fold(spark.createDataFrame(seqs, "seq_id long, seq string"), folding.FoldOptions(8, 3, 2000, 2, 2, -1.0))).withColumn("strand", F.lit("+"))
    names = [c.split()[0] for c in stitching.COLS.split(", ")]
    df = df.select(*names).cache()
    rows = df.collect()
    for neighbours in (False, True):
        want = set()
        for a in rows:
            for b in rows:
                here = b["f_first"] // 10 - a["f_first"] // 10
                arms = lambda x: tuple(x[2:6])
                apart = b["f_first"] > a["f_last"] or a["f_first"] > b["f_last"] or b["l_first"] > a["l_last"] or a["l_first"] > b["l_last"]
                if a["seqname"] == b["seqname"] and (here == 0 or neighbours and here == 1) and arms(a) < arms(b) and not apart and (got := stitching.join_paths(a, b, 3, 3)):
                    want.add((a["seqname"], "+", a["f_first"], b["f_last"], b["l_first"], a["l_last"], *got))
        out = [tuple(r) for r in stitching.stitch_pairs(df, size=10, neighbours=neighbours).collect()]
        assert len(out) == len(set(out)) and set(out) == want and len(want) > 20
    assert stitching.stitch_pairs(df.limit(0)).count() == 0


TEXT = """##maf version=1
# one

a score=3.5
s hg.chr1 10 4 + 99 AC-GT
s mm.chr2 11 5 - 99 ACAGT

 a score=1
 s hg.chr1 14 3 + 99 GGG
# inside
s rn.chr5 14 3 + 99 GGC

a score=2
i mm.chr2 N 0 C 0
s hg.chr1 40 3 + 99 GGG

a score=x
s hg.chr1 50 3 + 99 GGG

a score=7
s hg.chr1 60 2 + 99 GN
"""


def test_line_ends_and_blank_lines(spark, tmp_path):
    forms = {"lf": TEXT, "crlf": TEXT.replace("\n", "\r\n"), "spaced": TEXT.replace("\n\n", "\n \t\n"), "more": TEXT.replace("\n\n", "\n\n\n"), "bare": TEXT.split("\n", 3)[3]}
    for name, text in forms.items():
        (tmp_path / name).write_bytes(text.encode())
        blocks = maf.read_text(spark, str(tmp_path / name))
        got = sorted((r["score"], [(s["name"], s["chr"], s["position"], s["strand"], s["seq"]) for s in r["species"]], r["block_id"]) for r in maf.parse(blocks).collect())
        assert [g[0] for g in got] == [1.0, 3.5, 7.0], name
        assert got[1][1] == [("hg", "chr1", 10, "+", "AC-GT"), ("mm", "chr2", 11, "-", "ACAGT")] and got[0][1][1] == ("rn", "chr5", 14, "+", "GGC")
        assert {r["reason"]: r["n"] for r in maf.rejected(blocks).collect()} == {"another kind of line": 1, "no score": 1}
        if name == "lf":
            first = got
        assert got == first or name == "more"
    # split at any byte
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        many = maf.read_text(spark, str(tmp_path / "lf"))
        assert many.rdd.getNumPartitions() > 3 and maf.parse(many).count() == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_other_chromosomes_are_not_opened(spark, tmp_path):
    import gzip

    block = "a score=1\ns hg.{0} 1 4 + 9 ACGT\n\n"
    for c in ("chr1", "chr10", "chr2", "chrX"):
        (tmp_path / f"{c}.maf").write_text(block.format(c))
    (tmp_path / "chr3.maf.gz").write_bytes(gzip.compress(block.format("chr3").encode()))
    (tmp_path / "chr9.maf").symlink_to("/nowhere")
    got = maf.read_text(spark, str(tmp_path), ["chr1", "chr3", "chrX", "chr77"])
    assert sorted(f.rsplit("/", 1)[1] for f in got.inputFiles()) == ["chr1.maf", "chr3.maf.gz", "chrX.maf"]
    assert {r["species"][0]["chr"] for r in maf.parse(got).collect()} == {"chr1", "chr3", "chrX"}
    assert maf.read_text(spark, str(tmp_path), []).count() == 0


def test_alignments_are_parsed_once(spark, small):
    for name in ("phylo_score", "covariance", "maf_merge", "duplex_alignment"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract") <= 1 and plan.count("RLIKE") <= 3, name


def test_blocks_are_joined_in_a_stream(spark, tmp_path):
    """Files of shuffled blocks, one a trigger: all that a batch joins, most of it before the end; late blocks are not lost."""
    rng = np.random.default_rng(8)
    blocks, at = [], {"chr1": 0, "chr2": 500}
    for k in range(60):
        c = f"chr{1 + k % 2}"
        at[c] += int(rng.choice([0, 0, 0, 7]))
        n = int(rng.integers(8, 15))
        seq = "".join(rng.choice(list("ACGT"), n))
        lines = [f"a score={k}", f"s a.{c} {at[c]} {n} + 9999 {seq}"] + [f"s {x}.q {k} {n} {'+-'[k % 2]} 99 {seq[::-1]}" for x in "bc" if rng.random() < 0.7]
        blocks.append("\n".join(lines) + "\n")
        at[c] += n
    batch = tmp_path / "all.maf"
    batch.write_text("\n".join(blocks))
    parsed = maf.without_reference_gaps(maf.parse(maf.read_text(spark, str(batch))))
    rows = lambda df: sorted((r["chr"], r["position"], [tuple(s) for s in r["species"]]) for r in df.collect())
    want = rows(maf.merge_adjacent(parsed, ("a", "b", "c")))
    # shuffled within a short distance
    order = np.argsort(np.arange(60) + rng.uniform(0, 9, 60))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate(np.array_split(order, 6)):
        (folder / f"{k}.maf").write_text("\n".join(blocks[i] for i in part))
    stream = maf_stream.stream_merged(maf_stream.stream_blocks(spark, str(folder), files_a_trigger=1), ("a", "b", "c"), slack=200, quiet_ms=6000)
    query = stream.writeStream.format("memory").queryName("joined").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        early = None
        for _ in range(120):
            time.sleep(1)
            n = spark.table("joined").count()
            early = n if n and early is None else early
            if n >= len(want):
                break
        assert rows(spark.table("joined")) == want and 0 < early < len(want)
    finally:
        query.stop()
