import gzip
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import codes
from strandloom.functions import energy as E
from strandloom.operators import anomaly, folding, intervals, phylogeny, search, stitching
from strandloom.plans import pipeline
from strandloom.sources import maf, newick, regions
from strandloom.streaming import maf_stream
from tests.walk import traverse as plain_walk

GOLDEN = [("GCACG", "CGUGC", -6.01), ("AGCGCU", "UCGCGA", -7.98), ("CAGACG", "GUAGGC", -1.51), ("CAG----CG", "GUGAAAGGC", 4.69), ("CAGA-CG", "GUGAGGC", 0.89), ("GCCCG", "CGG-C", -2.7867), ("GAACAG", "CU---C", 5.34)]
SEQ = "AAATGATGCCGCAGGGGGGGGGGTGCGGCAATCATTT".replace("T", "U")


@pytest.mark.parametrize("l,r,want", GOLDEN)
def test_energies(l, r, want):  # noqa: E741
    assert E.path_energy(l, r) == pytest.approx(want, abs=1e-9)


def test_loops_and_symmetry(tmp_path):
    t = E.Loops()
    assert (t.one_by_one("AU", "AA", "AU"), t.one_by_one("UG", "UU", "UG")) == (1.9, 1.6)
    for path in (("AA-A", "UAAU"), ("A-AA", "UAAU"), ("AAAA", "UA-U"), ("AAAA", "U-AU")):
        assert E.loop(list(zip(*path, strict=True)), 0, 3, t) == 3.7
    assert t.one_by_two("UG", "UU", "U", "UG") == 3.0 and t.two_by_two("AU", "AA", "AA", "AU") == 2.8 and t.two_by_two("UG", "UU", "UU", "UG") == 3.1
    assert E.symmetry("AUCG", "UAGC") == 0 and E.symmetry("ACGU", "UGCA") == E.symmetry("ACGGU", "UGUCA") == 0.43
    assert len(E.BULGE_INITIATION) == len(E.LOOP_INITIATION) == 30 and sum(map(len, E.STACK.values())) == 36
    (tmp_path / "t.json").write_text('{"AU.AA.AU": 9.5}')
    assert E.Loops.from_json(str(tmp_path / "t.json")).one_by_one("AU", "AA", "AU") == 9.5
    assert E.path_energy("", "") == 0


def test_loop_tables():
    """Every cell: its number, the symmetry of a loop read from its other end, signs; and rows of the published tables."""
    t, rows = E.Loops(), E.small_loops()
    by = {r[:4]: r[4] for r in rows}
    assert len(by) == len(rows) == 36 * (10 + 2 * 26 + 100)
    assert all(by[q[::-1], three, five, p[::-1]] == pytest.approx(e) for (p, five, three, q), e in by.items())
    assert all(-3 < e < 4.5 and round(e, 1) == e for e in by.values()) and sum(by.values()) > 0
    two = lambda p, q, m: [t.two_by_two(p, m, n, q) for n in E.MISMATCHES]
    assert two("AU", "AU", "AG") == [2.2, 1.8, 1.2, 2.2, 2.8, 2.8, 1.3, 2.0, 2.5, 1.4]
    assert two("AU", "CG", "GA") == [0.9, 0.6, -1.1, 0.6, 1.2, 1.2, -0.5, 0.5, 1.3, -0.1]
    assert two("CG", "UA", "GG") == [0.5, 0.2, 0.5, 0.3, 0.3, 0.3, 1.2, 1.3, 0.3, 0.7]
    assert two("GC", "UG", "UU") == [2.4, 1.4, 0.6, 1.4, 1.4, 1.4, 1.0, 1.4, 1.4, 1.4]
    assert two("GU", "GU", "AA") == [3.6, 3.4, 2.2, 3.4, 3.4, 3.4, 3.7, 2.1, 3.4, 4.0]
    assert two("CG", "CG", "UC") == [1.4, 1.2, 0.0, 1.1, 1.2, 1.2, 0.5, -0.6, 1.2, 0.4]
    one = lambda p, q: [t.one_by_one(p, m, q) for m in E.MISMATCHES]
    assert one("GU", "CG") == [1.9, 1.2, 1.2, 1.2, 1.2, 1.2, 1.5, -1.4, 1.2, 1.5] and one("UG", "UA") == [1.9] * 7 + [-0.7, 1.9, 1.6]
    assert one("GC", "GC") == [0.9, 0.3, -0.1, -0.4, 0.5, 0.0, 0.5, -2.2, 0.6, -0.1]
    three = lambda p, q, c: [t.one_by_two(p, m, c, q) for m in ("AA", "AG", "CC", "GA", "GC", "GG", "UC", "UU")]
    assert three("AU", "AU", "A") == [3.7, 3.7, 3.7, 2.6, 2.6, 2.6, 3.7, 3.0] and three("CG", "CG", "C") == [2.3, 1.1, 2.5, 1.1, 2.3, 1.1, 2.2, 1.5]
    assert three("GU", "GC", "U") == [3.0, 3.0, 1.9, 1.9, 3.0, 1.9, 2.2, 2.2] and three("UA", "UG", "G") == [2.6, 2.6, 3.7, 2.6, 2.6, 2.6, 3.7, 3.0]


def test_symmetric_helices_have_their_penalty(spark):
    s = spark.createDataFrame([(1, "GCGCAAAAGCGC"), (2, "GGGGAAAACCCC")], "seq_id long, seq string")
    b = folding.bases(s)
    want = {1: E.path_energy("GCGC", "CGCG"), 2: E.path_energy("GGGG", "CCCC")}
    for found, key in ((folding.helices(folding.pair_join(b, b)), "key_a"), (folding.helices_of(s, ["seq_id"], below=9.9), "seq_id")):
        got = {r[key]: r["energy"] for r in found.filter("n_pairs = 4").collect()}
        assert got == {k: pytest.approx(e, abs=1e-3) for k, e in want.items()}


def test_bulge_states_at_the_end_of_a_path():
    e = E.bulge([("G", "C"), ("C", "G"), ("C", "-"), ("C", "G")], 1, 3)
    assert e == pytest.approx(3.8 - 3.3 - 0.9 - 0.616 * math.log(3))


def test_native_helix_energy_equals_the_path_energy(spark):
    rows = [(l, r) for l, r, _ in GOLDEN[:2]] + [("G", "C"), ("GU", "UG"), ("AAAA", "UUUU")]  # noqa: E741
    got = spark.createDataFrame(rows, "l string, r string").select("l", "r", E.helix_energy(F.col("l"), F.col("r")).alias("e")).collect()
    assert all(r["e"] == pytest.approx(E.path_energy(r["l"], r["r"]), abs=1e-3) for r in got)


def test_fold_goldens():
    fold = lambda **o: list(folding.traverse(SEQ, folding.FoldOptions(**o)))
    base = {"depth": 25, "lo": 10, "hi": 50, "mismatch_max": 0}
    assert not [d for d in fold(**base, bulge_max=0) if d[4] <= -15]
    found = fold(**base, bulge_max=1)
    best = min(found, key=lambda d: d[4])
    assert best == (1, 37, "AAAUGAU-GCCGCA", "UUUACUAACGGCGU", -16.837)
    for i, k, l, r, e in found + fold(depth=12, bulge_max=2, mismatch_max=2, minfold=-3.0):  # noqa: E741
        al, ar = l.replace("-", ""), r.replace("-", "")
        assert SEQ[i - 1 : i - 1 + len(al)] == al and SEQ[k - len(ar) : k][::-1] == ar
        assert e == E.path_energy(l, r)
    short = fold(depth=10, lo=1, hi=10**9, bulge_max=1, mismatch_max=0, minfold=-6.0)
    assert {d[0] for d in short} >= {1, 2, 3, 4, 5}


def test_fold_and_stitch_counts(spark):
    """Undominated duplexes of the golden sequence by count and place: none, one, five that stitch into one."""
    seqs = spark.createDataFrame([(1, SEQ)], "seq_id long, seq string")

    def best(d):
        d = d.withColumns({"key": F.concat_ws("|", "f_first", "l_last", "l", "r"), "n_pairs": codes.count_kind(F.col("l"), F.col("r"), "pair")})
        return intervals.undominated(d, "key")

    def fold(depth, bulges, lo, hi, minfold):
        return best(folding.arms(folding.fold(seqs, folding.FoldOptions(depth, lo, hi, bulges, 0, minfold))).withColumn("strand", F.lit("+")))

    place = lambda d: [tuple(r) for r in d.select("f_first", "f_last", "l_first", "l_last").orderBy("f_first").collect()]
    assert place(fold(25, 0, 10, 50, -15.0)) == []
    assert place(fold(25, 1, 10, 50, -15.0)) == [(1, 13, 24, len(SEQ))]
    five = fold(10, 1, 3, 10**9, -6.0)
    assert [p[0] for p in place(five)] == [1, 2, 3, 4, 5]
    assert place(best(stitching.stitch_all(five))) == [(1, 13, 24, len(SEQ))]


def _odd_sequences():
    rng = np.random.default_rng(5)
    for n, letters in ((1, "ACGU"), (2, "GC"), (30, "ACGU"), (45, "ACGUN"), (40, "GU"), (60, "ACGU")):
        s = "".join(rng.choice(list(letters), n))
        yield s
        yield s + "GGGGC" + s[::-1].translate(str.maketrans("ACGU", "UGCA"))


def test_search_equals_the_plain_walk():
    """Texts, places and energies of all duplexes, over options, with odd letters, and between two sequences."""
    whole = 0
    for n, s in enumerate(_odd_sequences()):
        for depth, lo, hi, bulges, mismatches, minfold in ((50, 3, 2000, 3, 3, -1.0), (6, -(10**6), 20, 1, 3, 2.0), (12, 0, 10**9, 2, 0, 0.0), (20, 8, 30, 0, 2, -2.0)):
            if len(s) > 60 and minfold >= 0:
                continue
            o = folding.FoldOptions(depth, lo, hi, bulges, mismatches, minfold)
            other = "GGACGUUACGNNACCUUGC" if n % 3 == 0 else None
            got, want = sorted(folding.traverse(s, o, other)), sorted(plain_walk(s, o, other))
            assert [d[:4] for d in got] == [d[:4] for d in want]
            assert [d[4] for d in got] == pytest.approx([d[4] for d in want], abs=2e-4)
            whole += len(got)
    assert whole > 1000


def test_tiles_equal_whole_sequences(spark):
    """Tiles far smaller than the sequences, odd rows, repeats, clashing columns, two sequences."""
    rows = [(n, s, s[::-1] or None, "x", "y") for n, s in enumerate([*_odd_sequences(), "", SEQ, SEQ, SEQ * 4])] + [(99, None, SEQ, "x", "y"), (98, SEQ, None, "x", "y")]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string, other string, l string, ti string")
    o = folding.FoldOptions(depth=12, hi=60, bulge_max=2, mismatch_max=2, minfold=-3.0)
    for other in (None, "other"):
        got = sorted(tuple(r) for r in folding.fold(seqs, o, other=other, size=16).collect())
        want = sorted((n, *d) for n, s, t, _, _ in rows if s and (t or other is None) for d in folding.traverse(s, o, t if other else None))
        assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) > 100
        assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=2e-4)
    assert folding.fold(seqs.limit(0), o).count() == 0


def test_search_in_parts(monkeypatch):
    whole = sorted(folding.traverse(SEQ, folding.FoldOptions(minfold=0.0)))
    monkeypatch.setattr(search, "PART", 7)
    monkeypatch.setattr(search, "FLUSH", 11)
    assert sorted(folding.traverse(SEQ, folding.FoldOptions(minfold=0.0))) == whole


def test_kernel_and_windows_agree(spark):
    """Gap-free: the helices of the DataFrame path are the kernel's maximal ones."""
    seqs = spark.createDataFrame([(1, SEQ), (2, "GGGAAAACCCUUUGGG"), (3, None), (4, "")], "seq_id long, seq string")
    b = folding.bases(seqs.filter("seq is not null"))
    native = {(r["key_a"], r["i"], r["k"], r["n_pairs"]): r["energy"] for r in folding.helices(folding.pair_join(b, b)).filter("energy < 0").collect()}
    kernel = folding.fold(seqs, folding.FoldOptions(bulge_max=0, mismatch_max=0, minfold=0.0, lo=-(10**6)))
    by = {(r["seq_id"], r["i"], r["k"], len(r["l"])): r["energy"] for r in kernel.collect()}
    checked = 0
    for key, e in native.items():
        if key in by:
            checked += 1
            assert by[key] == pytest.approx(e, abs=1e-3)
    assert checked >= 3


def test_stitch_goldens(spark):
    whole_l, whole_r = "GCACGAUCCG", "CGUGCUAGGC"
    mk = lambda l, r, f, k: ("s", "+", f, f + len(l) - 1, k - len(r) + 1, k, l, r, E.path_energy(l, r))
    df = spark.createDataFrame([mk(whole_l[:7], whole_r[:7], 1, 60), mk(whole_l[3:], whole_r[3:], 4, 57)], stitching.COLS)
    for d in (df, df.orderBy(F.desc("f_first"))):
        out = stitching.stitch_pairs(d).collect()
        assert [(r["l"], r["r"], r["f_first"], r["l_last"]) for r in out] == [(whole_l, whole_r, 1, 60)]
        assert out[0]["energy"] == E.path_energy(whole_l, whole_r)
    assert stitching.stitch_all(df).count() == 3
    a = SimpleNamespace(f_first=1, f_last=4, l_first=20, l_last=23, l="GCAC", r="CGUG", energy=-1.0)
    b = SimpleNamespace(f_first=3, f_last=6, l_first=18, l_last=21, l="GGAC", r="CCUG", energy=-1.0)
    assert stitching.join_paths(a, b, 3, 3) is None
    assert stitching.consumed("AC-G", "UGAC", 2, 3) == 3 and stitching.consumed("A-", "UA", 1, 1) == 1


def _duplex(key, f, l, e, name="c"):  # noqa: E741
    return (key, name, f[0], f[1], l[0], l[1], e)


def test_dominance(spark):
    cols = "key string, seqname string, f_first long, f_last long, l_first long, l_last long, energy double"
    rows = [_duplex("a", (100, 120), (200, 220), -5.0), _duplex("b", (100, 120), (200, 220), -9.0), _duplex("c", (300, 310), (400, 410), -1.0), _duplex("d", (100, 120), (200, 220), -9.0), _duplex("e", (100, 120), (200, 220), -9.5, "other")]
    df = spark.createDataFrame(rows, cols)
    assert {r["key"] for r in intervals.undominated(df, "key").collect()} == {"b", "c", "e"}
    far = spark.createDataFrame([_duplex("x", (49, 148), (300, 399), -5.0), _duplex("y", (50, 149), (300, 399), -7.0)], cols)
    assert intervals.undominated(far, "key", 0.98).count() == 2
    assert {r["key"] for r in intervals.undominated(far, "key", 0.98, everywhere=True).collect()} == {"y"}
    assert intervals.undominated(df.limit(0), "key").count() == 0


def test_overlap_join_is_exact(spark):
    rng = np.random.default_rng(0)
    mk = lambda n: [(i, f"c{rng.integers(2)}", int(x := rng.integers(1, 400)), int(x + rng.integers(0, 90))) for i in range(n)]
    a, b = mk(80), mk(60)
    x, y = (spark.createDataFrame(r, "id long, seqname string, first long, last long") for r in (a, b))
    got = sorted((r["id"], r["b_id"]) for r in intervals.overlap_join(x, y, 32).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert got == want
    assert {r["id"] for r in intervals.overlaps(x, [y], "id", 32).collect()} == {p for p, _ in want}


MAF = """##maf version=1
# a comment

a score=10.0
s hg.chr1 100 6 + 1000 ACG-TAC
s mm.chr2 50 7 + 1000 ACGTTAC

a score=5
s hg.chr1 106 5 + 1000 GGGTT
s rn.chr3 7 5 + 1000 GGCTT

a score=7
s hg.chr1 300 4 + 1000 acgt
s mm.chr2 90 4 - 1000 ACGN

a score=oops
s hg.chr1 400 4 + 1000 ACGT

a score=3
s hg.chr1 500 4 + 1000 ACGT
i mm.chr2 N 0 C 0
"""


def test_maf(spark, tmp_path, monkeypatch):
    (tmp_path / "x.maf").write_text(MAF)
    with gzip.open(tmp_path / "y.maf.gz", "wt") as f:
        f.write(MAF)
    for name in ("x.maf", "y.maf.gz"):
        blocks = maf.parse(maf.read_text(spark, str(tmp_path / name)))
        rows = {r["species"][0]["position"]: r for r in blocks.collect()}
        assert set(rows) == {100, 106, 300} and rows[300]["species"][0]["seq"] == "ACGT" and rows[300]["species"][1]["strand"] == "-"
    assert {r["species"][0]["position"] for r in maf.parse(maf.read_text(spark, str(tmp_path / "x.maf")), 5, 6).collect()} == {100}
    cut = maf.without_reference_gaps(blocks)
    assert [s["seq"] for s in cut.filter("score = 10").first()["species"]] == ["ACGTAC", "ACGTAC"]
    out = maf.merge_adjacent(cut, ["hg", "mm", "rn"], minspecies=2, minlength=3).orderBy("position").collect()
    assert [(r["position"], [(s["name"], s["seq"]) for s in r["species"]]) for r in out] == [
        (100, [("hg", "ACGTACGGGTT"), ("mm", "ACGTAC-----"), ("rn", "------GGCTT")]), (300, [("hg", "ACGT"), ("mm", "ACGN")]),
    ]
    # a block that comes twice counts once; islands go over the edges of stretches
    twice = maf.merge_adjacent(cut.unionByName(cut), ["hg", "mm", "rn"], minspecies=2, minlength=3)
    assert sorted((r["position"], r["species"][0]["seq"]) for r in twice.collect()) == [(100, "ACGTACGGGTT"), (300, "ACGT")]
    chain = [(k, "c", 7 * k + 100 * (k >= 30), 7) for k in range(60)] + [(99, "d", 7, 7)]
    for span in (1, 5, 50, 1 << 20):
        monkeypatch.setattr(maf, "SPAN", span)
        got = {r["block_id"]: r["island"]["position"] for r in maf._islands(spark.createDataFrame(chain, "block_id long, chr string, position long, n long")).collect()}
        assert got == {k: 7 if k == 99 else 0 if k < 30 else 310 for k, *_ in chain}
    filled = maf.fill_species(cut, ["hg", "mm", "rn"]).filter("score = 7").first()
    assert filled["alignment"] == ["ACGT", "ACGN", "----"]
    turned = maf.reverse_complement(cut).filter("score = 5").first()["species"]
    assert [(s["seq"], s["strand"]) for s in turned] == [("AACCC", "-"), ("AAGCC", "-")]
    stream = maf_stream.stream_blocks(spark, str(tmp_path / "*.maf"))
    q = stream.writeStream.format("memory").queryName("blocks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("blocks").count() == 3


def test_regions(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr15\t42192010\t42192020\t.\t0\t-\n")
    (tmp_path / "a.bedGraph").write_text("#x\nchr1 9 20 0.5\n")
    r = regions.load_bed(spark, str(tmp_path / "a.bed"), 5, 7).first()
    assert (r["seqname"], r["first"], r["last"], r["name"], r["strand"]) == ("chr15", 42192006, 42192027, ".", "-")
    g = regions.load_bedgraph(spark, str(tmp_path / "a.bedGraph")).first()
    assert (g["first"], g["last"], g["strand"], g["score"]) == (10, 20, "?", 0.5)
    d = spark.createDataFrame([("chr1", "+", 11, 20, 40, 49, -12.5), ("chr1", "-", 1, 2, 900_000, 900_001, -1.0)], "seqname string, strand string, f_first long, f_last long, l_first long, l_last long, energy double")
    lines = [r["line"].split("\t") for r in regions.bed12(d, "x").collect()]
    assert len(lines) == 1 and lines[0][:4] == ["chr1", "10", "49", "x"] and lines[0][4] == "1000.00" and lines[0][9:] == ["2", "10,10", "0,29"]
    row = spark.createDataFrame([(1.0, 2.0, -3.0, 4.0, 5.0, 6.0)], regions.FEATURES)
    regions.save_features(row, str(tmp_path / "f"))
    assert regions.load_features(spark, str(tmp_path / "f")).collect() == row.collect()


def test_newick_and_likelihoods():
    t = newick.parse("(((((hg19:0.006591,panTro2:0.006639):0.002184,gorGor1:0.009411):0.009942,ponAbe2:0.018342):0.014256,rheMac2:0.036199):0.021496,papHam1:0.04);")
    assert t.leaves() == ["hg19", "panTro2", "gorGor1", "ponAbe2", "rheMac2", "papHam1"]
    assert newick.parse("(a,b,c);").leaves() == ["a", "b"] and newick.parse("(a,b:1);").children[0].length == -1
    assert [r[1:3] for r in newick.parse("((a:1,b:2):3,c:4);").rows()] == [(-1, -1), (0, 0), (1, 0), (1, 1), (0, 1)]
    with pytest.raises(ValueError):
        newick.parse("((a,b);")
    q = phylogeny.SINGLE_Q
    assert np.allclose(phylogeny.expm(q * 0.002184) @ ((phylogeny.expm(q * 0.006591) @ [0, 0, 1, 0]) * (phylogeny.expm(q * 0.006639) @ [0, 0, 1, 0])), [0.004256, 0.001238, 0.966317, 0.001025], atol=1e-6)
    t = phylogeny.with_probabilities(newick.parse("((hg19:0.006591,panTro2:0.006639):0.002184,gorGor1:0.5);"), q)
    col = np.array([[2, 2, 0]])
    assert phylogeny.likelihoods(t, col, phylogeny.SINGLE_PI)[0] == pytest.approx(0.053863, abs=1e-6)
    assert phylogeny.likelihoods(t, col, phylogeny.SINGLE_PI, pruning="standard")[0] == pytest.approx(0.054513, abs=1e-6)
    assert phylogeny.likelihoods(t, np.array([[-1, -1, -1]]), phylogeny.SINGLE_PI, gapdenom=2.0)[0] > 0
    text = "((hg19:0.006591,panTro2:0.006639):0.002184,gorGor1:0.15);"
    one, two = phylogeny.with_probabilities(newick.parse(text), q), phylogeny.with_probabilities(newick.parse(text), phylogeny.paired_q())
    ggg = np.array([[2, 2, 2]])
    for last, s, p in (([1, 1, 2], 0.00046833, 0.0032272), ([1, 1, 3], 0.0084378, 0.0074917)):
        last = np.array([last])
        single = phylogeny.likelihoods(one, ggg, phylogeny.SINGLE_PI)[0] * phylogeny.likelihoods(one, last, phylogeny.SINGLE_PI)[0]
        paired = phylogeny.likelihoods(two, 4 * ggg + last, phylogeny.PAIRED_PI)[0]
        assert (single, paired) == (pytest.approx(p, rel=1e-4), pytest.approx(s, rel=1e-4))
    assert newick.parse(text).scaled(2).children[1].length == 0.3


def test_buckets_and_codes(spark):
    b = anomaly.buckets()
    assert len(b) == 22 and [x[1:3] for x in b[:4]] == [(1, 8), (1, 12), (8, 16), (12, 24)] and [x[3] for x in b[:4]] == [4, 6, 12, 18] and b[-1][1:] == (6144, 12288, 9216)
    rows = spark.createDataFrame([(4,), (5,), (9216,), (9217,)], "d int").select(anomaly.assigned(F.col("d")).alias("b")).collect()
    assert [r["b"] for r in rows] == [1, 2, 22, None]
    r = spark.createDataFrame([("AC-GU", "UGAAA")], "l string, r string")
    row = r.select(*codes.brackets(F.col("l"), F.col("r")), codes.count_kind(F.col("l"), F.col("r"), "bulge").alias("n")).first()
    assert tuple(row) == ("ACGU&AAAGU", "(( (&)  ))", 1)
    assert r.select(codes.alignment_brackets(F.col("l"), F.col("r"))).first()[0] == "((((" + ")).))"
    tree = newick.parse("((a:0.1,b:0.2):0.05,c:0.3);")
    d = spark.createDataFrame([(1, ["AC", "A-", "AG"])], "id int, alignment array<string>")
    one = phylogeny.likelihoods(phylogeny.with_probabilities(tree, phylogeny.SINGLE_Q), np.array([[0, 0, 0], [1, -1, 2]]), phylogeny.SINGLE_PI)
    assert phylogeny.unstructured_scores(d, "id", tree).first()["score"] == pytest.approx(np.log2(one).sum())
    e = spark.createDataFrame([("AACC",), ("A",), ("",)], "s string").select(F.round(phylogeny.dinucleotide_entropy(F.col("s")), 6)).collect()
    assert [x[0] for x in e] == [round(math.log2(3), 6), 0.0, 0.0]
    v = spark.createDataFrame([(0.0,), (123456.7,), (-0.00123456,)], "x double").select(codes.signif(F.col("x"))).collect()
    assert [x[0] for x in v] == [0.0, 123460.0, -0.0012346]


def test_isolation_forest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(1, 3000)), *map(float, rng.normal(size=5))) for i in range(1500)]
    rows += [(9000, 859.0, 9.0, -9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, dist double, cons double, deltag double, npairs double, entropy double, covariance double")
    out = anomaly.outliers(df, "id", 0.1).collect()
    assert 9000 in {r["id"] for r in out} and len(out) < 0.02 * len(rows)


def test_model_is_saved_and_its_threshold_counts_all_members(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(1, 9000)), *map(float, rng.normal(size=5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, dist double, cons double, deltag double, npairs double, entropy double, covariance double")
    model = anomaly.train(df, "id", 0.1, sample=300)
    anomaly.save(model, str(tmp_path / "m"))
    again = anomaly.load(spark, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, anomaly.predict(df, "id", m).collect())) for m in (model, again))
    assert a == b and a
    x = np.array([r[2:] for r in rows])
    import pickle

    for r in again.collect():
        _, lo, hi, _ = anomaly.buckets()[r["bucket"] - 1]
        own = np.array([lo <= q[1] <= hi for q in rows])
        s = pickle.loads(bytes(r["forest"])).score(x[own])
        assert own.sum() == r["n"] and abs((s > r["threshold"]).mean() - 0.1) <= 1.5 / own.sum() + 0.001
    assert anomaly.predict(df.limit(0), "id", again).count() == 0 and anomaly.train(df.limit(0), "id").count() == 0


def test_duplex_probabilities(spark):
    rows = [(n, float(e)) for n, es in ((2, (-1, -3)), (3, (-2, -4, -6)), (5, (-5,))) for e in es]
    df = spark.createDataFrame(rows, "n_pairs long, energy double")
    law = anomaly.duplex_law(df)
    got = {(r["n_pairs"], r["energy"]): r for r in anomaly.duplex_probabilities(df, law).collect()}
    rate = sum(n for n, _ in rows) / len(rows)
    poisson = lambda n: math.exp(-rate) * rate**n / math.factorial(n)
    normal = lambda e, m, s: math.exp(-((e - m) ** 2) / 2 / s**2) / s / math.sqrt(2 * math.pi)
    below = lambda e, m, s: (1 + math.erf((e - m) / s / math.sqrt(2))) / 2
    s3 = math.sqrt(8 / 3)
    assert got[3, -4.0]["pdf"] == pytest.approx(poisson(3) * normal(-4, -4, s3)) and got[5, -5.0]["pdf"] is None
    rest = 1 - sum(map(poisson, range(4)))
    assert got[2, -1.0]["cdf"] == pytest.approx(poisson(2) * below(-1, -2, 1) + poisson(3) * below(-1, -4, s3) + rest)


def test_small_functions(spark):
    d = spark.createDataFrame([("AC-GU", "UGAAA", -1.5)], "l string, r string, e double").select(codes.drawing(F.col("l"), F.col("r"), F.col("e"))).first()[0]
    assert d.split("\n") == ["      G ", "5' AC  U 3'", "3' UG  A 5'  \u0394G = -1.5", "     AA "]
    sp = "struct<name:string,chr:string,position:bigint,strand:string,seq:string>"
    df = spark.createDataFrame([((("a", "x", 1, "+", "AC")), ("a", "y", 1, "+", "AC")), (("a", "x", 1, "+", "AC"), ("a", "x", 1, "-", "AC"))], f"p {sp}, q {sp}")
    assert [r[0] for r in df.select(maf.same_species(F.col("p"), F.col("q"))).collect()] == [True, False]
    cols = "key string, seqname string, f_first long, f_last long, l_first long, l_last long, energy double"
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        f, n, g = int(rng.integers(1, 300)), int(rng.choice([3, 5, 9, 40, 200])), int(rng.integers(300, 320))
        rows.append(_duplex(f"k{i}", (f, f + n - 1), (g, g + n - 1), -float(rng.integers(1, 40))))
    share = lambda a, b: (min(a[1], b[1]) - max(a[0], b[0]) + 1) / min(a[1] - a[0] + 1, b[1] - b[0] + 1)
    lost = {a[0] for a in rows for b in rows if a[0] != b[0] and share(a[2:4], b[2:4]) >= 0.9 and share(a[4:6], b[4:6]) >= 0.9 and (b[6], b[0]) < (a[6], a[0])}
    df = spark.createDataFrame(rows, cols)
    assert {r["key"] for r in intervals.undominated(df, "key", 0.9, everywhere=True).collect()} == {r[0] for r in rows} - lost and lost
    got = intervals.collect(df.withColumn("n_pairs", F.col("f_last") - F.col("f_first") + 1), 5, -10.0).collect()
    order = [(r["f_first"] // 50, r["f_first"], r["f_last"], r["l_first"]) for r in got]
    assert order == sorted(order) and got


def test_pipeline(spark, tmp_path):
    comp = str.maketrans("ACGT", "TGCA")
    rng = np.random.default_rng(7)
    text = []
    for k in range(6):
        arm = "".join(rng.choice(list("ACGT"), 12))
        ref = "".join(rng.choice(list("ACGT"), 10)) + arm + "".join(rng.choice(list("AC"), 15)) + arm.translate(comp)[::-1]
        other = ref[:3] + "-" + ref[4:]
        text.append(f"a score=10\ns a.chr1 {1000 * k} {len(ref)} + 100000 {ref}\ns b.chr9 5 {len(ref) - 1} + 100000 {other}\n")
    (tmp_path / "x.maf").write_text("##maf\n\n" + "\n".join(text))
    (tmp_path / "g.bed").write_text("chr1\t0\t2100\tplus\t0\t+\nchr1\t2900\t9000\tminus\t0\t-\n")
    c = pipeline.PipelineConfig("((a:0.1,b:0.2):0.05,c:0.3);", depth=14, max_bulges=1, max_mismatches=1)
    rows = pipeline.blocks(maf.read_text(spark, str(tmp_path / "x.maf")), regions.load_bed(spark, str(tmp_path / "g.bed")), c).cache()
    assert rows.count() == 6
    found = pipeline.duplexes(rows, c).cache()
    by = {r["first"]: r for r in rows.collect()}
    assert found.groupBy("seqname").count().first()["count"] >= 6
    for r in found.collect():
        start = max(f for f in by if f <= r["f_first"])
        seq = by[start]["seq"] if r["strand"] == "+" else by[start]["seq"][::-1].translate(str.maketrans("ACGU", "UGCA"))
        left, right = seq[r["f_first"] - start : r["f_last"] - start + 1], seq[r["l_first"] - start : r["l_last"] - start + 1]
        arms = (r["l"].replace("-", ""), r["r"].replace("-", "")[::-1])
        want = (left, right) if r["strand"] == "+" else tuple(x[::-1].translate(str.maketrans("ACGU", "UGCA")) for x in (right, left))
        assert arms == want
    f = pipeline.feature_rows(found, c)
    import dataclasses

    some = pipeline.feature_rows(found, dataclasses.replace(c, supported_only=True, conserved_single=True))
    assert some.filter("cons < 0").count() == 0 and some.count() <= found.count()
    assert f.count() == found.count() and f.filter("dist < 3").count() == 0


def test_helix_rows_equal_the_window_path(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "".join(rng.choice(list("ACGUN"), n))) for i, n in enumerate((0, 1, 5, 40, 90))]
    seqs = spark.createDataFrame([*rows, (9, None)], "seq_id long, seq string")
    got = sorted((r["seq_id"], r["i"], r["k"], r["n_pairs"], round(r["energy"], 6)) for r in folding.helices_of(seqs, ["seq_id"], below=9.9).collect())
    b = folding.bases(seqs.filter("seq is not null"))
    want = sorted((r["key_a"], r["i"], r["k"], r["n_pairs"], round(r["energy"], 6)) for r in folding.helices(folding.pair_join(b, b)).collect())
    assert got == want and got
    small = [np.concatenate(c) for c in zip(*folding._helix_rows(search.CODE[np.frombuffer(rows[4][1].encode(), np.uint8)], search.CODE[np.frombuffer(rows[4][1].encode(), np.uint8)], True, 3, 2000, 9.9, block=300), strict=True)]
    assert len(small[0]) == sum(r[0] == 4 for r in want)
