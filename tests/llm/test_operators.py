import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, language, neardup, parsing, pieces, quality, sharding, substrings, urls, wavelet
from strandloom.llm import words as W
from tests.llm import brute

WORDS = "the quick brown fox jumps over a lazy dog while seven wild geese fly south past the old stone mill near our river".split()
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
SEEN = " ".join(WORDS)
ROWS = [
    (1, SEEN), (2, SEEN), (2, SEEN), (3, "Lead in. " + SEEN), (4, ""), (5, None), (6, "  \n\t "), (7, "one two three"),
    (8, "ONE two three"), (9, LONG), (10, LONG + " end"), (None, SEEN), (12, "Größe \U0001f642 " * 9), (13, SEEN + "\n" + SEEN),
]
CLASH = ("class", "sig", "rep", "kept", "score", "shard", "places", "h", "k", "bucket", "label", "p", "a", "b", "kind", "key", "window", "held", "row", "body")


def odd(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [(r[0], r[1]) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_near_duplicates(spark, small, which):
    df, rows = documents(spark, small) if which == "small" else (odd(spark), [r for r in dict.fromkeys(ROWS) if r[0] is not None])
    got = {tuple(r) for r in neardup.near_duplicates(df).filter("doc_id is not null").collect()}
    assert got == {(i, *v) for i, v in brute.near_duplicates(rows).items()}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_lower_likeness(spark):
    """Pairs with a likeness from 0.80 to 0.85, whose signatures often differ in more than 29 slots."""
    rows = []
    for i in range(600):
        w = [f"d{i}w{j}" for j in range(200)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:178], *(f"e{i}w{j}" for j in range(21))]))]
    want = {(i, *v) for i, v in brute.near_duplicates(rows, percent=80).items()}
    assert sum(kept for *_, kept in want) == 600 and all(kept for *_, kept in brute.near_duplicates(rows).values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(df, percent=80).collect()} == want


def test_hot_keys_are_cut_into_groups(spark, monkeypatch):
    """A template in many documents that are no duplicates: no group has more than two blocks, and every pair of members meets."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    where = spark.createDataFrame([(5, i, i) for i in range(300)] + [(6, 1, 1), (6, 2, 2), (7, 3, 3), (7, 4, 3)], "key long, rep long, comp long")
    sig = spark.createDataFrame([(i, bytes(2 * neardup.SLOTS)) for i in range(300)], "rep long, sig binary")
    groups = {}
    for r in neardup.grouped(where, sig).collect():
        groups.setdefault((r["grp"], r["key"]), []).append((r["rep"], r["side"]))
    assert max(map(len, groups.values())) <= 4 * 16
    met = [(k, *sorted((a, b))) for (_, k), g in groups.items() for n, (a, p) in enumerate(g) for b, q in g[:n] if p != q or p == 2]
    assert len(met) == len(set(met)) and set(met) == {(5, a, b) for b in range(300) for a in range(b)} | {(6, 1, 2)}
    # a large component and a few others: its members meet the others, and not each other
    where = spark.createDataFrame([(5, i, i if i < 20 else 99) for i in range(300)], "key long, rep long, comp long")
    groups = {}
    for r in neardup.grouped(where, sig).collect():
        groups.setdefault(r["grp"], []).append((r["rep"], r["side"]))
    met = [tuple(sorted((a, b))) for g in groups.values() for n, (a, p) in enumerate(g) for b, q in g[:n] if p != q or p == 2]
    assert len(met) == len(set(met)) and set(met) == {(a, b) for b in range(300) for a in range(min(b, 20))}
    same = [f"t{j}" for j in range(70)]
    rows = [(i, " ".join([*same, *(f"v{i // 2}w{j}" for j in range(24)), f"x{i % 2}"])) for i in range(300)]
    rows += [(i, " ".join([*same, *(f"u{i}w{j}" for j in range(8))])) for i in range(300, 400)]
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, *v) for i, v in brute.near_duplicates(rows).items()}


def test_index_finds_all_pairs_under_the_threshold():
    """Whatever slots differ, up to ``far`` of them, two signatures have a key in common."""
    rng = np.random.default_rng(8)
    assert neardup.index_for(85) == (22, 12)
    for p in range(65, 101):
        far, chunks = neardup.index_for(p)
        a = rng.integers(0, 1 << 16, (300, neardup.SLOTS)).astype(np.uint16)
        b = a.copy()
        for i, row in enumerate(b):
            # the worst case: two errors a chunk, and the rest of them in the last; or any slots
            parts = [list(rng.choice(x, min(2, len(x)), replace=False)) for x in np.array_split(np.arange(neardup.SLOTS), chunks)]
            rng.shuffle(parts)
            at = sum(parts, [])[:far] if i % 2 else rng.choice(neardup.SLOTS, far, replace=False)
            row[at] ^= np.uint16(1 + i)
        assert ((a != b).sum(1) == far).all() and (neardup.chunk_keys(a, chunks) == neardup.chunk_keys(b, chunks)).any(1).all()
    far, chunks = zip(*(neardup.index_for(p) for p in range(65, 101)), strict=True)
    assert list(far) == sorted(far, reverse=True) and list(chunks) == sorted(chunks, reverse=True)
    for p in (0, 50, 101):
        with pytest.raises(ValueError):
            neardup.index_for(p)


def test_loss_at_the_threshold():
    """The share of pairs of exactly 0.85 whose signatures differ in more than ``far`` slots, from 40 000 of them."""
    rng = np.random.default_rng(12)
    far, lost = neardup.index_for(85).far, 0
    for _ in range(20):
        same, a, b = (rng.integers(1 << 63, size=(2000, n), dtype=np.int64).astype(np.uint64) for n in (85, 8, 7))
        x, y = (neardup.signatures(list(np.concatenate([same, z], 1))) for z in (a, b))
        lost += int(((x != y).sum(1) > far).sum())
    assert lost <= 10


def test_rows_with_one_id_and_other_texts(spark):
    rows = [(1, SEEN), (2, SEEN), (2, "another text of eight words or so here"), (3, "another text of eight words or so here")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(WORDS) - 4
    assert got == sorted([(1, n, 1, True), (2, n, 1, False), (2, 4, 2, True), (3, 4, 2, False)])


@pytest.mark.parametrize("which", ["odd", "small"])
def test_substring_dedup(spark, small, which):
    df, rows = documents(spark, small) if which == "small" else (odd(spark), [r for r in dict.fromkeys(ROWS) if r[0] is not None])
    want = {(i, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, (n, g, k) in brute.substring_dedup(rows).items()}
    assert {tuple(r) for r in substrings.substring_dedup(df).filter("doc_id is not null").collect()} == want
    assert substrings.substring_dedup(df.limit(0)).count() == 0


def test_rows_with_one_id_are_judged_by_their_own_text(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(13)) for c in "xy")
    df = spark.createDataFrame([(1, x), (2, x), (2, y), (2, y), (3, f"lead {y}"), (None, x)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(df).collect())
    assert got == [(0, 13, 0), (1, 13, 0), (2, 13, 0), (2, 13, 0), (2, 13, 13), (3, 14, 13)]


def test_common_anchors_are_cut_into_windows(spark, small, monkeypatch):
    """Every anchor as a common one: the same result."""
    monkeypatch.setattr(substrings, "HOT", 0)
    df, rows = documents(spark, small)
    want = {(i, n, g) for i, (n, g, _) in brute.substring_dedup(rows).items()}
    assert {tuple(r)[:3] for r in substrings.substring_dedup(df.repartition(7)).collect()} == want


def _stretch_rows(rows):
    """Rows (key, least, words, [(doc, h, pos)]) as _located takes them."""
    places = [np.array(p, substrings.PLACE).tobytes() for *_, p in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].encode() for r in rows], pa.binary()), pa.array(places, pa.binary())], ["key", "least", "words", "places"])


def test_occurrences_come_from_the_automata(monkeypatch):
    a, b = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(4)]
    rows = [(1, 1, " ".join(a), [(1, 0, 5)]), (1, 2, " ".join(a[1:]), [(2, 0, 0), (8, 0, 3)]), (1, 3, " ".join(a[:5]), [(3, 0, 7)]), (2, 4, " ".join(b), [(4, 0, 0)]), (2, 5, " ".join(b), [(5, 0, 1), (5, 9, 2)])]
    took = lambda batches: {tuple(x.values()) for o in substrings._located(4)(iter(batches)) for x in o.to_pylist()}
    got = took([_stretch_rows(rows)])
    cover = lambda d: {(x, p) for x, _, pos, size in got if x == d for p in range(pos, pos + size)}
    assert cover(1) == cover(4) == set() and cover(2) == {(2, p) for p in range(5)} and cover(8) == {(8, p) for p in range(3, 8)}
    assert cover(3) == {(3, p) for p in range(7, 12)} and {r for r in got if r[0] == 5} == {(5, 0, 1, 4), (5, 9, 2, 4)}
    # rows come in other batches, and shards have a key each, or a part of one
    assert took([_stretch_rows(rows[:2]), _stretch_rows(rows[2:4]), _stretch_rows(rows[4:])]) == got
    monkeypatch.setattr(substrings, "SHARD", 2)
    assert took([_stretch_rows([r]) for r in rows]) == got
    # nothing is told without the automata
    monkeypatch.setattr(substrings, "automaton", lambda found, make=substrings.automaton: (make({b"\x7f\0\0\0": 0})[0], np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)))
    assert took([_stretch_rows(rows)]) == set()


def test_windows_of_one_hash_are_told_apart_by_their_words(monkeypatch):
    number, ptr = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int32), np.array([0, 3, 6, 9])
    want = substrings.confirmed(number, ptr, np.array([5, 6, 7]), np.array([5, 6, 7]), 3)
    monkeypatch.setattr(W, "run_hashes", lambda h, ptr, k: (np.array([0, 3, 6]), np.zeros(3, np.uint64)))
    got = substrings.confirmed(number, ptr, np.array([5, 6, 7]), np.array([5, 6, 7]), 3)
    assert want[0].tolist() == got[0].tolist() == [0, 6] and want[2].tolist() == got[2].tolist() == [5, 5]


def test_fingerprints(spark, small):
    df, rows = documents(spark, small)
    got = {r["doc_id"]: r for r in parsing.fingerprints(df).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    far = [r["near_next"] for r in got.values()]
    near = [r["near_edited"] for r in got.values()]
    assert np.mean(near) > 0.5 > 0.1 > np.mean(far)
    out = parsing.fingerprints(odd(spark)).collect()
    assert len(out) == len(ROWS)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert parsing.fingerprints(df.limit(0)).count() == 0


def test_equal_passages_share_phrases():
    rng = np.random.default_rng(1)
    a, b, c = (bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (4000, 37, 53))
    sig = parsing.signatures(*W.text_arrays(pa.array([a.decode(), (b + a).decode(), (c + a + b).decode()], pa.large_string())))
    assert parsing.likeness(sig[:1], sig[1:2])[0] > 0.9
    assert parsing.likeness(sig[:1], sig[2:])[0] > 0.85


def test_sharding(spark, small):
    df, rows = documents(spark, small)
    for d, n in ((df, 24), (odd(spark), 5), (df.limit(0), 3)):
        out = sharding.histogram_sort(d, n, 30).collect()
        assert len(out) == d.count()
        by = {}
        for r in out:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        if out:
            sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(n)]
            assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    want = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.histogram_sort(df).collect()} == want


def test_one_hot_text_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.histogram_sort(df, 8, 64).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(out) == 8 and max(r["s"] for r in out) < 1.02 * min(r["s"] for r in out)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_wavelet_shards(spark, small, which):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df, rows = documents(spark, small) if which == "small" else (odd(spark), None)
    got = wavelet.read_shards(wavelet.write_shards(df, path)).collect()
    tok = Tokenizer.from_file(path)
    if rows:
        at = 0
        by = {r["doc_id"]: r for r in got}
        for (i, t), e in zip(rows, tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
            ids = [*e.ids, 1]
            assert tuple(by[i])[1:4] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)
    else:
        assert len(got) == len(ROWS)
    assert wavelet.read_shards(wavelet.write_shards(df.limit(0), path)).count() == 0


def test_hot_keys_and_record_sizes(spark):
    """A key with most rows is dealt over groups by its texts; a record ends where it has enough ids; the order stays."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7 if i % 3 else i, f"text number {i} of some words") for i in range(600)] + [(None, f"none {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in CLASH})
    files = wavelet.write_shards(df, path, groups=12, most=100)
    assert files.count() > 30 and files.agg(F.max("n")).first()[0] < 120
    groups = files.select("grp").distinct().count()
    assert groups >= 8
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_shards(files).collect()), key=lambda r: r[0])
    assert [r[0] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    keys = [-1 if r[1] is None else r[1] for r in got]
    assert keys == sorted(keys)
    tok = Tokenizer.from_file(path)
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    want = sorted((-1 if d is None else d, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for (d, _), i in zip(rows, ids, strict=True))
    assert sorted((k, r[2], r[3]) for k, r in zip(keys, got, strict=True)) == want


def test_chunks_encode_as_whole_texts(spark, small):
    """Every tokenizer file, and texts that could tell chunks from whole texts."""
    from tokenizers import Tokenizer

    from strandloom.llm import tokens

    odd_texts = ["don't it's we'LL 're", "a.'s b,'t x.y!?z #a$b%c&d*e", "<|startoftext|> The <|ENDOFTEXT|>. a<|endoftext|>b", "É e\u0301 \u0130 ﬁ Ⅷ x\u0301. a\u0301,b", "x\x1cy\u2028z \u00a0.", "3.14,15 a1b2.c3", "", " \n ", "Ω ΑΣ. ΑΣ", "größe ŉa ªº ǆ ǅ ƻa çé,ü", "".join(map(chr, range(32, 0x260)))]
    texts = [t for _, t in documents(spark, small)[1]][:60] + odd_texts
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for part in (slice(0, None), slice(0, 60), *(slice(i, i + 1) for i in range(60, len(texts)))):
            enc = tokens.WordEncoder(path)
            ids, at = enc.ids(*W.text_arrays(pa.array(texts[part], pa.large_string())))
            assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == want[part]


def test_wavelet_matrix():
    ids = np.random.default_rng(3).integers(0, 60, 5000).astype(np.uint32) * 700
    m = wavelet.WaveletMatrix.frombytes(wavelet.WaveletMatrix.of(ids).tobytes())
    assert (m.decode() == ids).all() and (m.access(np.arange(5000)) == ids).all()
    for t in (0, 700, 41300, 5):
        where = np.flatnonzero(ids == t)
        assert m.rank(t, 5000) == len(where) and m.rank(t, 1234) == (where < 1234).sum()
        assert [m.select(t, k) for k in range(len(where))] == where.tolist() and m.select(t, len(where)) == -1


def test_pieces(spark, small):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    df, rows = documents(spark, small)
    for d, own in ((df, rows), (odd(spark), ROWS)):
        got = sorted((r["doc_id"] or 0, tuple(r["ids"]), r["round_trip"], r["parity"]) for r in pieces.encode(d, path, True).collect())
        assert got == sorted((i or 0, tuple(peer.encode(t or "")), True, True) for i, t in own)
    codec = pieces.Codec(path)
    texts = ["", " ", "   ", "  a   b", "\n", "a\n b \n\n  c", "\t x \r\n", "é漢\U0001f642", "a▁b"]
    data, offs = W.text_arrays(pa.array(texts))
    ids, at = codec.encode(data, offs)
    assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == peer.encode(texts)
    whole = codec.model.tokenizer().encode_batch(texts[:1] + texts[3:])
    assert [e.ids for e in whole] == peer.encode(texts[:1] + texts[3:])


def _message(*fields):
    """Protobuf wire format of (number, value): ints, floats, strings and messages."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_with_byte_fallback(spark, tmp_path, squeeze):
    """A model made of scores by hand: the rebuilt tokenizer and sentencepiece agree, and differing ids are told, not replaced."""
    import sentencepiece

    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces_ += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(["▁the", "▁qu", "ick", "▁fox", "▁", "qu", "ic", "k", "e", "t", "h", "f", "o", "x", "▁o", "the", "ver", "er", "v", "r"])]
    raw = b"".join(_message((1, _message((1, p), (2, s), (3, t)))) for p, s, t in pieces_)
    raw += _message((2, _message((3, 1), (4, len(pieces_)), (35, 1))), (3, _message((1, "identity"), (3, 1), (4, squeeze), (5, 1))))
    path = str(tmp_path / "u.model")
    (tmp_path / "u.model").write_bytes(raw)
    model = pieces.PieceModel.parse(raw)
    assert model.kind == pieces.UNIGRAM and model.byte_fallback and model.squeeze == bool(squeeze) and not model.charsmap
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the quick fox over the fox", "quiche \U0001f642 x", "", "ver", "thee  the ", " fox\tover", "éfox", "zzz the zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode(df, path, True).collect()}
    assert [got[i]["ids"] for i in range(len(texts))] == peer.encode(texts) and all(r["parity"] for r in got.values())
    clean = [i for i, t in enumerate(texts) if not squeeze or t == " ".join(t.split(" ")).strip() and "  " not in t]
    assert all(got[i]["round_trip"] for i in clean)
    codec = pieces.Codec(path)
    codec.peer = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids, _ = codec.encode(*W.text_arrays(pa.array(["the fox"])))
    assert ids.tolist() == peer.encode("the fox") and codec.differ


def test_contaminated(spark, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = bench.collect()
    w = items[0]["text"].split()
    edited = [x if i % 6 else "zzz" for i, x in enumerate(w)]
    rows = [(1, "clean text of no interest at all, but long enough"), (2, "before it " + items[0]["text"].upper() + " after"), (3, "x y " + " ".join(edited)), (4, None), (5, "")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(2, items[0]["item_id"]), (3, items[0]["item_id"])}
    assert got[2, items[0]["item_id"]]["score"] == 1 and (got[2, items[0]["item_id"]]["start_word"], got[2, items[0]["item_id"]]["end_word"]) == (2, 2 + len(w))
    assert decontaminate.contaminated(odd(spark), bench).count() == 0
    assert decontaminate.contaminated(odd(spark), bench.limit(0)).count() == 0
    df, docs = documents(spark, small)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, block=2000).collect()}
    whole = {(i, b["item_id"]) for i, t in docs for b in items if " ".join(b["text"].lower().split()) in " ".join(t.lower().split())}
    assert whole <= found and len(found) <= len(whole) + 3


def test_common_leaks_are_found(spark):
    """A leak's seeds are common where many documents have it; fewer than half of the item's seeds are in the leak."""
    item = [f"q{i}" for i in range(40)]
    edited = " ".join(x if i % 4 != 3 else "zzz" for i, x in enumerate(item))
    part = " ".join(item[:18])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for leak, score in ((edited, 0.6375), (part, 0.45)):
        rows = [(i, f"lead {i} in {leak} out {i}") for i in range(200)]
        got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        assert sorted((r["doc_id"], r["score"]) for r in got) == [(i, score) for i in range(200)]


def test_recall_against_aligning_all_pairs(spark):
    """Copies with replaced, added and missing words, and paraphrases: every pair that scores enough over the whole text is found."""
    rng = np.random.default_rng(21)
    words = [f"v{i}" for i in range(400)]
    items = [list(rng.choice(words, int(rng.integers(12, 50)))) for _ in range(20)]
    items[5] = items[4]  # repeated items are each found
    rows = []
    for i in range(240):
        body = list(items[i % 20])
        kind = i // 20 % 6
        if kind == 0:  # every third word is another
            body = [w if j % 3 != 2 else f"z{i}" for j, w in enumerate(body)]
        elif kind == 1:  # three in ten words are others, anywhere
            body = [w if rng.random() > 0.3 else f"z{i}" for w in body]
        elif kind == 2:  # a word is added after every fourth
            body = [x for j, w in enumerate(body) for x in ([w, f"z{j}"] if j % 4 == 3 else [w])]
        elif kind == 3:  # every fifth is missing
            body = [w for j, w in enumerate(body) if j % 5 != 4]
        elif kind == 4:  # the first half alone
            body = body[: len(body) // 2]
        rows.append((i, " ".join([*rng.choice(words, 30), *body, *rng.choice(words, 30)])))
    hashed = lambda ws: np.array([hash(w) for w in ws])
    want = {(i, k) for i, t in rows for k, item in enumerate(items) if decontaminate.align(hashed(item), hashed(t.split()))[0] >= 0.4}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got <= want and len(want) > 200 and len(want - got) <= 0.02 * len(want)


def test_seeds_in_parts_hold_whole_texts():
    own = np.repeat(np.arange(5), [3, 1, 4, 2, 1])
    got = list(decontaminate.parts(np.full(11, 2), own, 6))
    assert [x for p in got for x in range(*p)] == list(range(11))
    assert all(e == 11 or own[e] != own[e - 1] for _, e in got) and max(e - s for s, e in got) == 4


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, s, e = decontaminate.align(a, b)
        assert score == h.max() / (2 * len(a)) and 0 <= s <= e <= len(b)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = language.fold_of("doc_id", 5) == 0
    field = quality.fit(quality.labelled(docs, labels.filter(~held).select("doc_id", "quality")))
    rows = quality.score(docs.filter(held), field).join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    out = quality.score(odd(spark), field).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(docs.limit(0), field).count() == 0
    nothing = quality.fit(docs.limit(0).select("text", F.lit(1).alias("quality")))
    assert quality.score(odd(spark), nothing).count() == len(ROWS)


def test_lines_and_marginals():
    x, ptr, length = quality.line_features(*W.text_arrays(pa.array(["a b\nc", "", "\n", "x\n\ny\n"])))
    assert ptr.tolist() == [0, 2, 3, 5, 9] and length.tolist() == [3, 1, 0, 0, 0, 1, 0, 1, 0]
    rng = np.random.default_rng(2)
    u, t = rng.normal(size=4), rng.normal(size=(2, 2))
    p, _ = quality.marginals(u, t, np.array([0, 4]))
    weight = {}
    for n in range(16):
        y = [n >> i & 1 for i in range(4)]
        weight[tuple(y)] = np.exp(sum(u[i] * y[i] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3)))
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(4)]
    assert np.allclose(p, want)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.fold_of("doc_id", 4) == 2
    model = language.fit(docs.filter(~held))
    rows = language.identify(docs.filter(held), model, carry=("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    out = {r["doc_id"]: r for r in language.identify(odd(spark), model).collect()}
    assert out[4]["lang_pred"] == out[5]["lang_pred"] == out[6]["lang_pred"] == "und" and out[4]["score"] == 0
    assert language.identify(odd(spark), language.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0
    noise = spark.createDataFrame([(1, "漢字仮名交じり文を書く人々の話である" * 20)], "doc_id long, text string")
    assert not language.identify(noise, model).first()["accepted"]


def test_language_model_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    copies = docs.filter("lang = 'en'").limit(1).crossJoin(spark.range(500)).select("text", "lang")
    a, b = (language.fit(d, sample=40) for d in (docs, docs.unionByName(copies.limit(0)).repartition(7)))
    assert a.langs == b.langs and (a.centers == b.centers).all() and (a.least == b.least).all()
    crowd = language.fit(docs.unionByName(copies), sample=40)
    # the copies change the frequencies, but not which texts are clustered
    assert crowd.langs == a.langs and np.abs(crowd.centers - a.centers).max() < 0.2
    tie = spark.createDataFrame([("same words here", "aa"), ("same words here", "bb")], "text string, lang string")
    out = language.identify(tie.withColumn("doc_id", F.lit(1)), language.fit(tie)).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("aa", 0.5)}


def test_url_verdicts_equal_plain_counting(spark, small, monkeypatch):
    """The whole result against dictionaries, with few grams as common ones and with none."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    rows = [(r[0], r[1]) for r in pages.collect()]
    order, label = 4, {}
    for _, u in rows:
        host, _, path = (u.split("://", 1)[1] if "://" in u else "").partition("/")
        host, path = host.split("?")[0].split("#")[0].lower(), ("/" + path).split("?")[0].split("#")[0] if _ else ""
        best = [(len(h + p), w) for w, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        label[u] = max(best)[1] if best else None
    held = {u: zlib.crc32(u.encode()) % 5 == 0 for u in label}
    pad = {u: urls.START * order + u + urls.END for u in label}
    grams = {c: [(pad[u][i - order : i], pad[u][i]) for u in label if label[u] == c and not held[u] for i in range(order, len(pad[u]))] for c in ("allow", "block")}
    count = {c: {} for c in grams}
    for c, g in grams.items():
        for ctx, x in g:
            for k in range(order + 1):
                row = count[c].setdefault(ctx[order - k :], {})
                row[x] = row.get(x, 0) + 1

    def p(c, ctx, x):
        prob = 1 / 256
        for k in range(order + 1):
            if row := count[c].get(ctx[order - k :]):
                prob = (row.get(x, 0) + len(row) * prob) / (sum(row.values()) + len(row))
        return prob

    score = {u: np.mean([np.log(p("allow", t[i - order : i], t[i]) / p("block", t[i - order : i], t[i])) for i in range(order, len(t))]) for u, t in pad.items()}
    seen = {}
    for u, x in score.items():
        if held[u] and label[u]:
            at = label[u], int(min(max(np.floor((x + 5) / 10 * 200), 0), 199))
            seen[at] = seen.get(at, 0) + 1
    edge = urls.threshold(seen, 200, 5.0)
    for common in (urls.COMMON, 1):
        monkeypatch.setattr(urls, "COMMON", common)
        got = {r["page_id"]: r for r in urls.url_verdicts(pages).collect()}
        assert len(got) == len(rows)
        for i, u in rows:
            assert got[i]["score"] == pytest.approx(score[u], abs=1e-9)
            if label[u] or abs(score[u] - edge) > 1e-9:
                assert got[i]["verdict"] == (label[u] or ("allow" if score[u] >= edge else "block"))


def test_urls(spark, small):
    odd_urls = [None, "", "no scheme/net/", "http://NET/", "http://a.net", "https://x.Example.net/en/1?q", "http://example.net.evil.org/fr/", "http://notnet/", "http://u.example.com/de/#x", "ftp://h?p", "a://b://c/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(odd_urls)] + [(1, None)], "page_id long, url string").withColumns({c: F.lit(1) for c in CLASH})
    got = {r["page_id"]: r for r in urls.url_verdicts(df).collect() if r["page_id"] != 1}
    assert [got[i]["host"] for i in (0, 2, 3, 4, 5, 8, 9, 10)] == ["", "", "net", "a.net", "x.example.net", "u.example.com", "h", "b:"]
    assert [got[i]["rule"] for i in (3, 4, 5, 6, 7, 8)] == ["net/", None, "example.net/en/", "org/fr/", None, "example.com/de/"]
    assert [got[i]["verdict"] for i in (3, 5, 6, 8)] == ["block", "allow", "allow", "block"]
    assert urls.url_verdicts(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{small}/pages.parquet")
    out = urls.url_verdicts(pages).collect()
    assert len(out) == pages.count() and {r["verdict"] for r in out} <= {"allow", "block"}


def test_character_models(spark):
    """The table of log ratios against plain counting."""
    order, texts = 2, {"allow": ["abab", "abc"], "block": ["bbc", "cab"]}
    rows = [(i, t, c) for i, (c, t) in enumerate((c, t) for c, ts in texts.items() for t in ts)]
    df = spark.createDataFrame(rows, "row long, body string, label string").withColumns({"held": F.lit(False), "page_id": F.lit(0)})
    each = urls._grams(df, order)
    grams = each.groupBy("gram").agg(*(F.sum((F.col("label") == c).cast("long")).alias(c) for c in texts))
    got = {r["gram"]: r["ratio"] for r in urls.char_models(grams, order).collect()}

    def p(cls, gram):
        padded = [urls.START * order + t + urls.END for t in texts[cls]]
        prob = 1 / 256
        for k in range(order + 1):
            g = gram[order - k :]
            at = [(t[i - k : i], t[i]) for t in padded for i in range(order, len(t))]
            n = [c for ctx, c in at if ctx == g[:-1]]
            if n:
                prob = (n.count(g[-1]) + len(set(n)) * prob) / (len(n) + len(set(n)))
        return prob

    assert got and all(abs(v - np.log(p("allow", g) / p("block", g))) < 1e-9 for g, v in got.items())
