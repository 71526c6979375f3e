import hashlib
import itertools
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from strandloom.llm import licences, pieces, substrings, variants, vectors
from strandloom.llm import words as W
from tests.llm import brute
from tests.llm.test_operators import ROWS, documents, odd


def spelled(df, **options):
    return {r[0]: tuple(r)[1:] for r in variants.spelling_variants(df, **options).collect()}


@pytest.mark.parametrize("which", ["odd", "small"])
def test_spelling_variants(spark, small, which):
    df, rows = documents(spark, small) if which == "small" else (odd(spark), ROWS)
    want = brute.spelling(rows)
    assert spelled(df) == want
    # shards of a few words, each in several groups
    assert spelled(df, most=40, asking=60) == want
    assert spelled(df.limit(0)) == {}


def test_spelling_variants_chains_and_letters(spark):
    texts = ["elephant " * 2600, "elephants " * 230, "elephantss " * 21, "elephantssz " * 2, "ELEPHANT", "Éléphant " * 5, "éléphant " * 5, "Éléphan× " * 2, "aaaaaaaa" * 3000 + " " + "aaaaaaaa" * 3000]
    rows = [(k, t) for k, t in enumerate([*texts, None, "", "12345678 _______ āāāāāāāā"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.spelling(rows)
    assert spelled(df) == want and len(want) >= 8 and want["elephantssz"][1] == "elephant"


def test_trie_search_on_anagrams():
    """Many words with one vector and their neighbours: a leaf that no level divides."""
    rng = random.Random(4)
    words = sorted({"".join(p) for p in itertools.islice(itertools.permutations("abcdefgh"), 0, 40_000, 40)} | {"".join(rng.sample("abfvwkyh", 8)) for _ in range(400)})
    words += sorted({w[:k] + w[k + 1 :] for w in words[:300] for k in (0, 3)} | {w[:4] + "bfjq"[k % 4] + w[5:] for k, w in enumerate(words)} - set(words))
    words = list(dict.fromkeys(words))
    level = np.array([[sum(c in g for c in w) for g in variants.GROUPS] + [0] for w in words])
    want = {(a, b) for a in words for b in words if variants.one_edit(a.encode(), b.encode())}
    for dense in (1 << 16, 1, 1 << 40):
        old, variants.DENSE = variants.DENSE, dense
        try:
            i, j = variants.search(words, level, words, level)
        finally:
            variants.DENSE = old
        got = [(words[a], words[b]) for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and {(a, b) for a, b in got} | {(b, a) for a, b in got} == want and len(want) == 2 * len(got)


FULL = {t.label: t.text for t in reversed(licences.TEMPLATES)}


@pytest.mark.parametrize("which", ["odd", "small"])
def test_base_phrases(spark, small, which):
    more = [(20, "MIT License mit license, MIT-License"), (21, "gnu general public\tlicense GNU GENERAL PUBLIC LICENSES"), (22, "cc by cc by-nc cc_by"), (23, "ÄCC BY, cc\u212a by, cc by"), (24, "x " * 5000 + "apache license " * 5000)]
    df, rows = documents(spark, small) if which == "small" else (odd(spark), ROWS)
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = [tuple(r) for r in licences.licence_labels(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    want = []
    for i, t in [*rows, *more]:
        words, at, labels = brute.phrase_places(t, licences.PHRASES)
        want.append((i, len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licences.licence_labels(df.limit(0)).count() == 0


def test_licence_templates(spark):
    plain = "a story about a river and the people who live near it with no words of law " * 3
    texts = {
        0: plain, 1: plain + FULL["mit"] + " " + plain, 2: plain + licences.TEMPLATES[17].text.upper().replace(" ", ", ") + " " + plain, 3: "Licensed under CC BY-NC 4.0.", 4: "Licensed under the Apache License, Version 2.0.",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: FULL["bsd"].replace("binary forms", "binary form"), 7: FULL["zlib"] + " " + FULL["unlicense"], 8: "license " * 3000 + FULL["bsl-1.0"],
        9: " ".join(reversed(FULL["zlib"].split())), 10: None, 11: "", 12: FULL["zlib"] + " " + FULL["unlicense"],
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, file string, t int")
    got = {r["doc_id"]: r for r in licences.licence_labels(df).collect()}
    want = {0: "", 1: "mit", 2: "mit", 3: "cc-by,cc-by-nc", 4: "apache,apache-2.0", 5: "gpl,gpl-3.0", 6: "", 7: "unlicense,zlib", 8: "bsl-1.0", 9: "", 10: "", 11: "", 12: "unlicense,zlib"}
    assert {i: r["labels"] for i, r in got.items()} == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (want[i] != "") for i, r in got.items()) and got[2]["score"] == 1
    assert got[1]["base_labels"] == "" == got[7]["base_labels"] and got[4]["base_labels"] == "apache"


def test_every_template_is_found_in_its_own_text(spark):
    df = spark.createDataFrame([(i, "before it " + t.text + " after it") for i, t in enumerate(licences.TEMPLATES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.licence_labels(df).collect()}
    assert all(t.label in got[i] for i, t in enumerate(licences.TEMPLATES))
    assert all(k in t.text for t in licences.TEMPLATES for k in t.keys)


@pytest.mark.parametrize("dim", [1, 3, 4, 9])
def test_tree_of_entries_finds_the_nearest(dim):
    rng = np.random.default_rng(dim)
    for n in (1, 2, 7, 64, 256):
        for far in (2, 40, 1 << 28):
            entries = rng.integers(-far, far + 1, (n, dim))
            entries[rng.integers(0, n, n // 3)] = entries[0]
            q = np.concatenate([entries, rng.integers(-far, far + 1, (300, dim))])
            d = ((q[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
            at, best = vectors.Gnat(entries).nearest(q)
            assert (best == d.min(1)).all() and (at == [int(np.flatnonzero(row == row.min())[0]) for row in d]).all()


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, s int").repartition(3)
    out = vectors.vector_codes(df).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=str), {r["codebooks_sha256"] for r in out}


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], None if i % 7 == 0 else i % 3) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(3, rows[9][1], 1), (3, rows[9][1], 1), (200, None, 1), (201, [0.5] * 31 + [None], 1), (202, [nan] + [0.1] * 31, 2), (203, [-inf] * 32, 2), (204, [], 0), (205, [0.1] * 16, 0), (None, [0.0] * 32, None), (-5, [-0.001] * 32, 0)]
    want, books = brute.vector_codes(rows)
    got, sums = coded(spark, rows)
    assert got == want and sums == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    # fewer rows than entries; none that is kept; an empty table
    few = [(i, [float(i)] * 16, 0) for i in range(5)] * 2
    assert coded(spark, few)[0] == brute.vector_codes(few)[0]
    assert coded(spark, [(1, None, 1), (2, [nan] * 16, 1)]) == ([], set())
    assert vectors.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_parity_of_a_differing_chunk_anywhere(monkeypatch):
    """Told for a first, middle, last and only word, in any batch after the one that met it; not for a word that holds it."""
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    whole = codec.peer.encode

    def other(given, **options):
        found = whole(given, **options)
        return [[*ids, 0] if text.strip() == "zyx" else ids for text, ids in zip(given, found, strict=True)] if isinstance(given, list) else found

    codec.peer = SimpleNamespace(encode=other)
    texts = ["zyx abc", "abc zyx", "abc zyx abc", "zyx", "abc", "", "azyx zyxa", "abc abc"]
    for _ in range(2):
        codec.encode(*W.text_arrays(pa.array(texts)))
        assert codec.same.tolist() == [False, False, False, False, True, True, True, True]
    codec.encode(*W.text_arrays(pa.array(["abc", "azyx"])))
    assert codec.same.tolist() == [True, True]
    codec.memory.reset()
    codec.encode(*W.text_arrays(pa.array(["abc", "zyx azyx"])))
    assert codec.same.tolist() == [True, False]


def test_places_of_a_hot_window_are_bounded():
    """A window in very many batches with many places each: output begins long before the input ends."""
    words = " ".join(f"w{i}" for i in range(13)).encode()
    read = 0

    def batches():
        nonlocal read
        for k in range(4000):
            place = np.zeros(500, substrings.PLACE)
            place["doc"] = np.arange(500) + 500 * k
            read += 1
            yield pa.RecordBatch.from_arrays([pa.array([7]), pa.array([500 * k]), pa.array([words]), pa.array([place.tobytes()])], ["key", "least", "words", "places"])

    out, docs = substrings._located(13)(batches()), set()
    docs.update(next(out).column(0).to_pylist())
    assert read * 500 * 16 <= 10 * substrings.SHARD
    for b in out:
        docs.update(b.column(0).to_pylist())
    assert docs == set(range(1, 2_000_000))
