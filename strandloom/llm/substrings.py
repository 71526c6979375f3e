"""Substring dedup: passages that recur across documents are confirmed, compiled into sharded Aho-Corasick automata, and
located by streaming all documents through them.

A window is ``n`` consecutive words of a document. Four passes:

1. Anchors. Of each window's inner runs of ``ANCHOR`` words the one with the smallest hash is its anchor, so equal
   windows have equal anchors. Anchors that documents share go into a Bloom filter, whose size follows from their number
   up to a bound; a fuller filter costs time and no result.
2. Stretches. Neighbouring windows with one shared anchor are a stretch of words, which travels to the anchor's shard,
   once for each batch of texts, with the places where the batch has it. An anchor of very many stretches is cut: each of
   its windows is a stretch of its own and goes to the shard of its hash.
3. Automata. A shard confirms, word by word, which windows stand in several documents, and which is the first of them;
   runs of them with one first document are its phrases. They are compiled into an automaton (pyahocorasick, over word
   numbers), all stretches of the shard are streamed through it, and each occurrence in a document beyond the phrase's
   first one is told to that document.
4. Texts and told occurrences meet by document, and the words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm import bloom
from strandloom.llm import words as W
from strandloom.session import cut, ship

ANCHOR = 5
#: Windows in a stretch; rows that an anchor may send before it is cut; bytes of a shard's words and places.
LONG, HOT, SHARD = 64, 1024, 3 << 19
#: Least and most bits of the filter of shared anchors (32 MB).
FILTER = (1 << 20, 1 << 28)
#: Where a stretch stands: the row's document and hash, and its first word's number there.
PLACE = np.dtype([("doc", "<i8"), ("h", "<i4"), ("pos", "<i4")])


def _anchors_of(text: pa.Array, n: int):
    """(at, anchor, words): the first word of each window, its anchor's hash, and (data, start, end, ptr, hashes) of the words."""
    data, offs = W.text_arrays(text)
    start, end, ptr = W.word_spans(data, offs)
    h = W.span_hashes(data, start, end)
    size = min(ANCHOR, n)
    run_at, run = W.run_hashes(h, ptr, size)
    low = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    low[run_at] = run
    wide, need = 1, n - size + 1
    while wide * 2 <= need:
        low = np.minimum(low[: len(low) - wide], low[wide:])
        wide *= 2
    if rest := need - wide:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    last = np.repeat(ptr[1:], np.diff(ptr))
    at = np.flatnonzero(np.arange(len(h)) + n <= last)
    return at, low[at], (data, start, end, ptr, h)


def _heads(at: np.ndarray, anchor: np.ndarray, single: np.ndarray | None = None) -> np.ndarray:
    """Which windows begin a stretch: neighbours with one anchor are in one, LONG of them at most; ``single`` ones stand alone."""
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)]
    if single is not None:
        new |= single
    heads = np.flatnonzero(new)
    return np.flatnonzero((np.arange(len(at)) - heads[np.cumsum(new) - 1]) % LONG == 0)


def _anchors(n: int):
    """(anchor, n): how many different stretches of a batch an anchor has, or 2 at least if several documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text", 2 << 20):
            at, anchor, (_, _, _, ptr, h) = _anchors_of(b.column(2), n)
            heads = _heads(at, anchor)
            last = np.concatenate([heads[1:], [len(at)]]) - 1 if len(at) else heads
            stretch = W.part_hashes(h, at[heads], at[last] + n)
            anchor, doc = anchor[heads], b.column(0).to_numpy(zero_copy_only=False)[W.owners(ptr)[at[heads]]]
            order = np.lexsort((stretch, anchor))
            a, x, d = anchor[order], stretch[order], doc[order]
            new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            rows = np.add.reduceat((new | np.concatenate([[True], x[1:] != x[:-1]])).astype(np.int64), first)
            apart = np.maximum.reduceat(d, first) > np.minimum.reduceat(d, first)
            yield pa.RecordBatch.from_arrays([W.int64(a[first]), W.int64(np.maximum(rows, 1 + apart))], ["anchor", "n"])

    return run


def _stretches(n: int, shared, hot):
    """Texts to (key, least, words, places): a row for each different stretch of a batch; least is its first document there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, often = np.frombuffer(shared.value, np.uint64), np.frombuffer(hot.value, np.uint64)
        for b in W.pieces(batches, "text", 2 << 20):
            at, anchor, (data, start, end, ptr, h) = _anchors_of(b.column(2), n)
            may = bloom.passes(filt, anchor)
            at, anchor = at[may], anchor[may]
            if not len(at):
                continue
            single = bloom.passes(often, anchor)
            key = anchor.copy()
            run_hash = np.zeros(int(single.sum()), np.uint64)
            for j in range(n):
                run_hash = run_hash * np.uint64(W._ODD) + h[at[single] + j]
            key[single] = W.mix(run_hash)
            heads = _heads(at, anchor, single)
            last = np.concatenate([heads[1:], [len(at)]]) - 1
            body, offs = W.spaced(data, start, end)
            lo, hi = offs[at[heads]], offs[at[last] + n] - 1  # without the last word's space
            flat, ends = W.slices(body, lo, hi - lo)
            same = W.blobs(flat, ends).dictionary_encode()
            code = same.indices.to_numpy()
            own = W.owners(ptr)[at[heads]]
            place = np.zeros(len(heads), PLACE)
            place["doc"], place["h"] = (b.column(c).to_numpy(zero_copy_only=False)[own] for c in (0, 1))
            place["pos"] = at[heads] - ptr[own]
            order = np.lexsort((place["doc"], code))
            code, place = code[order], place[order]
            first = np.searchsorted(code, np.arange(len(same.dictionary) + 1))
            yield pa.RecordBatch.from_arrays([W.int64(key[heads][order][first[:-1]]), W.int64(place["doc"][first[:-1]]), same.dictionary, W.blobs(place, first)], ["key", "least", "words", "places"])

    return run


def confirmed(number: np.ndarray, ptr: np.ndarray, least: np.ndarray, most: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, window, first) of the windows that stand in more than one document.

    number: the words of all stretches, equal words alike; stretch i has ptr[i]:ptr[i + 1] and stands in documents from
    least[i] to most[i]. at: a window's first word; window: equal for equal windows; first: its first document.
    """
    at, h = W.run_hashes(W.mix(number.astype(np.uint64)), ptr, n)
    _, head, window = np.unique(h, return_index=True, return_inverse=True)
    if not len(at):
        return at, window, np.zeros(0, np.int64)
    if not all((number[at + j] == number[at[head[window]] + j]).all() for j in range(n)):
        # two windows of one hash: by the words themselves
        body = np.stack([number[at + j] for j in range(n)], 1)
        _, head, window = np.unique(body, axis=0, return_index=True, return_inverse=True)
        window = window.reshape(-1)
    own = W.owners(ptr)[at]
    first = np.full(len(head), np.iinfo(np.int64).max)
    last = np.full(len(head), np.iinfo(np.int64).min)
    np.minimum.at(first, window, least[own])
    np.maximum.at(last, window, most[own])
    keep = (last > first)[window]
    return at[keep], window[keep], first[window[keep]]


def phrases(number: np.ndarray, at: np.ndarray, first: np.ndarray, n: int) -> dict[bytes, int]:
    """The words of each run of neighbouring confirmed windows with one first document, and that document (the least)."""
    if not len(at):
        return {}
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1]), [True]]))
    found: dict[bytes, int] = {}
    for s, e, f in zip(at[edge[:-1]].tolist(), (at[edge[1:] - 1] + n).tolist(), first[edge[:-1]].tolist(), strict=True):
        found.setdefault(number[s:e].tobytes(), f)
    return found


def automaton(found: dict[bytes, int]) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray]:
    """(automaton, length of each phrase, its first document); the automaton gives a phrase's number."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    size = np.zeros(len(found), np.int64)
    for k, body in enumerate(found):
        words = np.frombuffer(body, np.int32)
        auto.add_word(tuple(words.tolist()), k)
        size[k] = len(words)
    auto.make_automaton()
    return auto, size, np.fromiter(found.values(), np.int64, len(found))


def _merged(doc: np.ndarray, h: np.ndarray, pos: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """(doc_id, h, pos, size): occurrences of one text that overlap or touch as one."""
    order = np.lexsort((pos, h, doc))
    doc, h, pos, size = doc[order], h[order], pos[order].astype(np.int64), size[order].astype(np.int64)
    if len(doc):
        text = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
        # with the text's number on top, ends of earlier texts are before all of a later one
        begin = (text << 32) + pos
        till = np.maximum.accumulate(begin + size)
        new = np.concatenate([[True], begin[1:] > till[:-1]])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        doc, h, pos, size = doc[first], h[first], pos[first], till[last] - begin[first]
    return pa.RecordBatch.from_arrays([W.int64(doc), pa.array(h), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc_id", "h", "pos", "size"])


def _located(n: int):
    """Rows of a shard in order of (key, least) to (doc_id, h, pos, size): the occurrences that are to go."""

    def shard(words: pa.Array, places: pa.Array) -> pa.RecordBatch:
        data, offs = W.text_arrays(words)
        start, end, ptr = W.word_spans(data, offs)
        body = data[data != 32]
        cuts = np.concatenate([[0], np.cumsum(end - start)])
        number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(body)]).dictionary_encode().indices.to_numpy().astype(np.int32) + np.int32(1)
        raw = places.cast(pa.large_binary())
        edge = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        place = np.frombuffer(raw.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(PLACE)
        edge = (edge - edge[0]) // PLACE.itemsize
        at, _, first = confirmed(number, ptr, np.minimum.reduceat(place["doc"], edge[:-1]), np.maximum.reduceat(place["doc"], edge[:-1]), n)
        found = phrases(number, at, first, n)
        ends = which = np.zeros(0, np.int64)
        if found:
            auto, size, doc = automaton(found)
            # one sequence of all stretches, with a number that no word has between them
            line = np.zeros(len(number) + len(ptr) - 1, np.int32)
            line[np.arange(len(number)) + W.owners(ptr)] = number
            hits = np.fromiter(chain.from_iterable(auto.iter(tuple(line.tolist()))), np.int64)
            ends, which = hits[0::2], hits[1::2]
        else:
            size = doc = np.zeros(0, np.int64)
        row = np.searchsorted(ptr[1:] + np.arange(len(ptr) - 1), ends, "left") if len(ends) else ends
        begin = ends - row - ptr[row] - size[which] + 1
        many = (edge[1:] - edge[:-1])[row]
        each, _ = W.slices(place, edge[row], many)
        late = each["doc"] > np.repeat(doc[which], many)
        pos = each["pos"] + np.repeat(begin, many)
        return _merged(each["doc"][late], each["h"][late], pos[late], np.repeat(size[which], many)[late])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.kept.clear()
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def given(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            return shard(t.column(2).combine_chunks().cast(pa.large_binary()).view(pa.large_string()), t.column(3).combine_chunks())

        for b in batches:
            key = b.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])) if len(key) else []
            more = np.cumsum(weight(b)) if len(key) else []
            at = 0
            for k in heads:
                before = int(more[k - 1]) if k else 0
                if size + before - (int(more[at - 1]) if at else 0) > SHARD and (held or k > at):
                    yield given([*held, b.slice(at, k - at)])
                    held, size, at = [], 0, int(k)
            if len(key):
                held.append(b.slice(at))
                size += int(more[-1]) - (int(more[at - 1]) if at else 0)
                last = key[-1]
                if size > 8 * SHARD:
                    # a key of very many batches, all with one stretch: go on with its first row, which has the first document
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield given([whole])
                    keep = _firsts(whole, last)
                    held, size = [keep], int(weight(keep).sum())
        if held:
            yield given(held)

    return run


def weight(b: pa.RecordBatch) -> np.ndarray:
    """The bytes of each row's words and places."""
    return sum(pc.binary_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))


def _firsts(b: pa.RecordBatch, key: int) -> pa.RecordBatch:
    """The first row of each different stretch of a key; b is in order of (key, least)."""
    b = b.filter(pa.array(b.column(0).to_numpy() == key))
    code = b.column(2).dictionary_encode().indices.to_numpy()
    return b.take(pa.array(np.unique(code, return_index=True)[1]))


def _removed(n: int, give_text: bool, carried: list):
    """Rows in order of (doc_id, h, kind): a row's texts, then the occurrences told to it."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text", *(c for c, _ in carried)] if give_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string(), *(t for _, t in carried)] if give_text else [])]

    def group(docs: list) -> pa.RecordBatch:
        data, offs = W.text_arrays(pa.array([d[1] or "" for d in docs], pa.large_string()))
        start, end, ptr = W.word_spans(data, offs)
        step = np.zeros(len(start) + 1, np.int64)
        for i, (_, _, told, _) in enumerate(docs):
            for pos, size in told:
                np.add.at(step, ptr[i] + pos, 1)
                np.add.at(step, ptr[i] + pos + size, -1)
        keep = np.cumsum(step[:-1]) == 0
        body, at = W.spaced(data, start, end)
        kept = body[np.repeat(keep, np.diff(at))].tobytes()
        till = np.concatenate([[0], np.cumsum(np.where(keep, np.diff(at), 0))])[ptr].tolist()
        n_words, n_kept = np.diff(ptr), np.diff(np.concatenate([[0], np.cumsum(keep)])[ptr])
        left = [kept[s : max(s, e - 1)] for s, e in zip(till[:-1], till[1:], strict=True)]
        cols = [[d[0] for d in docs], n_words, n_words - n_kept, [hashlib.sha256(x).hexdigest() for x in left]]
        if give_text:
            cols += [[d[1] if a == k else x.decode() for d, x, a, k in zip(docs, left, n_words.tolist(), n_kept.tolist(), strict=True)], *zip(*(d[3] for d in docs), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # (doc, text, occurrences, carried) of texts whose occurrences have all come
        texts: list = []  # of the row being read
        told: list = []
        here, size = None, 0

        def close() -> int:
            held.extend((d, t, tuple(told), x) for d, t, x in texts)
            more = sum(len(t or "") for _, t, _ in texts)
            texts.clear()
            told.clear()
            return more

        for b in batches:
            if not b.num_rows:
                continue
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc, h, kind = pc.fill_null(b.column(0), 0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            pos, wide = (pc.fill_null(b.column(c), 0).to_numpy() for c in (4, 5))
            # rows without a document number are documents of their own
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | null[1:]])
            edge = np.append(np.flatnonzero(new), b.num_rows).tolist()
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                own = None if null[s] else (int(doc[s]), int(h[s]))
                if own is None or own != here:
                    size += close()
                    here = own
                    if size > 2 << 20:
                        yield group(held)
                        held, size = [], 0
                mid = s + int(np.searchsorted(kind[s:e], 1))
                for i in range(s, mid):
                    texts.append((None if own is None else own[0], b.column(3)[i].as_py(), tuple(b.column(c)[i].as_py() for c in range(6, b.num_columns))))
                if e > mid:
                    told.append((pos[mid:e], wide[mid:e]))
        close()
        if held:
            yield group(held)

    return run


def occurrences(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, pos, size): where rows (doc_id, h, text) have words that a document with a smaller doc_id has too, as
    the automata of all shards tell; n words or more each, and perhaps some twice."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select("doc_id", "h", "text")
    met = cut(docs.mapInArrow(_anchors(n), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"))
    bits = min(FILTER[1], max(FILTER[0], 1 << (16 * met.count()).bit_length()))
    shared, hot = bloom.build(met, F.col("anchor"), bits), bloom.build(met.filter(F.col("n") > HOT), F.col("anchor"), FILTER[0])
    sent = docs.mapInArrow(_stretches(n, shared, hot), "key long, least long, words binary, places binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "key").sortWithinPartitions("key", "least").mapInArrow(_located(n), "doc_id long, h int, pos int, size int")


def substring_dedup(docs: DataFrame, n: int = 13, give_text: bool = False, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word covered by an n-word window that also begins in a document with a smaller key.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); with ``give_text`` also
    text: the input text where nothing is removed, else the kept words joined by one space; and the columns ``carry``,
    whose names are none of those. Words are runs without ASCII white space. Null and empty texts have no word. A row
    without a key removes nothing and loses nothing. Rows are judged each by its own text: rows with one key, equal or
    not, are none the other's first document. Empty table: no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    carry = tuple(carry) if give_text else ()
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.hash(text).alias("h"), F.col(text).alias("text"), *carry)
    told = occurrences(docs.select("doc_id", "h", "text"), n)
    kinds = [docs.schema[c].dataType for c in carry]
    none = lambda t: F.lit(None).cast(t)
    both = docs.select("doc_id", "h", F.lit(0).alias("kind"), "text", none("int").alias("pos"), none("int").alias("size"), *(F.col(c).alias(f"_{c}") for c in carry)).unionByName(
        told.select("doc_id", "h", F.lit(1).alias("kind"), none("string").alias("text"), "pos", "size", *(none(t).alias(f"_{c}") for c, t in zip(carry, kinds, strict=True)))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = (", text string" + "".join(f", `{c}` {t.simpleString()}" for c, t in zip(carry, kinds, strict=True))) if give_text else ""
    carried = [(c, to_arrow_type(t)) for c, t in zip(carry, kinds, strict=True)]
    return (
        both.repartition(parts, F.coalesce("doc_id", F.xxhash64("text")), "h")
        .sortWithinPartitions("doc_id", "h", "kind")
        .mapInArrow(_removed(n, give_text, carried), f"doc_id long, n_words long, n_removed long, kept_sha256 string{more}")
    )
