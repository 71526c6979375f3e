"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases of a few symbols each, and the phrases, named by hashes, are parsed again, level
by level. Where a phrase ends is decided by deterministic coin tossing: each symbol is replaced by the position and
value of the lowest bit in which it differs from the one before it, three times over, which leaves fewer than eight
labels with no two equal neighbours; a phrase begins at each local minimum. Runs of one symbol are a phrase of their
own. A decision sees only a few symbols to either side, so equal substrings have equal phrases inside, wherever they
stand. A fingerprint has, for each of its slots, the smallest hash of all phrase names of the levels it is taken from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.session import ship

LEVELS, TAKEN, SLOTS = 4, (2, 3, 4), 64


def _toss_table() -> np.ndarray:
    """For two different bytes (before, symbol): twice the lowest differing bit's position, plus the symbol's bit there."""
    a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    low = np.zeros((256, 256), np.uint8)
    for bit in range(7, -1, -1):
        low[((a ^ b) >> bit) & 1 == 1] = bit
    return (2 * low + ((b >> low) & 1)).astype(np.uint8).reshape(-1)


_TOSS = _toss_table()


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin. symbols: bytes; first: the index of each text's first symbol, in order, all different."""
    n = len(symbols)
    begin = np.zeros(n, bool)
    begin[first] = True
    new = np.empty(n, bool)  # the first of a run of equal symbols
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new |= begin
    at = np.flatnonzero(new)
    s = symbols[at]
    head = begin[at]
    length = np.diff(np.append(at, n))
    label = s
    for _ in range(3):
        before = np.empty_like(label)
        before[0] = 0
        before[1:] = label[:-1]
        before[head] = label[head] ^ 1
        same = before == label  # cannot be within a text, by construction, but for the first labels of one
        before[same] ^= 1
        label = _TOSS[(before.astype(np.uint16) << 8) | label]
    left = np.empty_like(label)
    left[0] = 255
    left[1:] = label[:-1]
    left[head] = 255
    right = np.empty_like(label)
    right[-1] = 255
    right[:-1] = label[1:]
    right[:-1][head[1:]] = 255
    run = length > 1
    after_run = np.empty(len(at), bool)
    after_run[0] = False
    after_run[1:] = run[:-1]
    starts = head | run | after_run | ((label < left) & (label <= right))
    return at[starts]


def name_phrases(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each phrase, from the names and the order of its symbols."""
    ends = np.append(starts[1:], len(names))
    up, down = W.powers(len(names) + 1)
    total = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * up[: len(names)], out=total[1:])
    return W.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTE = W.mix(np.arange(1, 257, dtype=np.uint64))


def signatures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of SLOTS uint16s for each text. An empty text has a row of its own kind."""
    n = len(offs) - 1
    low = np.full((n, SLOTS), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        first, names, symbols = offs[:-1][full], _BYTE[data], data
        for level in range(1, LEVELS + 1):
            starts = phrase_starts(symbols, first)
            names = name_phrases(names, starts)
            symbols = (names >> np.uint64(56)).astype(np.uint8)
            first = np.searchsorted(starts, first)
            if level in TAKEN:
                _lowest(names, first, full, low, level)
        # the whole text is a phrase too, so that short texts have one
        whole = W.span_hashes(data, offs[:-1][full], offs[1:][full])
        _lowest(whole, np.arange(len(full)), full, low, 0)
    return (W.mix(low.reshape(-1)) >> np.uint64(48)).astype(np.uint16).reshape(n, SLOTS)


def _lowest(names: np.ndarray, first: np.ndarray, full: np.ndarray, low: np.ndarray, level: int) -> None:
    """One permutation: each name falls into the slot of its high bits, of which every slot keeps the least."""
    own = W.mix(names + np.uint64(level))
    text = np.zeros(len(own), np.int64)
    text[first[1:]] = 1
    cell = full[np.cumsum(text)] * SLOTS + (own >> np.uint64(58)).astype(np.int64)
    value = own << np.uint64(6)
    order = np.lexsort((value, cell))
    c = cell[order]
    head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    flat = low.reshape(-1)
    flat[c[head]] = np.minimum(flat[c[head]], value[order][head])


#: What an empty slot becomes.
EMPTY = int(W.mix(np.array([np.iinfo(np.uint64).max], np.uint64))[0] >> np.uint64(48))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: of the slots that either has filled, the share that is equal; 1 for two empty ones."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(1)
    return np.where(n == 0, 1.0, ((a == b) & used).sum(1) / np.maximum(n, 1))


def _hex(sig: np.ndarray) -> list[str]:
    flat = sig.astype(">u2").tobytes().hex()
    return [flat[i : i + SLOTS * 4] for i in range(0, len(flat), SLOTS * 4)]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, doc_id); the last of each bucket is the next bucket's first text and gives no row."""

    def finish(ids: list, texts: list) -> pa.RecordBatch:
        """Rows for all texts but the last."""
        edited = []
        for t, nxt in zip(texts[:-1], texts[1:], strict=True):
            q = len(t) // 4
            edited.append(t[: len(t) - q] + nxt[:q])
        own = signatures(*W.text_arrays(pa.array(texts, pa.large_string())))
        new = signatures(*W.text_arrays(pa.array(edited, pa.large_string())))
        sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        cols = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(sha), pa.array(_hex(own[:-1])), pa.array(_hex(new)), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))]
        return pa.RecordBatch.from_arrays(cols, NAMES)

    ids: list = []
    texts: list = []
    size, bucket = 0, None
    for b in W.pieces(batches, "text", 1 << 20):
        for k, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != bucket:
                if len(ids) > 1:
                    yield finish(ids, texts)
                ids, texts, size, bucket = [], [], 0, k
            ids.append(i)
            texts.append(t or "")
            size += len(t or "")
            if size > 1 << 20 and len(ids) > 1:
                yield finish(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield finish(ids, texts)


def fingerprints(docs: DataFrame, buckets: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text, and its edited text: the last quarter replaced by the beginning of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is
    that of the next greater key, and after the last the first. Null text: empty. Null keys come first and repeated keys
    stand side by side in the order of their texts. One document alone is its own next. Empty table: no rows. Other
    columns are ignored.

    Texts move once, to buckets of neighbouring keys; each bucket also gets the first text of the next one.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edges = docs.select(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("e")).first()["e"]
    edges = sorted(set(edges or []))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("k"))) if edges else F.lit(0)
    ranged = docs.withColumn("bucket", at)
    # the first row of each bucket that has any, as (k, text hash): at most one for each bucket
    order = F.struct("k", F.xxhash64("text").alias("h"))
    heads = sorted((r["bucket"], r["o"]["k"], r["o"]["h"]) for r in ranged.groupBy("bucket").agg(F.min(order).alias("o")).collect())
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    first = spark.createDataFrame([(k, h, heads[i - 1][0]) for i, (_, k, h) in enumerate(heads)], "k long, h long, before int")
    ranged = ranged.withColumn("h", F.xxhash64("text"))
    # one copy of each head (of equal rows any) closes the bucket before it
    tails = ranged.join(F.broadcast(first), ["k", "h"]).dropDuplicates(["k", "h"]).select(F.col("before").alias("bucket"), "k", "doc_id", "text", "h", F.lit(1).alias("tail"))
    rows = ranged.select("bucket", "k", "doc_id", "text", "h", F.lit(0).alias("tail")).unionByName(tails)
    return (
        rows.repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "tail", "k", "h")
        .select("bucket", "doc_id", "text")
        .mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
