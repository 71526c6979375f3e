"""Benchmark decontamination: n-gram seeds find candidates, Smith-Waterman alignment scores them.

A seed is three lower-cased words of a test item that stand together, or with one word left out between them (``SHAPES``);
it is told by its words alone, so one replaced, added or missing word in every three does not hide it. Where no words were
added or left out, an alignment of the least score 0.4 keeps six words in ten, and so many cannot avoid all shapes. All
seeds count, however many documents have them: a leak makes its own seeds common. A document with two seeds of an item
near one diagonal is aligned with it there, word by word; the score is the alignment's, as a share of the item's own. A
place that has too few of the item's words to reach the least score is not aligned, and equal places are aligned once.

Items come in blocks of a bounded number of bytes, each broadcast and held against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.session import ship

SEED = 3
#: The words of a seed, by their distance from the first.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Bits of the table that tells most words' runs apart from seeds.
TABLE = 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Places of seeds that are looked at together, and alignments that a task remembers.
PLACES, KNOWN = 1 << 20, 1 << 14


def shaped(h: np.ndarray, ptr: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(at, hash) of the words of a shape at each word where it fits into its text; the hash is of the words alone."""
    n, wide = len(h), shape[-1] + 1
    if n < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n - wide + 1, len(shape), np.uint64)
    for j in shape:
        out = out * np.uint64(W._ODD) + h[j : n - wide + 1 + j]
    last = np.repeat(ptr[1:], np.diff(ptr))
    at = np.flatnonzero(np.arange(n - wide + 1) + wide <= last[: n - wide + 1])
    return at, W.mix(out[at])


class Items:
    """A block of items: their words' hashes, and their seeds in order of the hash."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        data, offs = W.text_arrays(pa.array([t or "" for _, t in rows], pa.large_string()))
        data = W.LOWER[data]
        start, end, ptr = W.word_spans(data, offs)
        self.h, self.ptr, self.ids = W.span_hashes(data, start, end), ptr, [i for i, _ in rows]
        n = np.diff(ptr)
        item, pos, seed = [], [], []
        # an item of SEED words or fewer has one seed, all its words
        short = [(tuple(range(k)), k) for k in range(1, SEED) if (n == k).any()]
        self.shapes = [s for s, _ in short] + list(SHAPES)
        for shape, k in [*short, *((s, None) for s in SHAPES)]:
            at, s = shaped(self.h, ptr, shape)
            own = W.owners(ptr)[at]
            keep = n[own] == k if k else n[own] >= SEED
            item.append(own[keep])
            pos.append((at - ptr[own])[keep])
            seed.append(s[keep])
        item, pos, seed = (np.concatenate(x) for x in (item, pos, seed))
        self.seeds, number = np.unique(seed, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.item, self.pos, self.number = item[order], pos[order], number[order]
        self.first = np.searchsorted(self.number, np.arange(len(self.seeds) + 1))
        self.may = np.zeros(1 << TABLE, bool)
        self.may[self.seeds >> np.uint64(64 - TABLE)] = True

    def found(self, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, seed number) of each seed in texts with words h."""
        words, seeds = [], []
        for shape in self.shapes:
            at, s = shaped(h, ptr, shape)
            may = self.may[s >> np.uint64(64 - TABLE)]
            at, s = at[may], s[may]
            where = np.minimum(np.searchsorted(self.seeds, s), len(self.seeds) - 1)
            hit = self.seeds[where] == s
            words.append(at[hit])
            seeds.append(where[hit])
        return np.concatenate(words), np.concatenate(seeds)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(score, start, end): the best local alignment of two word sequences; the score is a share of the item's own."""
    best, end = _forward(item, text)
    if best <= 0:
        return 0.0, 0, 0
    _, length = _forward(item[::-1], text[:end][::-1], best)
    return best / (MATCH * len(item)), end - length, end


def _forward(item: np.ndarray, text: np.ndarray, want: int | None = None) -> tuple[int, int]:
    """(best score, where it ends in text), the first if several; or where ``want`` is first reached."""
    slope = -GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.max())
        if top > best or want is not None and top == want and best == want and int(row.argmax()) < end:
            best, end = top, int(row.argmax())
    return best, end


def regions(doc_pos: np.ndarray, item_pos: np.ndarray, n: int, total: int, need: int) -> list[tuple[int, int, int]]:
    """(start, end, seeds) of the parts of a text to align with an item of n words: seeds near one diagonal, close to each other."""
    diagonal = doc_pos - item_pos
    order = np.argsort(diagonal, kind="stable")
    reach = max(4, n // 2)
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(diagonal[order]) > reach) + 1):
        d, p = diagonal[part], item_pos[part]
        if len(np.unique(p)) >= need:
            out.append((max(0, int(d.min()) - reach), min(total, int(d.max()) + n + reach), len(np.unique(p))))
    return out


def parts(many: np.ndarray, own: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of seeds found with about ``most`` places together, each with whole texts; own ascends."""
    ends, at = np.cumsum(many), 0
    while at < len(many):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        to = int(np.searchsorted(own, own[to], "left")) if to < len(own) else to
        if to <= at:
            to = int(np.searchsorted(own, own[at], "right"))
        yield at, to
        at = to


def _aligned(block, least: float):
    names = ["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        known: dict[tuple[int, bytes], tuple[float, int, int]] = {}

        def scored(k: int, words: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
            name = (k, text.tobytes())
            if name not in known:
                if len(known) >= KNOWN:
                    known.clear()
                # no alignment matches more words than those that the text has
                able = np.isin(words, text).sum() / len(words) >= least
                known[name] = align(words, text) if able else (0.0, 0, 0)
            return known[name]

        for b in W.pieces(batches, "text"):
            data, offs = W.text_arrays(b.column(1))
            data = W.LOWER[data]
            start, end, ptr = W.word_spans(data, offs)
            h = W.span_hashes(data, start, end)
            hits, seeds = items.found(h, ptr)
            order = np.argsort(hits, kind="stable")
            hits, seeds = hits[order], seeds[order]
            owner = W.owners(ptr)
            rows = []
            for x0, x1 in parts(items.first[seeds + 1] - items.first[seeds], owner[hits], PLACES):
                at, seed = hits[x0:x1], seeds[x0:x1]
                # each occurrence of a seed, for each item that has it
                many = items.first[seed + 1] - items.first[seed]
                entry = np.repeat(items.first[seed] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                at = np.repeat(at, many)
                own, item = owner[at], items.item[entry]
                order = np.lexsort((item, own))
                at, entry, own, item = at[order], entry[order], own[order], item[order]
                cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (item[1:] != item[:-1]), [True]]))
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    i, k = int(own[s]), int(item[s])
                    words = items.h[items.ptr[k] : items.ptr[k + 1]]
                    need = 2 if len(words) > SEED else 1
                    if e - s < need:
                        continue
                    text = h[ptr[i] : ptr[i + 1]]
                    best = None
                    for lo, hi, n in regions(at[s:e] - ptr[i], items.pos[entry[s:e]], len(words), len(text), need):
                        score, x, y = scored(k, words, text[lo:hi])
                        if best is None or score > best[0]:
                            best = (score, n, lo + x, lo + y)
                    if best and best[0] >= least:
                        rows.append((b.column(0)[i].as_py(), items.ids[k], *best))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, block: int = 8 << 20, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each document and item whose alignment scores ``least`` at all: doc_id, item_id, score, n_seeds, start_word, end_word.

    The words from start_word to end_word (excluded) of the text are the best aligned ones. Null, empty and wordless
    texts and items match nothing. An item of SEED words or fewer has one seed, all its words. ``block``: about so many
    bytes of items are held against the documents in one pass; a longer item has its own. Repeated documents or items: a
    row for each. Null keys are kept as null. Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    schema = "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long"
    out, part, size = None, [], 0

    def against(part: list) -> DataFrame | None:
        items = Items(part)
        if not len(items.seeds):
            return None
        return rows.mapInArrow(_aligned(spark.sparkContext.broadcast(items), least), schema)

    for r in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        more = len((r["t"] or "").encode())
        if part and size + more > block:
            got = against(part)
            part, size = [], 0
            out = got if out is None else out if got is None else out.unionByName(got)
        part.append((r["i"], r["t"]))
        size += more
    if part and (got := against(part)) is not None:
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)
