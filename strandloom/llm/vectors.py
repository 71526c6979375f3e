"""Compression of vectors to codes: a codebook for each part, its nearest entry found in a GNAT, all in whole numbers.

A node of the tree has split points, and a child for each: the entries nearest to it. For every pair of split point and
child it stores the range of distances from the one to the entries of the other. A vector's distances to the split points
then rule children out: no entry of a child can be as near as the best one so far if the triangle inequality puts all of
them farther, strictly, with room for the roots' rounding. What is left is compared by exact squared distances, ties by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut, ship

#: Components are held to this, so that squares and their sums stay exact.
LARGEST = 1 << 28
#: Rows that go through the trees at once.
BLOCK = 1 << 13
SALTS = 16


@dataclass
class Gnat:
    """A geometric near-neighbour access tree over some entries of a codebook (rows of whole numbers)."""

    entries: np.ndarray
    numbers: np.ndarray
    splits: np.ndarray = field(init=False)
    children: list[Gnat | None] = field(init=False)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None, degree: int = 6):
        self.entries = entries
        own = np.arange(len(entries)) if numbers is None else numbers
        self.numbers = own
        # split points far from each other: each next one is the farthest from those before
        chosen = [0]
        far = _squares(entries[own], entries[own[:1]])[:, 0]
        while len(chosen) < min(degree, len(own)):
            nxt = int(far.argmax())
            if nxt in chosen:
                nxt = next(k for k in range(len(own)) if k not in chosen)
            chosen.append(nxt)
            far = np.minimum(far, _squares(entries[own], entries[own[nxt : nxt + 1]])[:, 0])
        self.splits = own[chosen]
        rest = np.delete(own, chosen)
        d = _squares(entries[rest], entries[self.splits])
        home = d.argmin(1) if len(rest) else np.zeros(0, np.int64)
        self.children, n = [], len(self.splits)
        self.low, self.high = np.zeros((n, n)), np.zeros((n, n))
        for j in range(n):
            at = np.flatnonzero(home == j)
            self.children.append(Gnat(entries, rest[at], degree) if len(at) else None)
            if len(at):
                root = np.sqrt(d[at].astype(float))
                self.low[:, j], self.high[:, j] = root.min(0), root.max(0)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of q; of equal ones the smallest index."""
        best, at = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), np.iinfo(np.int64).max)
        self._search(q, np.arange(len(q)), best, at)
        return at, best

    def _search(self, q: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        d = _squares(q[rows], self.entries[self.splits])
        for j, number in enumerate(self.splits):
            better = (d[:, j] < best[rows]) | (d[:, j] == best[rows]) & (number < at[rows])
            best[rows[better]], at[rows[better]] = d[better, j], number
        root = np.sqrt(d.astype(float))
        for j, child in enumerate(self.children):
            if child is None:
                continue
            r = np.sqrt(best[rows].astype(float))[:, None]
            # squares are below 2**62: a root is off by a 2**-52nd at most, a sum of two by little more
            room = (root + r + self.high[:, j]) * 1e-14
            out = (root - r > self.high[:, j] + room) | (root + r < self.low[:, j] - room)
            left = rows[~out.any(1)]
            if len(left):
                child._search(q, left, best, at)


def _squares(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to each of e."""
    out = np.zeros((len(q), len(e)), np.int64)
    for k in range(q.shape[1]):
        d = q[:, k, None] - e[None, :, k]
        out += d * d
    return out


def whole_numbers(col: pa.Array, scale: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, offsets, floor(scale * component)) of the vectors that have no null or non-finite component and are not empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(col.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep = (bad[ends] == bad[ends - size]) & (size > 0) if n else np.zeros(0, bool)
    values = np.clip(np.floor(scale * flat[np.repeat(keep, size)]), -LARGEST, LARGEST).astype(np.int64)
    return np.flatnonzero(keep), np.concatenate([[0], np.cumsum(size[keep])]), values


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(the rows kept, their whole numbers) of each batch: vectors of ``width`` components."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            rows, offs, values = whole_numbers(part.column(part.schema.get_field_index("embedding")), scale)
            fit = np.diff(offs) == width
            values = values[np.repeat(fit, np.diff(offs))].reshape(-1, width)
            if len(values):
                yield part.take(pa.array(rows[fit])), values


def _cut_at(width: int, parts: int) -> np.ndarray:
    """Where the parts begin and end: equal, or the first ones longer by one."""
    return np.cumsum([0, *(len(x) for x in np.array_split(np.arange(width), parts))])


def first_vectors(rows: DataFrame, n: int, scale: int = 256) -> list[tuple[int, list[int]]]:
    """(vec_id, whole numbers) of the n smallest vec_ids that are kept, ascending; each task sends its n smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, offs, values = whole_numbers(b.column(1), scale)
            ids = b.column(0).take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))
            few = pc.sort_indices(ids, null_placement="at_end")
            # ids that repeat at the edge all go on: the order among them is the vectors'
            edge = ids.take(few[n - 1 : n]).to_pylist() if len(few) >= n else [None]
            few = few if edge[0] is None else few.filter(pc.less_equal(ids.take(few), edge[0]))
            yield pa.RecordBatch.from_arrays([ids.take(few), lists.take(few)], ["vec_id", "v"])

    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v array<long>").filter("vec_id is not null")
    return [(r["vec_id"], r["v"]) for r in found.orderBy("vec_id", "v").limit(n).collect()]


def _trees(books: list[np.ndarray]) -> list[Gnat]:
    return [Gnat(b) for b in books]


def _sums(books: list[np.ndarray], ends: np.ndarray, scale: int) -> Callable:
    """A task's sums and counts of the parts nearest to each entry: a row for each part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, n = _trees(books), len(books[0])
        count = np.zeros((len(books), n), np.int64)
        total = [np.zeros(b.shape, np.int64) for b in books]
        for _, values in _blocks(batches, int(ends[-1]), scale):
            for p, tree in enumerate(trees):
                part = values[:, ends[p] : ends[p + 1]]
                at, _ = tree.nearest(part)
                count[p] += np.bincount(at, minlength=n)
                np.add.at(total[p], at, part)
        out = [(p, e, int(count[p, e]), k, int(total[p][e, k])) for p in range(len(books)) for e in np.flatnonzero(count[p]) for k in range(total[p].shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["part", "entry", "n", "place", "total"])

    return run


def learned(rows: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> tuple[list[np.ndarray], np.ndarray]:
    """(codebooks, where parts begin and end). What comes to the driver is sums for parts x size entries, whatever the rows."""
    first = first_vectors(rows, size, scale)
    if not first:
        return [], np.zeros(0, np.int64)
    width = len(first[0][1])
    ends = _cut_at(width, parts)
    start = np.array([v for _, v in first if len(v) == width], np.int64)
    books = [start[:, a:b].copy() for a, b in zip(ends, ends[1:], strict=False)]
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_sums(books, ends, scale), "part long, entry long, n long, place long, total long")
        # a task's sums fit 64 bits, those of all tasks may not
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books, ends


def digest(books: list[np.ndarray]) -> str:
    """The sha256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes every vector; returns vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x). Codebooks start as the parts of the ``size`` smallest vec_ids and move ``rounds`` times to
    the floor of the mean of the parts nearest to each entry; unused entries stay. code: the nearest entry of each part, two hex
    digits each; error: the squared distances of all parts; label_error: the errors of all rows with that label.

    Null vectors, empty ones, those with a null or non-finite component, and those of another length than the first kept row's
    have no row. If parts can't be equal the first ones are longer by one. Components beyond 2**28 after scaling count as that. A
    null vec_id starts no codebook, and its row is coded. Of repeated vec_ids the smaller vectors start first; each row is coded.
    Fewer rows than ``size``: so many entries. Null labels are one label. No rows kept: no rows. Other columns are ignored.
    """
    if not 0 < size <= 256:
        raise ValueError("an entry's number has two hex digits")
    ship(rows.sparkSession)
    rows = rows.select("vec_id", "embedding", "label")
    kinds = dict(rows.dtypes)
    books, ends = learned(rows, parts, size, rounds, scale)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for b, values in _blocks(batches, int(ends[-1]), scale) if trees else ():
            code, error = np.zeros((len(values), len(trees)), np.uint8), np.zeros(len(values), np.int64)
            for p, tree in enumerate(trees):
                at, d = tree.nearest(values[:, ends[p] : ends[p + 1]])
                code[:, p] = at
                error += d
            whole = code.tobytes().hex()
            step = 2 * len(trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([whole[k : k + step] for k in range(0, len(whole), step)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = cut(rows.mapInArrow(run, schema))
    # a label that very many rows have is dealt over so many keys
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    dealt = coded.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    out = dealt.join(sums, dealt["label"].eqNullSafe(sums["of"]) & (dealt["salt"] == sums["s"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
