"""Token ids in wavelet matrices, one a shard: succinct bit-planes with rank and select.

A shard's ids, 16 bits each, are stored plane by plane from the highest bit; after each plane the ids with a 0 there come
before those with a 1, both in order. With the counts of ones before every 512 bits that gives, without unpacking:
``access`` to any position, ``rank`` (how often an id occurs before a position) and ``select`` (where it occurs). The
planes, the counts and the documents' lengths are one record of a file, written and read by Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens as T
from strandloom.llm import words as W
from strandloom.session import ship, written

MAGIC, BLOCK, END = b"WVM1", 512, 1
#: Ids that a plane is sorted by at once, so that they stay in a core's memory; bytes of text that are encoded together.
CACHED, PIECE = 1 << 16, 2 << 20
LEAST = -(1 << 63)


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        """planes: bits x bytes, packed, lowest bit first; zeros: of each plane; ones: before each block of each plane."""
        self.n, self.bits, self.planes, self.zeros, self.ones = n, bits, planes, zeros, ones

    @classmethod
    def of(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        n = len(ids)
        wide = -(-n // BLOCK) * BLOCK // 8
        planes, zeros = np.zeros((bits, wide), np.uint8), np.zeros(bits, np.int64)
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits):
            one = (ids >> ids.dtype.type(bits - 1 - level) & ids.dtype.type(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes[level, : len(packed)] = packed
            zeros[level] = n - np.count_nonzero(one)
            new, low, high = np.empty_like(ids), 0, int(zeros[level])
            for s in range(0, n, CACHED):
                own, bit = ids[s : s + CACHED], one[s : s + CACHED]
                up, down = own[bit], own[~bit]
                new[high : high + len(up)], new[low : low + len(down)] = up, down
                low, high = low + len(down), high + len(up)
            ids = new
        return cls(n, bits, planes, zeros, cls._directory(planes))

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        blocks = np.bitwise_count(planes).reshape(len(planes), -1, BLOCK // 8).sum(2, dtype=np.int64)
        return np.concatenate([np.zeros((len(planes), 1), np.int64), np.cumsum(blocks, 1)], 1).astype(np.uint32)

    def tobytes(self) -> bytes:
        return struct.pack("<4sIQ", MAGIC, self.bits, self.n) + self.zeros.astype("<i8").tobytes() + self.ones.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> WaveletMatrix:
        magic, bits, n = struct.unpack_from("<4sIQ", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        blocks = -(-n // BLOCK)
        at = 16
        zeros = np.frombuffer(raw, "<i8", bits, at)
        at += 8 * bits
        ones = np.frombuffer(raw, "<u4", bits * (blocks + 1), at).reshape(bits, blocks + 1)
        at += 4 * ones.size
        planes = np.frombuffer(raw, np.uint8, bits * blocks * (BLOCK // 8), at).reshape(bits, -1)
        return cls(n, bits, planes, zeros, ones)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        block = at // BLOCK
        out = self.ones[level][block].astype(np.int64)
        rows = np.concatenate([self.planes[level], np.zeros(BLOCK // 8, np.uint8)]).reshape(-1, BLOCK // 8)[block]
        inside = np.unpackbits(rows, axis=1, bitorder="little")
        inside[np.arange(BLOCK)[None] >= (at % BLOCK)[:, None]] = 0
        return out + inside.sum(1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at the given positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][at >> 3].astype(np.int64) >> (at & 7)) & 1
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out

    def rank(self, token: int, at: int) -> int:
        """How often the id occurs before position ``at``."""
        lo, hi = self._range(token, at)
        return hi - lo

    def _range(self, token: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for level in range(self.bits):
            a, b = self._ones(level, np.array([lo, hi]))
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level] + a), int(self.zeros[level] + b)
            else:
                lo, hi = int(lo - a), int(hi - b)
        return lo, hi

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of the id; -1 if there are fewer."""
        lo, hi = self._range(token, self.n)
        if k < 0 or k >= hi - lo:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            want = at - int(self.zeros[level]) if bit else at
            base = self.ones[level].astype(np.int64)
            before = base if bit else np.arange(len(base)) * BLOCK - base
            block = int(np.searchsorted(before, want, "right")) - 1
            row = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
            at = block * BLOCK + int(np.flatnonzero(row == bit)[want - before[block]])
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane to the first."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up, low, high = np.empty_like(ids), 0, int(self.zeros[level])
            mark = ids.dtype.type(1 << (self.bits - 1 - level))
            for s in range(0, self.n, CACHED):
                own, bit = up[s : s + CACHED], one[s : s + CACHED]
                above, below = np.flatnonzero(bit), np.flatnonzero(~bit)
                own[above], own[below] = ids[high : high + len(above)] | mark, ids[low : low + len(below)]
                low, high = low + len(below), high + len(above)
            ids = up
        return ids


def _encoded(path: str, bits: int):
    """(grp, doc_id, h, text) to (grp, doc_id, h, ids): the text's ids and the end of it, as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.per_worker(("wavelet", path), lambda: T.WordEncoder(path))
        for b in W.pieces(batches, "text", PIECE, keep=True):
            flat, at = encoder.ids(*W.text_arrays(b.column(3)))
            flat = np.insert(flat.astype(_kind(bits)), at[1:], END)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), W.blobs(flat, at + np.arange(len(at)))], ["grp", "doc_id", "h", "ids"])

    return run


def _kind(bits: int) -> np.dtype:
    return np.dtype("<u2" if bits <= 16 else "<u4")


def _shards(bits: int, most: int):
    """Rows (grp, doc_id, ids) in order to records: a group's next one begins where the last has ``most`` ids or more."""

    def record(grp: int, part: int, before: int, docs: list, ids: list, sizes: list) -> pa.RecordBatch:
        body = WaveletMatrix.of(np.concatenate(ids), bits).tobytes()
        doc = np.array([-1 if d is None else d for d in docs], np.int64)
        null = np.packbits([d is None for d in docs]).tobytes()
        names = ["grp", "part", "before", "n", "docs", "nulls", "sizes", "matrix"]
        numbers = [pa.array([x], pa.int64()) for x in (grp, part, before, sum(sizes))]
        return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x]) for x in (doc.tobytes(), null, np.array(sizes, np.int64).tobytes(), body))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, part, before, n, docs, ids, sizes = None, 0, 0, 0, [], [], []
        for b in batches:
            for own, doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if docs and (own != grp or n >= most):
                    yield record(grp, part, before, docs, ids, sizes)
                    part, before, n, docs, ids, sizes = part + 1, before + n, 0, [], [], []
                if own != grp:
                    grp, part, before = own, 0, 0
                docs.append(doc)
                ids.append(np.frombuffer(body.as_buffer(), _kind(bits)))
                sizes.append(len(ids[-1]))
                n += sizes[-1]
        if docs:
            yield record(grp, part, before, docs, ids, sizes)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            grp, part, before = (b.column(k)[i].as_py() for k in range(3))
            docs, nulls, sizes, body = (b.column(k)[i] for k in range(3, 7))
            doc, size = np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64)
            null = np.unpackbits(np.frombuffer(nulls.as_buffer(), np.uint8), count=len(doc)).astype(bool)
            at = np.concatenate([[0], np.cumsum(size)])
            raw = WaveletMatrix.frombytes(body.as_buffer()).decode().astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            where = [W.int64(np.full(len(doc), x)) for x in (grp, part)]
            yield pa.RecordBatch.from_arrays([*where, pa.array(doc, mask=null), W.int64(before + at[:-1]), W.int64(size), W.int64(np.array(crc, np.int64))], ["grp", "part", "doc_id", "start", "n_tokens", "ids_crc32"])


FILE = "grp long, part long, before long, n long, docs binary, nulls binary, sizes binary, matrix binary"


def _groups(docs: DataFrame, groups: int) -> Column:
    """The group of a row (doc_id, h): keys are cut at their quantiles, null ones first; a key that has several
    quantiles to itself is cut further, by the hash of its texts."""
    edges = docs.select(F.percentile_approx(F.coalesce("doc_id", F.lit(LEAST)), [i / groups for i in range(1, groups)], 100 * groups).alias("e")).first()["e"]
    many = Counter(edges or [])
    if not many:
        return F.lit(0).cast("long")
    key = F.coalesce("doc_id", F.lit(LEAST))
    before = F.size(F.filter(F.array(*(F.lit(e) for e in sorted(edges))), lambda e: e < key))
    inside = F.try_element_at(F.create_map(*(F.lit(x) for e, n in many.items() for x in (e, n))), key)
    return (before + F.coalesce(F.pmod(F.col("h"), inside + 1), F.lit(0))).cast("long")


def write_shards(docs: DataFrame, path: str, bits: int = 16, groups: int | None = None, key: str = "doc_id", text: str = "text", most: int = 1 << 23) -> DataFrame:
    """Encodes every text, appends id 1, and writes wavelet matrices, each of the texts of neighbouring keys (null keys first).

    Returns the files' records, read back. Texts are encoded where they are read and only their ids are exchanged. Keys
    are dealt over groups at their quantiles, and a group begins a new record where the last one has ``most`` ids, so a
    record's size does not depend on the groups' number; a text stands in one record, whole. Null texts are empty; equal
    keys stand in an order that follows from their texts' hashes alone. Empty table: no record. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))
    rows = docs.select(_groups(docs.select("doc_id", "h"), groups or 4 * parts).alias("grp"), "doc_id", "h", "text")
    made = rows.mapInArrow(_encoded(path, bits), "grp long, doc_id long, h long, ids binary")
    return written(made.repartition(parts, "grp").sortWithinPartitions("grp", "doc_id", "h").select("grp", "doc_id", "ids").mapInArrow(_shards(bits, most), FILE), "wavelet")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, grp and part (the record's), from the files alone."""
    spark = files.sparkSession
    # a row a group reaches the driver, however many records a group has
    at, total = [], 0
    for r in sorted(files.groupBy("grp").agg(F.sum("n").alias("n")).collect()):
        at.append((r["grp"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(at, "grp long, base long"))
    found = files.select("grp", "part", "before", "docs", "nulls", "sizes", "matrix").mapInArrow(_read, "grp long, part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(base, "grp").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "grp", "part")
