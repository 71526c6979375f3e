"""Words, hashes and batches of texts as numpy arrays, shared by the operators on documents.

A batch of texts is ``(data, offs)``: the UTF-8 bytes of all texts, one after another, and the offsets between them.
A null text is an empty one here; callers that tell them apart look at the column itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that divide words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = -(-n // (1 << 18)) * (1 << 18)
        both = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _powers = tuple(both)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (uint64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a string column; offs start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


#: What a worker keeps from one task of an operator to the next, as the memory of a tokenizer.
kept: dict = {}


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each has about ``most`` bytes of text; a longer text stands alone, whole.

    Without ``keep`` the worker first drops what another operator's tasks have kept.
    """
    if not keep:
        kept.clear()
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size + 16)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, ptr): the bytes of each word, and for each text the range ptr[i]:ptr[i + 1] of its words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    word = ~space
    start = np.flatnonzero(word & before)
    return start, np.flatnonzero(word & after) + 1, np.searchsorted(start, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes anywhere."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offs): every word followed by one space; word i has the bytes offs[i]:offs[i + 1], its space included."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(offs[-1], 32, np.uint8)
    word = ~SPACE[data]
    out[np.repeat(offs[:-1] - start, size) + np.flatnonzero(word)] = data[word]
    return out, offs


def slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, offs): the parts of ``flat`` that begin at ``start``, one after another; they may overlap."""
    offs = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])], offs


def run_hashes(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, hash) of each run of k words inside one text; at: the number of its first word in the batch."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out *= np.uint64(_ODD)
        out += h[j : n - k + 1 + j]
    last = np.repeat(ptr[1:], np.diff(ptr))  # where the text of each word ends
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last[: n - k + 1])
    return at, mix(out[at])


def part_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words from start to end (excluded), of any lengths; equal runs have equal ones."""
    up, down = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def owners(ptr: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


def blobs(flat: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """A binary column: row i has the bytes of flat[ptr[i]:ptr[i + 1]]."""
    flat = np.ascontiguousarray(flat)
    offs = (np.asarray(ptr) * flat.dtype.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer(offs), pa.py_buffer(flat)]).cast(pa.binary())
