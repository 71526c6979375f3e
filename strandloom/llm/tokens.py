"""Encoding batches of texts with the tokenizers library: every different chunk of a worker's texts once.

A text is cut where no token can reach across, the library encodes each chunk it has not seen, and the texts' ids are
put together from the chunks'. The memory of chunks is bounded: a full one is emptied. Results are those of encoding
whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from strandloom.llm.words import LOWER, kept


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a longer copy where it has no room for n items."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


class Memory:
    """The ids of chunks: numbers of chunks by their text, and the ids of all, one after another."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.odd: set[str] = set()  # chunks that ``encode`` has put here
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def add(self, words: list[str]) -> None:
        """Remembers different new chunks, numbered on from those that are there."""
        found = self.encode(words)
        n, size = len(self.number), np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        self.start, self.size = _room(self.start, n + len(words)), _room(self.size, n + len(words))
        self.flat = _room(self.flat, self.used + len(flat))
        self.size[n : n + len(words)] = size
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, data: np.ndarray, cuts: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of texts in ids). Chunk j has the bytes cuts[j]:cuts[j + 1]; text i has chunks ptr[i]:ptr[i + 1]."""
        n = len(cuts) - 1
        if n <= 0:
            self.last = np.zeros(0, np.int64)
            return np.zeros(0, np.uint32), np.zeros(len(ptr), np.int64)
        words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.number) + len(names) > self.most:
            self.reset()
        own = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(own < 0)
        own[new] = len(self.number) + np.arange(len(new))
        for i in range(0, len(new), 50_000):
            self.add([names[j] for j in new[i : i + 50_000].tolist()])
        own = own[words.indices.to_numpy()]
        self.last = own
        size = self.size[own]
        ends = np.cumsum(size)
        at = np.repeat(self.start[own] - (ends - size), size) + np.arange(ends[-1])
        return self.flat[at], np.concatenate([[0], ends])[ptr]


    def with_odd(self, ptr: np.ndarray) -> np.ndarray:
        """Which texts of the last call have an odd chunk. ptr: text i had its chunks ptr[i]:ptr[i + 1]."""
        if not self.odd or not len(self.last):
            return np.zeros(len(ptr) - 1, bool)
        n = np.concatenate([[0], np.cumsum(np.isin(self.last, [self.number[c] for c in self.odd]))])[ptr]
        return n[1:] > n[:-1]


def per_worker(key, make: Callable, threads: bool = False):
    """What ``make`` gives, made once in each Python worker and kept until a task of another operator begins there.

    threads: whether the library encodes batches on several threads, which shortens a task but costs more CPU time.
    """
    if key not in kept:
        kept.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        kept[key] = make()
    return kept[key]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level models: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?#$%&*"]] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True


def words_apart(data: np.ndarray, offs: np.ndarray, stops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, cuts, ptr) of texts cut at spaces and line feeds, which are dropped; with ``stops`` also between a small
    letter of ASCII and a sign after it."""
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    black = (data != 32) & (data != 10)
    start = np.empty(len(data), bool)
    start[0] = True
    np.logical_not(black[:-1], out=start[1:])
    if stops:
        start[1:] |= _SMALL[data[:-1]] & _STOPS[data[1:]]
    start[offs[:-1][offs[:-1] < len(data)]] = True
    start &= black
    kept_data = data[black]
    return kept_data, np.append(np.flatnonzero(start[black]), len(kept_data)), np.searchsorted(np.flatnonzero(start), offs)


class WordEncoder:
    """Ids of texts by a tokenizers file, as encoding whole texts without special tokens gives them.

    For the word BPE with lower case (its normaliser and its pattern are known) texts are lower-cased and cut where the
    pattern always cuts, and a chunk of small Latin letters (under U+0250, where nothing is to be composed) is one word
    that the library's model takes as it is, byte by byte. Any other tokenizer gets whole texts.
    """

    #: Fixed value: the pattern of word BPE files that drop white space.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known = steps == ["NFC", "Replace", "Lowercase"] and splits == [self.PATTERN, None] and all("<|" in x["content"] for x in spec["added_tokens"])
        self.model = self.tok.model
        self.memory = Memory(self._encode)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        out: list = [None] * len(chunks)
        rest = []
        for i, c in enumerate(chunks):
            if not (self.known and c.isalpha() and c.islower()):
                rest.append(i)
            elif c.isascii():
                out[i] = [t.id for t in self.model.tokenize(c)]
            elif max(c) < "\u0250":
                out[i] = [t.id for t in self.model.tokenize(c.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of texts in ids)."""
        if not self.known:
            cuts = np.unique(offs)
            return self.memory.ids(data, cuts, np.searchsorted(cuts, offs))
        # what looks like a special token is left as it is: those are found before anything is lower-cased
        plain = b"<|" not in data.tobytes()
        return self.memory.ids(*words_apart(LOWER[data] if plain else data, offs, plain))
