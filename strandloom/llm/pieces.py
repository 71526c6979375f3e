"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as protobuf wire format; from it come the pieces, scores and types, the normaliser, the marker
for spaces and the byte fallback, rebuilt as a tokenizer: a unigram model from the scores, or for a BPE model merges in
the order of the scores of what they make. Parity with the sentencepiece library is verified for every chunk that a
worker encodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens as T
from strandloom.llm import words as W
from strandloom.session import ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; groups do not occur."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    by_whitespace: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> PieceModel:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                m.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                m.kind, m.by_whitespace = spec.get(3, UNIGRAM), bool(spec.get(22, 1))
            elif number == 3:
                spec = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m

    @property
    def byte_fallback(self) -> bool:
        return BYTE in self.types

    def merges(self) -> list[tuple[str, str]]:
        """Every pair of pieces that is a piece, by that piece's score, the best first."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        found = [(-self.scores[i], i, k, p[:k], p[k:]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, whole: bool = True):
        """A tokenizer for whole texts; or for chunks, which have their first space already."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        unk = self.types.index(UNKNOWN)
        if self.kind == UNIGRAM:
            tok = Tokenizer(models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk, self.byte_fallback))
        else:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            tok = Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[unk], fuse_unk=True, byte_fallback=self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if whole and self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        return tok

    def surfaces(self) -> list[bytes]:
        """The bytes that each id stands for."""
        return [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]


class Codec:
    """Encodes and decodes batches with one model; made once in a worker."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = PieceModel.parse(f.read())
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        # nothing reaches across a space unless the model normalises or crosses white space
        self.chunked = self.model.by_whitespace and not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        self.tok = self.model.tokenizer(not self.chunked)
        self.memory = T.Memory(self._encode)
        parts = self.model.surfaces()
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts])
        self.start = np.cumsum(self.size) - self.size

    @property
    def differ(self) -> set[str]:
        """The chunks in memory that sentencepiece encodes otherwise."""
        return self.memory.odd

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids; a chunk that sentencepiece encodes otherwise is remembered."""
        own = [e.ids for e in self.tok.encode_batch(chunks, add_special_tokens=False)]
        # sentencepiece puts a space before what it is given: a chunk begins with that space, or is given after a line feed
        after = self.peer.encode("\n")
        given = [c if not self.chunked else c[1:] if c[0] == " " and c != " " else "\n" + c for c in chunks]
        for i, (c, ids) in enumerate(zip(chunks, self.peer.encode(given, num_threads=2), strict=True)):
            if given[i][:1] == "\n" and given[i] != c:
                ids = ids[len(after) :]
            if own[i] != ids:
                self.differ.add(c)
        return own

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of texts in ids); ``same`` then says for each text whether sentencepiece encodes every chunk of it alike."""
        if not self.chunked:
            cuts = np.unique(offs)
            return self._ids(data, cuts, np.searchsorted(cuts, offs))
        full = np.flatnonzero(np.diff(offs))
        data = np.insert(data, offs[:-1][full], 32)  # the space that the model puts before a text
        grow = np.zeros(len(offs), np.int64)
        grow[full + 1] = 1
        offs = offs + np.cumsum(grow)
        space, feed = data == 32, data == 10
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] |= feed
        cut[1:] |= feed
        cut[1:-1] |= space[1:] & ~space[:-1]
        cut[offs] = True
        cuts = np.flatnonzero(cut)
        return self._ids(data, cuts, np.searchsorted(cuts, offs))

    def _ids(self, data: np.ndarray, cuts: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.memory.ids(data, cuts, ptr)
        self.same = ~self.memory.with_odd(ptr)
        return found

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(data, offs): the texts of the ids, without the space that the model put first."""
        size = self.size[ids].copy()
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        offs = np.concatenate([[0], ends])[at]
        if self.model.dummy_prefix:
            first = offs[:-1][np.diff(offs) > 0]
            first = first[out[first] == 32]
            keep = np.ones(len(out), bool)
            keep[first] = False
            return out[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
        return out, offs


def _run(path: str, give_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = T.per_worker(("pieces", path), lambda: Codec(path), threads=True)
        for b in W.pieces(batches, "text", 2 << 20, keep=True):
            data, offs = W.text_arrays(b.column(1))
            ids, at = codec.encode(data, offs)
            back, places = codec.decode(ids, at)
            raw, text, new = ids.astype("<u4").tobytes(), data.tobytes(), back.tobytes()
            crc, same = [], []
            for i in range(len(offs) - 1):
                crc.append(zlib.crc32(raw[4 * at[i] : 4 * at[i + 1]]))
                same.append(text[offs[i] : offs[i + 1]] == new[places[i] : places[i + 1]])
            cols, names = [b.column(0), W.int64(np.diff(at)), W.int64(np.array(crc, np.int64)), pa.array(same), pa.array(codec.same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"]
            if give_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, path: str, give_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text.

    Returns doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip (decoding
    gives the text back), parity (sentencepiece encodes every chunk of it alike; the ids are the rebuilt tokenizer's in any
    case) and with ``give_ids`` ids. Null and empty texts have no ids. A text with U+2581 does not come back as it was: the model takes
    that character for a space. Repeated rows and null keys: each row by itself. Other columns are ignored.
    """
    ship(docs.sparkSession)
    more = ", ids array<int>" if give_ids else ""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_run(path, give_ids), f"doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean{more}")
