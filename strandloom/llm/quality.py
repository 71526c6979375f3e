"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are those of its own text and of the lines before and after it; neighbouring
labels are tied by a transition matrix. The forward-backward algorithm gives each line's marginal, and a document's
quality is their mean by length, mapped by a logistic curve. Lines have no labels of their own: the field learns from
the documents' labels, given to all their lines, and the curve from the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.session import ship

_KIND = np.full(256, 6, np.uint8)  # other bytes: beyond ASCII
_KIND[:128] = 5  # symbols
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[W.SPACE] = 3
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 4
OWN = ("one", "log_chars", "lower", "upper", "digit", "space", "point", "symbol", "beyond", "bar", "bang", "log_words", "word_length", "distinct", "same_as_before", "ends", "few", "seen")
#: Of the neighbours' features these are taken too.
BESIDE = tuple(OWN.index(x) for x in ("log_chars", "upper", "symbol", "bar", "bang", "distinct", "same_as_before", "ends", "few", "seen"))
WIDTH = len(OWN) + 2 * len(BESIDE) + 2


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, ptr, lengths): a row for each line; text i has lines ptr[i]:ptr[i + 1], one at least."""
    n = len(data)
    feed = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], feed + 1]), kind="stable")
    # a line feed at the end of a text begins an empty last line of that text, before the next text's first
    text = np.searchsorted(offs[1:-1], np.sort(feed), "right") if len(feed) else np.zeros(0, np.int64)
    ptr = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offs) - 1) + 1)])
    ends = np.append(starts[1:], n)
    ends[:-1] -= ((ends[:-1] > starts[:-1]) & (ends[:-1] > 0) & np.isin(ends[:-1] - 1, feed, assume_unique=False)).astype(np.int64)
    last = ptr[1:] - 1
    ends[last] = offs[1:]
    length = np.maximum(ends - starts, 0)
    kind = _KIND[data]

    def sums(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends] - total[starts]

    size = np.maximum(length, 1)
    share = [sums(kind == k) / size for k in range(7)]
    ws, we, _ = W.word_spans(data, offs)
    h = W.span_hashes(data, ws, we)
    wptr = np.concatenate([np.searchsorted(ws, starts), [len(ws)]])
    # lines may be empty at the same place: make the word ranges ascend
    wptr = np.maximum.accumulate(wptr)
    count = np.diff(wptr)
    line = np.repeat(np.arange(len(starts)), count)
    order = np.lexsort((h, line))
    hs, ls = h[order], line[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
    distinct = np.bincount(ls[fresh], minlength=len(starts))
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    same = np.bincount(line[twice], minlength=len(starts))
    chars = np.bincount(line, we - ws, minlength=len(starts))
    whole = W.span_hashes(data, starts, starts + length)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(ptr))
    order = np.lexsort((np.arange(len(whole)), whole, owner))
    again = np.zeros(len(whole), bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    final = np.zeros(len(starts), np.uint8)
    some = length > 0
    final[some] = data[starts[some] + length[some] - 1]
    words = np.maximum(count, 1)
    own = np.stack(
        [
            np.ones(len(starts)), np.log1p(length) / 5, *share[:1], *share[1:2], *share[2:3], *share[3:4], *share[4:5], *share[5:6], *share[6:7],
            sums(data == ord("|")) / words, sums(data == ord("!")) / words, np.log1p(count) / 3, chars / words / 8, distinct / words, same / words,
            np.isin(final, np.frombuffer(b".?!:;\"')", np.uint8)), count < 3, again & some,
        ],
        axis=1,
    ).astype(np.float32)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ptr[:-1]] = True
    last[ptr[1:] - 1] = True
    before, after = np.zeros((len(own), len(BESIDE)), np.float32), np.zeros((len(own), len(BESIDE)), np.float32)
    before[1:] = own[:-1, BESIDE]
    before[first] = 0
    after[:-1] = own[1:, BESIDE]
    after[last] = 0
    return np.concatenate([own, before, after, first[:, None], last[:, None]], axis=1), ptr, length


def marginals(unary: np.ndarray, trans: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions 2 x 2). unary: log-odds of good; all chains step together."""
    u = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))], axis=1)
    u /= u.sum(1, keepdims=True)
    m = np.exp(trans)
    n = np.diff(ptr)
    order = np.argsort(-n, kind="stable")
    start, sizes = ptr[:-1][order], n[order]
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    forward, back = np.empty_like(u), np.ones_like(u)
    for t, k in enumerate(alive):
        at = start[:k] + t
        a = u[at] if t == 0 else (forward[at - 1] @ m) * u[at]
        forward[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        right = u[at] * back[at]
        joint = forward[at - 1][:, :, None] * m[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = right @ m.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    p = forward * back
    return p[:, 1] / p.sum(1), pairs


class Field:
    """Feature weights, transition scores, the two numbers of the logistic curve, and the odds that become 0.3."""

    def __init__(self, weights, trans, slope=1.0, offset=0.0, shift=0.0):
        self.weights, self.trans, self.slope, self.offset, self.shift = weights, trans, slope, offset, shift

    def mean(self, x: np.ndarray, ptr: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' marginals, for each text."""
        p, _ = marginals(x @ self.weights, self.trans, ptr)
        w = length + 1.0
        return np.add.reduceat(p * w, ptr[:-1]) / np.add.reduceat(w, ptr[:-1]) if len(ptr) > 1 else np.zeros(0)

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.offset + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_field(x: np.ndarray, ptr: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3, mark: float = 0.3) -> Field:
    """Maximum conditional likelihood by Adam; both classes weigh the same in the features' gradient."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    y = label[owner].astype(float)
    share = np.clip(np.array([1 - y.mean(), y.mean()]), 1e-6, 1)
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0])
    inner = np.ones(len(x), bool)
    inner[ptr[:-1]] = False
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (inner & (y == k)).sum()
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(w.size + 4), np.zeros(w.size + 4)]
    for i in range(1, steps + 1):
        p, pairs = marginals(x @ w, t, ptr)
        grad = np.concatenate([x.T @ (weight * (p - y)) / len(x) + decay * w, ((pairs - seen) / len(x) + decay * t).reshape(-1)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**i)) / (np.sqrt(state[1] / (1 - 0.999**i)) + 1e-9)
        w, t = w - move[: w.size], np.clip(t - move[w.size :].reshape(2, 2), -3, 3)
    field = Field(w, t)
    z = _logit(field.mean(x, ptr, length))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((q - label) * z).sum() + 1e-2 * a, (q - label).sum()])
        s = q * (1 - q)
        hess = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    a = max(a, 1e-3)
    # the odds that part the classes best, both rates counting alike, become those of ``mark``
    line = a * z + b
    order = np.argsort(line)
    good = label[order] == 1
    rates = np.concatenate([[0], np.cumsum(~good) / max(1, (~good).sum()) - np.cumsum(good) / max(1, good.sum())])
    best = np.flatnonzero(rates >= rates.max() - 1e-12)
    v = line[order]
    i = int(best[len(best) // 2])
    edge = (v[max(i - 1, 0)] + v[min(i, len(v) - 1)]) / 2
    return Field(w, t, a, b, np.log(mark / (1 - mark)) - edge)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.pieces(batches, "text"):
        x, ptr, length = line_features(*W.text_arrays(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), W.blobs(x.reshape(-1), ptr * WIDTH), W.blobs(length.astype(np.int32), ptr)], ["quality", "x", "length"])


def fit(rows: DataFrame, sample: int = 4000) -> Field:
    """Learns from (text, quality) rows; about ``sample`` of them, by the hash of the text, reach the driver as features.

    Rows without a quality are left out; null texts count as empty. Without both labels the field knows nothing and
    scores everything the same.
    """
    ship(rows.sparkSession)
    rows = rows.filter("quality in (0, 1)").select(F.col("quality").cast("int").alias("quality"), "text")
    n = rows.count()
    part = rows.filter((F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)) < min(1.0, sample / max(1, n)))
    got = part.mapInArrow(_featured, "quality int, x binary, length binary").collect()
    label = np.array([r["quality"] for r in got])
    if len(set(label.tolist())) < 2:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)))
    length = [np.frombuffer(r["length"], np.int32) for r in got]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got])
    return fit_field(x, np.concatenate([[0], np.cumsum([len(v) for v in length])]), np.concatenate(length), label)


def score(docs: DataFrame, field: Field, text: str = "text", carry: tuple[str, ...] = ("doc_id",), mark: float = 0.3) -> DataFrame:
    """(carried columns), score, predicted, n_lines, bad_chars (the length expected in bad lines) for each row.

    score: 0 to 1, the greater the likelier good; predicted: 1 if it is ``mark`` at least. Null and empty texts are one
    empty line. Equal texts have equal scores; long texts are scored whole.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*carry, F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(field)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Field = shared.value
        for b in W.pieces(batches, "text"):
            x, ptr, length = line_features(*W.text_arrays(b.column(b.schema.get_field_index("text"))))
            mean = f.mean(x, ptr, length)
            s = f.score(mean)
            chars = np.add.reduceat(length, ptr[:-1])
            keep = [b.column(i) for i, c in enumerate(b.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s), pa.array((s >= mark).astype(np.int32)), W.int64(np.diff(ptr)), pa.array((1 - mean) * chars)], [*(c for c in b.schema.names if c != "text"), "score", "predicted", "n_lines", "bad_chars"])

    return rows.mapInArrow(run, f"{kinds}, score double, predicted int, n_lines long, bad_chars double")


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """(text, quality) of about ``sample`` labelled documents, chosen by the hash of their key; those are few, so they are broadcast."""
    own = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = own.count()
    few = own.filter((F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)) < min(1.0, sample / max(1, n)))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "quality")
