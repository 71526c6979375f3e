"""Language identification by the nearest of several TF-IDF centroids of each language.

Features are hashed byte n-grams (2, 3 and 4 bytes of the lower-cased letters, with one space for what stands between
words) in ``DIMS`` cells; document frequencies
are counted over all rows that may be learned from. A bounded sample of each language is clustered by spherical k-means
into ``CENTROIDS`` centroids. A text gets the language of the centroid of the greatest cosine; it is rejected if that
cosine is far below what the language's own texts have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.session import ship

DIMS, SIZES, CENTROIDS, STEPS, SHARP = 1 << 13, (2, 3, 4), 3, 12, 40.0
#: Texts with fewer different cells than this have smaller cosines; what is asked of them is less.
FEW = 400
UNKNOWN = "und"


#: Lower-cased bytes; ASCII that is no letter is a space.
_LETTERS = W.LOWER.copy()
_LETTERS[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 32


def _plain(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with single spaces; also the capitals of Latin-1, whose UTF-8 is C3 80 to C3 9E."""
    low = _LETTERS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]
    low[lead] += 32
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def _counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, counts) of each text, cells ascending. N-grams do not cross texts."""
    data, offs = _plain(data, offs)
    low = data.astype(np.uint64)
    cells = []
    for k in SIZES:
        code = np.zeros(max(0, len(low) - k + 1), np.uint64)
        for j in range(k):
            code = code << np.uint64(8) | low[j : len(low) - k + 1 + j]
        cells.append((W.mix(code + np.uint64(k << 40)) >> np.uint64(51)).astype(np.int64))
    for s, e in zip(offs[:-1], offs[1:], strict=True):
        own = np.zeros(DIMS, np.int64)
        for k, c in zip(SIZES, cells, strict=True):
            if e - s >= k:
                own += np.bincount(c[s : e - k + 1], minlength=DIMS)
        at = np.flatnonzero(own)
        yield at, own[at]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: in how many of its texts each cell occurs."""
    seen, n = np.zeros(DIMS, np.int64), 0
    for b in W.pieces(batches, "text"):
        for at, _ in _counts(*W.text_arrays(b.column(0))):
            seen[at] += 1
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([W.int64(np.append(at, DIMS)), W.int64(np.append(seen[at], n))], ["cell", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.pieces(batches, "text"):
        at, n = [], []
        for a, c in _counts(*W.text_arrays(b.column(2))):
            at.append(a.astype(np.int16))
            n.append(np.minimum(c, np.iinfo(np.int32).max).astype(np.int32))
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in at])])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), W.blobs(np.concatenate(at), ptr), W.blobs(np.concatenate(n), ptr)], ["lang", "place", "at", "n"])


def _weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The cells' TF-IDF, of length 1."""
    w = ((1 + np.log(n)) * idf[at]).astype(np.float32)
    size = np.sqrt((w * w).sum())
    return w / size if size > 0 else w


def cluster(rows: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means from far-apart starts; rows have length 1. Fewer rows than k: one centroid each."""
    k = min(k, len(rows))
    mean = rows.mean(0)
    start = [int(np.argmax(rows @ mean))]
    while len(start) < k:
        start.append(int(np.argmin((rows @ rows[start].T).max(1))))
    centers = rows[start]
    for _ in range(steps):
        own = (rows @ centers.T).argmax(1)
        new = np.stack([rows[own == j].mean(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return centers


class Model:
    """idf, the centroids, the language of each, and the least cosine that each language accepts."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, owner: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centers, self.owner, self.langs, self.least = idf, centers, owner, langs, least

    @classmethod
    def empty(cls) -> Model:
        """A model that knows no language."""
        return cls(np.ones(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), [], np.zeros(0))


def fit(rows: DataFrame, sample: int = 400, slack: float = 0.5) -> Model | None:
    """Learns from (text, lang) rows; those without text or lang are left out. None if nothing is left.

    Frequencies count every row. ``sample``: the bound on the texts of a language that are clustered, and that reach the
    driver; they are the different ones of the smallest hashes, so the model does not depend on how rows are dealt, and
    copies do not crowd it. A language accepts cosines of ``slack`` times the first percentile of its sample's own cosines.
    """
    ship(rows.sparkSession)
    rows = rows.filter("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not have:
        return None
    found = rows.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS + 1)
    for r in found:
        seen[r["cell"]] = r["n"]
    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1
    # about so many different texts of each language, with room for the scatter; then exactly the bound
    share = F.lit(0.0)
    for lang, n in have.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * sample / max(n, 1) + 30 / max(n, 1))).otherwise(share)
    part = rows.filter((F.shiftrightunsigned("h", 11) / float(1 << 53)) < share).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    part = part.withColumn("place", place).filter(F.col("place") <= sample)
    got: dict[str, list] = {lang: [] for lang in have}
    for r in sorted(part.select("lang", "place", "text").mapInArrow(_vectors, "lang string, place int, at binary, n binary").collect()):
        own = np.zeros(DIMS, np.float32)
        at = np.frombuffer(r["at"], np.int16)
        own[at] = _weigh(at, np.frombuffer(r["n"], np.int32), idf)
        if len(at):
            got[r["lang"]].append(own)
    langs = sorted(x for x in got if got[x])
    if not langs:
        return None
    centers, owner, least = [], [], []
    for i, lang in enumerate(langs):
        own = np.stack(got[lang])
        c = cluster(own, CENTROIDS)
        centers.append(c)
        owner += [i] * len(c)
        least.append(slack * float(np.quantile((own @ c.T).max(1), 0.01)))
    return Model(idf, np.concatenate(centers).astype(np.float32), np.array(owner), langs, np.array(least))


def _predict(model, only_accepted: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        best = np.array([m.owner == i for i in range(len(m.langs))])
        for b in W.pieces(batches, "text"):
            text = b.column(b.schema.get_field_index("text"))
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score, near = [], np.zeros(b.num_rows), np.zeros(b.num_rows)
            ok = np.zeros(b.num_rows, bool)
            for i, (at, n) in enumerate(_counts(*W.text_arrays(text))):
                if not letter[i] or not len(m.langs):
                    lang.append(UNKNOWN)
                    continue
                cos = m.centers[:, at] @ _weigh(at, n, m.idf)
                each = np.where(best, cos, -1).max(1)
                k = int(each.argmax())
                p = np.exp(SHARP * (each - each[k]))
                lang.append(m.langs[k])
                score[i], near[i] = 1 / p.sum(), min(1.0, max(0.0, float(each[k])))
                ok[i] = each[k] >= m.least[k] * min(1.0, np.sqrt(len(at) / FEW))
            if only_accepted:
                yield b.filter(pa.array(ok))
                continue
            keep = [b.column(i) for i, f in enumerate(b.schema.names) if f != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score), pa.array(near), pa.array(ok)], [*(f for f in b.schema.names if f != "text"), "lang_pred", "score", "cosine", "accepted"])

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns), lang_pred, score, cosine, accepted for each row.

    score: the softmax of the languages' best cosines, 0 to 1. Null texts and those without a letter: ``und``, score 0,
    not accepted; so is every text if nothing was learned. Short, long and repeated texts: each by itself, whole.
    """
    spark = docs.sparkSession
    ship(spark)
    model = model or Model.empty()
    rows = docs.select(*carry, F.col(text).alias("text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"{kinds}, lang_pred string, score double, cosine double, accepted boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose ``text`` is of a known language; null texts and those without a letter go."""
    spark = docs.sparkSession
    ship(spark)
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast(model or Model.empty()), True), docs.schema)


def fold_of(key: str, folds: int):
    """crc32 of the key as text, modulo folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
