"""Outliers for each class of distances: overlapping logarithmic buckets, an isolation forest in each, comparisons with means."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut, ship

FEATURES = ("cons", "deltag", "npairs", "entropy", "covariance")
#: greater than the mean, less, greater ...: what an outlier's features must be.
HEURISTIC = (">", "<", ">", ">", ">")


def buckets(base: int = 2, lo: int = 2, hi: int = 12) -> list[tuple[int, int, int, int]]:
    """(bucket, first, last, middle): base**i to base**(i+1), and one half a step on, for i in lo..hi; the first two start at 1."""
    out = []
    for i in range(lo, hi + 1):
        for a, b in ((base**i, base ** (i + 1)), (base**i + base ** (i - 1), base ** (i + 1) + base**i)):
            a = 1 if i == lo else a
            out.append((len(out) + 1, a, b, ((b - a) >> 1) + a))
    return out


def assigned(dist: Column, table: Sequence[tuple] | None = None) -> Column:
    """The first bucket whose middle is not under the distance; null beyond the last."""
    table = sorted(table or buckets(), key=lambda x: x[3])
    under = F.size(F.filter(F.array(*(F.lit(mid) for *_, mid in table)), lambda m: m < dist))
    return F.try_element_at(F.array(*(F.lit(b) for b, *_ in table)), under + 1)


def members(rows: DataFrame, dist: str = "dist") -> DataFrame:
    """Each row once for every bucket that its distance is in, ends included. The table of buckets is fixed and small."""
    table = rows.sparkSession.createDataFrame(buckets(), "bucket int, b_first int, b_last int, b_mid int")
    return rows.join(F.broadcast(table), (F.col(dist) >= F.col("b_first")) & (F.col(dist) <= F.col("b_last")))


def bucket_means(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return members(rows).groupBy("bucket").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("sum", F.sum))))


class IsolationForest:
    """Liu, Ting and Zhou, 2008: random splits part outliers from the rest in few steps. All trees are flat arrays:
    ``feature`` (-1 for a leaf), ``cut``, ``low`` and ``high`` (the children), ``path`` (a leaf's length of path)."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 1):
        self.trees, self.sample, self.rng = trees, sample, np.random.default_rng(seed)

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> IsolationForest:
        n = min(self.sample, len(x))
        self.norm = max(self.expected(n), 1e-9)
        deep = int(np.ceil(np.log2(max(n, 2))))
        nodes: list[list] = []
        self.roots = []
        for _ in range(self.trees):
            self.roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0, 0.0])
            todo = [(len(nodes) - 1, x[self.rng.choice(len(x), n, replace=False)], 0)]
            while todo:
                at, own, depth = todo.pop()
                able = np.flatnonzero(own.max(0) > own.min(0))
                if depth == deep or len(own) <= 1 or not len(able):
                    nodes[at][4] = depth + self.expected(len(own))
                    continue
                f = int(self.rng.choice(able))
                where = self.rng.uniform(own[:, f].min(), own[:, f].max())
                low = own[:, f] < where
                nodes[at][:4] = [f, where, len(nodes), len(nodes) + 1]
                # a cut at the least value leaves one side empty
                for part in (own[low], own[~low]):
                    nodes.append([-1, 0.0, 0, 0, float(depth + 1)])
                    if len(part):
                        todo.append((len(nodes) - 1, part, depth + 1))
        feature, cuts, low, high, path = zip(*nodes, strict=True)
        self.feature, self.low, self.high = (np.array(c, np.int32) for c in (feature, low, high))
        self.cut, self.path, self.deep = np.array(cuts), np.array(path), deep
        return self

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """0 to 1, the greater the odder; all trees descend together, a step a level."""
        out = np.zeros(len(x))
        for s in range(0, len(x), block):
            own = x[s : s + block]
            at = np.broadcast_to(np.array(self.roots, np.int32), (len(own), len(self.roots))).copy()
            row = np.arange(len(own))[:, None]
            for _ in range(self.deep):
                f = self.feature[at]
                on = f >= 0
                if not on.any():
                    break
                at = np.where(on, np.where(own[row, f] < self.cut[at], self.low[at], self.high[at]), at)
            out[s : s + block] = self.path[at].mean(1)
        return 2.0 ** (-out / self.norm)



def train(rows: DataFrame, key: str, contamination: float = 0.1, sample: int = 2048, features: Sequence[str] = FEATURES, seed: int = 1) -> DataFrame:
    """(bucket, threshold, forest, and the bucket's n, means and sums): a model, a row for each bucket of two members or more.

    A forest's trees learn from a sample of its bucket's members of about ``sample`` rows, by the hash of the key. Its
    threshold is the quantile of all members' scores that ``contamination`` leaves above it.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(key, "dist", *features)
    means = cut(bucket_means(rows, features))
    share = F.broadcast(means.filter("n > 1").select("bucket", F.least(F.lit(1.0), sample / F.col("n")).alias("share")))  # a row for each bucket
    picked = members(rows).join(share, "bucket").filter((F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)) < F.col("share"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        x = pdf[list(features)].sort_values(list(features)).to_numpy(float)
        b = int(pdf["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [np.int32(b)], "forest": [pickle.dumps(IsolationForest(seed=seed + b).fit(x))]})

    forests = cut(picked.groupBy("bucket").applyInPandas(grow, "bucket int, forest binary"))
    scored = members(rows).select("bucket", *features).mapInPandas(_scores(spark, forests, features, []), "bucket int, anomaly double")
    limits = scored.groupBy("bucket").agg(F.percentile_approx("anomaly", 1 - contamination, 100_000).alias("threshold"))
    return cut(forests.join(limits, "bucket").join(means, "bucket"))


def save(model: DataFrame, path: str) -> None:
    model.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _scores(spark: SparkSession, forests: DataFrame, features: Sequence[str], keep: Sequence[str]):
    """A function of frames (bucket, keep, features) to (keep, bucket, anomaly). Forests: one for each bucket, of a fixed size."""
    shared = spark.sparkContext.broadcast({r["bucket"]: bytes(r["forest"]) for r in forests.select("bucket", "forest").collect()})

    def run(frames):
        import pickle

        loaded = {b: pickle.loads(m) for b, m in shared.value.items()}
        for f in frames:
            bucket, x = f["bucket"].to_numpy(), f[list(features)].to_numpy(float)
            out = np.full(len(f), np.nan)
            for b in np.unique(bucket):
                if b in loaded:
                    out[bucket == b] = loaded[b].score(x[bucket == b])
            yield f[list(keep)].assign(bucket=bucket.astype(np.int32), anomaly=out)[~np.isnan(out)]

    return run


def predict(rows: DataFrame, key: str, model: DataFrame, features: Sequence[str] = FEATURES, heuristic: Sequence[str | Callable] = HEURISTIC) -> DataFrame:
    """(key, bucket, anomaly): the rows that their bucket's forest isolates and whose features all compare as asked with its means.

    ``model``: from train() or load(). Rows beyond the last bucket, or of one without a forest, are none.
    """
    ship(rows.sparkSession)
    found = rows.select(key, "dist", *features).withColumn("bucket", assigned(F.col("dist"))).filter("bucket is not null")
    found = validated(found, model.drop("forest", "threshold"), features, heuristic).select(key, "bucket", *features)
    kind = dict(rows.dtypes)[key]
    scored = found.mapInPandas(_scores(rows.sparkSession, model, features, [key]), f"{key} {kind}, bucket int, anomaly double")
    return scored.join(F.broadcast(model.select("bucket", "threshold")), "bucket").filter("anomaly >= threshold").select(key, "bucket", "anomaly")


def outliers(rows: DataFrame, key: str, contamination: float = 0.1, sample: int = 2048, features: Sequence[str] = FEATURES, heuristic: Sequence[str | Callable] = HEURISTIC, seed: int = 1) -> DataFrame:
    """What predict() tells of rows by a model trained on them."""
    return predict(rows, key, train(rows, key, contamination, sample, features, seed), features, heuristic)


def duplex_law(rows: DataFrame) -> DataFrame:
    """(n_pairs, n, mean, sd, mean_pairs): for each length the normal law of energies, and the Poisson law's mean of lengths."""
    by = rows.groupBy("n_pairs").agg(F.count("*").alias("n"), F.avg("energy").alias("mean"), F.stddev_pop("energy").alias("sd"))
    # a row for each length
    whole = by.agg((F.sum(F.col("n") * F.col("n_pairs")) / F.sum("n")).alias("mean_pairs"))
    return by.join(F.broadcast(whole))


def duplex_probabilities(rows: DataFrame, law: DataFrame, with_cdf: bool = True) -> DataFrame:
    """rows (with n_pairs and energy) with pdf, and cdf: how likely a duplex is at least as long and as stable.

    pdf is null for a length that the law does not have, or with one energy alone. cdf sums over the law's lengths from
    n_pairs on, with what is longer than all of them. ``law``: a row for each length, as duplex_law() gives.
    """
    log_poisson = lambda n, m: -m + n * F.log(m) - F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    own = law.filter("sd > 0").select("n_pairs", "mean", "sd", F.exp(log_poisson(F.col("n_pairs"), F.col("mean_pairs"))).alias("_p"))
    z = (F.col("energy") - F.col("mean")) / F.col("sd")
    out = rows.join(F.broadcast(own), "n_pairs", "left").withColumn("pdf", F.col("_p") * F.exp(-z * z / 2) / (F.col("sd") * float(np.sqrt(2 * np.pi)))).drop("mean", "sd", "_p")
    if not with_cdf:
        return out
    from math import exp, lgamma, log

    table = sorted(tuple(r) for r in law.filter("sd > 0").select("n_pairs", "mean", "sd", "mean_pairs").collect())
    poisson = lambda n, rate: exp(-rate + n * log(rate) - lgamma(n + 1))
    # what is longer than all lengths of the law
    rest = 1 - sum(poisson(i, table[0][3]) for i in range(int(table[-1][0]) + 1)) if table else 0.0
    ship(rows.sparkSession)
    n, mean, sd, p = (np.array(c, float) for c in zip(*((n, m, sd, poisson(n, rate)) for n, m, sd, rate in table), strict=True)) if table else [np.zeros(0)] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, energy = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("n_pairs", "energy"))
            total = np.zeros(len(energy))
            for i in range(len(n)):
                # of each length of the law the rows that are no longer
                at = np.flatnonzero(n[i] >= long)
                total[at] += p[i] * (1 + _erf((energy[at] - mean[i]) / (sd[i] * np.sqrt(2)))) / 2
            total = np.where(np.isnan(long), rest, total + rest)
            null = batch.column("energy").is_null().to_numpy(zero_copy_only=False) & np.isnan(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, mask=null)], [*batch.schema.names, "cdf"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("cdf", T.DoubleType())]))


def _erf(x: np.ndarray) -> np.ndarray:
    """As erf(), of an array."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = np.zeros(len(x))
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def erf(x: Column) -> Column:
    """The error function within 1.5e-7, by a polynomial in 1 / (1 + p|x|) (Abramowitz and Stegun, 7.1.26)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def validated(rows: DataFrame, means: DataFrame, features: Sequence[str] = FEATURES, heuristic: Sequence[str | Callable] = HEURISTIC) -> DataFrame:
    """Rows (with bucket) whose features all compare as asked with their bucket's means; a comparison is "<", ">" or a function of two columns.

    ``means``: a row for each bucket, as bucket_means() gives; the buckets' number is fixed.
    """
    compare = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    keep = F.lit(True)
    for c, how in zip(features, heuristic, strict=True):
        keep &= (how if callable(how) else compare[how])(F.col(c), F.col(f"mean_{c}"))
    return rows.join(F.broadcast(means.select("bucket", *(f"mean_{c}" for c in features))), "bucket").filter(keep).select(rows.columns)
