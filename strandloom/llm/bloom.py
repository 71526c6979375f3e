"""A Bloom filter of fixed size, built on the executors by groups of words and broadcast to readers.

The size is a parameter, so what is broadcast never grows with the data. A fuller filter lets more rows through, which
costs time but no result: every reader joins what passes with the exact set afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.words import mix

PROBES, SEGMENT_WORDS = 3, 4096


def build(df: DataFrame, key: Column, bits: int = 1 << 26) -> Broadcast:
    """The filter of the 64-bit hashes in ``key`` (already well mixed); ``bits``: a power of two, 2**18 at least."""
    log = bits.bit_length() - 1
    places = F.explode(F.array(*(F.shiftrightunsigned(key, 64 - log) if j == 0 else F.shiftrightunsigned(F.shiftleft(key, 19 * j), 64 - log) for j in range(PROBES)))).alias("at")
    words = (
        df.select(places)
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
        .withColumn("segment", F.floor(F.col("word") / SEGMENT_WORDS).cast("int"))
    )

    def fold(pdf):
        out = np.zeros(SEGMENT_WORDS, np.int64)
        out[pdf["word"].to_numpy() % SEGMENT_WORDS] = pdf["mask"].to_numpy()
        return pdf.iloc[:1][["segment"]].assign(body=[out.tobytes()])

    whole = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("segment").applyInPandas(fold, "segment int, body binary").collect():
        at = r["segment"] * SEGMENT_WORDS
        whole[at : at + SEGMENT_WORDS] = np.frombuffer(r["body"], np.int64)
    return df.sparkSession.sparkContext.broadcast(whole.tobytes())


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the filter; words: its body as uint64."""
    log = (len(words) * 64).bit_length() - 1
    out = np.ones(len(h), bool)
    for j in range(PROBES):
        at = ((h << np.uint64(19 * j)) >> np.uint64(64 - log)).astype(np.int64)
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def id_hash(ids: np.ndarray) -> np.ndarray:
    """Mixes 64-bit ids for build() and passes()."""
    return mix(ids.astype(np.int64, copy=True).view(np.uint64))
