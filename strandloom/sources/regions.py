"""BED and bedGraph files (plain or .gz), feature tables, and the BED12 sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "dist double, cons double, deltag double, npairs double, entropy double, covariance double"


def bed(lines: DataFrame, expand_first: int = 0, expand_last: int = 0) -> DataFrame:
    """(seqname, first, last, name, strand) from text lines (value): first is the file's start plus 1; both ends may be moved out."""
    f = F.split("value", "\t")
    at = lambda i: F.try_element_at(f, F.lit(i))
    return lines.filter(~F.col("value").rlike("^(#|track|browser|$)")).select(
        at(1).alias("seqname"), (at(2).try_cast("long") + 1 - expand_first).alias("first"), (at(3).try_cast("long") + expand_last).alias("last"), at(4).alias("name"), F.coalesce(at(6), F.lit("?")).alias("strand")
    )


def load_bed(spark: SparkSession, path: str, expand_first: int = 0, expand_last: int = 0) -> DataFrame:
    return bed(spark.read.text(path), expand_first, expand_last)


def bedgraph(lines: DataFrame) -> DataFrame:
    """(seqname, first, last, strand, score): lines that begin with ``#`` are dropped; the strand is ``?``."""
    f = F.split("value", r"\s+")
    return lines.filter(~F.col("value").startswith("#")).select(f[0].alias("seqname"), (f[1].try_cast("long") + 1).alias("first"), f[2].try_cast("long").alias("last"), F.lit("?").alias("strand"), f[3].try_cast("double").alias("score"))


def load_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return bedgraph(spark.read.text(path))


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).csv(path, sep="\t")


def save_features(rows: DataFrame, path: str) -> None:
    rows.select(*(x.split()[0] for x in FEATURES.split(", "))).write.csv(path, sep="\t")


def colour(energy: Column, most: float = -35.0) -> Column:
    """A shade from white to red by the energy's share of ``most``, in hundredths from 1 to 100; 0 and above the first."""
    step = F.when(energy < 0, F.greatest(F.lit(1), F.least(F.lit(100), F.floor(F.abs(energy) / abs(most) * 100)))).otherwise(1).cast("int")
    fade = (255 - F.floor((step - 1) * 255 / 99)).cast("int").cast("string")
    return F.concat_ws(",", F.lit("255"), fade, fade)


def code7(*key: Column) -> Column:
    """A code of seven digits and letters, the same for the same key."""
    return F.lpad(F.right(F.conv(F.hex(F.xxhash64(*key)), 16, 36), F.lit(7)), 7, "0")


def bed12(duplexes: DataFrame, name: str, max_distance: int = 100_000, most: float = -35.0) -> DataFrame:
    """(line): a BED12 line for each duplex (seqname, strand, f_first, f_last, l_first, l_last, energy) within ``max_distance``."""
    score = F.least(F.lit(1000.0), F.col("energy") * -250)
    cols = [
        F.col("seqname"), (F.col("f_first") - 1).cast("string"), F.col("l_last").cast("string"), F.lit(name), F.round(score, 2).cast("decimal(20,2)").cast("string"),
        F.when(F.col("strand") == "+", "+").otherwise("-"), (F.col("f_first") - 1).cast("string"), F.col("l_last").cast("string"), colour(F.col("energy"), most), F.lit("2"),
        F.concat_ws(",", (F.col("f_last") - F.col("f_first") + 1).cast("string"), (F.col("l_last") - F.col("l_first") + 1).cast("string")), F.concat_ws(",", F.lit("0"), (F.col("l_first") - F.col("f_first")).cast("string")),
    ]
    return duplexes.filter(F.col("l_first") - F.col("f_last") <= max_distance).select(F.concat_ws("\t", *cols).alias("line"))


def write_bed12(duplexes: DataFrame, name: str, path: str) -> None:
    bed12(duplexes, name).write.text(path)
