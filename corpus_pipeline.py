"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, language, neardup, pieces, substrings
from strandloom.session import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near some language's centroid; the model learns from the stage's own rows that have a lang."""
    docs = docs.select(*COLUMNS)
    return language.accepted(docs, language.fit(docs))


#: Near-duplicates of the near_dedup stage: hundredths of likeness of five-word shingles.
PERCENT = 80


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (likeness PERCENT or more).

    Rows with one doc_id are judged each by its own text, and equal ones stay or go together. A row without a doc_id stays
    unless a row with one has its text.
    """
    found = neardup.near_duplicates(docs, percent=PERCENT, give_hash=True)
    kept = found.filter("kept or doc_id is null and component_id is null").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(*COLUMNS)
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & F.xxhash64("text").eqNullSafe(kept["_h"]), "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of which nothing is left goes."""
    done = substrings.substring_dedup(docs, give_text=True, carry=("lang", "source"))
    return done.filter("n_words > n_removed").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with an item of benchmark; rows with one doc_id are judged each by its own text."""
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    bad = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), key="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(bad, "_row", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text, with their count and checks."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), give_ids=True)


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]
#: Alignment, automata and the tokenizer can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
