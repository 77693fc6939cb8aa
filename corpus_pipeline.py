"""Corpus preparation: quality, near-duplicates, benchmark passages, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read as the next one's docs. All but the last return the columns of documents, whatever they are called.

Null and empty texts go through each stage like any other: they are near-duplicates of one another, hold no passage and no
personal data, and are packed as the end id alone if quality keeps them. Very long texts are worked on whole. Repeated rows are
one document after near_duplicates, ties of ids going by a hash of the text. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import decontamination, packing, pii, quality, simhash
from scribelake.llm.common import materialize, read_table, unused
from scribelake.llm.tokens import vocabulary_path


BATCH_ROWS = 1000  # whole texts that a worker and its task hold at a time, at most; Spark's own bound is 10,000


def _in_short_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score KEEP_FROM or more."""
    _in_short_batches(spark)
    score = unused(docs.columns, "score")[0]
    scored = quality.with_quality(docs, quality.quality_model(spark, sf_dir), score)
    return scored.where(F.col(score) >= quality.KEEP_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate component."""
    _in_short_batches(spark)
    return simhash.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _in_short_batches(spark)
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars counted anew."""
    _in_short_batches(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    _in_short_batches(spark)
    return packing.pack(docs, vocabulary_path(), end_id=0, capacity=packing.CAPACITY)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained quality model or the packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
