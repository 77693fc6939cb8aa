"""Sinks: exports, saved prescriptions, history and reports. All append files; none rewrites what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLOCK_FIELDS, display_date, display_time

EXPORT = ("date", "time", "query", *BLOCK_FIELDS, "llm_model_used", "generation_time_sec")


def export_rows(blocks: DataFrame) -> DataFrame:
    """process_id and the twelve columns of an export; an unknown generation time is N/A."""
    time = F.coalesce(F.format_number("generation_time", 2), F.lit("N/A"))
    rows = blocks.withColumn("date", display_date(F.col("created_at"))).withColumn("time", display_time(F.col("created_at")))
    return rows.withColumn("llm_model_used", F.col("model_name")).withColumn("generation_time_sec", time).select("process_id", *EXPORT)


def write_export(blocks: DataFrame, path: str) -> None:
    export_rows(blocks).write.mode("append").partitionBy("process_id").option("header", True).csv(path)


def write_saved_prescriptions(rows: DataFrame, path: str) -> None:
    """id, timestamp, patient_id, visit_id, transcript, medications as JSON lines."""
    rows.select("id", "timestamp", "patient_id", "visit_id", "transcript", "medications").write.mode("append").json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_history_batch(path: str):
    """For foreachBatch: a batch goes to a folder of its own, so a repeated batch replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def evolve_history(rows: DataFrame) -> DataFrame:
    """rows with the columns that later versions added."""
    later = rows.sparkSession.createDataFrame([], "generation_time double, audio_path string, model_name string, model_label string")
    return rows.unionByName(later, allowMissingColumns=True)


def read_history(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_eval_report(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines a section."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
