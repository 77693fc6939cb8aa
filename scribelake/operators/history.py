"""Threads and their history: filters, latest rows, updates and deletions as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..storage import materialize


def latest_history(history: DataFrame, n: int, process_id: int | None = None, order: str = "id") -> DataFrame:
    rows = history if process_id is None else history.where(F.col("process_id") == process_id)
    return rows.orderBy(F.col(order).desc()).limit(n)


def latest_active_thread(threads: DataFrame) -> DataFrame:
    return threads.where("status = 'active'").agg(F.max_by(F.struct(*threads.columns), "process_id").alias("t")).select("t.*")


def list_threads(threads: DataFrame) -> DataFrame:
    return threads.orderBy(F.col("process_id").desc())


def history_with_thread(history: DataFrame, threads: DataFrame, how: str = "inner") -> DataFrame:
    return history.join(threads, "process_id", how)


def stop_thread(threads: DataFrame, stopped: DataFrame) -> DataFrame:
    """stopped: process_id, stopped_at."""
    rows = threads.drop("stopped_at").join(stopped, "process_id", "left")
    return rows.withColumn("status", F.when(F.col("stopped_at").isNotNull(), "stopped").otherwise(F.col("status")))


def delete_threads(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Threads or history without those of the deleted threads."""
    return rows.join(gone.select("process_id"), "process_id", "left_anti")


def create_threads(threads: DataFrame, new: DataFrame) -> DataFrame:
    """new (name, created_at) with ids that follow those of threads, active, and an output path of its own.

    Rows are sorted over ranges; a row's id is the number of rows in the ranges before and its place in its own.
    """
    top = threads.agg(F.max("process_id").alias("top")).first()["top"] or 0
    placed = new.repartitionByRange("created_at", "name").sortWithinPartitions("created_at", "name")
    placed = materialize(placed.withColumn("__at", F.monotonically_increasing_id()), "threads").withColumn("__range", F.shiftright("__at", 33))
    counts = placed.groupBy("__range").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).drop("n")
    rows = placed.join(F.broadcast(starts), "__range").withColumn("process_id", F.lit(top) + F.col("__before") + F.col("__at") - F.col("__first") + 1)
    path = F.concat(safe_name(F.col("name")), F.lit("_"), F.date_format("created_at", "yyyyMMdd_HHmmss"))
    return rows.select("process_id", "name", F.lit("active").alias("status"), path.alias("path"), "created_at")


def drop_repeated_requests(requests: DataFrame, by: str, order: list[str], text: str = "text") -> DataFrame:
    """Without requests whose normalized text is that of the one before in the same session."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\W+", " "))
    before = F.lag("__norm").over(Window.partitionBy(by).orderBy(*order))
    rows = requests.withColumn("__norm", norm)
    return rows.withColumn("__same", F.coalesce(F.col("__norm") == before, F.lit(False))).where(~F.col("__same")).drop("__norm", "__same")


def pick_transcript(candidates: DataFrame, chain: DataFrame) -> DataFrame:
    """rx_id, text, primary, used, fallback_reason: the first good transcript in the order of the chain (model, place),
    the requested model first. candidates: rx_id, model, requested, text, ok, error."""
    rows = candidates.join(chain, "model").withColumn("place", F.when(F.col("model") == F.col("requested"), -1).otherwise(F.col("place")))
    best = rows.groupBy("rx_id").agg(
        F.min_by(F.struct("model", "text"), F.when(F.col("ok"), F.col("place"))).alias("b"), F.min("requested").alias("primary"),
        F.max(F.when(F.col("model") == F.col("requested"), F.coalesce("error", F.lit("failed")))).alias("error"),
    )
    return best.select("rx_id", F.col("b.text").alias("text"), "primary", F.col("b.model").alias("used"), F.when(F.col("b.model") != F.col("primary"), F.col("error")).alias("fallback_reason"))
