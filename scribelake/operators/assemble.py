"""Items to whole prescriptions, display rows and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLOCK_FIELDS, format_block
from .extract import evidence

ITEM = ("item_no", "medicine", "strength", "dose", "dose_unit", "frequency", "duration", "route", "instruction", "additional_instruction", "item_status", "confidence")


def _overall() -> list[Column]:
    return [
        F.when(F.bool_and(F.col("item_status") == "ERROR"), "ERROR").when(F.bool_or(F.col("val_status").isin("NEEDS_REVIEW", "ERROR")), "NEEDS_REVIEW").otherwise("VALIDATED").alias("overall_status"),
        F.count("*").alias("total_medicines"), F.count_if(F.col("val_status") == "NEEDS_REVIEW").alias("review_count"),
    ]


def overall_status(items: DataFrame) -> DataFrame:
    """rx_id, overall_status, total_medicines, review_count."""
    return items.groupBy("rx_id").agg(*_overall())


def assemble(items: DataFrame, raw: str = "raw_text") -> DataFrame:
    """rx_id, items (array of structs in item_no order, those in error left out, with evidence spans), overall_status,
    total_medicines, warnings, metadata. Items are read once."""
    fields = {"medicine": F.col("medicine"), "strength": F.col("strength"), "frequency": F.col("frequency"), "duration": F.col("duration")}
    have = [c for c in ITEM if c in items.columns]
    rows = items.withColumn("evidence", evidence(F.col(raw), fields))
    nested = F.array_sort(F.collect_list(F.when(F.col("item_status") != "ERROR", F.struct("item_no", F.struct(*have[1:]).alias("fields")))))
    spans = F.array_sort(F.collect_list(F.struct("item_no", F.map_entries("evidence").alias("spans"))))
    return rows.groupBy("rx_id").agg(
        nested.alias("items"), spans.alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"),
        F.struct(F.count("*").alias("extracted"), F.count_if(F.col("item_status") == "ERROR").alias("rejected"), F.round(F.avg("confidence"), 4).alias("mean_confidence")).alias("metadata"),
        *_overall(),
    )


def is_valid_prescription(status):
    return status.isin("VALIDATED", "NORMALIZED", "EXTRACTED")


def legacy_blocks(items: DataFrame) -> DataFrame:
    """rx_id, item_no, BLOCK_FIELDS: NONE for what is missing, oral for a missing route."""
    none = lambda c: F.coalesce(c, F.lit("NONE"))
    return items.select(
        "rx_id", "item_no", F.col("medicine").alias("Drug_name"), none("strength").alias("strength"), none("frequency").alias("frequency"), none("duration").alias("duration"),
        F.coalesce("route", F.lit("oral")).alias("route"), none("instruction").alias("instruction"), none("additional_instruction").alias("additional_instruction"),
    )


def formatted(blocks: DataFrame) -> DataFrame:
    """rx_id, output: the blocks of a prescription as text."""
    one = F.struct("item_no", format_block(*[F.col(f) for f in BLOCK_FIELDS]).alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda b: b["block"])
    return blocks.groupBy("rx_id").agg(F.array_join(ordered, "\n").alias("output"))


def display_rows(items: DataFrame) -> DataFrame:
    """One table row an item."""
    both = F.nullif(F.concat_ws("; ", "instruction", "additional_instruction"), F.lit(""))
    return items.select("rx_id", "item_no", "medicine", "frequency", "duration", both.alias("instructions"), F.upper(F.coalesce("route", F.lit("ORAL"))).alias("route"), F.slice(F.coalesce("options", F.array().cast("array<string>")), 1, 3).alias("options"))


def apply_review_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: rx_id, item_no, action (accept, reject, edit, delete, add), value. Accept puts the value as the name and
    clears the options; reject drops that option, and the row once none is left; edit puts the name; add makes a row."""
    d = decisions.groupBy("rx_id", "item_no").agg(
        F.max_by("value", F.when(F.col("action").isin("accept", "edit"), F.col("seq"))).alias("name"), F.bool_or(F.col("action") == "accept").alias("accepted"),
        F.bool_or(F.col("action") == "delete").alias("deleted"), F.collect_set(F.when(F.col("action") == "reject", F.col("value"))).alias("rejected"),
    )
    rows = items.join(d, ["rx_id", "item_no"], "left")
    left = F.array_except("options", F.coalesce("rejected", F.array().cast("array<string>")))
    rows = rows.withColumn("__left", F.when(F.coalesce("accepted", F.lit(False)), F.array().cast("array<string>")).otherwise(left))
    gone = F.coalesce("deleted", F.lit(False)) | ((F.size("options") > 0) & (F.size("__left") == 0) & ~F.coalesce("accepted", F.lit(False)))
    kept = rows.where(~gone).withColumn("medicine", F.coalesce("name", "medicine")).withColumn("options", F.col("__left")).select(*items.columns)
    added = decisions.where("action = 'add'").select("rx_id", "item_no", F.col("value").alias("medicine"))
    return kept.unionByName(added, allowMissingColumns=True)


def dedup_blocks(blocks: DataFrame, by: str = "rx_id", order: str = "item_no", name: str = "Drug_name") -> DataFrame:
    """The first block of each medicine name, case and blanks around aside; blocks of name NONE all stay."""
    key = F.lower(F.trim(name))
    first = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    return blocks.withColumn("__n", first).where((key == "none") | (F.col("__n") == 1)).drop("__n")
