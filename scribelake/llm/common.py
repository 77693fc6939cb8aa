"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_folder  # noqa: F401

FIT_CHARS = 30_000  # of a row that a model is fitted on; with the bound on rows, this bounds what the driver holds

MARK_BITS = 1 << 29  # of the bitmap of marks, at most: 64 MB


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def kept(owner: tuple, make):
    """What make() gives, which this worker keeps for owner until another owner asks. A worker outlives its stage, so what each
    stage keeps would add up. Not for two owners that take turns within a task."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def forget() -> None:
    """Drop what kept() keeps, at the end of a task: an executor has more workers than tasks, and those that wait hold theirs."""
    _kept.clear()


def unused(columns, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def holdout_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, each: int) -> tuple[list, float]:
    """(text, label) rows outside the held-out remainder, at most `each` of label 0 and of label 1, chosen by a hash of
    the id and in a fixed order; and the share of label 1 among all labels outside that remainder.

    A model is fitted on these rows only, on FIT_CHARS characters at most of each. Nothing but the text leaves this
    function with the label.
    """
    known = labels.where((holdout_bucket(F.col("doc_id"), modulus) != held) & F.col(label).isin(0, 1))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("pick"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    take = lambda y: known.where(F.col("label") == y).orderBy("pick", "doc_id").limit(each)
    chosen = take(0).unionByName(take(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    found = rows.select("pick", "doc_id", "label", F.left("text", F.lit(FIT_CHARS)).alias("text")).collect()
    found.sort(key=lambda r: (r["pick"], r["doc_id"], r["label"], r["text"]))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [(r["text"], r["label"]) for r in found], share


def maybe_marked(key: Column, marks: DataFrame) -> Column:
    """False for keys (long) that are surely none of marks (one column, long).

    The marks go to the workers as a bitmap with a bit for each mark's last digits: of 64 bits a mark, so that one in 64 other
    keys is let through, but never more than MARK_BITS, whatever the number of marks; beyond some ten million marks more are
    let through. What is let through must meet the marks in a join; the rest stays where it is read.
    """
    marks = marks.toDF("mark")
    bits = min(MARK_BITS, max(64, 1 << (64 * marks.count() - 1).bit_length()))
    at = F.col("mark").bitwiseAND(F.lit(bits - 1))
    words = marks.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(mark & {bits - 1} & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = marks.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        place = keys.to_numpy(np.int64) & (bits - 1)
        return pd.Series((shared.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return maybe(key)
