"""Order within groups of any size, exactly: rows are dealt by ranges of (group, order), so that no task holds a whole group.

A group's rows lie in a run of ranges. Counts or sums by group and range are few; their running totals say how much of a
group lies before each range, and only within a range are rows put in order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _ranged(rows: DataFrame, by: list[str], order: list[Column], label: str) -> DataFrame:
    """rows in written ranges, with __part (the range). Equal keys are told apart, so they can be cut anywhere."""
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    return materialize(rows.repartitionByRange(*[F.col(c) for c in by], *order, "__tie").withColumn("__part", F.spark_partition_id()), label)


def _meet(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """left and the columns of right other than by, where by and __part agree. Null groups are groups like any other."""
    names = {c: f"__of_{c}" for c in [*by, "__part"]}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(other, same, how).drop(*names.values())


def _before(ranged: DataFrame, by: list[str], total: Column) -> DataFrame:
    """by, __part, __before: the group's total in earlier ranges."""
    totals = ranged.groupBy(*by, "__part").agg(total.alias("__own"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum("__own").over(earlier), F.lit(0)))


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows and name: the sum of value over the rows of the group up to each row, in order. With F.lit(1) it numbers them."""
    ranged = _ranged(rows.withColumn("__value", value), by, [F.col(c) for c in order], "running")
    within = Window.partitionBy(*by, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumn("__sum", F.sum("__value").over(within))
    before = _before(ranged, by, F.sum("__value"))
    return _meet(own, before.drop("__own"), by, "left").select(*rows.columns, (F.col("__sum") + F.col("__before")).alias(name))


def order_statistics(df: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and a column for each of ranks: the value at this place, from 0, of the group's sorted values. ranks: functions of
    the number of values. Nulls have no place; groups of nulls alone have no row.

    Only the ranges that hold a rank are put in order.
    """
    ranged = _ranged(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")), by, [F.col("__v")], "ranks")
    sizes = _before(ranged, by, F.count("*")).withColumn("__n", F.sum("__own").over(Window.partitionBy(*by)))
    places = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("__n")).cast("long").alias("k")) for name, rank in ranks.items()])
    wanted = sizes.select(*by, "__part", "__own", "__before", F.explode(places).alias("w")).where((F.col("w.k") >= F.col("__before")) & (F.col("w.k") < F.col("__before") + F.col("__own")))
    wanted = materialize(wanted.select(*by, "__part", F.col("w.name").alias("__name"), (F.col("w.k") - F.col("__before") + 1).alias("__k")), "ranks-wanted")
    here = wanted.select(*by, "__part").distinct()
    found = _meet(ranged, here, by, "left_semi")
    found = found.withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__v", "__tie")))
    at = _meet(found, wanted, by, "inner").where(F.col("__place") == F.col("__k"))
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks])
