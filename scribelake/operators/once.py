"""Work on equal values done once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "__once"


def digest(given: list[str]) -> Column:
    """32 bytes of each of the columns (strings or numbers): SHA-256 of the value, zeros for null."""
    of = lambda c: F.coalesce(F.unhex(F.sha2(F.col(c).cast("string").cast("binary"), 256)), F.lit(bytes(32)))
    return F.concat(*[of(c) for c in given])


def once(rows: DataFrame, given: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows and the columns that work adds to the columns given; equal values of these, null among them, are
    worked on once, dealt over all partitions, since work on texts is large against their size.

    Results meet the rows by a digest of the values, which work gets as column KEY and must keep; the values themselves it
    may drop. rows are read twice. Columns of rows that work adds again are replaced.
    """
    # By a hash of the values: Spark would leave out a deal like that of distinct, which is put together by size.
    each = rows.select(*given).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*given))
    done = work(each.withColumn(KEY, digest(given)))
    made = [c for c in done.columns if c not in (*given, KEY)]
    own = [c for c in rows.columns if c not in made]
    return rows.select(*own, digest(given).alias(KEY)).join(done.select(KEY, *made), KEY).select(*own, *made)
