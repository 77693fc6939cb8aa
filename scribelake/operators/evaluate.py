"""Scores of extracted items against expected ones, and latency summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_expected
from .ranges import order_statistics

FIELDS = ("medicine", "strength", "frequency", "duration", "route")


def pair_by_ordinal(expected: DataFrame, actual: DataFrame, key: str = "rx_id", order: str = "item_no") -> DataFrame:
    """Each expected item with the actual one of the same place: key, pos, e (struct), a (struct or null).

    The items of a key are few, so they meet as arrays of one row, which stay where the key is.
    """
    listed = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), F.struct(*[F.col(f) for f in FIELDS]).alias("item")))).alias(name))
    both = listed(expected, "__e").join(listed(actual, "__a"), key, "left")
    rows = both.select(key, "__a", F.posexplode("__e").alias("__i", "__of"))
    return rows.select(key, (F.col("__i") + 1).alias("pos"), F.col("__of.item").alias("e"), F.get("__a", F.col("__i"))["item"].alias("a"))


def field_confusion(pairs: DataFrame) -> DataFrame:
    """field, expected, tp, fp, fn. An expected value that is missed or wrong is an fn; a value where none is expected, or
    a wrong one, is an fp; a route or frequency where none is expected counts as no error."""
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("e")[f].alias("e"), F.col("a")[f].alias("a")) for f in FIELDS])).alias("f")).select("f.*")
    ok = matches_expected(F.col("a"), F.col("e"))
    free = F.col("field").isin("route", "frequency")
    return rows.groupBy("field").agg(
        F.count("e").alias("expected"), F.count_if(F.col("e").isNotNull() & ok).alias("tp"),
        F.count_if(F.col("a").isNotNull() & ~ok & ~(F.col("e").isNull() & free)).alias("fp"), F.count_if(F.col("e").isNotNull() & ~ok).alias("fn"),
    )


def field_metrics(confusion: DataFrame) -> DataFrame:
    part = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 4)
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("expected")
    return confusion.select(
        "field", part(tp, tp + fp).alias("precision"), part(tp, n).alias("recall"), part(fp, tp + fp).alias("false_positive_rate"), part(fn, n).alias("false_negative_rate"), part(tp, tp + fp + fn).alias("accuracy"),
    )


def case_failures(pairs: DataFrame, counts: DataFrame, key: str = "rx_id") -> DataFrame:
    """key, failures (sorted), passed. counts: key, expected_count, actual_count."""
    said = lambda f: F.when(~matches_expected(F.col("a")[f], F.col("e")[f]), F.concat(F.lit("item "), F.col("pos").cast("string"), F.lit(f": {f}")))
    items = pairs.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(*map(said, FIELDS)))))).alias("f"))
    wrong = F.col("expected_count") != F.col("actual_count")
    rows = counts.join(items, key, "left")
    more = F.when(wrong, F.array(F.concat(F.lit("count: expected "), F.col("expected_count").cast("string"), F.lit(", got "), F.col("actual_count").cast("string")))).otherwise(F.array().cast("array<string>"))
    failures = F.concat(more, F.coalesce("f", F.array().cast("array<string>")))
    return rows.select(key, failures.alias("failures"), (F.size(failures) == 0).alias("passed"))


def category_pass_rates(cases: DataFrame) -> DataFrame:
    """category (null: all), cases, passed, pass_rate in percent."""
    return cases.rollup("category").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).withColumn("pass_rate", F.round(100 * F.col("passed") / F.col("cases"), 2))


def hallucination_counters(pairs: DataFrame, known: Column, raw: Column) -> DataFrame:
    """One row: values that nothing expects, by kind. pairs with a boolean column for a known medicine and the text."""
    a, e = F.col("a"), F.col("e")
    extra = lambda f: F.count_if(a[f].isNotNull() & e[f].isNull())
    unsaid = F.count_if(a["strength"].isNotNull() & ~F.contains(F.lower(raw), F.lower(F.regexp_extract(a["strength"], r"(\d+(?:\.\d+)?)", 1))))
    return pairs.agg(
        F.count_if(a["medicine"].isNotNull() & ~known).alias("unknown_medicine"), unsaid.alias("unsaid_strength"), extra("strength").alias("invented_strength"),
        extra("duration").alias("invented_duration"), extra("frequency").alias("invented_frequency"),
    )


def latency_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, min, p50, p95, p99, max (interpolated), rounded to 2 places. Groups of any size."""
    rows, keys = (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])
    r = lambda c: F.round(c, 2)
    out = rows.groupBy(*keys).agg(F.count(value).alias("count"), r(F.avg(value)).alias("mean"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    low = {f"__{p}": lambda n, q=q: F.floor(q * (n - 1)) for p, q in shares.items()}
    high = {f"__{p}_next": lambda n, q=q: F.ceil(q * (n - 1)) for p, q in shares.items()}
    found = order_statistics(rows, value, keys, low | high)
    found = found.withColumnsRenamed({c: f"__of_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys])
    place = lambda q: q * (F.col("count") - 1)
    between = lambda p, q: r((F.floor(place(q)) + 1 - place(q)) * F.col(f"__{p}") + (place(q) - F.floor(place(q))) * F.col(f"__{p}_next")).alias(p)
    return out.join(found, same, "left").select(*by, "count", "mean", "min", *[between(p, q) for p, q in shares.items()], "max")


def p95_nearest_rank(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The value at place int(0.95 n) of each sorted group, counted from 0. Groups of any size."""
    rows, keys = (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])
    return order_statistics(rows, value, keys, {"p95": lambda n: F.floor(0.95 * n)}).select(*by, "p95")


def rtf_summary(df: DataFrame, latency: str, duration: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.sum(latency) / F.sum(duration), 4).alias("rtf"), F.count("*").alias("clips"))


def utterance_duration(segments: DataFrame, *by: str) -> DataFrame:
    """max(end) - min(start); without starts, max(end)."""
    return segments.groupBy(*by).agg(F.round(F.max("end") - F.coalesce(F.min("start"), F.lit(0.0)), 2).alias("duration"))


def transcript_success(transcripts: DataFrame, items: DataFrame) -> DataFrame:
    """model, transcripts, extracted (with an item at least), success_rate, mean_latency."""
    n = items.groupBy("rx_id").agg(F.count("*").alias("n"))
    rows = transcripts.join(n, "rx_id", "left")
    return rows.groupBy("model").agg(
        F.count("*").alias("transcripts"), F.count_if(F.col("n") > 0).alias("extracted"), F.round(F.count_if(F.col("n") > 0) / F.count("*"), 4).alias("success_rate"), F.round(F.avg("latency"), 2).alias("mean_latency"),
    )
