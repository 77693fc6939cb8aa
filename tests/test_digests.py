"""Rows meet the results of their texts by digests, and the items of orders are dealt once, before texts are made of them."""

import re

from pyspark.sql import functions as F

from scribelake.operators import once as O
from scribelake.plans import tables as S
from scribelake.plans.registry import QUERIES


def _orders(spark, folder):
    parts = [(i, n, f"Brand#{i + 1}", "PROMO", 5 + i, 900.0) for i, n in enumerate(("cold widget", "small bolt", "blue rod"))]
    lines = [(rx, ((rx or 2) + k) % 3, 1, k, float(k), 1.0, 0.07 if (rx or 2) % 2 else None) for rx in (*range(1, 9), None) for k in range(1, 2 + (rx or 2) % 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _exchanges(df, on):
    """The distinct exchanges by a column, of the final plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if re.search(rf"(?<!Reused)Exchange hashpartitioning\({on}#", line)]


def test_digests_tell_nulls_and_columns_apart(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("ab", ""), ("", "ab"), (None, "a"), ("a", None), (None, None), ("", "")], "a string, b string")
    digests = [bytes(r["d"]) for r in rows.select(O.digest(["a", "b"]).alias("d")).collect()]
    assert len(set(digests)) == 8 and {len(d) for d in digests} == {64}


def test_rows_do_not_meet_results_by_their_text(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "n int, t string")
    out = O.once(rows, ["t"], lambda each: each.select(O.KEY, F.length("t").alias("size")))
    assert sorted(tuple(r) for r in out.select("n", "size").collect()) == [(1, 1), (2, 1), (3, None), (4, 1)]
    plan = out.select("n", "size")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join" in line and "t#" in line.split("Join")[1]] == []


def test_items_of_orders_are_dealt_once(spark, tmp_path):
    folder = _orders(spark, tmp_path)
    items = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert items(S.orders(spark, folder)) == items(S.dictation(spark, folder))
    texts = S.texts(spark, folder)
    assert len(_exchanges(texts, "l_orderkey")) == 1
    assert not [line for line in texts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "text" in line]


def test_advice_is_counted_once_a_text(spark, tmp_path):
    out = QUERIES["j17_route_advice"](spark, _orders(spark, tmp_path))
    assert {r["rx_id"]: (r["n"], r["advice"]) for r in out.collect()} == {rx: (1 + (rx or 2) % 4, "Avoid alcohol") for rx in (*range(1, 9), None)}
    assert not _exchanges(out, "rx_id")
