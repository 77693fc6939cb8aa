"""Items of orders are read and their names worked on once, with the same results."""

import json

from pyspark.sql import functions as F

from scribelake.functions import text as T
from scribelake.operators import assemble, evaluate, reconcile, validate
from scribelake.operators import formulary as C

FIELDS = "medicine string, strength string, frequency string, duration string, route string, instruction string, additional_instruction string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prescriptions_are_assembled_in_one_reading(spark):
    rows = [(1, 10, "B", "ERROR", "ERROR", 0.5), (1, 2, "A", "VALIDATED", "NEEDS_REVIEW", 0.9), (1, 1, "C", "VALIDATED", "VALIDATED", 0.8), (2, 1, "D", "ERROR", "ERROR", 0.7), (3, 1, "E", "VALIDATED", "VALIDATED", 0.6)]
    none = "cast(null as string)"
    items = spark.createDataFrame(rows, "rx_id long, item_no int, medicine string, item_status string, val_status string, confidence double").selectExpr(
        "*", f"{none} as strength", f"{none} as frequency", f"{none} as duration", "array(medicine) as warnings", "concat('take ', medicine) as raw_text"
    )
    out = assemble.assemble(items)
    assert "Join" not in plan_of(out)
    got = {r["rx_id"]: ([i["item_no"] for i in r["items"]], [e["item_no"] for e in r["evidence"]], r["overall_status"], r["total_medicines"], r["review_count"], r["metadata"]["rejected"]) for r in out.collect()}
    assert got == {1: ([1, 2], [1, 2, 10], "NEEDS_REVIEW", 3, 1, 1), 2: ([], [1], "ERROR", 1, 0, 1), 3: ([1], [1], "VALIDATED", 1, 0, 0)}


def test_names_are_recognized_in_one_reading(spark):
    cat = C.catalogue(C.build_formulary(spark.createDataFrame([], C.RAW), None, True))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(name):
        read.add(1)
        return name

    names = ["Dolo 650 mg", "Dolo 650 mg", "Dolo", "the doctor", "Qwrtzp 5 mg", None, ""]
    items = spark.createDataFrame([(i, m) for i, m in enumerate(names)], "n int, m string").select("n", same("m").alias("medicine"))
    rows = validate.recognized(items, cat)
    assert read.value == len(names)
    got = {r["n"]: (r["medicine"], r["recognized"], r["is_medication"]) for r in rows.collect()}
    want = [(True, True)] * 3 + [(False, False), (False, True), (False, False), (False, False)]
    assert got == {i: (m, *w) for i, (m, w) in enumerate(zip(names, want))}


def test_names_are_split_once_for_pairs(spark):
    rows = lambda *names: spark.createDataFrame([(1, k, n, *[None] * 6) for k, n in enumerate(names)], f"rx_id long, item_no int, {FIELDS}")
    out = reconcile.pair(rows("Dolo 650", "Pan 40", "", None), rows("pan", "Azee", "dolo", ""))
    assert plan_of(out).count("split(") == 2
    got = [(r["pos"], r["a"] and r["a"]["medicine"], r["b"] and r["b"]["medicine"]) for r in out.collect()]
    assert sorted(got) == [(0, "Dolo 650", "dolo"), (1, "Pan 40", "pan"), (2, "", None), (3, None, None), (4, None, "Azee"), (5, None, "")]


def test_pairs_by_ordinal_stay_with_their_key(spark):
    item = lambda name: (name, None, None, None, None)
    schema = "rx_id long, item_no int, medicine string, strength string, frequency string, duration string, route string"
    e = spark.createDataFrame([(1, 10, *item("b")), (1, 2, *item("a")), (2, 1, *item("c")), (None, 1, *item("d"))], schema)
    a = spark.createDataFrame([(1, 3, *item("x")), (3, 1, *item("y")), (None, 1, *item("z")), (2, 1, *item("u")), (2, 2, *item("v"))], schema)
    out = evaluate.pair_by_ordinal(e, a)
    assert "Window" not in plan_of(out)
    assert {(r["rx_id"], r["pos"], r["e"]["medicine"], r["a"] and r["a"]["medicine"]) for r in out.collect()} == {(1, 1, "a", "x"), (1, 2, "b", None), (2, 1, "c", "u"), (None, 1, "d", None)}


def test_equal_values_match_without_rules(spark):
    pairs = [("1-0-1", "1-0-1"), ("A.", "a"), ("a b", "b"), ("a", "b"), (None, "a"), (None, None), ("a", None), ("", ""), ("...", "...")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, a string, e string").select("n", T.matches_expected(F.col("a"), F.col("e")).alias("ok"))
    assert [r["ok"] for r in sorted(rows.collect())] == [True, True, True, False, False, True, False, True, True]
    assert json.dumps(plan_of(rows)).count("THEN true") == 1
