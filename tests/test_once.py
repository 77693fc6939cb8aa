"""Equal values are worked on once, and every row has its result."""

import json

from pyspark.sql import functions as F

from scribelake.functions import text as T
from scribelake.llm import quality
from scribelake.operators import clauses, extract
from scribelake.operators import formulary as C
from scribelake.operators.once import once


def test_once(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def low(a):
        worked.add(1)
        return None if a is None else a.lower()

    values = [("A", 1), ("A", 1), ("A", 2), (None, 1), (None, None), (None, 1), ("", 1)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "n int, a string, b int")
    got = {r["n"]: (r["a"], r["b"], r["low"]) for r in once(rows, ["a", "b"], lambda each: each.withColumn("low", low("a"))).collect()}
    assert got == {i: (a, b, a and a.lower()) for i, (a, b) in enumerate(values)}
    assert worked.value == 5


def test_equal_texts_are_cut_once(spark):
    text = "Take Dolo 650 mg twice daily. Avoid alcohol. Take Pan 40 mg once daily for 5 days."
    rows = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "Rest well."), (5, "Rest well.")], "rx_id int, text string")
    cut = clauses.segment(rows)
    got = sorted((r["rx_id"], r["clause_id"], r["clause"], tuple(r["advice"]), r["start_char"], r["end_char"]) for r in cut.collect())
    one = [(1, "Take Dolo 650 mg twice daily", ("Avoid alcohol",), 0, 28), (2, "Take Pan 40 mg once daily for 5 days", (), 45, 81)]
    assert got[:4] == [(rx, *c) for rx in (1, 2) for c in one] and [g[:3] for g in got[4:]] == [(5, 1, "Rest well")] * 2
    assert "Aggregate [text" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_equal_prescriptions_have_equal_items(spark):
    cat = C.catalogue(C.build_formulary(spark.createDataFrame([], C.RAW), None, True))
    text = "Take Dolo 650 mg twice daily for 5 days. Take Pan 40 mg once daily."
    rows = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "Take Pan 40 mg once daily.")], "rx_id int, text string")
    got = sorted((r["rx_id"], r["item_no"], r["medicine"], r["strength"], r["duration"]) for r in extract.extract(rows, cat).collect())
    dolo, pan = ("Dolo 650 mg", "650 mg", "5 days"), ("Pan 40 mg", "40 mg", None)
    assert got == [(1, 1, *dolo), (1, 2, *pan), (2, 1, *dolo), (2, 2, *pan), (4, 1, *pan)]


def test_block_values_are_read_once(spark):
    rows = spark.createDataFrame([("Drug_name: A tab\nstrength: 1\nDrug_name: a\nstrength: 2",), (None,)], "c string")
    parsed = rows.select(T.parse_blocks(F.col("c")).alias("b"))
    assert [[(b["Drug_name"], b["strength"]) for b in r["b"]] for r in parsed.collect()] == [[("A", "1")], [("NONE", "NONE")]]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("*duration") == 1


def test_texts_are_not_shuffled_for_labels(spark, tmp_path, monkeypatch):
    docs = [(i, f"word {i} " * 9 if i % 2 else "!! " * i) for i in range(1, 200)] + [(1, "again"), (None, "x"), (500, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 150)] + [(900, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    met = []
    monkeypatch.setattr(quality, "fit_featured", lambda rows, share: met.append(rows))
    quality.quality_model(spark, str(tmp_path))
    plan = met[0]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("MapInPandas")
    known = {i for i in range(1, 150) if __import__("zlib").crc32(str(i).encode()) % 4 != 2}
    want = sorted((i % 2, json.dumps([float(v) for v in quality.features(t)])) for i, t in docs if i in known and t is not None)
    assert sorted((r["label"], json.dumps(list(r["x"]))) for r in met[0].collect()) == want
