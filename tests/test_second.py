"""The second extraction on literal dictations, and the containment index against comparing all pairs."""

import random

import pytest

from scribelake.functions import text as T
from scribelake.operators import containment, lookup, second
from scribelake.operators import formulary as C

DICTATIONS = [
    "Take Paracetamol 650 mg twice daily for 5 days after meals. Meet the doctor after 5 days.",
    "Take Dolo 650 mg once daily. Take Pan 40 mg before breakfast for 7 days. Avoid alcohol. Complete the full course of the antibiotic.",
    "Take Augmentin 625 mg 1 tablet twice daily for 5 days. Do not stop the antibiotic course early. Take rest and drink plenty of fluids",
    "Apply Soframycin ointment twice daily to the wound, increase the dose by 20 mg if swelling persists",
    "Take Telma 40 mg once daily, increase the dose by 20 mg if blood pressure remains high, consult your doctor",
    "Inhale one rotacap of Foracort 200 mcg twice daily. Rinse your mouth thoroughly after using the inhaler. Both should be taken for 10 days",
    "Take Dolo 500 mg and Pan 40 mg twice daily for 3 days. Return if the rash involves the face",
    "Hello doctor how are you. I have fever.",
    "",
    None,
    "Take one tablet of Crocin every 6 hours. It should be taken 3 times a day",
    "Take water. Give Azithromycin 500 mg at bedtime",
    "Drink plenty of fluids. Take Dolo 650 mg daily. Take Pan 40 mg daily. Avoid smoking.",
]
# rx_id, item_no, medicine, strength, frequency, duration, route, instruction, additional_instruction
WANT = [
    (0, 1, "Paracetamol", "650 mg", "twice daily", "5 days", "oral", "1. after meals", "1. Meet the doctor after 5 days"),
    (1, 1, "Dolo 650 mg", None, "once daily", None, "oral", None, None),
    (1, 2, "Pan 40 mg", None, None, "7 days", "oral", "1. before breakfast", "1. Avoid alcohol"),
    (2, 1, "Augmentin 625 mg", "1 tablet", "twice daily", "5 days", "oral", None, "1. Do not stop the antibiotic course early 2. Take rest 3. Drink plenty of fluids"),
    (3, 1, "Soframycin", None, "twice daily", None, "topical", None, "1. increase the dose by 20 mg 2. If swelling persists"),
    (4, 1, "Telma 40 mg", None, "once daily", None, "oral", None, "1. increase the dose by 20 mg 2. If blood pressure remains high, consult your doctor"),
    (5, 1, "Foracort 200 mcg", None, "twice daily", "10 days", "inhalation", "1. rinse your mouth thoroughly after using the inhaler", "1. Rinse your mouth thoroughly after using the inhaler"),
    (5, 2, "Both should be taken", None, None, "10 days", "oral", None, "1. Both should be taken for 10 days"),
    (6, 1, "Dolo 500 mg", None, "twice daily", "3 days", "oral", None, None),
    (6, 2, "Pan 40 mg", None, "twice daily", "3 days", "oral", None, "1. Return 2. If the rash involves the face"),
    (10, 1, "Crocin", None, "every 6 hours", None, "oral", None, None),
    (11, 1, "Azithromycin", "500 mg", "at bedtime", None, "oral", "1. at bedtime", "1. Take water"),
    (12, 1, "Dolo 650 mg", None, "daily", None, "oral", None, None),
    (12, 2, "Pan 40 mg", None, "daily", None, "oral", None, "1. Drink plenty of fluids 2. Avoid smoking"),
]


@pytest.fixture(scope="module")
def cat(spark):
    return C.catalogue(C.build_formulary(spark.createDataFrame([], C.RAW), None, True))


def test_dictations(spark, cat):
    rows = spark.createDataFrame(list(enumerate(DICTATIONS)), "rx_id long, text string")
    got = second.extract_b(rows, cat).drop("confidence").orderBy("rx_id", "item_no").collect()
    assert [tuple(r) for r in got] == WANT


def test_standard(spark, cat):
    rows = spark.createDataFrame([(1, DICTATIONS[0]), (2, DICTATIONS[2]), (3, DICTATIONS[11]), (4, "")], "rx_id long, text string")
    got = {(r["rx_id"], r["medicine"]): r for r in second.standard(rows, cat).collect()}
    assert got[1, "Paracetamol 650 mg"]["strength"] == "650 mg" and got[1, "Paracetamol 650 mg"]["status"] == "NORMALIZED"
    assert got[2, "Augmentin 625 mg"]["status"] == "CONFLICT" and got[2, "Augmentin 625 mg"]["strength"] == "625 mg"
    assert got[3, "Azithromycin"]["confidence"] == 0.85
    assert {rx for rx, _ in got} == {1, 2, 3}


def test_match_spans(spark):
    texts = ["take 5 mg, then 10 mg and 5 mg", "", "no dose", "5 mg", None, "5 mg5 mg"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.match_spans(T.F.col("t"), r"\d+ MG").alias("m")).collect()
    import re

    for r in rows:
        want = None if r["t"] is None else [(m.start(), m.end(), m.group()) for m in re.finditer(r"(?i)\d+ MG", r["t"])]
        assert (None if r["m"] is None else [tuple(m) for m in r["m"]]) == want


def test_containment(spark):
    rng = random.Random(7)
    word = lambda k: "".join(rng.choice("abé") for _ in range(k))
    left = [word(rng.randrange(0, 7)) for _ in range(120)] + [None, "", "zzz", "ab"]
    right = [word(rng.randrange(0, 12)) for _ in range(150)] + [None, "", "zz"]
    a, b = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(x,) for x in right], "y string")
    pairs = {(x, y) for x in left for y in right if x and y and x in y}
    found = containment.contained(a, b)
    assert sorted(map(tuple, found.collect())) == sorted(pairs)
    both = {(x, y) for x in left for y in right if x and y and (x in y or y in x)}
    assert sorted(map(tuple, containment.either_contains(a, b).collect())) == sorted(both)
    assert containment.contained(a.where("false"), b).count() == containment.contained(a, b.where("false")).count() == 0


def test_no_nested_loops(spark, cat):
    keys = spark.createDataFrame([("dolo",), ("paracetamol",), ("pan",), ("",), (None,)], "key string")
    for find in (lookup.find_by_brand, lookup.find_by_generic, lookup.strengths_for_base):
        plan = find(keys, cat)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["key"] for r in lookup.strengths_for_base(keys, cat).collect()} == {"dolo", "pan"}
    assert "650" in lookup.strengths_for_base(keys, cat).where("key = 'dolo'").first()["strengths"]
