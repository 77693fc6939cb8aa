"""The name ladder and what else there is of a product, on literal names."""

import pytest

from scribelake.operators import formulary as C
from scribelake.operators import lookup


@pytest.fixture(scope="module")
def cat(spark):
    return C.catalogue(C.build_formulary(spark.createDataFrame([], C.RAW), None, True))


def test_ladder(spark, cat):
    keys = ["Dolo", "99003", "tel ma", "grocin", "Dolo xyzzy", "Dollo xyzzy qqqq", "zzzzzz", "", None, "water"]
    got = {r["key"]: r for r in lookup.ground_medicine(spark.createDataFrame([(k,) for k in keys], "key string"), cat).collect()}
    name = {r["drug_id"]: r["base_name"] for r in cat.products.collect()}
    assert {k: (r["rung"], name[r["drug_id"]], r["suggested"]) for k, r in got.items() if k in ("Dolo", "99003", "tel ma", "grocin")} == {
        "Dolo": (1, "DOLO", False), "99003": (1, "PAN", False), "tel ma": (2, "TELMA", False), "grocin": (3, "CROCIN", True),
    }
    assert got["Dolo xyzzy"]["rung"] in (3, 4) and name[got["Dolo xyzzy"]["drug_id"]] == "DOLO"
    assert not {"zzzzzz", "", None, "water"} & set(got)
    assert got["Dolo"]["confidence"] == 0.95


def test_same_dose(spark, cat):
    by = {r["drug_id"]: r for r in cat.products.collect()}
    keys = spark.createDataFrame([("dolo", "650 mg"), ("dolo", "777"), ("dolo", None), ("grocin", "500 mg"), ("nothing like it", "5"), (None, "5")], "key string, dose string")
    rows = lookup.same_dose(keys, cat).orderBy("key", "dose", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault((r["key"], r["dose"]), []).append(by[r["drug_id"]]["drug_name"])
    assert got["dolo", "650 mg"][0] == "DOLO 650 TAB" and all("650" in n for n in got["dolo", "650 mg"])
    assert got["dolo", "777"] == got["dolo", None] and got["dolo", None][:2] == ["DOLO 650 TAB", "DOLO 500 TAB"]
    assert got["grocin", "500 mg"][0] == "CROCIN 500 TAB" and ("nothing like it", "5") not in got


def test_available_drugs(spark, cat):
    ids = {r["drug_name"]: r["drug_id"] for r in cat.products.collect()}
    dolo = ids["DOLO 650 TAB"]
    items = [(1, dolo, "500", "650 mg", "Dolo"), (2, dolo, None, "650 mg", "Dolo"), (3, dolo, None, None, "Dolo 500 mg"), (4, dolo, None, None, "Dolo"), (5, None, "5", None, "x"), (6, dolo, "", None, None)]
    rows = lookup.with_available_drugs(spark.createDataFrame(items, "n long, drug_id string, dose string, strength string, medicine string"), cat).collect()
    got = {r["n"]: [d["drug_name"] for d in r["available_drugs"]] for r in rows}
    assert got[1][0] == got[3][0] == "DOLO 500 TAB" and got[2][0] == "DOLO 650 TAB"
    assert got[4] == got[6] and len(got[4]) > len(got[1]) and got[5] == [] and len(rows) == 6
    first = next(r for r in rows if r["n"] == 2)["available_drugs"][0]
    assert first["drug_id"] == dolo and "650" in first["strengths"] and first["routes"] == ["ORAL", "RT"] and first["drug_type"] == "b"


def _products(spark, rows):
    return C.catalogue(C.build_formulary(spark.createDataFrame([(i, code, name, "b", generic, brand, None, k) for k, (i, code, name, generic, brand) in enumerate(rows)], C.RAW)))


def test_decimal_dose_in_code(spark):
    own = _products(spark, [("1", "A-25", "ALPHA TAB", "G", "ALPHA"), ("2", "A-2.5", "ALPHA TAB", "G", "ALPHA"), ("3", "A-12.50", "ALPHA TAB", "G", "ALPHA")])
    keys = spark.createDataFrame([("alpha", "2.5 mg"), ("alpha", "50"), ("alpha", "7")], "key string, dose string")
    got = {}
    for r in lookup.same_dose(keys, own).orderBy("rank").collect():
        got.setdefault(r["dose"], []).append(r["drug_id"])
    assert got == {"2.5 mg": ["2"], "50": ["3"], "7": ["1", "2", "3"]}


def test_formulations_of_crowded_names(spark):
    """Many products of few names, brands and generics, with more hits than the limit: as by comparing all with all."""
    import random
    import re

    rng = random.Random(5)
    rows = [(str(k), f"{rng.choice('XYZ')}{k}-{rng.randint(1, 9)}", f"{rng.choice(['ALPHA', 'BRAVO', 'DELTA', 'GAMMA'])} {rng.choice([5, 7, 12, 40])} TAB", rng.choice(["G1", "G2", "G3"]), rng.choice(["B1", "B2"])) for k in range(150)]
    own = _products(spark, rows)
    products = own.products.collect()
    asked = [(p["drug_id"], n) for p in products[:12] for n in ("5", "7", "3", "12", "77", None)]
    want = {}
    for of, number in asked:
        me = next(p for p in products if p["drug_id"] == of)
        pool = {}
        for p in products:
            places = [i for i, c in enumerate(("base_name", "brand_name", "generic_name")) if p[c] == me[c]]
            if places:
                hit = number is not None and (number in p["strength_values"] or any(re.search(rf"\b{number}\b", p[c]) for c in ("drug_name", "drug_code")))
                pool[p["drug_id"]] = (hit, places[0], p["ord"])
        some = any(h for h, *_ in pool.values())
        want[of, number] = sorted((x for x in pool if pool[x][0] or not some), key=lambda x: (*pool[x][1:], x))[:4]
    got = {}
    for r in lookup._formulations(spark.createDataFrame(asked, "drug_id string, number string"), own, 4).orderBy("rank").collect():
        got.setdefault((r["drug_id"], r["number"]), []).append(r["other"])
    assert got == want
