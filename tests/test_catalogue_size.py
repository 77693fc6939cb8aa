"""Joins with the catalogue, whose tables are far larger than their files, are not planned by the size of the files."""

import pytest

from scribelake.operators import formulary as C
from scribelake.operators import extract, lookup

# drug_id, drug_code, drug_name, drug_type, generic_name, brand_name, provenance, ord
RAW = [
    ("1", "B#23-5", "COLD ROD 5 TAB", "b", "PROMO", "BRAND#23", None, 3), ("2", "B#23-5", "COLD ROD 5 TAB", "b", "PROMO", "BRAND#23", None, 1), ("3", "B#7-40", "COLD ROD 40 TAB", "b", "PROMO", "BRAND#7", None, 2),
    ("4", "B#9-12", "BLUE BOLT 12 TAB", "b", "PROMO", "BRAND#9", None, 4), ("5", "B#9-12", "BLUE BOLT 12 TAB", "b", "PROMO", "BRAND#9", None, 4), ("6", None, "BLUE BOLT 2.5 TAB", "b", "PROMO", "BRAND#9", None, 5),
]


@pytest.fixture(scope="module")
def cat(spark):
    return C.catalogue(C.build_formulary(spark.createDataFrame(RAW, C.RAW)))


def asked(spark):
    rows = [
        ("cold rod", 2.0, 3.0), ("cold rod", 1.0, 4.0), ("cold rod", 20.0, 20.0), ("cold rod", 1.0, 1.0), ("cold rod", 1.0, 98.0), ("blue bolt", 6.0, 6.0), ("blue bolt", 2.0, 3.0), ("brand#7", 30.0, 10.0),
        ("blu bolt", 6.0, 6.0), ("blue bolt", None, 6.0), ("zzzz", 1.0, 4.0), ("", 1.0, 4.0), (None, 1.0, 4.0),
    ]
    return spark.createDataFrame(rows, "key string, a double, b double")


def test_sums_are_found_without_a_broadcast_of_products(spark, cat):
    found = lookup.find_composite(asked(spark), cat)
    want = {("cold rod", 2.0, 3.0, "2"), ("cold rod", 1.0, 4.0, "2"), ("cold rod", 20.0, 20.0, "3"), ("cold rod", 1.0, 1.0, "2"), ("blue bolt", 6.0, 6.0, "4"), ("blue bolt", 2.0, 3.0, "6"), ("blu bolt", 6.0, 6.0, "4")}
    got = {tuple(r) for r in found.collect()}
    assert {g for g in got if g[0] != "brand#7"} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    products = [line for line in plan.splitlines() if "Join" in line and "drug_id" in line]
    assert products and all("strategy=merge" in line for line in products)


def test_options_and_strengths_without_a_broadcast_of_products(spark, cat):
    options = lookup.composite_options(asked(spark), cat)
    got = sorted((r["drug_id"], r["confidence"], r["rank"]) for r in options.where("key = 'cold rod' and a = 20").collect())
    assert got == [("1", 0.85, 3), ("2", 0.85, 2), ("3", 0.95, 1)]
    for rows in (options, C.strength_map(cat.products, cat.bases)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        products = [line for line in plan.splitlines() if "Join" in line and "drug_id" in line]
        assert products and all("strategy=merge" in line for line in products)


def test_products_of_a_small_file_are_dealt_over_all_partitions(spark):
    one = spark.createDataFrame(RAW, C.RAW).coalesce(1)
    assert C.build_formulary(one).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_said_products_meet_clauses(spark, cat, monkeypatch):
    seen, strength = [], extract.extract_strength
    monkeypatch.setattr(extract, "extract_strength", lambda rows, cat, by, said=None: seen.append(said and said.count()) or strength(rows, cat, by, said))
    rows = spark.createDataFrame([(1, "Take cold rod 5 mg twice daily. Take blue bolt 12 mg daily."), (2, "Take cold rod 40 mg daily.")], "rx_id long, text string")
    got = sorted((r["rx_id"], r["medicine"], r["strength"], r["drug_id"], r["available_routes"]) for r in extract.extract(rows, cat).collect())
    assert got == [(1, "blue bolt 12 mg", "12 mg", "4", ["ORAL"]), (1, "cold rod 5 mg", "5 mg", "2", ["ORAL"]), (2, "cold rod 40 mg", "40 mg", "2", ["ORAL"])]
    assert seen == [2]
