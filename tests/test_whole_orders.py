"""Queries over all items of an order against the rules in plain Python."""

import random
import re

import pytest

from scribelake.plans.registry import QUERIES

FREQUENCY = {0: "Twice a day (1-0-1)", 1: "Twice a day (1-0-1)", 2: "Thrice a day (1-1-1)", 3: "Once a day (1-0-0)", 4: "every 6 hours"}
SAID = {0: "twice daily", 1: "1-0-1", 2: "TID", 3: "once daily", 4: "every 6 hours"}


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """The folder of the tables, and rx_id: the items in order."""
    rng, folder = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    names = ["cold widget", "small widget", "large bolt", "large widget", "blue rod", "cold rod"]
    parts = [(i, n, f"Brand#{i + 1}", "PROMO", 5 + 7 * i, 900.0) for i, n in enumerate(names)]
    lines = [(rx, rng.randrange(6), 1, rng.randrange(1, 5), float(rng.randrange(1, 40)), float(k), 0.07 if rng.random() < 0.4 else 0.01) for rx in range(1, 30) for k in range(rng.choice([1, 2, 4, 8]))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    found = {}
    for rx, part, _, line, quantity, _, discount in sorted(lines, key=lambda r: (r[0], r[3], r[1], r[2], r[4], r[5])):
        name, strength, days = names[part], f"{5 + 7 * part} mg", f"{int(quantity)} days"
        text = f"Take {name} {strength} {SAID[line % 5]} for {days}{' after meals' if discount > 0.05 else ''}."
        items = found.setdefault(rx, [])
        items.append(dict(no=len(items) + 1, name=name, medicine=f"{name} {strength}", strength=strength, frequency=FREQUENCY[line % 5], duration=days, text=text))
    assert max(map(len, found.values())) == 8
    return folder, found


def reconciled(rx, items):
    text = " ".join(i["text"] for i in items).lower()
    a = [i for i in items if i["no"] % 6]
    b = [dict(i, medicine=i["name"], strength="777 mg" if (rx + i["no"]) % 7 == 0 else i["strength"]) for i in reversed(items) if (rx + i["no"]) % 5]
    free, out = list(b), []
    for x in a:
        p, y = x["medicine"].split()[0].upper(), None
        for z in free:
            q = z["medicine"].split()[0].upper()
            if p == q or p in z["medicine"].upper() or q in x["medicine"].upper():
                y = z
                break
        if y is None:
            out.append((x["medicine"], x["strength"], "NORMALIZED" if b else "EXTRACTED", 0))
            continue
        free.remove(y)
        f, g = x["frequency"].lower(), y["frequency"].lower()
        alike = any(w in f and w in g for w in ("once", "twice")) or f in g or g in f
        n = (x["strength"] != y["strength"]) + (x["duration"] != y["duration"]) + (not alike)
        out.append((max(x["medicine"], y["medicine"], key=len), x["strength"], "CONFLICT" if n else "NORMALIZED", n))
    left = [(y["medicine"], y["strength"], "NORMALIZED", 0) for y in free if y["medicine"] in text]
    return {(rx, k + 1, *row) for k, row in enumerate(out + left)}


def test_reconcile(spark, orders):
    folder, found = orders
    got = [tuple(r) for r in QUERIES["x14_reconcile_all_items"](spark, folder).collect()]
    want = set().union(*(reconciled(rx, items) for rx, items in found.items()))
    assert set(got) == want and len(got) == len(want)
    assert {r[4] for r in got} >= {"CONFLICT", "NORMALIZED"}


def test_assemble(spark, orders):
    folder, found = orders
    want = set()
    for rx, items in found.items():
        status = ["ERROR" if (rx + i["no"]) % 5 == 0 else "NEEDS_REVIEW" if (rx + i["no"]) % 3 == 0 else "VALIDATED" for i in items]
        overall = "ERROR" if set(status) == {"ERROR"} else "NEEDS_REVIEW" if set(status) != {"VALIDATED"} else "VALIDATED"
        want.add((rx, ",".join(str(i["no"]) for i, s in zip(items, status) if s != "ERROR"), status.count("ERROR"), overall, len(items)))
    assert {tuple(r) for r in QUERIES["a16_assemble_all_items"](spark, folder).collect()} == want
    assert {w[3] for w in want} == {"ERROR", "NEEDS_REVIEW", "VALIDATED"}


def test_case_failures(spark, orders):
    folder, found = orders
    key = lambda s: " ".join(re.sub(r"[^\w\s]", " ", s.lower()).split())
    want = set()
    for rx, items in found.items():
        actual = [i for i in items if (rx + i["no"]) % 4]
        failures = []
        for k, e in enumerate(items):
            for f in ("medicine", "strength", "frequency", "duration"):
                a = key(actual[k][f]) if k < len(actual) else None
                if a is None or not (a in key(e[f]) or key(e[f]) in a):
                    failures.append(f"item {k + 1}: {f}")
        more = [f"count: expected {len(items)}, got {len(actual)}"] if len(items) != len(actual) else []
        want.add((rx, ";".join(more + sorted(failures)), not more and not failures))
    assert {tuple(r) for r in QUERIES["a10_case_failures_all_items"](spark, folder).collect()} == want
    assert {w[2] for w in want} == {True, False}


def test_pairs_and_suggestions(spark, orders):
    """Greedy pairs against plain Python; suggestions are distinct by base name and dose, ranked from 1, three at most."""
    folder, found = orders
    want = set()
    for rx, items in found.items():
        free = [i for i in items if i["no"] % 3]
        for x in items:
            p = x["medicine"].split()[0].upper()
            y = next((z for z in free if z["medicine"].split()[0].upper() in x["medicine"].upper() or p in z["medicine"].split()[0].upper()), None)
            if y:
                free.remove(y)
            want.add((rx, x["no"], y and y["no"]))
        want |= {(rx, None, z["no"]) for z in free}
    got = {(r["rx_id"], r["item_no"], r["other_no"]) for r in QUERIES["j20_reconcile_pairs"](spark, folder).collect()}
    assert got == want
    by = {}
    for r in QUERIES["t02_top_suggestions"](spark, folder).collect():
        by.setdefault(r["key"], []).append((r["rank"], r["base_name"], r["dose"], r["confidence"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 3
        assert len({r[1:3] for r in rows}) == len(rows) and [r[3] for r in rows] == sorted((r[3] for r in rows), reverse=True)
