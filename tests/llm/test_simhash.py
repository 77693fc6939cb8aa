"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from scribelake.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > len(h))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "délta", "eps x", "zeta,", "İx", "theta", "iota", "kappa"]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 80, 300]))] for _ in range(40)]
    out = [" ".join(b) for b in base] + [None, "", " \t\x0b", "\x1c", " ".join(base[4]).upper()]
    for b in base[:25]:
        for _ in range(4):
            c = list(b)
            if c:
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append("\n".join(c))
    return out


def test_fingerprint(texts):
    for t in texts + ["word " * 40000]:
        assert simhash.text_fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("largest", [8192, 3])
def test_near_duplicates(spark, texts, largest):
    rows = [(100 - i, t, 1, "x") for i, t in enumerate(texts)] + [(100, texts[0], 2, "again"), (None, "lone words with no id at all", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, fp string")
    got = simhash.near_duplicates(docs, largest=largest).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    nodes = sorted(set(fps))
    root = plain_components(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
    smallest = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            smallest[root[f]] = min(smallest.get(root[f], r[0]), r[0])
    want = sorted((str(r[0]), f, str(smallest.get(root[f]))) for r, f in zip(rows, fps))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 20, dtype=np.uint64)
    points = seeds[rng.integers(0, 20, 600)]
    for _ in range(4):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    points = np.unique(points)
    a, b = simhash.tree_links(points, 3, at_once=5000)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(points)) for i in range(j) if (int(points[i]) ^ int(points[j])).bit_count() <= 3}
    assert got == want


def test_long_paths(spark):
    rng = random.Random(9)
    names = rng.sample(range(1000), 60)
    links = list(zip(names, names[1:])) + [(2000, 2001), (2001, 2002), (2003, 2003)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: min(names) for n in names if n != min(names)} | {2001: 2000, 2002: 2000}


@pytest.mark.parametrize("bits", [64, 1 << 29])
def test_deduplicate(spark, texts, monkeypatch, bits):
    """Whether the bitmap lets all rows through to the join or few."""
    from scribelake.llm import common

    monkeypatch.setattr(common, "MARK_BITS", bits)
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(100, texts[0], "again"), (None, "lone words with no id at all", None), (None, "lone words with no id at all", None), (500, None, "y"), (501, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decided string").repartition(4)
    fps = [plain_fingerprint(r[1]) for r in rows]
    root, first = plain_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3), {}
    for r, f in zip(rows, fps):
        first[root[f]] = min(first.get(root[f], (True, 1 << 60)), (r[0] is None, r[0] or 0))
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.deduplicate(docs).collect()]
    assert sorted(got) == sorted(first.values())
    assert simhash.deduplicate(docs).columns == docs.columns and simhash.deduplicate(docs.where("false")).count() == 0
