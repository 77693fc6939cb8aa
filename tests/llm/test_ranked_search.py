"""Ranked search against scores of all documents by brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scribelake.llm import ranked_search as S


def words(text):
    return re.findall(S.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item_id, rank, doc_id, score), documents without id behind equal scores."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(words(text)) if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Straße", "ÉTÉ", "日本", "a_b", "x-y", "it's"]
    return [" ".join(rng.choice(vocabulary) for _ in range(int(rng.paretovariate(0.9)) % 200)) for _ in range(n)], rng


def test_segment_search_equals_sorting():
    rng = np.random.default_rng(4)
    for _ in range(60):
        many, terms = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        lists = [np.sort(rng.choice(many, int(rng.integers(0, many + 1)), replace=False)) for _ in range(terms)]
        impacts = [rng.integers(0, int(rng.choice([2, 5, 1000])), len(x)) for x in lists]
        ids = rng.permutation(many) * 3 + 1
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        segment = S.Segment(ids, starts, np.concatenate(lists).astype(np.int64), np.concatenate(impacts).astype(np.int64))
        scores = np.zeros(many, np.int64)
        for x, y in zip(lists, impacts):
            np.add.at(scores, x, y)
        for k in (1, 5, 50):
            order = [d for d in np.lexsort((ids, -scores)) if scores[d] > 0][:k]
            at, got = segment.search(np.arange(terms), k)
            assert at.tolist() == order and got.tolist() == scores[order].tolist()


@pytest.mark.parametrize("segment_docs", [7, 1 << 13])
def test_search(spark, monkeypatch, segment_docs):
    monkeypatch.setattr(S, "SEGMENT_DOCS", segment_docs)
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 4 if segment_docs == 7 else 1000)
    texts, rng = made(250, 2)
    texts += [None, "", " -- !", "w1 " * 5000, "copy of a passage w2 w3"] + ["copy of a passage w2 w3"] * 70
    docs = [(i * 5 % 997, t) for i, t in enumerate(texts)] + [(None, "copy of a passage w2 w3"), (None, "w1 w2"), (4, "twice w5"), (4, "twice w5")]
    items = [(i, " ".join(rng.sample(words(" ".join(texts[:200])), 12))) for i in range(10)] + [(20, None), (21, "?!"), (22, "nowhere to find"), (23, "COPY of A passage"), (24, "W1 été straße"), (None, "w2 twice")]
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, term string, places int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items + items[:1]], "item_id long, text string, score int")
    got = sorted(map(tuple, S.search(S.build_index(rows), asked, 50).collect()), key=str)
    assert got == plain(docs, items, 50)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "some text")], "item_id long, text string")
    assert S.search(S.build_index(none), item).count() == 0
    assert S.search(S.build_index(one), item.where("false")).count() == 0
    assert [tuple(r)[:3] for r in S.search(S.build_index(one), item).collect()] == [(7, 1, 1)]


def test_index_holds_every_term(spark):
    texts, _ = made(40, 8)
    index = S.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    ids = next(r["doc_ids"] for r in index if r["term"] is None)
    got = {(r["term"], ids[p]): tf for r in index if r["term"] is not None for p, tf in zip(r["places"], r["tfs"])}
    assert got == {(t, i): n for i, text in enumerate(texts) for t, n in Counter(words(text)).items()}
