"""Matches against all windows of all items."""

import random
import re

import numpy as np
import pytest

from scribelake.llm import decontamination as dc


def bag(words, size):
    out = {}
    for i in range(len(words) - size + 1):
        s = tuple(words[i : i + size])
        out[s] = out.get(s, 0) + 1
    return out


def plain(docs, items):
    """All windows of all items, the whole document for items that are longer."""
    parsed = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in items]
    texts = {tuple(w) for _, w in parsed if w}
    df = {}
    for w in texts:
        for s in bag(list(w), min(5, len(w))):
            df[s] = df.get(s, 0) + 1
    out = {}
    for doc, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for item, w in parsed:
            b = bag(w, min(5, len(w))) if w else {}
            for begin in range(max(1, len(words) - len(w) + 1)) if w else ():
                mine = bag(words[begin : begin + len(w)], min(5, len(w)))
                if not mine.keys() & b.keys():
                    continue
                low = sum(min(mine.get(s, 0), n) / df[s] for s, n in b.items())
                high = sum(max(mine.get(s, 0), n) / df[s] for s, n in b.items())
                lost = {s: n - mine.get(s, 0) for s, n in b.items() if n > mine.get(s, 0)}
                foreign = sum(n for s, n in mine.items() if s not in b)
                if foreign:  # each weighs the mean of what it replaces
                    high += foreign * sum(n / df[s] for s, n in lost.items()) / sum(lost.values())
                if low / high >= 0.8:
                    out[doc, item] = max(out.get((doc, item), 0), low / high)
    return out


@pytest.mark.parametrize("at_once", [20_000, 7])
def test_against_all_windows(spark, tmp_path, monkeypatch, at_once):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "x_1"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 5, 12, 30, 60])))) for i in range(20)] + [(20, None), (21, "..."), (22, "Alpha, beta! gamma delta.")]
    items += [(23, items[5][1])]
    docs = []
    for k in range(60):
        body = say(rng.choice([0, 10, 200]))
        passage = rng.choice(items)[1]
        passage = (passage or "").split()
        if passage and k % 3:
            if k % 3 == 2 and len(passage) > 5:
                passage[0 if k % 2 else rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((k, ", ".join(body).upper() if k % 4 == 0 else " ".join(body), "en"))
    docs += [(100, None, "en"), (101, "", "en"), (102, "alpha BETA gamma\ndelta " * 400, "en"), (None, "alpha beta gamma delta", None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, matches string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", at_once)
    got = dc.op3_simhash_decontamination(spark, folder).collect()
    want = plain([d[:2] for d in docs], items)
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want)
    left = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, matches string"), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "matches"]
    assert {r["doc_id"] for r in left.collect()} == {d[0] for d in docs} - {d for d, _ in want}


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, none).count() == 1
    assert dc.decontaminate(docs.where("false"), none.union(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))).count() == 0


def test_index_selects_and_covers_the_similarity():
    rng = random.Random(7)
    words = [[f"v{rng.randrange(10**6)}" for _ in range(59)] for _ in range(300)]
    index = dc.Benchmark([(i, " ".join(w)) for i, w in enumerate(words)])
    memo, missed, tried = dc._Hashes(), 0, 0
    for k, w in enumerate(words):
        for at in (0, 1, 29, 58):  # similarity from 0.96 down to 0.803
            changed = list(w)
            changed[at] = "new"
            changed[-1] = "new" if k % 2 else changed[-1]
            if index.similarity(k, dc.shingle_hashes(dc.word_hashes(" ".join(changed), memo), 5)) >= 0.8:
                tried += 1
                missed += k not in index.matches(dc.word_hashes(" ".join(changed), memo))
    assert tried == 1200 and missed <= 1
    multi = index.index[59]
    at_random = np.random.default_rng(1).integers(0, 1 << 16, (200, 16)).astype(np.uint32)
    keys = at_random | (np.arange(16, dtype=np.uint32) << np.uint32(16))
    candidates = np.searchsorted(multi.keys, keys, "right") - np.searchsorted(multi.keys, keys, "left")
    assert candidates.sum() < 0.05 * 200 * 300  # of random windows, each with all items
    assert not len(multi.within(at_random, dc.RADIUS)[0])
    # and no item within the radius is lost by the blocks
    near = multi.prints.copy()
    for row in near:
        for bit in rng.sample(range(256), dc.RADIUS):
            row[bit // 16] ^= np.uint32(1 << bit % 16)
    window, item = multi.within(near, dc.RADIUS)
    assert {(i, i) for i in range(300)} <= set(zip(window.tolist(), item.tolist()))


def test_words_put_in(spark):
    rng = random.Random(3)
    start, end = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    items = [(i, " ".join([*start, *(f"m{i}x{j}" for j in range(8 + i % 4)), *end])) for i in range(12)]
    docs = []
    for i, text in items:
        for n in (1, 2, 8, 9):
            w = text.split()
            at = rng.randrange(8, 24)
            docs.append((len(docs), " ".join(["x", "y", *w[:at], *(f"n{rng.randrange(99)}" for _ in range(n)), *w[at:], "z"])))
        docs.append((len(docs), " ".join([*start, *(f"n{j}" for j in range(i)), *end, *start, "q", *end])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = dc.with_matches(frame, spark.createDataFrame(items, "item_id long, text string"), "found").collect()
    got = {(r["doc_id"], m["item_id"]): m["similarity"] for r in found for m in r["found"]}
    want = plain(docs, items)
    assert got == {k: pytest.approx(v) for k, v in want.items()} and want


def test_long_text_of_hits(monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(n))) for i, n in enumerate([7, 9, 9, 12])]
    text = " ".join(rng.choice([t for _, t in items] + ["q"]) for _ in range(60))
    index = dc.Benchmark(items)
    for at_once in (2048, 16):
        monkeypatch.setattr(dc, "AT_ONCE", at_once)
        got = {index.ids[k]: s for k, (s, _, _) in index.matches(dc.word_hashes(text, dc._Hashes())).items()}
        assert got == {i: pytest.approx(s) for (_, i), s in plain([(0, text)], items).items()}


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([3, 5, 6, 9, 10, 16, 16, 30, 59, 59])] + [(10, "again " * 30)]
    docs = []
    for _, text in items:
        words = text.split()
        for cut in range(1, len(words)):
            docs += [(len(docs), " ".join(words[:-cut])), (len(docs) + 1, " ".join(words[cut:]))]
        docs.append((len(docs), " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :])))
        docs.append((len(docs), " ".join(["new", *words[1:-1]])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = dc.with_matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], m["item_id"]): m["similarity"] for r in found for m in r["matches"]}
    want = plain(docs, items)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert len(want) > 40


def test_copies_and_blocks_leave_the_similarity(spark, monkeypatch):
    rng = random.Random(8)
    text = [f"w{i}" for i in range(59)]
    near = " ".join([*text[:30], "changed", *text[31:]])
    for copies in (1, 2, 5):
        index = dc.Benchmark([(i, " ".join(text)) for i in range(copies)])
        found = index.matches(dc.word_hashes(near, dc._Hashes()))
        assert [round(s, 3) for s, _, _ in found.values()] == [0.833] * copies
    start, end = [f"a{i}" for i in range(25)], [f"b{i}" for i in range(25)]
    items = [(i, " ".join([*start, f"slot{i}", *end])) for i in range(12)] + [(50 + i, ("W0, " if i else "w0 ") + " ".join(text[1:])) for i in range(6)]
    items += [(80 + i, " ".join(f"v{rng.randrange(90)}" for _ in range(20))) for i in range(6)]
    docs = [(0, near), (1, " ".join(["x", *start[1:], "slot3", *end])), (2, " ".join([*start, "slot99", *end])), (3, items[-1][1] + " more")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for at_once in (20_000, 7, 3):
        monkeypatch.setattr(dc, "ITEMS_AT_ONCE", at_once)
        rows = dc.with_matches(frame, benchmark).collect()
        got.append({(r["doc_id"], m["item_id"]): round(m["similarity"], 9) for r in rows for m in r["matches"]})
    assert got[0] == got[1] == got[2]
    assert {i for d, i in got[0] if d == 0} == set(range(50, 56)) and {i for d, i in got[0] if d == 1} == {3} and (3, 85) in got[0]
    # in item 3, the shingles without the slot are in 12 texts: 37 and 5 of weight 1/12 and 1; the first of them is replaced
    assert got[0][1, 3] == pytest.approx((41 / 12 + 5) / (42 / 12 + 5 + 1 / 12))


def test_blocks_of_repeated_rows(spark, monkeypatch):
    """Equal rows are one item of a block, matched as often as they are; a long item counts as several."""
    equal = [(1, "one two three four five six")] * 5000
    others = [(10 + i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(10)] + [(30, None), (31, " - "), (32, "word " * 5000)]
    benchmark = spark.createDataFrame(equal + others, "item_id long, text string").repartition(4)
    assert [sorted(r[2] for r in items) for items, _ in dc._blocks(benchmark)] == [[1] * 12 + [5000]]
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 4)
    blocks = [items for items, _ in dc._blocks(benchmark)]
    assert all(len(b) <= 4 for b in blocks) and sorted(r[0] for b in blocks for r in b) == [1, *range(10, 20), 31, 32]
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (1, "x one two three four five six y"), (2, "alpha3 beta3 gamma3 delta3 epsilon3"), (3, "nothing"), (None, None), (4, "")], "doc_id long, text string")
    got = dc.with_matches(docs, benchmark).collect()
    assert sorted((str(r["doc_id"]), sorted({m["item_id"] for m in r["matches"]}), len(r["matches"])) for r in got) == [("1", [1], 5000), ("1", [1], 5000), ("2", [13], 1), ("3", [], 0), ("4", [], 0), ("None", [], 0)]
    assert sorted(str(r["doc_id"]) for r in dc.decontaminate(docs, benchmark).collect()) == ["3", "4", "None"]


@pytest.mark.parametrize("bits", [64, 1 << 29])
def test_marks(spark, monkeypatch, bits):
    """Marked keys are let through whatever the size of the bitmap, and few others while it is large enough."""
    from pyspark.sql import functions as F

    from scribelake.llm import common

    monkeypatch.setattr(common, "MARK_BITS", bits)
    rows = spark.range(20000).select(F.xxhash64("id").alias("k"), (F.col("id") % 40 == 0).alias("marked"))
    kept = rows.where(common.maybe_marked(F.col("k"), rows.where("marked").select("k"))).groupBy("marked").count().collect()
    n = {r["marked"]: r["count"] for r in kept}
    assert n[True] == 500 and (n[False] > 15000 if bits == 64 else n.get(False, 0) < 700)
    assert rows.where(common.maybe_marked(F.col("k"), rows.where("false").select("k"))).count() == 0
