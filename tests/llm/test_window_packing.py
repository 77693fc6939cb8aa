"""Windows by differencing: against the library's ids, and against plain differencing of whole vectors."""

import random
import zlib

import numpy as np
import pytest

from scribelake.llm import window_packing as W
from scribelake.llm.tokens import PieceEncoder, vocabulary_path

from .packing_tools import sequence_count

TEXTS = ["Plain words, and plain words.", None, "", " \n\t ", "it's DON'T 'S ''s we'll", "word*** " * 3000, "x" * 30000, "éa É. ́x é", "Plain words, and plain words."]


def padding(rows, capacity):
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    return sum(capacity - n for n in used.values() if n & (n - 1))


def plain_difference(lengths, k):
    """Sums of the windows, with vectors of k sums; the same choice among ties."""
    heap = [(x, -i, [x] + [0] * (k - 1)) for i, x in enumerate(lengths)]
    made, taken = len(lengths), 0
    while len(heap) > 1:
        heap.sort(key=lambda h: (-h[0], -h[1]))
        (_, _, a), (_, _, b) = heap[:2]
        sums = sorted((x + y for x, y in zip(a, b[::-1])), reverse=True)
        taken += sums[-1]
        heap = heap[2:] + [(sums[0] - sums[-1], -made, [s - sums[-1] for s in sums])]
        made += 1
    return sorted(s + taken for s in heap[0][2])


@pytest.mark.parametrize("k", [1, 2, 3, 7, 40, 90])
def test_difference(k):
    rng = random.Random(k)
    for draw in (lambda: rng.randint(1, 2047), lambda: 700, lambda: rng.choice([1, 2, 2000])):
        lengths = [draw() for _ in range(80)]
        windows = W.difference(lengths, k)
        assert sorted(i for w in windows for i in w) == list(range(80))
        sums = sorted([sum(lengths[i] for i in w) for w in windows] + [0] * (k - len(windows)))
        assert sums == plain_difference(lengths, k)
    assert W.difference([], k) == []


def test_near_equal_windows():
    rng = random.Random(3)
    lengths = [rng.randint(1, 600) for _ in range(1000)]
    sums = [sum(lengths[i] for i in w) for w in W.difference(lengths, sum(lengths) // 2048)]
    assert max(sums) - min(sums) < 0.04 * 2048


@pytest.mark.parametrize("lengths", [[], [1], [5, 5, 5], [2047] * 9, [1] * 5000, [1000, 1, 1, 2000, 1500], [1024, 1024], [63, 64, 65]])
def test_fill(lengths):
    pieces = W.fill(lengths, 2048)
    rows = [{"sequence_id": w, "offset": o, "length": n} for _, _, n, w, o in pieces]
    sequence_count(rows, 2048)
    assert padding(rows, 2048) == 0
    spans = {}
    for i, start, n, _, _ in pieces:
        spans.setdefault(i, []).append((start, n))
    for i, n in enumerate(lengths):
        end = 0
        for start, length in sorted(spans[i]):
            assert start == end and length > 0
            end += length
        assert end == n


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i - 4, t, "en", 5) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 1), (1, "twice", "en", 0), (1, "twice", "en", 0)]
    rows += [(100 + i, " ".join(rng.choice(["some", "words", "of", "text"]) for _ in range(rng.randint(0, 70))), "de", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `group` string, place int").repartition(5)
    got = W.pack_windows(docs, vocabulary_path(), 1, 64, group_rows=50, keep_ids=True).collect()
    sequence_count(got, 64)
    assert padding(got, 64) == 0
    library = PieceEncoder(vocabulary_path()).library
    whole = lambda t: tuple(library.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["doc_tokens"], tuple(ids.tolist())))
    for doc_id, text in {(r[0], r[1]) for r in rows if r[0] != 1}:
        parts = sorted(by_doc[doc_id])
        ids = whole(text)
        assert sum((p[2] for p in parts), ()) == ids and {p[1] for p in parts} == {len(ids)}
        assert [p[0] for p in parts] == [sum(len(q[2]) for q in parts[:i]) for i in range(len(parts))]
    ones = sorted(p[2] for p in by_doc[1])
    assert sum(map(len, ones)) == 2 * len(whole("twice")) + len(whole(TEXTS[5]))
    assert W.pack_windows(docs.where("false"), vocabulary_path()).count() == 0
