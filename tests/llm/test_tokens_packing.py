"""Token files and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest

from scribelake.llm import packing, token_files
from scribelake.llm.tokens import PieceEncoder, vocabulary_path

TEXTS = [
    "Plain words, and plain words.", None, "", " \n\t ", "it's DON'T 'S ''s we'll", "ΑΣ ΟΔΟΣ İstanbul straße", "éa É. ́x é",
    "...a..b,.c! 12,3.4", "a\x1cb c\x1f", "<|endoftext|>hi <|startoftext|>", "日本語。テスト، مرحبا x\x85y\xa0z", "word*** " * 3000, "x" * 30000, "½ ² Ǆ ﬁ", "Plain words, and plain words.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 - 20, t, "en", 5) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 1), (1, "tie b", "en", 0), (1, "tie a", "en", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, task int").repartition(4)


def library_ids(text, end):
    return PieceEncoder(vocabulary_path()).library.encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_equals_library():
    e, rng = PieceEncoder(vocabulary_path(), memo_entries=50), random.Random(5)
    alphabet = "abcDEF ,.!'’\n éÉß12-*́ΣİK"
    texts = TEXTS[4:] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == e.library.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_go_whole(tmp_path):
    import json

    from tokenizers import Tokenizer, models, pre_tokenizers

    assert PieceEncoder(vocabulary_path()).by_pieces
    letters = {chr(c): c - 31 for c in range(32, 127)} | {"?": 0}
    cased = Tokenizer(models.WordLevel(letters, unk_token="?"))
    cased.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    path = str(tmp_path / "cased.json")
    cased.save(path)
    assert json.load(open(path))
    other = PieceEncoder(path)
    assert not other.by_pieces
    assert np.frombuffer(other.encode(["A b, c"])[0], "<u2").tolist() == cased.encode("A b, c", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_block_round_trip(kind):
    for ids in ([], [0], [1, 2**31, 2**32 - 1, 7], list(range(1000))):
        ids = np.asarray(ids, "<u4")
        entry, planes = token_files.pack_block(ids, kind)
        back, end = token_files.unpack_block(entry, b"".join(planes), 0)
        assert back.tolist() == ids.tolist() and end == sum(map(len, planes))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files(spark, docs, tmp_path, kind):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, vocabulary_path(), 1, block_ids=64, segment_ids=100, kind=kind)
    order = sorted([(r["doc_id"], r["text"] or "") for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in order:
        ids = library_ids(text, 1)
        want.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.token_digest(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    read = token_files.read_tokens(spark, path).collect()
    assert sorted(tuple(r["ids"]) for r in read) == sorted(tuple(library_ids(t, 1)) for _, t in order)


def test_files_of_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(docs.where("false"), path, vocabulary_path(), 1)
    assert token_files.token_digest(spark, path).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing(spark, docs):
    rows = packing.pack(docs, vocabulary_path(), 0, 64, keep_ids=True).collect()
    check_packing(rows, 64)
    want = []
    for r in docs.collect():
        ids = library_ids(r["text"], 0)
        want += [(r["doc_id"], i // 64, i, tuple(ids[i : i + 64])) for i in range(0, len(ids), 64)]
    got = [(r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(docs.where("false"), vocabulary_path()).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


def plain_supersteps(lengths, capacity):
    """Sizes of the sequences after the same supersteps, with a stack for the sweep."""
    left, gaps, steps = {n: lengths.count(n) for n in lengths}, [], 0
    while left:
        steps += 1
        roomiest, longest = max(gaps, default=0), max(left)
        opens_from = capacity // 2 + 1 if longest > capacity // 2 else 1
        fitting = [n for n in left if n <= roomiest]
        waiting = {n: c for n, c in left.items() if n > roomiest and n >= opens_from}
        if fitting:
            slots = sorted(((r // max(1, r // max(fitting)), r, i) for i, r in enumerate(gaps) for _ in range(max(1, r // max(fitting)))), key=lambda x: (-x[0], -x[1]))
            free, k = [], 0
            for n in sorted(fitting, reverse=True):
                while k < len(slots) and slots[k][0] >= n:
                    free.append(slots[k][2])
                    k += 1
                while left[n] and free:
                    gaps[free.pop()] -= n
                    left[n] -= 1
        reached, need = 0, -(-sum(n * c for n, c in waiting.items()) // capacity)
        for n in sorted(waiting, reverse=True):
            reached += waiting[n]
            need = max(need, -(-reached // (capacity // n)))
        for n in sorted(waiting, reverse=True):
            now = min(need, waiting[n])
            need, left[n] = need - now, left[n] - now
            gaps += [capacity - n] * now
        left = {n: c for n, c in left.items() if c}
    return sorted(gaps), steps


@pytest.mark.parametrize("kind", ["any", "short", "ends"])
def test_supersteps(spark, kind):
    rng = random.Random(kind)
    capacity, n = 100, 700
    draw = {"any": lambda: rng.randint(1, 100), "short": lambda: min(100, int(rng.expovariate(1 / 6)) + 1), "equal": lambda: 34, "middle": lambda: rng.randint(25, 55), "one": lambda: 1, "ends": lambda: rng.choice([1, 1, 100, 99, 50])}
    lengths = [draw[kind]() for _ in range(n)]
    seen, rows = {}, []
    for x in lengths:
        seen[x] = seen.get(x, -1) + 1
        rows.append((x, seen[x]))
    moves = packing.best_fit(spark.createDataFrame(rows, "length long, rank long").repartition(5), capacity).collect()
    assert sorted((r["length"], r["rank"]) for r in moves) == sorted(rows)
    used = {}
    for r in moves:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    want, steps = plain_supersteps(lengths, capacity)
    assert sorted(capacity - u for u in used.values()) == want and max(r["step"] for r in moves) == steps
    assert len({(r["sequence_id"], r["step"], r["slot"]) for r in moves}) == n
    assert len(used) <= 1.05 * best_fit_decreasing(lengths, capacity)
