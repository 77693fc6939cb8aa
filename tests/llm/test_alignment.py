"""Alignment against both libraries over whole texts, and the laws of the fragment monoid."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scribelake.llm import alignment as L
from scribelake.llm.tokens import vocabulary_path

PATHS = vocabulary_path(L.A_VOCABULARY), vocabulary_path(L.B_VOCABULARY)
TEXTS = [
    "Plain words, and plain words.", None, "", " ", "  two  blanks\nand\ttabs \n", "naïve 日本語 🙂 é", "a▁b is not a blank", "<|endoftext|> </s> <unk> <0x41>",
    "unhyphenatedlongwordwithoutblanks" * 40, "one " * 300, "it's 1,234.5 -- ok?", "　wide\xa0blank x", "Plain words, and plain words.",
]


@pytest.fixture(scope="module")
def al():
    return L.aligner(*PATHS)


def plain(al, text):
    """Groups and links of one text, from the libraries' own tokens."""
    if not text:
        return None
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    if b"".join(al.a_bytes[i] for i in a) != (" " + text).encode() or b"".join(al.b_bytes[i] for i in b) != (" " + text).encode():
        return None
    ends = lambda ids, size: np.cumsum([len(size[i]) for i in ids]).tolist()
    ea, eb = ends(a, al.a_bytes), ends(b, al.b_bytes)
    groups, links, pa, pb = [], [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        qa, qb = ea.index(end) + 1, eb.index(end) + 1
        groups.append(",".join(map(str, a[pa:qa])) + "|" + ",".join(map(str, b[pb:qb])))
        links.append((a[qa - 1], b[qb - 1]))
        pa, pb = qa, qb
    return len(a), len(b), groups, links


def texts_of(n, seed):
    rng = random.Random(seed)
    draw = ["word", " ", " ", "  ", "été", "日本", ".", "\n", "'s", "12", "🙂", "antidisestablish", "X"]
    return ["".join(rng.choice(draw) for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_token_bytes(al):
    assert all(len(x) for x in al.a_bytes) and all(len(x) for x in al.b_bytes)
    assert al.a_bytes[al.a.token_to_id("Ġthe")] == b" the" and al.b_bytes[al.b.piece_to_id("<0x0A>")] == b"\n"
    assert al.cuttable


def test_cut_texts_give_the_tokens_of_whole_ones(al):
    cut = 0
    for text in texts_of(150, 1) + [t for t in TEXTS if t]:
        s = " " + text
        for chunk, halo in ((7, 40), (30, 15), (50, 200)):
            ranges = al.ranges(text, chunk, halo)
            cut += len(ranges) > 1
            f = L.EMPTY
            for (read, lo, hi), tokens in zip(ranges, al.encode([r[0] for r in ranges])):
                f = L.compose(f, al.fragment(*tokens, lo, hi))
            want = plain(al, text)
            row = L._whole(1, f, True)
            if want is None:
                assert row[1:6] == (0, 0, 0, "", "")
            else:
                assert (row[1], row[2], row[5]) == (want[0], want[1], ";".join(want[2])), (s, chunk)
                assert dict(zip(row[6].tolist(), row[7].tolist())) == Counter(a * al.many + b for a, b in want[3])
    assert cut > 100


def test_monoid(al):
    rng = random.Random(2)
    for text in texts_of(30, 3):
        (tokens,) = al.encode([" " + text])
        size = len((" " + text).encode())
        places = [0, *sorted(rng.randrange(size + 1) for _ in range(6)), size]
        parts = [al.fragment(*tokens, lo, hi) for lo, hi in zip(places, places[1:])]
        same = lambda x, y: all(np.array_equal(a, b) for a, b in zip(x, y))
        whole = al.fragment(*tokens, 0, size)

        def fold(ps):
            if len(ps) == 1:
                return ps[0]
            k = rng.randrange(1, len(ps))
            return L.compose(fold(ps[:k]), fold(ps[k:]))

        for _ in range(4):
            assert same(fold(parts), whole)
        assert same(L.compose(L.EMPTY, whole), whole) and same(L.compose(whole, L.EMPTY), whole)


def test_documents(spark, al):
    long = [" ".join(texts_of(40, 9)), "y" * 900, ("ab cd " * 500) + "▁", "z" * 300 + " tail of words " * 40]
    texts = TEXTS + texts_of(40, 5) + long
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, "no id", None, 1), (3, "repeated row", "en", 0), (3, "repeated row", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string, `groups` int").repartition(5)
    found = {(r[0], r[1]): plain(al, r[1]) for r in rows}
    counts = Counter(link for r in rows for link in (found[r[0], r[1]] or ((), (), (), ()))[3])
    best = {}
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for doc_id, text, *_ in rows:
        f = found[doc_id, text]
        if f is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[3]
            want.append((doc_id, f[0], f[1], len(f[2]), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    for chunk, halo, fan in ((100, 60, 2), (1 << 15, 1 << 12, 8)):
        aligned = L.align(docs, *PATHS, keep_groups=True, chunk=chunk, halo=halo, fan=fan)
        got = [tuple(r) for r in L.with_counts(aligned, al.many).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in aligned.where("n_a > 0").collect())
    # Pairs are bounded by the bytes of both vocabularies.
    assert L.pair_counts(aligned).count() == len(counts) <= sum(map(len, al.a_bytes)) + sum(map(len, al.b_bytes))
    assert all(al.a_bytes[a].endswith(al.b_bytes[b]) or al.b_bytes[b].endswith(al.a_bytes[a]) for a, b in counts)
    none = L.with_counts(L.align(docs.where("false"), *PATHS), al.many)
    assert none.count() == 0 and len(none.columns) == 8
