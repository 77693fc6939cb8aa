"""One-permutation MinHash against the same rule in plain Python."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from scribelake.llm import fingerprints as fp


def h64(value: bytes, seed=42) -> int:
    x = xxhash.xxh64_intdigest(value, seed)
    return x - 2**64 if x >> 63 else x


def fold(values, size) -> int:
    seed = 42
    for v in values:
        seed = h64(v.to_bytes(size, "little", signed=True), seed % 2**64)
    return seed


def plain_bins(text):
    words = text.lower().strip(" ").split()
    words = words or [""]
    w = [h64(x.encode()) for x in words]
    hashes = [fold(w[i : i + 5], 8) for i in range(len(w) - 4)] or [fold(w, 8)]
    cells = [None] * 256
    for h in sorted(hashes, reverse=True):
        cells[(h >> 56) + 128] = h & 255
    out = list(cells)
    for i in range(256):
        if cells[i] is None:
            walk = [fold([i, k], 4) % 256 for k in range(6)]
            full = [j for j in walk if cells[j] is not None]
            j = full[0] if full else min((j for j in range(256) if cells[j] is not None), key=lambda j: fold([i, j], 4))
            out[i] = cells[j]
    return out


def plain_likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 2**-8) / (1 - 2**-8))


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_BUCKET", 6)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["É", "ß"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 6, 40, 400]))) for _ in range(60)] + ["a" * 5000, None]
    rows = [(rng.randrange(-(10**12), 10**12), t, 1, "c") for t in texts] + [(None, "no id here but many words to read", 2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, ghost string").repartition(3)
    got = {r["doc_id"]: r for r in fp.fingerprint_pairs(docs).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(order)
    for k, (doc_id, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[doc_id]
        assert (r["n_chars"], r["edited"]) == (len(text), edited)
        assert r["bins"] == plain_bins(text) and r["edited_bins"] == plain_bins(edited) and r["next_bins"] == plain_bins(nxt)


def test_query_columns(spark, tmp_path):
    rows = [(1, "one two three four five six", 5), (2, "one two three four five six", 5), (3, "", 5)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, near_next int").write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in fp.op9_one_permutation_minhash(spark, folder).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and len(got[1]["fingerprint"]) == 512
    assert got[2]["near_next"] == 1.0 and got[3]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    bins = plain_bins(rows[0][1])
    assert got[1]["fingerprint"] == "".join(f"{x:02x}" for x in bins)
    assert abs(got[3]["near_next"] - plain_likeness(plain_bins(""), bins)) < 1e-12


def test_likeness_is_unbiased(spark):
    rng = random.Random(1)
    pairs = []
    for i in range(40):
        a = [f"t{i}_{rng.randrange(10**9)}" for _ in range(300)]
        pairs.append((" ".join(a), " ".join(a[:200] + [f"u{rng.randrange(10**9)}" for _ in range(100)])))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fp.with_bins(fp.with_bins(df, "a", "x"), "b", "y")
    mean = df.agg(F.avg(fp.likeness(F.col("x"), F.col("y")))).first()[0]
    assert abs(mean - 196 / (296 + 100)) < 0.03


def test_nothing(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert fp.op9_one_permutation_minhash(spark, folder).count() == 0
