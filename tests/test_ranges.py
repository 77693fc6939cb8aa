"""Order statistics, running sums, transcripts and clips dealt over ranges and chunks, against plain Python."""

import math
import random

import pytest

from pyspark.sql import functions as F

from scribelake.functions import signal as G
from scribelake.operators import evaluate, frames, ranges


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [("hot", 5.0, i) for i in range(400)] + [(rng.choice(["a", "b", None]), round(rng.expovariate(0.1), 3), i) for i in range(500)]
    rows += [("one", 3.0, 1), ("none", None, 1), ("a", None, 2)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double, i long").repartition(5)


def groups(rows):
    out = {}
    for g, v, _ in rows:
        out.setdefault(g, [])
        if v is not None:
            out[g].append(v)
    return {g: sorted(v) for g, v in out.items()}


def test_order_statistics(values):
    rows, df = values
    got = {r["g"]: (r["low"], r["mid"]) for r in ranges.order_statistics(df, "v", ["g"], {"low": lambda n: F.lit(0) * n, "mid": lambda n: F.floor(n / 2)}).collect()}
    assert got == {g: (v[0], v[len(v) // 2]) for g, v in groups(rows).items() if v}
    assert ranges.order_statistics(df.where("false"), "v", ["g"], {"low": lambda n: n - n}).count() == 0


def test_latencies(values):
    rows, df = values
    at = lambda v, q: v[math.floor(q * (len(v) - 1))] + (q * (len(v) - 1) % 1) * (v[math.ceil(q * (len(v) - 1))] - v[math.floor(q * (len(v) - 1))])
    got = {r["g"]: r for r in evaluate.latency_summary(df, "v", "g").collect()}
    for g, v in groups(rows).items():
        assert got[g]["count"] == len(v)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert got[g][name] == (pytest.approx(at(v, q), abs=0.0051) if v else None)
    p95 = {r["g"]: r["p95"] for r in evaluate.p95_nearest_rank(df, "v", "g").collect()}
    assert p95 == {g: v[int(0.95 * len(v))] for g, v in groups(rows).items() if v}
    every = sorted(v for _, v, _ in rows if v is not None)
    assert evaluate.p95_nearest_rank(df, "v").first()["p95"] == every[int(0.95 * len(every))]
    assert evaluate.latency_summary(df, "v").first()["p50"] == pytest.approx(at(every, 0.5), abs=0.0051)


def test_running(values):
    rows, df = values
    got = ranges.running(df, ["g"], ["i", "v"], F.lit(1), "n").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(((r["i"], -math.inf if r["v"] is None else r["v"]), r["n"]))
    for group in by.values():
        assert sorted(n for _, n in group) == list(range(1, len(group) + 1))
        assert [k for k, _ in sorted(group, key=lambda x: x[1])] == sorted(k for k, _ in group)


@pytest.mark.parametrize("chunk", [7, 1 << 14])
def test_transcripts(spark, chunk):
    rng = random.Random(6)
    rows = [(s, k, rng.choice(["Take one.", "", None, "x", "a longer sentence of words"])) for s in ("a", "b", None) for k in range(30)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "session_id string, seq long, text string").repartition(4)
    got = {(r["session_id"], r["seq"]): r["transcript"] for r in frames.running_transcript(df, chunk=chunk).collect()}
    assert got == {(s, k): " ".join(t for x, j, t in rows if x == s and j <= k and t is not None) for s, k, _ in rows}
    sizes = [len(r["__text"]) for r in frames.transcript_chunks(frames.transcript_offsets(df), chunk=chunk).collect()]
    assert max(sizes) < chunk + 27


@pytest.mark.parametrize("chunk", [4, 5, 1 << 14])
def test_clips(spark, chunk):
    rng = random.Random(2)
    clips = {s: [round(rng.uniform(-1, 1), 4) for _ in range(n)] for s, n in enumerate([1, 2, 4, 5, 17, 64, 100])}
    rows = [(s, i, v) for s, c in clips.items() for i, v in enumerate(c)]
    rng.shuffle(rows)
    samples = spark.createDataFrame(rows, "session_id long, i long, value double")
    arrays = spark.createDataFrame([(s, c) for s, c in clips.items()], "session_id long, v array<double>")
    whole = {r[0]: r[1:] for r in arrays.select("session_id", G.rms(F.col("v")), G.zero_crossing_rate(F.col("v"))).collect()}
    assert {r[0]: r[1:] for r in G.clip_features(samples, chunk).collect()} == {s: pytest.approx(w) for s, w in whole.items()}
    for rate, target in ((8000, 16000), (16000, 8000), (44100, 16000), (16000, 16000)):
        want = {(r["session_id"], i): v for r in arrays.select("session_id", G.resample_linear(F.col("v"), F.lit(rate), target).alias("r")).collect() for i, v in enumerate(r["r"])}
        got = G.clip_resampled(samples, rate, target, chunk).collect()
        assert len(got) == len(want) and {(r["session_id"], r["i"]): r["value"] for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    want = {(r["session_id"], k): f for r in arrays.select("session_id", G.frame_split(F.col("v"), 6, 3).alias("f")).collect() for k, f in enumerate(r["f"])}
    assert {(r["session_id"], r["frame_no"]): r["values"] for r in G.clip_frames(samples, 6, 3).collect()} == want
