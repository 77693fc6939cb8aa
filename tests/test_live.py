"""Frame rules against a plain loop, in one pass and as streams; control rows, timers and late rows of streams."""

import random
import time
from datetime import datetime, timedelta

import pytest

from scribelake.functions import text as T
from scribelake.operators import assemble, clauses, frames, reconcile
from scribelake.plans import live
from scribelake.streaming import streams

START = datetime(2024, 1, 1)


def plain_flags(rows):
    """(flag, floor) of each (rms, zcr): loud after two, quiet after ten and a hold of three, floor over calm frames."""
    floor, loud_run, quiet_run, on, hold, out = 0.004, 0, 0, False, 0, []
    for rms, zcr in rows:
        if rms < 0.008:
            floor = 0.95 * floor + 0.05 * rms
        if rms > max(0.01, 2.8 * floor) and zcr < 0.45:
            loud_run, quiet_run = loud_run + 1, 0
            if loud_run >= 2:
                on, hold = True, 3
        else:
            loud_run, quiet_run = 0, quiet_run + 1
            if quiet_run >= 10:
                on, hold = (on, hold - 1) if hold else (False, 0)
        out.append((on or hold > 0, floor))
    return out


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(4)
    out = {}
    for s, n in ((1, 1500), (2, 40), (3, 1), (4, 300)):
        level = [rng.choice([0.0, 0.002, 0.007, 0.009, 0.012, 0.03, 0.2]) * (1 if (k // 17) % 2 else 0.1 if rng.random() < 0.7 else 1) for k in range(n)]
        out[s] = [(x, rng.choice([0.1, 0.1, 0.1, 0.6])) for x in level]
    return out


def frame_rows(sessions):
    return [(s, k, START + timedelta(milliseconds=30 * k), rms, zcr) for s, rows in sessions.items() for k, (rms, zcr) in enumerate(rows)]


SCHEMA = "session_id long, frame_no long, ts timestamp, rms double, zcr double"


def test_flags_in_one_pass(spark, sessions):
    found = frames.speech_flags(spark.createDataFrame(frame_rows(sessions), SCHEMA).repartition(3)).collect()
    want = {(s, k): f for s, rows in sessions.items() for k, f in enumerate(plain_flags(rows))}
    assert {(r["session_id"], r["frame_no"]): r["is_speech"] for r in found} == {k: f for k, (f, _) in want.items()}
    for r in found:
        assert r["noise_floor"] == pytest.approx(want[r["session_id"], r["frame_no"]][1], rel=1e-9)
    assert frames.speech_flags(spark.createDataFrame([], SCHEMA)).count() == 0
    # Null levels are quiet and leave the floor as it is.
    null = frames.speech_flags(spark.createDataFrame([(1, 0, START, None, None), (1, 1, START, 0.5, 0.1), (1, 2, START, 0.5, 0.1)], SCHEMA)).orderBy("frame_no").collect()
    assert [r["is_speech"] for r in null] == [False, False, True]


def in_batches(spark, tmp_path, parts, schema):
    """A stream of one file a batch."""
    path = str(tmp_path / "in")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


LAST = (99, 0, START + timedelta(hours=9), 0.0, 0.1)  # of another session: the watermark passes all rows before


def test_flags_of_rows_out_of_order(spark, sessions, tmp_path):
    """Frames come in any order, up to ten seconds late and so in later batches, and give what one pass over all gives."""
    rng = random.Random(1)
    rows = sorted((r for r in frame_rows(sessions) if r[0] in (1, 2, 4)), key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 8)))
    parts = [rows[k : k + 300] for k in range(0, len(rows), 300)]
    assert any(parts[k][i][1] > parts[k + 1][j][1] and parts[k][i][0] == parts[k + 1][j][0] for k in range(3) for i in range(300) for j in range(0, 300, 7))
    found = live.to_its_end(streams.speech_flags(in_batches(spark, tmp_path, [*parts, [LAST]], SCHEMA)), "test").collect()
    want = {(s, k): f for s in (1, 2, 4) for k, (f, _) in enumerate(plain_flags(sessions[s]))}
    assert {(r["session_id"], r["frame_no"]): r["is_speech"] for r in found} == want and len(found) == len(want)


def test_other_operators_out_of_order(spark, sessions, tmp_path):
    """The same of changes, the frames before speech, and the gate: shuffled batches equal one sorted batch."""
    rng = random.Random(7)
    flagged = [(s, k, ts, rms, (k // 11 + s) % 3 == 0) for s, k, ts, rms, _ in frame_rows(sessions) if s in (2, 4)]
    schema, last = "session_id long, frame_no long, ts timestamp, rms double, is_speech boolean", (99, 0, LAST[2], 0.0, False)
    mixed = sorted(flagged, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 8)))
    for k, f in enumerate((streams.transition_stream, lambda x: streams.preroll_stream(x, 100), lambda x: streams.energy_gate(x, 0.3))):
        got = []
        for name, parts in (("sorted", [flagged, [last]]), ("mixed", [mixed[:90], mixed[90:210], mixed[210:], [last]])):
            (tmp_path / f"{name}{k}").mkdir()
            found = live.to_its_end(f(in_batches(spark, tmp_path / f"{name}{k}", parts, schema)), "test").drop("ts").collect()
            got.append(sorted(tuple(r) for r in found if r["session_id"] != 99))
        assert got[0] == got[1] and got[0]


def test_finished_sessions_leave_no_state(spark, sessions, tmp_path):
    rows = [r for r in frame_rows(sessions) if r[0] == 2]
    again = [(2, 100 + k, START + timedelta(hours=10, milliseconds=30 * k), 0.5, 0.1) for k in range(3)]
    stream = in_batches(spark, tmp_path, [rows, [LAST], again, [(98, 0, START + timedelta(hours=20), 0.0, 0.1)]], SCHEMA)
    spark.conf.set(*streams.STATE_STORE)
    at = str(tmp_path / "checkpoint")
    out = []
    run = streams.speech_flags(stream).writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    run.awaitTermination()
    read = lambda name: {r["key"]["session_id"] for r in spark.read.format("statestore").option("stateVarName", name).load(at).collect()}
    assert 2 not in read("memory") and 99 not in read("memory")
    # The session that speaks again after its time begins anew: its first loud frame is no speech.
    flags = {r["frame_no"]: r["is_speech"] for r in out if r["session_id"] == 2}
    assert [flags[100], flags[101], flags[102]] == [False, True, True] and len(flags) == len(rows) + 3


def test_transcripts_with_control_rows(spark, tmp_path):
    schema = "session_id long, seq long, kind string, text string"
    parts = [
        [(1, 0, "sentence", "One."), (1, 1, "sentence", "?!"), (2, 0, "sentence", "Lost.")],
        [(1, 2, "sentence", "Two."), (2, 1, "reset", None), (2, 2, "sentence", "Kept.")],
        [(1, 3, "finalize", None), (1, 4, "sentence", "Three."), (2, 3, "sentence", "x" * 30)],
    ]
    stream = in_batches(spark, tmp_path, parts, schema)
    found = live.to_its_end(streams.assemble_transcript(stream, idle_ms=None, most_chars=20), "test", "update").collect()
    said = {tuple(r) for r in found}
    assert (1, 0, "One. Two.", True) in said and (1, 0, "Three.", False) in said
    assert (2, 0, "Kept.", False) in said and (2, 1, "x" * 30, False) in said  # what no longer fits is emitted, not dropped
    assert not any("Lost. Kept." in r["transcript"] for r in found)


def test_idle_sessions_end_by_a_timer(spark, tmp_path):
    schema = "session_id long, seq long, kind string, text string"
    stream = in_batches(spark, tmp_path, [[(1, 0, "sentence", "One.")]], schema)
    spark.conf.set(*streams.STATE_STORE)
    run = streams.assemble_transcript(stream, idle_ms=300).writeStream.outputMode("update").format("memory").queryName("idle").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            if any(r["final"] for r in spark.table("idle").collect()):
                break
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("idle").where("final").collect()] == [(1, 0, "One.", True)]
    finally:
        run.stop()


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp"
    at = lambda minutes: (START + timedelta(minutes=minutes),)
    stream = in_batches(spark, tmp_path, [[at(0), at(1), at(300)], [at(301)], [at(2), at(299)], [at(600)]], schema)
    from pyspark.sql import functions as F

    rows = streams.with_late_limit(stream, "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    found = {r["at"].hour: r["n"] for r in live.to_its_end(rows, "test").selectExpr("w.start as at", "n").collect()}
    assert found == {0: 2, 4: 1, 5: 2}  # 00:02 came after the watermark had passed its window


def test_commit_without_overlap(spark, tmp_path):
    schema = "session_id long, seq long, text string, silence_s double, ts timestamp"
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [(1, 0, "take one tablet", 1.0, at(0)), (1, 2, "One Tablet after food", 0.9, at(2))], [(1, 1, "not yet", 0.1, at(1)), (1, 3, "after food", 0.8, at(3)), (1, 4, None, 0.9, at(4))],
        [(9, 0, "x", 0.0, at(900))],
    ]
    found = live.to_its_end(streams.commit_on_silence(in_batches(spark, tmp_path, parts, schema)), "test").orderBy("seq").collect()
    assert [(r["seq"], r["text"]) for r in found] == [(0, "take one tablet"), (2, "after food")]


def test_small_operators(spark):
    one = lambda *columns: spark.range(1).select(*columns).first()
    from pyspark.sql import functions as F

    phrases = F.array(*map(F.lit, ["with water", "after meals", "meals", "2. call the doctor today or so", "unknown"]))
    source = F.lit("Take after meals. Call the doctor tomorrow, with water")
    assert one(T.chronological(phrases, source))[0] == ["after meals", "2. call the doctor today or so", "with water", "unknown"]
    advice = spark.createDataFrame([("finish the antibiotic", "Augmentin 625"), ("finish the antibiotic", "Dolo 650"), ("rest", "Dolo 650"), (None, "x")], "advice string, clause string")
    assert {tuple(r) for r in clauses.class_guard(advice).where("advice is not null").collect()} == {("finish the antibiotic", "Augmentin 625"), ("rest", "Dolo 650")}
    blocks = spark.createDataFrame([(1, 1, "Dolo"), (1, 2, " dolo "), (1, 3, "NONE"), (1, 4, "none"), (2, 1, "Dolo")], "rx_id long, item_no int, Drug_name string")
    assert {tuple(r)[:2] for r in assemble.dedup_blocks(blocks).collect()} == {(1, 1), (1, 3), (1, 4), (2, 1)}
    texts = spark.createDataFrame([(1, "Drug_name: Dolo\nstrength: 650 mg\nroute: N/A\nDrug_name: NONE")], "rx_id long, raw_text string")
    found = reconcile.second_extraction(texts, T.parse_blocks).collect()
    assert [(r["medicine"], r["strength"], r["route"], r["spans"]["strength"]["start"]) for r in found] == [("Dolo", "650 mg", None, 26)]


class Counted:
    """State of one session that counts what goes to and fro: calls, and elements of lists."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def put(self, values):
        self.calls, self.value = self.calls + len(values), values

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return list(self.timers)


def test_held_rows_are_one_element_of_state():
    """What a session costs in calls to its state does not hang on its rows; nulls, timers and the end of a session."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import TimerValues

    state, session = Counted(), streams._Recent(500, timedelta(seconds=60))
    session.init(state)
    n = 400
    frames = pd.DataFrame({"us": [1_000_000 + 100_000 * k for k in range(n)], "frame_no": range(n), "is_speech": [k == n - 1 or None for k in range(n)]})
    assert not list(session.handleInputRows((7,), iter([frames[200:].copy(), frames[:200].copy()]), TimerValues(0, 0)))
    assert state.timers == [1001] and state.calls <= 4
    state.timers, state.calls = [], 0  # Spark drops the timer that fires
    (found,) = session.handleExpiredTimer((7,), TimerValues(0, 50_000), None)
    assert found["frame_no"].tolist() == list(range(n - 6, n - 1)) and found["session_id"].tolist() == [7] * 5
    assert state.timers == [40_900 + 60_000] and state.calls <= 4
    # A later row moves the timer; the watermark past both ends the session.
    late = pd.DataFrame({"us": [90_000_000], "frame_no": [n], "is_speech": [False]})
    assert not list(session.handleInputRows((7,), iter([late]), TimerValues(0, 50_000))) and state.timers == [90_001]
    state.timers = []
    assert not list(session.handleExpiredTimer((7,), TimerValues(0, 200_000), None)) and state.value is None and state.timers == []
