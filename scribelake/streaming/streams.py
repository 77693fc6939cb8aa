"""Live sessions: frames to flags, flags to utterances, sentences to transcripts and items.

Frames and sentences are keyed by session_id on event time ts. Late rows: within `LATE` of the newest ts they count,
after that they are dropped (and counted by Spark as numRowsDroppedByWatermark). Append mode holds a window back until
the watermark has passed it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import is_utterance_complete
from ..operators.frames import Heard, Rule

LATE = "10 seconds"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_late_limit(stream: DataFrame, late: str = LATE) -> DataFrame:
    return stream.withWatermark("ts", late)


IDLE = timedelta(minutes=10)


def _values(column: pd.Series, kind: str) -> list:
    """A column of a batch as plain values; None for null, for which pandas has NaN."""
    values = column.tolist()
    if column.dtype.kind in "ib":
        return values
    return [None if v is None or v != v else int(v) if kind == "long" else v for v in values]


class _InOrder(StatefulProcessor):
    """Rows of a session one by one in order of event time, whatever the order and the batches in which they come.

    A row is held until the watermark has reached its ts, so that no earlier row can follow; an event-time timer wakes a
    session whose rows are due without new ones. After a pause of more than `idle` a session begins anew, and what is remembered of
    it is dropped by a timer once the watermark is so far past its last row. `fields` are held of a row besides ts.

    A session has one value of state: what is remembered, its only timer, and the rows held, which are pickled as one element,
    since each element and each call goes to and fro between Spark and Python on its own.
    """

    FIELDS: tuple[tuple[str, str], ...] = ()
    MEMORY = ""
    OUT = ""

    def __init__(self, idle: timedelta | None):
        self.idle_ms = None if idle is None else int(idle.total_seconds() * 1000)

    def begin(self) -> tuple:
        """What is remembered at first."""
        raise NotImplementedError

    def recall(self, memory: tuple) -> tuple:
        """What is remembered, as it is read from the state."""
        return memory

    def step(self, memory: tuple, key: int, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        """What is remembered after a row, and what goes out."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # last_us: of the last row released; timer_ms: the session's timer; held: rows in order.
        self.memory = handle.getValueState("memory", self.MEMORY + ", last_us long, timer_ms long, held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            new += zip(*[_values(frame[name], kind) if name in frame else [None] * len(frame) for name, kind in (("us", "long"), *self.FIELDS)])
        yield from self._release(key, new, timers.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, [], timerValues.getCurrentWatermarkInMs(), True)

    def _release(self, key, new: list[tuple], watermark_ms: int, woken: bool) -> Iterator[pd.DataFrame]:
        """woken: by the session's timer, which Spark deletes."""
        kept, out = self.memory.get(), []
        memory, (last, timer, held) = (self.recall(tuple(kept[:-3])), kept[-3:]) if kept else (self.begin(), (None, None, None))
        held = sorted([*(pickle.loads(held) if held else []), *new], key=lambda r: r[:2])
        due = sum(r[0] <= watermark_ms * 1000 for r in held)
        for us, *row in held[:due]:
            if self.idle_ms is not None and last is not None and us - last > self.idle_ms * 1000:
                memory = self.begin()
            memory, more = self.step(memory, key[0], us, tuple(row))
            last = us if last is None else max(last, us)
            out += more
        held = held[due:]
        first = held[0][0] if held else None
        at = None if first is None else first // 1000 + 1
        if at is None and self.idle_ms is not None and last is not None:
            at = last // 1000 + self.idle_ms
        ended = first is None and at is not None and at <= watermark_ms
        if timer is not None and not woken and (ended or timer != at):
            self.handle.deleteTimer(timer)
        if ended:
            self.memory.clear()
        else:
            if at is not None and (woken or timer != at):
                self.handle.registerTimer(at)
            self.memory.update((*memory, last, at, pickle.dumps(held) if held else None))
        if out:
            columns = zip((c.split() for c in self.OUT.split(", ")), zip(*out))
            yield pd.DataFrame({name: np.array(values, {"long": "int64", "boolean": "bool", "string": object}[kind]) for (name, kind), values in columns})

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, processor: _InOrder, late: str) -> DataFrame:
    """us: ts in microseconds, whatever the session's time zone."""
    fields = [name for name, _ in processor.FIELDS if name in rows.columns]
    out = with_late_limit(rows, late).select("session_id", "ts", F.unix_micros("ts").alias("us"), *fields).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime"
    )
    return out.select(*[F.timestamp_micros(c).alias("ts") if c == "us" else c for c in out.columns])


class _Flags(_InOrder):
    """The flag of each frame. A row with control `reset` forgets the session."""

    FIELDS = (("frame_no", "long"), ("rms", "double"), ("zcr", "double"), ("control", "string"))
    MEMORY = "floor double, loud boolean, run long, late long"
    OUT = "session_id long, frame_no long, us long, is_speech boolean"

    def __init__(self, rule: Rule, idle: timedelta | None):
        super().__init__(idle)
        self.rule = rule

    def begin(self) -> tuple:
        return tuple(Heard(self.rule.floor))

    def step(self, memory: tuple, key: int, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        frame_no, rms, zcr, control = row
        if control == "reset":
            return self.begin(), []
        nan = float("nan")
        heard = Heard(*memory).then(nan if rms is None else rms, nan if zcr is None else zcr, self.rule)
        memory = (float(heard.floor), bool(heard.loud), int(heard.run), int(heard.late))
        return memory, [] if control else [(key, frame_no, us, heard.is_speech(self.rule))]


def speech_flags(frames: DataFrame, rule: Rule = Rule(), late: str = LATE, idle: timedelta | None = IDLE) -> DataFrame:
    """session_id, frame_no, ts, rms, zcr (and control) -> session_id, frame_no, ts, is_speech."""
    return _in_order(frames, _Flags(rule, idle), late)


def utterances(frames: DataFrame, gap: str = "390 milliseconds", least_ms: int = 300, late: str = LATE) -> DataFrame:
    """Speech frames of a session with pauses below gap, if they span least_ms: session_id, start, end, frames."""
    spoken = with_late_limit(frames.where("is_speech"), late)
    out = spoken.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.where((F.col("end").cast("double") - F.col("start").cast("double")) * 1000 >= least_ms).select("session_id", "start", "end", "frames")


def interim_windows(frames: DataFrame, length: str = "12 seconds", step: str = "600 milliseconds", least: int = 1, late: str = LATE) -> DataFrame:
    """The last `length` of a session every `step`, where it has `least` frames: what is decoded again before a pause."""
    out = with_late_limit(frames, late).groupBy("session_id", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("frames"), F.avg("rms").alias("rms"))
    return out.where(F.col("frames") >= least).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", F.round("rms", 6).alias("rms"))


def step_ticks(frames: DataFrame, step: str = "600 milliseconds", late: str = LATE) -> DataFrame:
    out = with_late_limit(frames, late).groupBy("session_id", F.window("ts", step).alias("w")).agg(F.count("*").alias("frames"))
    return out.select("session_id", F.col("w.start").alias("start"), "frames")


class _Sessions(StatefulProcessor):
    """Sentences of a session in order; control rows finalize (emit all) or reset it, and a session without rows for
    idle_ms of processing time is finalized by a timer. Beyond most_chars, sentences are emitted as a part of their own
    before they leave the state."""

    def __init__(self, idle_ms: int | None, most_chars: int):
        self.idle_ms, self.most_chars = idle_ms, most_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sentences = handle.getListState("sentences", "text string")
        self.part = handle.getValueState("part", "part int")

    def _kept(self) -> list[str]:
        return [t for (t,) in self.sentences.get()] if self.sentences.exists() else []

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "part", "transcript", "final"]).astype({"session_id": "int64", "part": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept, part, out, final = self._kept(), (self.part.get()[0] if self.part.exists() else 0), [], False
        for kind, text in pd.concat(list(rows)).sort_values("seq")[["kind", "text"]].itertuples(index=False):
            if kind == "reset":
                kept, part, final = [], 0, False
            elif kind == "finalize":
                out.append((key[0], part, " ".join(kept), True))
                kept, part, final = [], 0, True
            elif any(c.isalnum() for c in text or ""):
                if kept and sum(map(len, kept)) + len(text) > self.most_chars:
                    out.append((key[0], part, " ".join(kept), False))
                    kept, part = [], part + 1
                kept.append(text)
                final = False
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if kept:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        if kept:
            self.sentences.put([(t,) for t in kept])
        else:
            self.sentences.clear()
        self.part.update((part,))
        if not final:
            out.append((key[0], part, " ".join(kept), False))
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, part = self._kept(), (self.part.get()[0] if self.part.exists() else 0)
        self.sentences.clear()
        self.part.clear()
        yield self._out([(key[0], part, " ".join(kept), True)] if kept else [])

    def close(self) -> None:
        pass


def assemble_transcript(sentences: DataFrame, idle_ms: int | None = 60_000, most_chars: int = 1 << 20) -> DataFrame:
    """session_id, seq, kind (sentence, finalize, reset), text -> session_id, part, transcript, final after each batch.

    idle_ms None: no timer, for a source that is read to its end (a timer keeps such a run alive).
    """
    return sentences.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Sessions(idle_ms, most_chars), outputStructType="session_id long, part int, transcript string, final boolean", outputMode="Update", timeMode="None" if idle_ms is None else "ProcessingTime"
    )


class _Buffer(StatefulProcessor):
    """The frames of the last keep_ms of a session, in any order; older ones leave the state, and so does all of a session whose
    last frame is keep_ms behind the watermark."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "ms long, frame_no long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.frames.get()] if self.frames.exists() else []
        for frame in rows:
            held += zip((frame["us"] // 1000).tolist(), frame["frame_no"].tolist())
        newest = max(held)[0]
        held = sorted(x for x in held if newest - x[0] <= self.keep_ms)
        self.frames.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.keep_ms + 1)
        yield pd.DataFrame({"session_id": [key[0]], "first_frame": [held[0][1]], "last_frame": [held[-1][1]], "frames": [len(held)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.frames.clear()
        yield pd.DataFrame({"session_id": [], "first_frame": [], "last_frame": [], "frames": []}).astype("int64")

    def close(self) -> None:
        pass


def bounded_buffer(frames: DataFrame, keep_ms: int = 120_000, late: str = LATE) -> DataFrame:
    """session_id, first_frame, last_frame, frames in the last keep_ms of the session, after each batch."""
    return with_late_limit(frames, late).withColumn("us", F.unix_micros("ts")).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Buffer(keep_ms), outputStructType="session_id long, first_frame long, last_frame long, frames long", outputMode="Update", timeMode="EventTime"
    )


class _Commit(_InOrder):
    """Decoded windows overlap: a text is committed at a pause, without the words that the one before ended with."""

    FIELDS = (("seq", "long"), ("text", "string"), ("silence_s", "double"))
    MEMORY = "done string"
    OUT = "session_id long, seq long, text string"

    def __init__(self, silence_s: float, idle: timedelta | None):
        super().__init__(idle)
        self.silence_s = silence_s

    def begin(self) -> tuple:
        return ("",)

    def step(self, memory: tuple, key: int, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        seq, text, silence = row
        if silence is None or silence < self.silence_s or not (text or "").strip():
            return memory, []
        old, new = memory[0].split(), text.split()
        n = next((i for i in range(min(8, len(old), len(new)), 0, -1) if [w.lower() for w in old[-i:]] == [w.lower() for w in new[:i]]), 0)
        if not new[n:]:
            return memory, []
        return (" ".join([*old, *new[n:]][-64:]),), [(key, seq, " ".join(new[n:]))]


def commit_on_silence(texts: DataFrame, silence_s: float = 0.8, late: str = LATE, idle: timedelta | None = IDLE) -> DataFrame:
    """session_id, seq, ts, text, silence_s -> committed session_id, seq, text."""
    return _in_order(texts, _Commit(silence_s, idle), late)


class _Changes(_InOrder):
    FIELDS = (("frame_no", "long"), ("is_speech", "boolean"))
    MEMORY = "speaking boolean"
    OUT = "session_id long, frame_no long, us long, is_speech boolean"

    def begin(self) -> tuple:
        return (False,)

    def step(self, memory: tuple, key: int, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        frame_no, flag = row[0], bool(row[1])
        return (flag,), [(key, frame_no, us, flag)] if flag != memory[0] else []


def transition_stream(flags: DataFrame, late: str = LATE, idle: timedelta | None = IDLE) -> DataFrame:
    """Frames at which the flag of a session changes."""
    return _in_order(flags, _Changes(idle), late)


class _Recent(_InOrder):
    """Frames of the last keep_ms before speech, emitted once it begins; what is remembered never holds more."""

    FIELDS = (("frame_no", "long"), ("is_speech", "boolean"))
    MEMORY = "speaking boolean, quiet array<struct<frame_no:bigint,ms:bigint>>"
    OUT = "session_id long, frame_no long"

    def __init__(self, keep_ms: int, idle: timedelta | None):
        super().__init__(idle)
        self.keep_ms = keep_ms

    def begin(self) -> tuple:
        return (False, [])

    def recall(self, memory: tuple) -> tuple:
        return memory[0], [tuple(q) for q in memory[1]]

    def step(self, memory: tuple, key: int, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        frame_no, flag, ms, (spoke, quiet) = row[0], bool(row[1]), us // 1000, memory
        # Rows come in order of time, so those too old are at the front.
        old = next((k for k, (_, m) in enumerate(quiet) if ms - m <= self.keep_ms), len(quiet))
        del quiet[:old]
        if flag:
            return (True, []), [] if spoke else [(key, n) for n, _ in quiet]
        quiet.append((frame_no, ms))
        return (False, quiet), []


def preroll_stream(flags: DataFrame, keep_ms: int = 200, late: str = LATE, idle: timedelta | None = IDLE) -> DataFrame:
    """session_id, frame_no of quiet frames within keep_ms before speech begins."""
    return _in_order(flags, _Recent(keep_ms, idle), late)


class _Gate(_InOrder):
    """RMS gate with its own noise floor; speech counts as recent for hold_s after the last loud frame."""

    FIELDS = (("frame_no", "long"), ("rms", "double"))
    MEMORY = "floor double, spoke long"
    OUT = "session_id long, frame_no long, active boolean"

    def __init__(self, hold_s: float, idle: timedelta | None):
        super().__init__(idle)
        self.hold_us = hold_s * 1_000_000

    def begin(self) -> tuple:
        return 0.004, -(10**17)

    def step(self, memory: tuple, key: int, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        (floor, spoke), (frame_no, rms) = memory, row
        if rms is not None and rms > max(0.010, 2.2 * floor):
            spoke = us
        elif rms is not None:
            floor = 0.95 * floor + 0.05 * rms
        return (float(floor), int(spoke)), [(key, frame_no, us - spoke <= self.hold_us)]


def energy_gate(frames: DataFrame, hold_s: float = 1.8, late: str = LATE, idle: timedelta | None = IDLE) -> DataFrame:
    return _in_order(frames, _Gate(hold_s, idle), late)


def dedup_stream(requests: DataFrame, late: str = LATE) -> DataFrame:
    """The first of equal normalized texts of a session within the late limit."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\W+", " "))
    return with_late_limit(requests.withColumn("norm_text", norm), late).dropDuplicatesWithinWatermark(["session_id", "norm_text"])


def stream_latency(rows: DataFrame, window: str = "1 minute", late: str = LATE) -> DataFrame:
    out = with_late_limit(rows, late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), F.percentile_approx("latency", 0.95).alias("p95"))
    return out.select(F.col("w.start").alias("start"), "n", "mean", "p95")


def complete_sentences(sentences: DataFrame) -> DataFrame:
    return sentences.where(is_utterance_complete(F.col("text")))


def stream_extract(sentences: DataFrame, extract, write):
    """A query that extracts the items of committed sentences batch by batch: extract(transcripts) -> items, which
    write(items, batch_id) puts away; a batch that is repeated has the same id."""
    rows = complete_sentences(sentences)
    return rows.writeStream.foreachBatch(lambda batch, batch_id: write(extract(batch), batch_id))
