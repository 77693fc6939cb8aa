"""Queries of the streaming operators: the given tables as streams that are read to their end, with SQL over the whole tables.

A window leaves a stream in append mode once the watermark, which trails the newest event by streams.LATE, has passed it, so
the SQL keeps the windows that end by then.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import extract
from ..sources import readers
from ..storage import shared_folder
from ..streaming import streams
from . import tables as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


c = F.col


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream of its files. A stream's path is a folder or a pattern, and the table may be one file."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return stream(spark, sf, "events").selectExpr(
        "user_id as session_id", "event_id as frame_no", "cast(ts as timestamp) as ts", "value / 1000.0 as rms", "0.1D as zcr", "event_type != 'error' as is_speech",
    )


def to_its_end(rows: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All that the stream gives until its source has no more; every batch is a folder of its own, so one that is
    repeated replaces itself."""
    spark = rows.sparkSession
    spark.conf.set(*streams.STATE_STORE)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    run = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(StructType([*rows.schema, StructField("batch", IntegerType())])).parquet(f"{path}/rows").drop("batch")


E = f"({S.FRAMES_SQL})"
# Frame by frame over all sessions at once, from the rule as it is stated: loud and quiet runs, and a hold after speech.
_WALK = f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_no) AS n FROM {E} e),
w AS (SELECT session_id, frame_no, ts, n, CASE WHEN rms < 0.008 THEN 0.95 * 0.004 + 0.05 * rms ELSE 0.004 END AS floor, rms > greatest(0.01, 2.8 * 0.004) AS loud,
  1 AS run, false AS speaking, 0 AS hold FROM f WHERE n = 1
 UNION ALL SELECT session_id, frame_no, ts, n, floor, loud, run, CASE WHEN loud AND run >= 2 THEN true WHEN NOT loud AND run >= 10 AND hold = 0 THEN false ELSE speaking END,
  CASE WHEN loud AND run >= 2 THEN 3 WHEN NOT loud AND run >= 10 AND hold > 0 THEN hold - 1 ELSE hold END FROM (
   SELECT session_id, frame_no, ts, n, floor, loud, CASE WHEN loud = was_loud THEN run + 1 ELSE 1 END AS run, speaking, hold FROM (
    SELECT *, rms > greatest(0.01, 2.8 * floor) AS loud FROM (
     SELECT f.session_id, f.frame_no, f.ts, f.n, f.rms, CASE WHEN f.rms < 0.008 THEN 0.95 * w.floor + 0.05 * f.rms ELSE w.floor END AS floor, w.loud AS was_loud, w.run, w.speaking, w.hold
     FROM f JOIN w ON f.session_id = w.session_id AND f.n = w.n + 1))))"""
FLAGS_SQL = f"{_WALK} SELECT session_id, frame_no, speaking OR hold > 0 AS is_speech FROM w"
FLOOR_SQL = f"{_WALK} SELECT session_id, frame_no, round(floor, 9) AS noise_floor FROM w"


_CLOSED = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events)"
_WHOLE = timedelta(days=400)  # the given sessions pause for days, and are one session nevertheless


@query(f"{_WALK} SELECT session_id, frame_no, speaking OR hold > 0 AS is_speech FROM w WHERE ts <= {_CLOSED}")
def st01_speech_flags(spark, sf):
    return to_its_end(streams.speech_flags(frames(spark, sf).drop("is_speech"), idle=_WHOLE), "st01").select("session_id", "frame_no", "is_speech")


@query(
    f"WITH f AS (SELECT * FROM {E} e WHERE is_speech), a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM f WINDOW w AS (PARTITION BY session_id ORDER BY ts, frame_no)), "
    "b AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, frame_no) AS k FROM a) SELECT session_id, count(*) AS frames, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM b GROUP BY session_id, k "
    f"HAVING epoch_ms(max(ts)) - epoch_ms(min(ts)) >= 300 AND max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECOND FROM f)"
)
def st02_utterances(spark, sf):
    out = to_its_end(streams.utterances(frames(spark, sf), "1 hour"), "st02")
    return out.select("session_id", "frames", (F.unix_micros("end") - F.unix_micros("start")).alias("us"))


@query(
    f"WITH e AS {E}, w AS (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM e, range(3) r(k)) "
    f"SELECT session_id, epoch_ms(start) AS start_ms, count(*) AS frames FROM w WHERE start + INTERVAL 3 HOUR <= {_CLOSED} GROUP BY 1, 2 HAVING count(*) >= 2"
)
def st03_interim_windows(spark, sf):
    out = to_its_end(streams.interim_windows(frames(spark, sf), "3 hours", "1 hour", 2), "st03")
    return out.select("session_id", F.unix_millis("start").alias("start_ms"), "frames")


@query(f"SELECT session_id, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS frames FROM {E} e WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY 1, 2")
def st04_step_ticks(spark, sf):
    out = to_its_end(streams.step_ticks(frames(spark, sf), "1 hour"), "st04")
    return out.select("session_id", F.unix_millis("start").alias("start_ms"), "frames")


def _turns(spark, sf, kind: str) -> DataFrame:
    return stream(spark, sf, "conversations").selectExpr("conv_id as session_id", "turn as seq", f"{kind} as kind", "text")


@query("SELECT conv_id AS session_id, string_agg(text, ' ' ORDER BY turn) AS transcript, false AS final FROM conversations WHERE regexp_matches(text, '[\\p{L}\\p{N}]') GROUP BY 1")
def st05_assemble_transcript(spark, sf):
    out = to_its_end(streams.assemble_transcript(_turns(spark, sf, "'sentence'"), idle_ms=None, most_chars=1 << 30), "st05", "update")
    return out.select("session_id", "transcript", "final")


@query(
    "WITH t AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS a, max(turn) OVER (PARTITION BY conv_id) AS b FROM conversations) SELECT conv_id AS session_id, "
    "coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn > a AND turn < b AND regexp_matches(text, '[\\p{L}\\p{N}]')), '') AS transcript, true AS final FROM t GROUP BY 1 HAVING min(a) < min(b)"
)
def st06_control_rows(spark, sf):
    """The first turn of a conversation resets it and the last one finalizes it."""
    ends = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    rows = stream(spark, sf, "conversations").join(ends, "conv_id")
    rows = rows.where("a < b").selectExpr("conv_id as session_id", "turn as seq", "case when turn = a then 'reset' when turn = b then 'finalize' else 'sentence' end as kind", "text")
    out = to_its_end(streams.assemble_transcript(rows, idle_ms=None, most_chars=1 << 30), "st06", "update")
    return out.where("final").select("session_id", "transcript", "final")


@query(
    f"WITH f AS (SELECT *, min(CASE WHEN is_speech THEN frame_no END) OVER (PARTITION BY session_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM {E} e) "
    f"SELECT f.session_id, f.frame_no FROM f JOIN f g ON f.session_id = g.session_id AND f.next = g.frame_no WHERE NOT f.is_speech AND epoch_ms(g.ts) - epoch_ms(f.ts) <= 3600000 AND g.ts <= {_CLOSED}"
)
def st07_preroll_stream(spark, sf):
    return to_its_end(streams.preroll_stream(frames(spark, sf), 3_600_000, idle=_WHOLE), "st07")


@query(
    f"WITH f AS (SELECT *, max(epoch_ms(ts)) OVER (PARTITION BY session_id) AS newest FROM {E} e) SELECT session_id, arg_min(frame_no, (ts, frame_no)) AS first_frame, arg_max(frame_no, (ts, frame_no)) AS last_frame, count(*) AS frames FROM f "
    "WHERE newest - epoch_ms(ts) <= 86400000 GROUP BY 1"
)
def st08_bounded_buffer(spark, sf):
    return to_its_end(streams.bounded_buffer(frames(spark, sf), 86_400_000), "st08", "update")


@query()
def st09_commit_on_silence(spark, sf):
    """Turns as decoded windows, every third without a pause."""
    rows = stream(spark, sf, "conversations").selectExpr("conv_id as session_id", "turn as seq", "timestamp_seconds(60 * turn) as ts", "text", "case when turn % 3 = 2 then 0.1D else 1.0D end as silence_s")
    return to_its_end(streams.commit_on_silence(rows, idle=_WHOLE), "st09")


@query("SELECT DISTINCT user_id AS session_id, event_type AS norm_text FROM events")
def st10_dedup_stream(spark, sf):
    rows = stream(spark, sf, "events").selectExpr("user_id as session_id", "cast(ts as timestamp) as ts", "concat(upper(event_type), '!') as text")
    return to_its_end(streams.dedup_stream(rows), "st10").select("session_id", "norm_text")


@query(f"SELECT session_id, frame_no, is_speech FROM (SELECT *, coalesce(lag(is_speech) OVER (PARTITION BY session_id ORDER BY frame_no), false) AS before FROM {E} e) WHERE is_speech != before AND ts <= {_CLOSED}")
def st11_transition_stream(spark, sf):
    return to_its_end(streams.transition_stream(frames(spark, sf), idle=_WHOLE), "st11").select("session_id", "frame_no", "is_speech")


@query(f"SELECT rx_id, line, truth_frequency AS frequency, truth_duration AS duration FROM ({S.DICTATION_SQL}) d")
def st12_stream_extract(spark, sf):
    """Sentences of ordered items as they come in, each batch extracted and put away on its own."""
    said = S.dictation_of(spark, stream(spark, sf, "lineitem"), S.table(spark, sf, "part"))
    path = f"{shared_folder(spark)}/st12-{uuid.uuid4().hex}"

    def fields(batch: DataFrame) -> DataFrame:
        return batch.select("rx_id", "line", extract.extract_frequency(c("text"), c("text"))["value"].alias("frequency"), extract.extract_duration(c("text"), c("text"))["value"].alias("duration"))

    put = lambda items, n: items.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    streams.stream_extract(said.select("rx_id", "line", "text"), fields, put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("rx_id long, line long, frequency string, duration string, batch int").parquet(f"{path}/rows").drop("batch")


@query(f"SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY 1")
def st13_stream_latency(spark, sf):
    rows = stream(spark, sf, "events").selectExpr("cast(ts as timestamp) as ts", "value as latency")
    return to_its_end(streams.stream_latency(rows, "1 hour"), "st13").select(F.unix_millis("start").alias("start_ms"), "n", F.round("mean", 6).alias("mean"))


@query(
    f"WITH RECURSIVE f AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session_id ORDER BY frame_no) AS n FROM {E} e), s AS (SELECT DISTINCT session_id FROM f), "
    "w AS (SELECT session_id, CAST(0 AS BIGINT) AS frame_no, CAST(0 AS BIGINT) AS n, CAST(0.004 AS DOUBLE) AS floor, CAST(-100000000000000000 AS BIGINT) AS spoke, CAST(0 AS BIGINT) AS us FROM s "
    "UNION ALL SELECT f.session_id, f.frame_no, f.n, CASE WHEN f.rms > greatest(0.010, 2.2 * w.floor) THEN w.floor ELSE 0.95 * w.floor + 0.05 * f.rms END, CASE WHEN f.rms > greatest(0.010, 2.2 * w.floor) THEN f.us ELSE w.spoke END, f.us "
    "FROM f JOIN w ON f.session_id = w.session_id AND f.n = w.n + 1) SELECT session_id, frame_no, us - spoke <= 3600000000 AS active FROM w WHERE n > 0 AND us <= (SELECT epoch_us(max(ts)) - 10000000 FROM events)"
)
def st14_energy_gate(spark, sf):
    return to_its_end(streams.energy_gate(frames(spark, sf), 3600.0, idle=_WHOLE), "st14")


@query(f"SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1")
def st15_late_limit(spark, sf):
    """Windows that a late limit of two hours has closed."""
    rows = streams.with_late_limit(stream(spark, sf, "events").selectExpr("cast(ts as timestamp) as ts"), "2 hours")
    out = rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return to_its_end(out, "st15").select(F.unix_millis("w.start").alias("start_ms"), "n")


@query(f"SELECT session_id, frame_no, round(rms, 6) AS rms FROM {E} e")
def s07_read_frame_stream(spark, sf):
    """Frames written as files and read as a stream of a few files a batch."""
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    S.frames(spark, sf).select("session_id", "frame_no", "ts", "rms", "zcr").write.parquet(path)
    return to_its_end(readers.read_frame_stream(spark, path), "s07").select("session_id", "frame_no", F.round("rms", 6).alias("rms"))
