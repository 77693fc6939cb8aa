"""Speech frames of sessions in batch: flags, segments, trimming, silence. frames: session_id, frame_no, ts, rms, zcr."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .ranges import running


class Rule(NamedTuple):
    """When frames are speech. A frame is loud above `threshold` and above `ratio` noise floors, with few zero crossings;
    the floor is a moving mean of frames below `calm` thresholds. `on_after` loud frames in a row are speech; it lasts
    until, since the last such frame, more than `hold` frames have stood at place `off_after` or later of a quiet run."""

    threshold: float = 0.01
    ratio: float = 2.8
    crossings: float = 0.45
    calm: float = 0.8
    floor: float = 0.004
    rate: float = 0.05
    on_after: int = 2
    off_after: int = 10
    hold: int = 3


def with_noise_floor(frames: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """frames with noise_floor, after each frame.

    A moving mean weighs the calm frame i of k by rate (1 - rate)^(k - i). Calm frames are cut into blocks after which
    what came before weighs 1e-12; running sums within a block and the ends of the two blocks before give every mean,
    so that a long session is dealt over tasks.
    """
    keep = 1 - rule.rate
    block = max(1, math.ceil(12 * math.log(10) / -math.log(keep)))
    calm = F.col("rms") < rule.calm * rule.threshold
    rows = frames.withColumn("__k", F.sum(F.when(calm, 1).otherwise(0)).over(_by_session()))
    rows = rows.withColumn("__block", F.floor((F.col("__k") - 1) / block)).withColumn("__j", F.col("__k") - F.col("__block") * block)
    weighed = F.when(calm, F.col("rms") * F.pow(F.lit(keep), -F.col("__j"))).otherwise(0.0)
    rows = rows.withColumn("__sum", rule.rate * F.sum(weighed).over(Window.partitionBy("session_id", "__block").orderBy("frame_no")))
    ends = rows.where("__block >= 0").groupBy("session_id", "__block").agg((F.max("__sum") * keep**block).alias("__end"))
    earlier = F.coalesce(F.lag("__end").over(Window.partitionBy("session_id").orderBy("__block")), F.lit(rule.floor))
    ends = ends.select("session_id", (F.col("__block") + 1).alias("__block"), (F.col("__end") + keep**block * earlier).alias("__before"))
    out = rows.join(ends, ["session_id", "__block"], "left").withColumn(
        "noise_floor", F.when(F.col("__k") == 0, rule.floor).otherwise(F.pow(F.lit(keep), F.col("__j")) * (F.col("__sum") + F.coalesce("__before", F.lit(rule.floor))))
    )
    return out.drop("__k", "__block", "__j", "__sum", "__before")


def speech_flags(frames: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """session_id, frame_no, ts, rms, zcr, is_speech, noise_floor; each frame depends on all before it in its session.

    Null levels are not loud. Frames of one session and number are taken in any order.
    """
    rows = with_noise_floor(frames.select("session_id", "frame_no", "ts", "rms", "zcr"), rule)
    loud = F.coalesce((F.col("rms") > F.greatest(F.lit(rule.threshold), rule.ratio * F.col("noise_floor"))) & (F.col("zcr") < rule.crossings), F.lit(False))
    rows = rows.withColumn("__loud", loud)
    change = F.when(F.col("__loud") != F.coalesce(F.lag("__loud").over(_by_session()), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("__run", F.sum(change).over(_by_session()))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy("session_id", "__run").orderBy("frame_no")))
    heard = F.col("__loud") & (F.col("__place") >= rule.on_after)
    rows = rows.withColumn("__late", F.sum(F.when(~F.col("__loud") & (F.col("__place") >= rule.off_after), 1).otherwise(0)).over(_by_session()))
    rows = rows.withColumn("__heard", F.max(F.when(heard, F.col("__late"))).over(_by_session()))
    flag = F.coalesce(F.col("__late") - F.col("__heard") <= rule.hold, F.lit(False))
    return rows.select("session_id", "frame_no", "ts", "rms", "zcr", flag.alias("is_speech"), "noise_floor")


class Heard(NamedTuple):
    """What a live session remembers of its frames: the floor, the run it is in, and late quiet frames since speech."""

    floor: float
    loud: bool = False
    run: int = 0
    late: int = -1  # no speech yet

    def then(self, rms: float, zcr: float, rule: Rule) -> "Heard":
        floor = (1 - rule.rate) * self.floor + rule.rate * rms if rms < rule.calm * rule.threshold else self.floor
        loud = rms > max(rule.threshold, rule.ratio * floor) and zcr < rule.crossings
        run = self.run + 1 if loud == self.loud else 1
        if loud:
            return Heard(floor, loud, run, 0 if run >= rule.on_after else self.late)
        return Heard(floor, loud, run, self.late + (self.late >= 0 and run >= rule.off_after))

    def is_speech(self, rule: Rule) -> bool:
        return 0 <= self.late <= rule.hold


def _by_session(order: str = "frame_no"):
    return Window.partitionBy("session_id").orderBy(order)


def speech_segments(flags: DataFrame, min_frames: int = 2) -> DataFrame:
    """session_id, start_frame, end_frame, frames of each run of speech of min_frames or more; a session without one is
    one segment as a whole."""
    start = F.when(F.col("is_speech") != F.coalesce(F.lag("is_speech").over(_by_session()), F.lit(False)), 1).otherwise(0)
    rows = flags.withColumn("__run", start).withColumn("__run", F.sum("__run").over(_by_session()))
    runs = rows.where("is_speech").groupBy("session_id", "__run").agg(F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.count("*").alias("frames"))
    runs = runs.where(F.col("frames") >= min_frames).drop("__run")
    whole = flags.groupBy("session_id").agg(F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.count("*").alias("frames"))
    return runs.unionByName(whole.join(runs, "session_id", "left_anti"))


def trim_silence(flags: DataFrame, pad: int = 4) -> DataFrame:
    """The frames from pad before the first to pad after the last speech frame; none of a session without speech."""
    w = Window.partitionBy("session_id")
    speech = F.when(F.col("is_speech"), F.col("frame_no"))
    rows = flags.withColumn("__a", F.min(speech).over(w)).withColumn("__b", F.max(speech).over(w))
    return rows.where((F.col("frame_no") >= F.col("__a") - pad) & (F.col("frame_no") <= F.col("__b") + pad)).drop("__a", "__b")


def preroll(flags: DataFrame, ms: int = 200) -> DataFrame:
    """Quiet frames within ms before speech begins."""
    at = (F.col("ts").cast("double") * 1000).cast("long")
    w = Window.partitionBy("session_id").orderBy("__ms").rangeBetween(0, ms)
    rows = flags.withColumn("__ms", at)
    return rows.withColumn("__soon", F.max(F.col("is_speech").cast("int")).over(w)).where(~F.col("is_speech") & (F.col("__soon") == 1)).drop("__ms", "__soon")


def state_transitions(flags: DataFrame) -> DataFrame:
    """Frames at which the flag changes; a session begins quiet."""
    before = F.coalesce(F.lag("is_speech").over(_by_session()), F.lit(False))
    return flags.withColumn("__before", before).where(F.col("is_speech") != F.col("__before")).drop("__before")


TRANSCRIPT_CHUNK = 1 << 14  # characters of a chunk, and of the sentence that crosses its end


def transcript_offsets(sentences: DataFrame, by: str = "session_id", order: str = "seq", text: str = "text") -> DataFrame:
    """sentences and __end: how long the session's transcript is up to each, a blank between sentences. Null texts add nothing."""
    size = F.coalesce(F.length(text).cast("long") + 1, F.lit(0))
    return running(sentences, [by], [order], size, "__end").withColumn("__end", F.greatest(F.lit(0), F.col("__end") - 1))


def transcript_chunks(offsets: DataFrame, by: str = "session_id", order: str = "seq", text: str = "text", chunk: int = TRANSCRIPT_CHUNK) -> DataFrame:
    """by, __chunk, __begin, __text: each session's transcript in chunks of bounded size; __begin is the first one's place."""
    begin = F.col("__end") - F.length(text)
    rows = offsets.where(F.col(text).isNotNull()).select(by, order, F.col(text).alias("__said"), begin.alias("__begin"), F.floor(begin / chunk).alias("__chunk"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("__begin", order, "__said"))), lambda s: s["__said"])
    return rows.groupBy(by, "__chunk").agg(F.min("__begin").alias("__begin"), F.array_join(said, " ").alias("__text"))


def running_transcript(sentences: DataFrame, by: str = "session_id", order: str = "seq", text: str = "text", chunk: int = TRANSCRIPT_CHUNK) -> DataFrame:
    """sentences and transcript: all texts of the session so far.

    What is kept a sentence is how long the transcript is up to it; the texts are kept once, in chunks, and put together
    for the rows that are read.
    """
    offsets = materialize(transcript_offsets(sentences, by, order, text).withColumn("__row", F.monotonically_increasing_id()), "transcript-offsets")
    chunks = transcript_chunks(offsets, by, order, text, chunk).withColumnRenamed(by, "__by")
    parts = offsets.select(by, "__row", "__end").join(chunks, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__begin") <= F.col("__end")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "__text"))), lambda p: p["__text"]), " ")
    read = parts.groupBy("__row").agg(F.substring(whole, F.lit(1), F.first("__end").cast("int")).alias("transcript"))
    return offsets.join(read, "__row", "left").select(*sentences.columns, F.coalesce("transcript", F.lit("")).alias("transcript"))


def has_speech(flags: DataFrame) -> DataFrame:
    return flags.groupBy("session_id").agg(F.bool_or("is_speech").alias("has_speech"))


def suppress_silent(recordings: DataFrame, flags: DataFrame, least: float = 0.008) -> DataFrame:
    """recordings (session_id, text): the text is '' where no speech was seen and the overall RMS is below least."""
    loud = flags.groupBy("session_id").agg(F.bool_or("is_speech").alias("__s"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("__r"))
    rows = recordings.join(loud, "session_id", "left")
    return rows.withColumn("text", F.when(~F.coalesce("__s", F.lit(False)) & (F.coalesce("__r", F.lit(0.0)) < least), "").otherwise(F.col("text"))).drop("__s", "__r")
