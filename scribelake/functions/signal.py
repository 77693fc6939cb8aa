"""Audio columns: frame features, splitting and resampling. Samples are arrays of double between -1 and 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = 480  # samples: 30 ms at 16 kHz
SHORTEST = 64


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def zero_crossing_rate(samples: Column) -> Column:
    """Share of neighbours with different signs; 0 counts as positive."""
    n = F.size(samples)
    signs = F.transform(samples, lambda x: F.when(x < 0, -1.0).otherwise(1.0))
    steps = F.zip_with(F.slice(signs, 2, F.greatest(n - 1, F.lit(0))), F.slice(signs, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - 1) / 2).otherwise(0.0)


def frame_split(samples: Column, frame: int = FRAME, shortest: int = SHORTEST) -> Column:
    """array of frames; a rest of `shortest` samples or more is a frame of its own, and so is a clip shorter than one."""
    n = F.size(samples)
    whole = F.floor(n / frame).cast("int")
    frames = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), lambda i: i < whole), lambda i: F.slice(samples, i * frame + 1, frame))
    rest = F.slice(samples, whole * frame + 1, F.greatest(n - whole * frame, F.lit(0)))
    keep = ((n - whole * frame) >= shortest) | ((whole == 0) & (n > 0))
    return F.when(keep, F.concat(frames, F.array(rest))).otherwise(frames)


def resample_block_avg(samples: DataFrame, ratio: float, session: str = "session_id") -> DataFrame:
    """session, i, value -> session, block, value: the mean of each block of ratio samples, clamped, as a 16-bit number."""
    block = F.floor(F.col("i") / ratio).alias("block")
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("value")))
    out = samples.groupBy(session, block).agg(mean.alias("m"))
    return out.select(session, "block", F.floor(F.when(F.col("m") < 0, F.col("m") * 32768).otherwise(F.col("m") * 32767)).cast("int").alias("value"))


def resample_linear(samples: Column, rate: Column, target: int = 16000) -> Column:
    """The array at the target rate, by linear interpolation between its ends."""
    n = F.size(samples)
    m = F.floor(n * target / rate).cast("int")
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(F.lit(0.0))

    def at(i: Column) -> Column:
        x = i * step
        low = F.floor(x).cast("int")
        return F.get(samples, low) + (x - low) * (F.get(samples, F.least(low + 1, n - 1)) - F.get(samples, low))

    grid = F.filter(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), lambda i: i < m)
    return F.when(rate == target, samples).otherwise(F.transform(grid, at))


# --- clips of any length: rows (session, i, value), i from 0 without holes ------------------------------------------------
CHUNK = 1 << 14  # samples that meet in one row


def chunked(samples: DataFrame, chunk: int = CHUNK, halo: int = 0, session: str = "session_id") -> DataFrame:
    """session, chunk, values: the samples in order, in rows of `chunk`, each with the first `halo` samples of the next."""
    own = F.floor(F.col("i") / chunk).cast("long")
    before = F.when((own > 0) & (F.col("i") - own * chunk < halo), own - 1)
    rows = samples.select(session, "i", "value", F.explode(F.array_compact(F.array(own, before))).alias("chunk"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"])
    return rows.groupBy(session, "chunk").agg(values.alias("values"))


def clip_features(samples: DataFrame, chunk: int = CHUNK, session: str = "session_id") -> DataFrame:
    """session, rms, zcr over whole clips. A chunk's last sample meets the next chunk's first."""
    rows = chunked(samples, chunk, 1, session)
    own = F.slice("values", 1, chunk)
    squares = F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)
    turns = zero_crossing_rate(F.col("values")) * F.greatest(F.size("values") - 1, F.lit(0))
    sums = rows.select(session, F.size(own).alias("n"), squares.alias("s"), turns.alias("t")).groupBy(session).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    return sums.select(session, F.sqrt(F.col("s") / F.col("n")).alias("rms"), F.when(F.col("n") > 1, F.col("t") / (F.col("n") - 1)).otherwise(0.0).alias("zcr"))


def clip_frames(samples: DataFrame, frame: int = FRAME, shortest: int = SHORTEST, session: str = "session_id") -> DataFrame:
    """session, frame_no, values of the frames that frame_split gives."""
    rows = chunked(samples, frame, 0, session).withColumnRenamed("chunk", "frame_no")
    return rows.where((F.size("values") == frame) | (F.size("values") >= shortest) | (F.col("frame_no") == 0))


def clip_resampled(samples: DataFrame, rate: int, target: int = 16000, chunk: int = CHUNK, session: str = "session_id") -> DataFrame:
    """session, i, value at the target rate, as resample_linear gives. A chunk makes the samples that lie behind one of its own
    and before the next, for which it has the first sample of the next chunk."""
    if rate == target:
        return samples.select(session, "i", "value")
    sizes = samples.groupBy(session).agg(F.count("*").alias("n")).withColumn("m", F.floor(F.col("n") * target / rate).cast("long"))
    sizes = sizes.withColumn("step", F.when(F.col("m") > 1, (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))).withColumnRenamed(session, "__of")
    rows = chunked(samples, chunk, 1, session).join(sizes, F.col(session).eqNullSafe(F.col("__of"))).where("m > 0")
    first = F.col("chunk") * chunk
    # Rounding may put a sample next to where division puts it, so one more on either side is tried.
    low = F.when(F.col("step") > 0, F.greatest(F.lit(0), F.floor(first / F.col("step")) - 1)).otherwise(F.lit(0))
    high = F.when(F.col("step") > 0, F.least(F.col("m") - 1, F.ceil((first + chunk) / F.col("step")) + 1)).otherwise(F.col("m") - 1)
    rows = rows.withColumn("j", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))))
    at = F.col("j") * F.col("step")
    place = (F.floor(at) - first).cast("int")
    rows = rows.where((place >= 0) & (place < chunk)).withColumn("low", F.get("values", place)).withColumn("next", F.get("values", F.least(place + 1, F.size("values") - 1)))
    return rows.select(session, F.col("j").alias("i"), (F.col("low") + (at - F.floor(at)) * (F.col("next") - F.col("low"))).alias("value"))


def pcm16(raw: bytes):
    """Little-endian 16-bit mono samples as float32 between -1 and 1."""
    import numpy as np

    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768.0
