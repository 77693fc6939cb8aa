"""Readers of catalogues, transcripts, golden cases and audio."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import pcm16
from ..operators import formulary as C

LARGEST_AUDIO = 25 * 1024 * 1024


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """What read gives, or no rows where the path is missing."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_formulary_json(spark: SparkSession, path: str) -> DataFrame:
    """{drugData: [...]} in the columns of a raw catalogue; a missing file is an empty one."""
    item = "drug_id string, drug_code string, drug_name string, drug_type string, generic_name string, brand_name string, provenance string"
    nested = f"drugData array<struct<{item.replace(' string', ':string')}>>"
    read = lambda: spark.read.schema(nested).option("multiLine", True).json(path).select(F.posexplode("drugData"))
    rows = _or_empty(read, spark, f"pos int, col struct<{item.replace(' string', ':string')}>")
    return rows.select("col.*", F.col("pos").cast("long").alias("ord"))


def read_route_map(spark: SparkSession, path: str) -> DataFrame:
    """drug_id, route_code, pos in file order, blanks left out."""
    read = lambda: spark.read.option("header", True).schema("drug_id string, route_code string").csv(path)
    rows = _or_empty(read, spark, "drug_id string, route_code string")
    rows = rows.select(F.trim("drug_id").alias("drug_id"), F.upper(F.trim("route_code")).alias("route_code"), F.monotonically_increasing_id().alias("pos"))
    return rows.where("drug_id != '' and route_code != ''")


def read_reference_lists(spark: SparkSession, **paths: str) -> dict[str, DataFrame]:
    """Header CSV files as they are, by name."""
    return {name: _or_empty(lambda p=path: spark.read.option("header", True).csv(p), spark, "code string") for name, path in paths.items()}


def read_transcripts(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """rx_id, session_id, text, mode; blank texts are left out, fast_mode sets the mode."""
    rows = spark.read.schema("rx_id long, session_id string, patient_id string, visit_id string, text string, mode string, fast_mode boolean").format(kind).load(path)
    mode = F.when(F.col("fast_mode"), "FAST").otherwise(F.upper(F.coalesce("mode", F.lit("STANDARD"))))
    return rows.where(F.trim("text") != "").withColumn("mode", mode).drop("fast_mode")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """id, category, text, pos (from 1; null without items) and the expected fields."""
    item = "medicine_name:string,strength:string,frequency:string,duration:string,route:string,expected_status:string"
    schema = f"id string, category string, input_text string, expected_items array<struct<{item}>>, safety_invariants map<string,boolean>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.select("id", "category", F.col("input_text").alias("text"), "safety_invariants", F.posexplode_outer("expected_items"))
    return rows.select("id", "category", "text", (F.col("pos") + 1).alias("pos"), "col.*", "safety_invariants")


def read_audio(spark: SparkSession, path: str, largest: int = LARGEST_AUDIO) -> DataFrame:
    """path, rate, samples, error of WAV and raw PCM files; stereo is averaged, and empty, unreadable and too large ones
    (whose content is not read) have an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,pcm}").load(path)
    large = files.where(F.col("length") > largest).select("path", F.lit(None).cast("int").alias("rate"), F.lit(None).cast("array<double>").alias("samples"), F.lit("too large").alias("error"))
    files = files.where(F.col("length") <= largest).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        for batch in batches:
            out = []
            for name, raw in batch.itertuples(index=False):
                rate, samples, error = 16000, None, None
                try:
                    if name.endswith(".wav"):
                        with wave.open(io.BytesIO(raw)) as f:
                            rate = f.getframerate()
                            samples = pcm16(f.readframes(f.getnframes())).reshape(-1, f.getnchannels()).mean(axis=1)
                    else:
                        samples = pcm16(raw)
                    error = None if len(samples) else "empty"
                except (wave.Error, EOFError, ValueError) as e:
                    error = str(e) or type(e).__name__
                out.append((name, rate, None if samples is None else samples.astype("float64"), error))
            yield pd.DataFrame(out, columns=["path", "rate", "samples", "error"])

    return files.mapInPandas(decode, "path string, rate int, samples array<double>, error string").unionByName(large)


def read_frame_stream(spark: SparkSession, path: str, schema: str = "session_id long, frame_no long, ts timestamp, rms double, zcr double", kind: str = "parquet", files_a_batch: int = 8) -> DataFrame:
    """A stream of the frame files that appear under path."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)


def pcm_chunks_to_frames(chunks: DataFrame) -> DataFrame:
    """session_id, chunk_no, ts, pcm (binary) -> session_id, chunk_no, ts, samples."""

    @F.pandas_udf("array<double>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: pcm16(b).astype("float64") if b is not None else None)

    return chunks.select("session_id", "chunk_no", "ts", decode("pcm").alias("samples"))


def catalogue_from(spark: SparkSession, json_path: str, routes_path: str, with_curated: bool = True) -> C.Catalogue:
    return C.catalogue(C.build_formulary(read_formulary_json(spark, json_path), read_route_map(spark, routes_path), with_curated))
