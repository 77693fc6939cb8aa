"""The given tables as prescriptions: dictations, a catalogue, frames, threads. Each as a DataFrame and as SQL.

part stands for the catalogue, lineitem with part for dictated orders (their truth is in the columns), events for speech
frames and latencies, orders for threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formulary as C
from ..storage import materialize

_ITEM = """
SELECT l_orderkey AS rx_id, l_linenumber AS line, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_name, p_size,
 concat('Take ', p_name, ' ', CAST(p_size AS {S}), ' mg ',
  CASE l_linenumber % 5 WHEN 0 THEN 'twice daily' WHEN 1 THEN '1-0-1' WHEN 2 THEN 'TID' WHEN 3 THEN 'once daily' ELSE 'every 6 hours' END,
  ' for ', CAST(CAST(l_quantity AS INT) AS {S}), ' days', CASE WHEN l_discount > 0.05 THEN ' after meals.' ELSE '.' END) AS text,
 concat(CAST(p_size AS {S}), ' mg') AS truth_strength,
 CASE l_linenumber % 5 WHEN 0 THEN 'Twice a day (1-0-1)' WHEN 1 THEN 'Twice a day (1-0-1)' WHEN 2 THEN 'Thrice a day (1-1-1)' WHEN 3 THEN 'Once a day (1-0-0)' ELSE 'every 6 hours' END AS truth_frequency,
 concat(CAST(CAST(l_quantity AS INT) AS {S}), ' days') AS truth_duration, CASE WHEN l_discount > 0.05 THEN 'after meals' END AS truth_instruction
"""
_ITEMS = "FROM {L} JOIN {P} ON l_partkey = p_partkey\n"
_DICTATION = _ITEM + _ITEMS
DICTATION_SQL = _DICTATION.format(S="VARCHAR", L="lineitem", P="part")
ORDER = "line, l_partkey, l_suppkey, l_quantity, l_extendedprice"
PART_SQL = (
    "SELECT CAST(p_partkey AS VARCHAR) AS drug_id, concat(upper(p_brand), '-', CAST(p_size AS VARCHAR)) AS drug_code, concat(upper(p_name), ' ', CAST(p_size AS VARCHAR), ' TAB') AS drug_name, "
    "upper(p_name) AS base_name, upper(p_brand) AS brand_name, upper(p_type) AS generic_name, CAST(p_size AS VARCHAR) AS size, split_part(p_brand, '#', 2) AS brand_no, p_partkey AS ord FROM part"
)
FRAMES_SQL = "SELECT user_id AS session_id, event_id AS frame_no, ts, value / 1000.0 AS rms, event_type != 'error' AS is_speech FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an ordered item."""
    return dictation_of(spark, table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def dictation_of(spark: SparkSession, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return spark.sql(_DICTATION.format(S="STRING", L="{l}", P="{p}"), l=lineitem, p=part)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dictation, with the items of an order in one partition. Only the columns of the tables are dealt, before texts are made of
    them, and all that a query does with orders reads this one exchange."""
    given = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, p_name, p_size "
    rows = spark.sql(given + _ITEMS.format(L="{l}", P="{p}"), l=table(spark, sf_dir, "lineitem"), p=table(spark, sf_dir, "part"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return spark.sql(_ITEM.format(S="STRING") + "FROM {rows}", rows=dealt)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As texts, written once: work on distinct texts reads them twice, and to make them anew costs more than to write them."""
    return materialize(texts(spark, sf_dir), "transcripts")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rx_id, text: the items of an order, in order, one sentence each; in as many partitions as shuffles have, since the work on
    a text is large against its size."""
    rows = orders(spark, sf_dir)
    said = F.sort_array(F.collect_list(F.struct("line", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "text")))
    return rows.groupBy("rx_id").agg(F.array_join(F.transform(said, lambda t: t["text"]), " ").alias("text"))


def raw_formulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as drug_id", "concat(upper(p_brand), '-', p_size) as drug_code", "concat(upper(p_name), ' ', p_size, ' TAB') as drug_name", "'b' as drug_type",
        "upper(p_type) as generic_name", "upper(p_brand) as brand_name", "cast(null as string) as provenance", "p_partkey as ord",
    )


def formulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build_formulary(raw_formulary(spark, sf_dir))


def catalogue(spark: SparkSession, sf_dir: str) -> C.Catalogue:
    return C.catalogue(formulary(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame_no, ts, rms, zcr, is_speech; ts as a timestamp in UTC."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as session_id", "event_id as frame_no", "cast(ts as timestamp) as ts", "value / 1000.0 as rms", "0.1D as zcr", "event_type != 'error' as is_speech",
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: the distinct names of parts, as written and misspelt."""
    p = table(spark, sf_dir, "part")
    return p.selectExpr("p_name as key").unionByName(p.selectExpr("translate(p_name, 'i', 'y') as key")).distinct()


NAMES_SQL = "SELECT DISTINCT key FROM (SELECT p_name AS key FROM part UNION ALL SELECT translate(p_name, 'i', 'y') FROM part)"
