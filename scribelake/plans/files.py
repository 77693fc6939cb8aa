"""Queries of sources and sinks (the given tables written in their formats and read back), and of operators on clauses and items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble, clauses, extract, lookup, reconcile
from ..sources import readers, writers
from ..storage import shared_folder
from . import relational as R
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
P, D = f"({S.PART_SQL})", f"({S.DICTATION_SQL})"


def place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def documents_of(rows: DataFrame, block, document, path: str) -> str:
    """JSON files under path, one for each value of block: document, a column of all rows of that block."""
    blocks = rows.groupBy(block.alias("block")).agg(document.alias("value"))
    blocks.write.partitionBy("block").text(path)
    return f"{path}/*"


# --- sources and sinks ----------------------------------------------------------------------------------------------------
@query(f"SELECT drug_id, drug_code, drug_name, brand_name, generic_name FROM {P} f")
def s01_read_formulary_json(spark, sf):
    item = F.struct("drug_id", "drug_code", "drug_name", "drug_type", "generic_name", "brand_name")
    whole = F.to_json(F.struct(F.collect_list(item).alias("drugData")))
    path = documents_of(S.raw_formulary(spark, sf), F.floor(c("ord") / 500), whole, place(spark, "formulary"))
    return readers.read_formulary_json(spark, path).select("drug_id", "drug_code", "drug_name", "brand_name", "generic_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS drug_id, upper(split_part(p_brand, '#', 1)) AS route_code FROM part WHERE p_size % 3 != 0")
def s02_read_route_map(spark, sf):
    path = place(spark, "routes")
    rows = S.table(spark, sf, "part").selectExpr("concat(' ', p_partkey) as drug_id", "case when p_size % 3 = 0 then ' ' else split_part(p_brand, '#', 1) end as route_code")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_route_map(spark, path).select("drug_id", "route_code")


@query("SELECT 'routes' AS list, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation UNION ALL SELECT 'units', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def s03_read_reference_lists(spark, sf):
    routes, units = place(spark, "list"), place(spark, "list")
    S.table(spark, sf, "nation").selectExpr("n_nationkey as code", "n_name as name").write.option("header", True).csv(routes)
    S.table(spark, sf, "region").selectExpr("r_regionkey as code", "r_name as name").write.option("header", True).csv(units)
    lists = readers.read_reference_lists(spark, routes=routes, units=units, schedules=place(spark, "missing"))
    return lists["routes"].select(F.lit("routes").alias("list"), "code", "name").unionByName(lists["units"].select(F.lit("units").alias("list"), "code", "name"))


@query("SELECT conv_id * 1000 + turn AS rx_id, text, CASE WHEN turn % 2 = 0 THEN 'FAST' ELSE 'STANDARD' END AS mode FROM conversations WHERE turn % 5 != 4 AND trim(text) != ''")
def s04_read_transcripts(spark, sf):
    path = place(spark, "transcripts")
    rows = S.table(spark, sf, "conversations").selectExpr("cast(conv_id * 1000 + turn as long) as rx_id", "role as session_id", "case when turn % 5 = 4 then '  ' else text end as text", "turn % 2 = 0 as fast_mode")
    rows.write.json(path)
    return readers.read_transcripts(spark, path).select("rx_id", "text", "mode")


@query(f"SELECT CAST(rx_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY rx_id ORDER BY {S.ORDER}) AS pos, p_name AS medicine_name, truth_strength AS strength FROM {D} d")
def s05_read_golden(spark, sf):
    order = F.array_sort(F.collect_list(F.struct(*S.ORDER.split(", "), "p_name", "truth_strength")))
    items = F.transform(order, lambda x: F.struct(x["p_name"].alias("medicine_name"), x["truth_strength"].alias("strength")))
    cases = S.dictation(spark, sf).groupBy("rx_id").agg(items.alias("expected_items"))
    cases = cases.select("rx_id", F.struct(c("rx_id").cast("string").alias("id"), F.lit("x").alias("category"), F.lit("said").alias("input_text"), "expected_items").alias("case"))
    path = documents_of(cases, F.floor(c("rx_id") / 5000), F.to_json(F.collect_list("case")), place(spark, "golden"))
    return readers.read_golden(spark, path).select("id", c("pos").cast("long").alias("pos"), "medicine_name", "strength")


@query("SELECT o_orderkey AS id, o_orderstatus AS transcript, 1 AS medications FROM orders")
def s09_saved_prescriptions(spark, sf):
    path = place(spark, "saved")
    rows = S.table(spark, sf, "orders").selectExpr("o_orderkey as id", "cast(o_orderdate as string) as timestamp", "o_custkey as patient_id", "1 as visit_id", "o_orderstatus as transcript", "array(named_struct('name', o_orderpriority)) as medications")
    writers.write_saved_prescriptions(rows.where("id % 2 = 0"), path)
    writers.write_saved_prescriptions(rows.where("id % 2 != 0"), path)
    kept = spark.read.schema("id long, transcript string, medications array<struct<name:string>>").json(path)
    return kept.select("id", "transcript", F.size("medications").alias("medications"))


@query("SELECT event_id AS id, user_id AS process_id, event_type AS query FROM events")
def s10_append_history(spark, sf):
    path = place(spark, "history")
    rows = S.table(spark, sf, "events").selectExpr("event_id as id", "user_id as process_id", "event_type as query")
    writers.append_history(rows.where("process_id % 3 = 0"), path)
    writers.append_history(rows.where("process_id % 3 != 0"), path)
    return writers.read_history(spark, path)


@query("SELECT 'standard' AS section, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'fast', o_orderstatus, count(*) FROM orders GROUP BY 2")
def s13_eval_report(spark, sf):
    path, orders = place(spark, "report"), S.table(spark, sf, "orders")
    by = lambda name: orders.groupBy(c(name).alias("category")).agg(F.count("*").alias("n"))
    writers.write_eval_report({"standard": by("o_orderpriority"), "fast": by("o_orderstatus")}, path)
    read = lambda name: spark.read.schema("category string, n long").json(f"{path}/{name}").select(F.lit(name).alias("section"), "category", "n")
    return read("standard").unionByName(read("fast"))


# --- clauses ----------------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey AS rx_id, l_linenumber AS clause_id, max(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id "
       "FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)")
def w03_previous_medication(spark, sf):
    rows = S.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("rx_id"), c("l_linenumber").alias("clause_id")).agg((F.max("l_returnflag") == "N").alias("is_medication"))
    return clauses.previous_medication(rows).select("rx_id", "clause_id", "previous_id")


@query(f"SELECT rx_id, line, CASE WHEN line % 3 = 0 THEN 'twice daily' WHEN line % 3 = 1 THEN 'every 6 hours' ELSE 'at bedtime' END AS said FROM {D} d")
def w12_first_pattern_wins(spark, sf):
    """Patterns in their order, wherever they stand: the one that stands first in the text is the last pattern."""
    text = F.expr("concat('at bedtime ', case line % 3 when 0 then 'or twice daily' when 1 then 'but every 6 hours' else '' end)")
    return S.dictation(spark, sf).select("rx_id", "line", T.first_pattern(text, (r"every \d+ hours", "twice daily", "at bedtime")).alias("said"))


_ORDERED = f"SELECT *, row_number() OVER (PARTITION BY rx_id ORDER BY {S.ORDER}) AS k, lead(text) OVER (PARTITION BY rx_id ORDER BY {S.ORDER}) AS next FROM {D} d"


@query(
    f"WITH t AS (SELECT rx_id, string_agg(text, ' ' ORDER BY {S.ORDER}) AS text FROM {D} d GROUP BY 1), k AS (SELECT rx_id, rtrim(text, '.') AS clause, row_number() OVER (PARTITION BY rx_id ORDER BY {S.ORDER}) AS clause_id FROM {D} d) "
    "SELECT k.rx_id, CAST(clause_id AS INT) AS clause_id, CAST(instr(lower(t.text), lower(clause)) - 1 AS INT) AS start_char, CAST(instr(lower(t.text), lower(clause)) - 1 + length(clause) AS INT) AS end_char FROM k JOIN t USING (rx_id)"
)
def x03_clause_offsets(spark, sf):
    return clauses.segment(S.transcripts(spark, sf)).select("rx_id", "clause_id", "start_char", "end_char")


@query(
    f"SELECT rx_id, line, CASE WHEN line % 3 = 0 THEN '1. with water 2. after meals' WHEN line % 3 = 1 THEN '1. after meals 2. call me' ELSE '1. after meals' END AS said, count(*) AS n FROM {D} d GROUP BY ALL"
)
def w11_chronological_order(spark, sf):
    """Phrases found by rules in any order, put as the text has them; contained ones go, unknown ones follow."""
    text = F.expr("concat(case when line % 3 = 0 then 'With water, ' else '' end, 'take after meals')")
    phrases = F.expr("case line % 3 when 0 then array('meals', 'after meals', 'with water') when 1 then array('call me', 'after meals') else array('after meals', 'after') end")
    rows = S.dictation(spark, sf).select("rx_id", "line", T.numbered_list(T.chronological(phrases, text)).alias("said"))
    return rows.groupBy("rx_id", "line", "said").agg(F.count("*").alias("n"))


@query(f"SELECT rx_id, line, line % 3 AS kind, count(*) AS n FROM {D} d WHERE line % 3 != 1 GROUP BY ALL")
def j19_class_guard(spark, sf):
    advice = F.expr("case line % 3 when 0 then 'finish the antibiotic course' when 1 then 'use the eye drops at night' else 'rest well' end")
    rows = S.dictation(spark, sf).select("rx_id", "line", (c("line") % 3).alias("kind"), advice.alias("advice"), F.concat(F.lit("Take Augmentin and "), "p_name").alias("clause"))
    return clauses.class_guard(rows).groupBy("rx_id", "line", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT rx_id, line, CASE truth_frequency WHEN 'Twice a day (1-0-1)' THEN 'two' WHEN 'every 6 hours' THEN 'four' WHEN 'Once a day (1-0-0)' THEN 'one' END AS doses FROM {D} d")
def u01_rule_table(spark, sf):
    rules = [(r"\b(twice|1-0-1)\b", "two"), (r"every 6 hours", "four"), (r"\bonce\b", "one"), (r"\b(daily|every)\b", "some")]
    return S.dictation(spark, sf).select("rx_id", "line", T.rule_value(c("text"), rules).alias("doses"))


# --- two extractions ---------------------------------------------------------------------------------------------------------
@query(f"SELECT rx_id, line, concat(p_name, ' ', truth_strength) AS medicine, truth_strength AS strength, instr(text, truth_strength) - 1 AS at FROM {D} d")
def u02_second_extraction(spark, sf):
    """A user's extractor as a column expression: blocks out of 'field: value' lines."""
    said = S.dictation(spark, sf).select(F.struct("rx_id", "line").alias("rx_id"), c("text").alias("raw_text"), F.concat(F.lit("Drug_name: "), "p_name", F.lit(" "), "truth_strength", F.lit("\nstrength: "), "truth_strength", F.lit("\nroute: NONE")).alias("output"))
    out = reconcile.second_extraction(said.select("rx_id", F.concat_ws("\x00", "raw_text", "output").alias("raw_text")), lambda text: T.parse_blocks(F.split(text, "\x00")[1]))
    return out.select(c("rx_id.rx_id").alias("rx_id"), c("rx_id.line").alias("line"), "medicine", "strength", c("spans.strength.start").cast("long").alias("at"))


_WHOLE = f"""(SELECT rx_id, CAST(row_number() OVER (PARTITION BY rx_id ORDER BY {S.ORDER}) AS INT) AS item_no, concat(p_name, ' ', truth_strength) AS medicine, truth_strength AS strength FROM {D} d)"""


@query(f"SELECT rx_id, item_no, medicine, strength, 'EXTRACTED' AS status FROM {_WHOLE} i")
def j21_passthrough(spark, sf):
    """All items of all orders, where no second extraction is there."""
    return reconcile.passthrough(R._all_items(spark, sf)).select("rx_id", "item_no", "medicine", "strength", "status")


@query()
def j20_reconcile_pairs(spark, sf):
    """Pairs of all items of an order with those of a second extraction, in which every third item is missing. SQL cannot
    express the greedy pairing; x14_reconcile_all_items is compared with plain Python."""
    a = R._all_items(spark, sf)
    b = a.where("item_no % 3 != 0").withColumn("medicine", F.split("medicine", " ")[0])
    return reconcile.pair(a, b).select("rx_id", "pos", c("a.item_no").alias("item_no"), c("b.item_no").alias("other_no"))


@query("SELECT l_orderkey AS rx_id, l_linenumber AS item_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'NONE' ELSE l_returnflag END AS l_returnflag FROM lineitem)) WHERE n = 1 OR l_returnflag = 'NONE'")
def o06_dedup_blocks(spark, sf):
    rows = S.table(spark, sf, "lineitem").selectExpr("l_orderkey as rx_id", "l_linenumber as item_no", "case when l_linestatus = 'O' then 'NONE' else l_returnflag end as Drug_name").distinct()
    return assemble.dedup_blocks(rows).select("rx_id", "item_no")


@query("SELECT l_orderkey AS rx_id, CAST(l_linenumber AS INT) AS line, CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE concat(l_returnflag, '; ', l_linestatus) END AS said, count(*) AS n FROM lineitem GROUP BY ALL")
def o02_ordered_union(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(c("l_orderkey").alias("rx_id"), c("l_linenumber").cast("int").alias("line"), T.ordered_union(F.array("l_returnflag"), F.array("l_linestatus", "l_returnflag")).alias("said"))
    return rows.groupBy("rx_id", "line", "said").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS rx_id, o_orderstatus IN ('O') AS valid FROM orders")
def p16_valid_prescription(spark, sf):
    status = F.when(c("o_orderstatus") == "O", "VALIDATED").when(c("o_orderstatus") == "F", "ERROR").otherwise("NEEDS_REVIEW")
    return S.table(spark, sf, "orders").select(c("o_orderkey").alias("rx_id"), assemble.is_valid_prescription(status).alias("valid"))


# --- top matches --------------------------------------------------------------------------------------------------------------
@query(f"SELECT * FROM ({R._FUZZY}) x WHERE rank <= 2")
def t01_top_matches(spark, sf):
    found = lookup.find_fuzzy(S.names(spark, sf), S.catalogue(spark, sf), limit=2)
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("confidence", F.round("confidence", 6))


@query()
def t02_top_suggestions(spark, sf):
    """Suggestions of distinct (base name, first strength) for misspelt names."""
    return lookup.did_you_mean(S.names(spark, sf), S.catalogue(spark, sf), limit=3)


@query(
    f"WITH c AS ({R.ORACLE_SQL['j14_find_composite']}), f AS {P}, s AS (SELECT c.key, c.a, c.b, c.drug_id, g.drug_id AS other, g.ord FROM c JOIN f ON f.drug_id = c.drug_id JOIN f g ON g.base_name = f.base_name), "
    "o AS (SELECT key, a, b, other AS drug_id, CASE WHEN other = drug_id THEN 0.95 ELSE 0.85 END AS confidence, row_number() OVER (PARTITION BY key, a, b ORDER BY CASE WHEN other = drug_id THEN 0 ELSE 1 END, ord, other) AS rank FROM s) SELECT * FROM o WHERE rank <= 3"
)
def t03_composite_options(spark, sf):
    asked = S.table(spark, sf, "part").selectExpr("p_name as key", "cast(floor(p_size / 2) as double) as a", "cast(p_size - floor(p_size / 2) as double) as b")
    return lookup.composite_options(asked, S.catalogue(spark, sf))


@query(f"WITH f AS {P} SELECT rx_id, line, d.p_name AS medicine FROM {D} d")
def x04_extract_medicine(spark, sf):
    rows = S.dictation(spark, sf).select("rx_id", "line", c("text").alias("clause"), F.lit(None).cast("string").alias("seed"))
    return extract.extract_medicine(rows, S.catalogue(spark, sf)).select("rx_id", "line", F.lower("medicine").alias("medicine"))
