"""Queries of the text and name functions, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import normalize as Z
from ..functions import rules as R
from ..functions import text as T
from ..operators.once import once
from . import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, source, columns: dict[str, Column], sql: str | None) -> None:
    """source(spark, sf_dir) -> rows; columns are made of them. sql gives the same columns."""
    QUERIES[name] = lambda spark, sf_dir: source(spark, sf_dir).select(*[c.alias(k) for k, c in columns().items()])
    if sql:
        ORACLE_SQL[name] = sql


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fold(expr: str, rules) -> str:
    """The same replacements, in the same order, by the other engine's regular expressions."""
    for pattern, by in rules:
        expr = f"regexp_replace({expr}, {_lit(pattern.replace('(?i)', ''))}, {_lit(by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'gi')"
    return expr


def _runs(expr: str, letters: str) -> str:
    for x in letters:
        expr = f"regexp_replace({expr}, '{x}+', '{x}', 'g')"
    return expr


D = f"FROM ({S.DICTATION_SQL}) d"
P = f"FROM ({S.PART_SQL}) f"
W = f"FROM ({S.NAMES_SQL}) n"
c, lit = F.col, F.lit
_dict, _names = S.dictation, S.names
_forms = S.formulary
_id = lambda **more: {"rx_id": c("rx_id"), "line": c("line"), **more}

# names
_add("f01_clean_base_name", S.raw_formulary, lambda: {"drug_id": c("drug_id"), "base_name": N.clean_base_name(c("drug_name"))}, f"SELECT drug_id, base_name {P}")
_l = "regexp_replace({}, '[^a-z]', '', 'g')"
_sx = _l.format("replace(lower(key), 'ph', 'f')")
_codes = _runs(f"translate({_sx}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000')", "0123456")
_add(
    "f02_soundex", _names, lambda: {"key": c("key"), "soundex": N.soundex_ph(c("key"))},
    f"SELECT key, concat(upper(substr({_sx}, 1, 1)), substr(concat(replace(substr({_codes}, 2), '0', ''), '000'), 1, 3)) AS soundex {W}",
)
_pb = "regexp_replace(replace(replace(replace(replace(" + _l.format("lower(key)") + ", 'ph', 'f'), 'ck', 'k'), 'th', 't'), 'sh', 's'), 'c([eiy])', 's\\1', 'g')"
_add(
    "f03_phonetic_backbone", _names, lambda: {"key": c("key"), "backbone": N.phonetic_backbone(c("key"))},
    f"SELECT key, replace({_runs(f'''translate({_pb}, 'bpvfwckqgjdtszxlrmnaeiouyh', 'PPPPPKKKKKTTSSSLRMN0000000')''', 'PKTSLRMN0')}, '0', '') AS backbone {W}",
)
_add("f04_levenshtein", _names, lambda: {"key": c("key"), "distance": N.levenshtein_ph(c("key"), F.translate(F.upper(c("key")), "E", "A"))}, f"SELECT key, levenshtein(replace(lower(key), 'ph', 'f'), replace(lower(translate(upper(key), 'E', 'A')), 'ph', 'f')) AS distance {W}")
_add("f05_strengths", _forms, lambda: {"drug_id": c("drug_id"), "strengths": F.array_join("strength_values", ",")}, f"SELECT drug_id, CASE WHEN size = brand_no THEN size WHEN CAST(size AS INT) < CAST(brand_no AS INT) THEN concat(size, ',', brand_no) ELSE concat(brand_no, ',', size) END AS strengths {P}")
_add("f06_dosage_form", _forms, lambda: {"drug_id": c("drug_id"), "dosage_form": c("dosage_form")}, f"SELECT drug_id, 'TAB' AS dosage_form {P}")
_add("f18_candidate_name", _dict, lambda: _id(name=N.clean_candidate_name(F.concat(lit("Take one tablet of "), c("p_name")))), f"SELECT rx_id, line, p_name AS name {D}")
_add("f19_full_name", _dict, lambda: _id(name=N.clean_full_name(F.concat(lit("give two of "), c("p_name"), lit(" orally")))), f"SELECT rx_id, line, p_name AS name {D}")
_add("f20_number_in_name", _forms, lambda: {"drug_id": c("drug_id"), "hit": N.number_in_name(c("drug_name"), lit("1"))}, f"SELECT drug_id, size = '1' AS hit {P}")
_add("f24_core_words", _dict, lambda: _id(words=F.array_join(N.core_words(F.concat(lit("take tab "), c("p_name"), lit(" mg")), ), ",")), f"SELECT rx_id, line, replace(p_name, ' ', ',') AS words {D}")
_add("f25_split_dose", _dict, lambda: _id(dose=N.split_dose(c("truth_strength"), c("p_name"))["dose"], unit=N.split_dose(c("truth_strength"), c("p_name"))["unit"]), f"SELECT rx_id, line, CAST(p_size AS VARCHAR) AS dose, 'mg' AS unit {D}")
_add("p03_valid_medication", _dict, lambda: _id(valid=N.is_valid_medication(c("p_name")), invalid=N.is_valid_medication(F.when(c("line") % 2 == 0, lit("hot water")).otherwise(lit("take the doctor")))), f"SELECT rx_id, line, true AS valid, false AS invalid {D}")
_add("t07_sort_strengths", _dict, lambda: _id(sorted=F.array_join(N.sort_strengths(F.array(F.concat(c("p_size").cast("string"), lit("%")), c("p_size").cast("string"), lit("9.5"))), ",")), f"SELECT rx_id, line, concat(CASE WHEN p_size < 9.5 THEN concat(CAST(p_size AS VARCHAR), ',9.5') ELSE concat('9.5,', CAST(p_size AS VARCHAR)) END, ',', CAST(p_size AS VARCHAR), '%') AS sorted {D}")

# normalisation: the same text once
def _said_once(name: str, said: Callable[[], Column], made: Callable[[Column], Column], sql: str) -> None:
    """rx_id, line and text: what made makes of said, which is of a dictation's columns."""
    rows = lambda s, d: once(S.dictation(s, d).select("rx_id", "line", said().alias("said")), ["said"], lambda each: each.withColumn("text", made(c("said"))))
    _add(name, rows, lambda: _id(text=c("text")), sql)


_mixed = "concat(text, ' Take eight and fifty, dollar six fifty met for men ', CAST({size} AS {S}), ' roz do baar khane ke baad lo, 5 din tak aur goli')"
_spoken = lambda: F.expr(_mixed.format(size="p_size", S="STRING"))
_msql = _mixed.format(size="p_size", S="VARCHAR")
_said_once("f07_normalize_asr", _spoken, Z.normalize_asr, f"SELECT rx_id, line, {sql_fold(_msql, R.HEARD)} AS text {D}")
_said_once("f08_normalize_hinglish", _spoken, Z.normalize_hinglish, f"SELECT rx_id, line, {sql_fold(_msql, R.HINGLISH)} AS text {D}")
_noisy = "concat('Hello doctor, how are you. Dr. Roy, yesterday 4:30 PM ', text, ' Thank you very much. BP is 120, ok. Apply ice packs to knee.')"
_said_once("f09_clean_noise", lambda: F.expr(_noisy), Z.clean_noise, f"SELECT rx_id, line, {sql_fold(f'trim({sql_fold(_noisy, [(R.SPEAKER, chr(46) + chr(32) + chr(84) + chr(97) + chr(107) + chr(101) + chr(32))])})', [(p, ' ') for p in R.NOISE])} AS text {D}")
_said_once("f10_normalize_numbers", lambda: F.expr("concat(text, '  1,', p_size, '  .5% and .25mg')"), Z.normalize_numbers, f"SELECT rx_id, line, concat(text, ' 1', CAST(p_size AS VARCHAR), ' 0.5 % and 0.25 mg') AS text {D}")
_said_once("f11_correct_punctuation", lambda: F.expr("concat(text, '  take ', p_name, ' daily and apply ', p_name, ' , if fever persists meet doctor')"), Z.correct_punctuation, f"SELECT rx_id, line, concat(text, ' Take ', p_name, ' daily. Apply ', p_name, '. If fever persists. Meet doctor.') AS text {D}")
_said_once("f12_normalize_text", lambda: c("text"), Z.normalize_text, f"SELECT rx_id, line, text {D}")
_said_once("f13_spell_correct", lambda: F.expr("concat('Parasitamol, ', text, ' sefixime; montelecast')"), Z.spell_correct, f"SELECT rx_id, line, concat('Paracetamol, ', text, ' cefixime; montelukast') AS text {D}")
_said_once("f14_clean_hallucinations", lambda: F.expr("concat('[music] ', text, ' go go go go Thank you for watching!')"), Z.clean_hallucinations, f"SELECT rx_id, line, concat(text, ' go') AS text {D}")
_said_once("f15_word_numbers", lambda: F.expr("concat('one tablet, half tab and Two drops of ', text)"), Z.word_numbers, f"SELECT rx_id, line, concat('1 tablet, 0.5 tab and 2 drops of ', text) AS text {D}")
_add("f39_instruction_noise", _dict, lambda: _id(text=T.clean_instruction_noise(F.expr("concat('thank you. ', case when line % 2 = 0 then text else '' end)"))), f"SELECT rx_id, line, CASE WHEN line % 2 = 0 THEN text ELSE 'NONE' END AS text {D}")
_add("p15_clean_segments", lambda s, d: S.dictation(s, d).select("rx_id", "line", F.filter(F.transform(F.split("text", " for "), Z.clean_hallucinations), lambda t: t != "").alias("segments")), lambda: _id(text=Z.clean_hallucinations(F.array_join("segments", " "))), f"SELECT rx_id, line, rtrim(replace(text, ' for ', ' '), '.') AS text {D}")

# schedules, keys, spans
_said = "CASE line % 4 WHEN 0 THEN 'twice daily 101' WHEN 1 THEN 'TID' WHEN 2 THEN 'once daily' ELSE 'every 8 hours' END"
_add("f16_canonical_frequency", _dict, lambda: _id(frequency=T.canonical_frequency(F.expr(_said))), f"SELECT rx_id, line, CASE line % 4 WHEN 0 THEN 'Twice a day (1-0-1)' WHEN 1 THEN 'Thrice a day (1-1-1)' WHEN 2 THEN 'Once a day (1-0-0)' ELSE 'every 8 hours' END AS frequency {D}")
_add("f17_normalize_schedule", _dict, lambda: _id(schedule=T.normalize_schedule(F.expr(_said))), f"SELECT rx_id, line, CASE line % 4 WHEN 0 THEN 'Twice a day (1-0-1)' WHEN 1 THEN 'Thrice a day (1-1-1)' WHEN 2 THEN 'Once a day (1-0-0)' ELSE 'every 8 hours' END AS schedule {D}")
_add("f21_cmp_key", _dict, lambda: _id(key=T.cmp_key(F.expr("concat(' ', upper(p_name), '-', p_size, '  MG')"))), f"SELECT rx_id, line, concat(p_name, ' ', CAST(p_size AS VARCHAR), ' mg') AS key {D}")
_add("f22_matches_expected", _dict, lambda: _id(key=T.eval_key(c("truth_frequency")), hit=T.matches_expected(c("text"), c("truth_strength"))), f"SELECT rx_id, line, trim(regexp_replace(regexp_replace(lower(truth_frequency), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key, true AS hit {D}")
_add("f23_find_span", _dict, lambda: _id(start=T.find_span(c("text"), F.upper("truth_strength"))["start"], verbatim=T.find_span(c("text"), F.upper("truth_strength"))["verbatim"]), f"SELECT rx_id, line, CAST(instr(text, truth_strength) - 1 AS INT) AS start, truth_strength AS verbatim {D}")
_add("f31_numbered_list", _dict, lambda: _id(text=T.numbered_list(F.split("p_name", " "))), f"SELECT rx_id, line, concat('1. ', split_part(p_name, ' ', 1), ' 2. ', split_part(p_name, ' ', 2)) AS text {D}")
_add("f32_prune_contained", _dict, lambda: _id(text=F.array_join(T.prune_contained(F.array(F.split("p_name", " ")[0], c("p_name"), F.upper("p_name"), lit("other"))), ",")), f"SELECT rx_id, line, 'other' AS text {D}")
_add("f33_align_overlap", _dict, lambda: _id(text=T.align_overlap(F.concat(lit("so "), F.upper("p_name")), F.concat(c("p_name"), lit(" for "), c("truth_duration")))), f"SELECT rx_id, line, concat('for ', truth_duration) AS text {D}")
_block = "concat('Drug_name: \"', p_name, '\" tablet\nstrength: ', truth_strength, '\nfrequency: ', truth_frequency, '\nroute: <oral|iv>\nDrug_name: ', p_name, ' tablet\nstrength: 1')"
_blocks = lambda s, d: once(S.dictation(s, d).select("rx_id", "line", "p_name", "truth_strength", "truth_frequency"), ["p_name", "truth_strength", "truth_frequency"], lambda each: each.withColumn("blocks", T.parse_blocks(F.expr(_block.replace('"', "").replace("\n", "\\n")))))
_add("f26_parse_blocks", _blocks, lambda: _id(n=F.size("blocks"), **{k: F.get("blocks", lit(0))[f] for k, f in (("name", "Drug_name"), ("strength", "strength"), ("route", "route"))}), f"SELECT rx_id, line, 1 AS n, p_name AS name, truth_strength AS strength, 'NONE' AS route {D}")
_one = lambda: F.array(F.struct(c("p_name").alias("Drug_name"), *[lit("NONE").alias(f) for f in T.BLOCK_FIELDS[1:]]))
_add("f27_attach_single_dose", _dict, lambda: _id(name=F.get(T.attach_single_dose(c("text"), _one()), lit(0))["Drug_name"]), f"SELECT rx_id, line, concat(p_name, ' ', truth_strength) AS name {D}")
_add("f28_extract_json", _dict, lambda: _id(name=F.try_variant_get(T.extract_json(F.expr("concat('Answer: ```json {\"name\": \"', p_name, '\"} ```')")), "$.name", "string")), f"SELECT rx_id, line, p_name AS name {D}")
_add("f29_format_block", _dict, lambda: _id(block=T.format_block(c("p_name"), c("truth_strength"), c("truth_frequency"), c("truth_duration"), lit(None).cast("string"), c("truth_instruction"), lit(None).cast("string"))), f"SELECT rx_id, line, concat('Drug_name: ', p_name, chr(10), 'strength: ', truth_strength, chr(10), 'frequency: ', truth_frequency, chr(10), 'duration: ', truth_duration, chr(10), 'route: NONE', chr(10), 'instruction: ', coalesce(truth_instruction, 'NONE'), chr(10), 'additional_instruction: NONE') AS block {D}")
_orders = lambda s, d: S.table(s, d, "orders")
_add("f37_safe_name", _orders, lambda: {"o_orderkey": c("o_orderkey"), "name": T.safe_name(F.concat(c("o_orderpriority"), lit(" no. "), c("o_orderstatus")))}, "SELECT o_orderkey, regexp_replace(concat(o_orderpriority, ' no. ', o_orderstatus), '[^A-Za-z0-9_-]', '_', 'g') AS name FROM orders")
_add("f38_date_time", _orders, lambda: {"o_orderkey": c("o_orderkey"), "date": T.display_date(c("o_orderdate")), "time": T.display_time(c("o_orderdate"))}, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%H:%M:%S') AS time FROM orders")

# predicates
_add("p01_empty_to_null", _dict, lambda: _id(value=T.clean_empty_to_null(F.expr("case line % 4 when 0 then ' n/a ' when 1 then '' when 2 then 'Unknown' else p_name end"))), f"SELECT rx_id, line, CASE WHEN line % 4 = 3 THEN p_name END AS value {D}")
_add("p02_placeholder", _dict, lambda: _id(hit=T.is_placeholder(F.expr("case line % 3 when 0 then concat('<', p_name, '>') when 1 then 'second dose or NONE' else p_name end"))), f"SELECT rx_id, line, line % 3 != 2 AS hit {D}")
_advice = "CASE line % 4 WHEN 0 THEN concat('Avoid ', p_name) WHEN 1 THEN 'also take walks' WHEN 2 THEN 'Return if worse' ELSE text END"
_add("p04_pure_advice", _dict, lambda: _id(hit=T.is_pure_advice(F.expr(_advice))), f"SELECT rx_id, line, line % 4 != 3 AS hit {D}")
_add("p05_med_indicator", _dict, lambda: _id(hit=T.has_med_indicator(F.expr(_advice)), none=T.has_med_indicator(lit("take rest"))), f"SELECT rx_id, line, line % 4 = 3 AS hit, false AS none {D}")
_add("p06_dose_or_schedule", _dict, lambda: _id(hit=T.has_dose_or_schedule(F.expr("case line % 2 when 0 then p_name else text end"))), f"SELECT rx_id, line, line % 2 = 1 AS hit {D}")
_open = "CASE line % 4 WHEN 0 THEN concat('take ', p_name, ' and') WHEN 1 THEN concat('take ', p_name, ' ', CAST(p_size AS {S})) WHEN 2 THEN concat(p_name, ' if fever') ELSE text END"
_add("p08_utterance_complete", _dict, lambda: _id(complete=T.is_utterance_complete(F.expr(_open.format(S="STRING")))), f"SELECT rx_id, line, line % 4 = 3 AS complete {D}")
_add("p11_ambiguous_frequency", _dict, lambda: _id(hit=T.ambiguous_frequency(F.expr("case line % 3 when 0 then 'once or twice daily' when 1 then 'not more than twice daily' else truth_frequency end"))), f"SELECT rx_id, line, line % 3 != 2 AS hit {D}")
_add("p12_contradictory_text", _dict, lambda: _id(hit=T.contradictory_text(F.expr("case when line % 2 = 0 then concat(text, ' twice daily and also once daily') else text end"))), f"SELECT rx_id, line, line % 2 = 0 AS hit {D}")
_add("p13_remove_commentary", _dict, lambda: _id(instruction=T.remove_commentary(F.concat(lit("Please note; "), F.coalesce("truth_instruction", lit(""))), c("text"))), f"SELECT rx_id, line, truth_instruction AS instruction {D}")
