"""Clauses to typed fields: medicine, strength and dose, frequency, duration, route, instructions; then whole prescriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..functions.normalize import normalize_text, word_numbers
from ..functions.text import canonical_frequency, find_span, first_pattern, has, let, prune_contained, substring_of
from ..storage import materialize
from . import clauses as S
from . import formulary as C
from . import lookup as L
from .once import KEY, once

NOT_FOUND = "Medicine not found"
# Doses.
DOSE = rf"(?i)\b((\d+(?:\.\d+)?)\s*(mg(?:/ml|/g)?|grams?|gm|g|mcg|µg|ml|l|iu|units?|%|meq|{R.COUNTED_FORMS})(?!\w))"
TITRATION = r"(?i)\b(?:increase|decrease|reduce|double|taper)\s+(?:the\s+)?(?:dose|dosage)\s+(?:by\s+)?\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml)?"
LEAD_DOSE = (
    r"(?i)\b\d+(?:\.\d+)?\s*(?:mg(?:/ml|/g)?|grams?|gm|g|mcg|µg|ml|l|iu|units?|%|meq|puffs?|drops?|tablets?|capsules?|sachets?|vials?)(?!\w)|"
    r"\b(?<!\w)(?!(?:101|111|100|010|001|110|011|1111)\b)\d{2,4}\b"
)
COMBINED = r"(?i)(\d+(?:\.\d+)?)\s*(mg|g|mcg|ml)?\s*(?:\+|\band\b|/)\s*(\d+(?:\.\d+)?)\s*(mg|g|mcg|ml)?"
UNTIMED = r"\b(\d+(?:\.\d+)?)\b(?!\s*(?:days?|weeks?|months?|hours?|hrs?|times))"
BY_VERB = (
    r"(?i)(?:take|administer|give|consume|dissolve|inhale|apply|put|instill|gently\s+massage|massage|cleanse)?\s*(?:one|two|three)?\s*(?:tablet|tab|capsule|cap|rotacap|pill|vial|sachet|puff)?\s*"
    r"(?:of\s+)?([A-Za-z0-9\-]+(?:\s+[A-Za-z0-9\-]+){0,3}?)\s*(?:tablet|capsule|oral\s+suspension|suspension|sachet|vial|cream|ointment|gel|drops|rotacap|puff|paste|wash|orally|topically|by\s+mouth|"
    r"before|after|twice|once|three|up\s+to|in\s+one\s+liter|every|onto|along|to\s+the|over|for|till|upto|until|daily|SOS|HS|STAT)\b"
)


def extract_frequency(clause: Column, full: Column) -> Column:
    """struct(value, raw, start, confidence): in the first 120 characters, in the clause, or said of all or of 'it'."""

    def found(c: Column, confidence: float, at: bool) -> Column:
        def pack(raw: Column) -> Column:
            start = F.when(F.lit(at), F.instr(clause, raw) - 1)
            return F.when(raw.isNotNull(), F.struct(canonical_frequency(raw).alias("value"), raw.alias("raw"), start.alias("start"), F.lit(confidence).alias("confidence")))

        return let(first_pattern(c, R.FREQUENCIES), pack)

    of = lambda pattern: F.nullif(F.trim(F.regexp_extract(full, pattern, 1)), F.lit(""))
    return F.coalesce(found(F.substring(clause, 1, 120), 0.95, True), found(clause, 0.90, True), found(of(R.PLURAL_FREQUENCY), 0.85, False), found(of(R.SINGULAR_FREQUENCY), 0.80, False))


def extract_duration(clause: Column, full: Column) -> Column:
    """struct(value, start, confidence)."""
    pack = lambda v, s, c: F.when(v.isNotNull(), F.struct(v.alias("value"), s.alias("start"), F.lit(c).alias("confidence")))

    def said(own: Column) -> Column:
        days = F.regexp_extract(own, r"(?i)^(\d+)\s+day$", 1)
        value = F.when((days != "") & (days.cast("int") > 1), F.concat(days, F.lit(" days"))).otherwise(own)
        return pack(value, F.instr(clause, own) - 1, 0.95)

    shared = F.nullif(F.trim(F.regexp_extract(full, R.PLURAL_DURATION, 1)), F.lit(""))
    return F.coalesce(let(F.trim(first_pattern(clause, R.DURATIONS, 1)), said), pack(shared, F.lit(None).cast("int"), 0.85))


def extract_route(clause: Column, formulary_routes: Column | None = None, policy: str = "stated") -> Column:
    """struct(value, source, confidence). policy "stated": null if the clause does not say; "formulary": the first route
    of the product, or oral."""
    low = F.lower(clause)
    contains = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    stated = F.lit(None).cast("string")
    oral = r"\b(?:" + "|".join(w.replace(" ", r"\s") for w in R.ORAL) + r")\b"
    stated = F.when(has(low, oral), "oral").otherwise(stated)
    stated = F.when(contains(R.RECTAL), "rectal").otherwise(stated)
    injected = contains(R.INJECTED) | low.rlike(r"\b(?:iv|im|sc)\b")
    stated = F.when(injected, F.when(low.contains("intramuscular") | low.rlike(r"\bim\b"), "intramuscular").otherwise("intravenous")).otherwise(stated)
    for route, words in reversed(R.ROUTES):
        stated = F.when(contains(words), route).otherwise(stated)
    pack = lambda v, s, c: F.struct(v.alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))
    if policy == "stated":
        return F.when(stated.isNotNull(), pack(stated, "stated", 0.95)).otherwise(pack(F.lit(None).cast("string"), "none", 0.0))
    routes = F.transform(F.coalesce(formulary_routes, F.array().cast("array<string>")), lambda r: F.lower(F.trim(r)))
    known = F.filter(routes, lambda r: r.isin("oral", "topical", "nasal", "inhalation", "ophthalmic", "otic", "intravenous", "intramuscular", "rectal", "sublingual"))
    return (
        F.when(stated.isNotNull(), pack(stated, "stated", 0.95))
        .when(F.size(known) > 0, pack(F.get(known, F.lit(0)), "formulary", 0.85))
        .when(F.size(routes) > 0, pack(F.get(routes, F.lit(0)), "formulary", 0.80))
        .otherwise(pack(F.lit("oral"), "default", 0.70))
    )


def _primary(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(c, p), F.lit(label)) if label else substring_of(c, p) for p, label in R.PRIMARY]))


def _additional(c: Column) -> Column:
    return F.array_compact(F.array(*[F.trim(substring_of(c, p)) for p in R.ADDITIONAL]))


def extract_instructions(clause: Column, advice: Column, full: Column) -> Column:
    """struct(primary, additional): labels or words joined by '; ', without those that another one contains."""
    none = F.array().cast("array<string>")
    advice = F.coalesce(advice, none)
    told = F.nullif(F.trim(F.regexp_extract(full, R.BROADCAST_INSTRUCTION, 0)), F.lit(""))
    # Each text goes through one copy of the patterns.
    primary = F.flatten(F.transform(F.array_compact(F.concat(F.array(clause), advice, F.array(told))), _primary))
    pattern = "|".join(R.ADDITIONAL)
    loose = F.filter(advice, lambda a: ~has(a, pattern) & (F.length(a) > 5))
    own = F.array_distinct(F.concat(F.flatten(F.transform(F.concat(F.array(clause), advice), _additional)), loose))
    additional = F.coalesce(F.nullif(own, none), F.flatten(F.transform(F.array(full), _additional)))
    join = lambda a: F.nullif(F.array_join(prune_contained(a), "; "), F.lit(""))
    return F.struct(join(primary).alias("primary"), join(additional).alias("additional"))


def _named(clauses: DataFrame, candidates: Column) -> DataFrame:
    """clauses and column candidates: those of an array of struct(step, name) that may be a medicine, in that order."""
    kept = F.filter(candidates, lambda c: c["name"].isNotNull() & (F.length(c["name"]) >= 2) & N.is_valid_medication(c["name"]))
    return clauses.withColumn("candidates", kept)


def first_candidates(clauses: DataFrame) -> DataFrame:
    """clauses and lead, candidates: the seed, what stands before the first dose, and what follows a verb."""
    lead = F.trim(F.split(F.col("clause"), LEAD_DOSE)[0])
    dosed = has(F.col("clause"), LEAD_DOSE)
    verb = F.nullif(F.trim(F.regexp_extract("clause", BY_VERB, 1)), F.lit(""))
    rung = lambda step, name: F.struct(F.lit(step).alias("step"), N.clean_candidate_name(name).alias("name"))
    rows = clauses.withColumn("lead", F.when(dosed, N.clean_candidate_name(lead)))
    return _named(rows, F.array(rung(1, F.col("seed")), F.struct(F.lit(2).alias("step"), F.col("lead").alias("name")), rung(3, verb)))


def word_candidates(clauses: DataFrame) -> DataFrame:
    """clauses and candidates: pairs of words, then words."""
    words = F.regexp_extract_all("clause", F.lit(r"([A-Za-z0-9\-]{3,})"), 1)
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    from_ = lambda names, step: F.transform(names, lambda n, i: F.struct((i + step).alias("step"), N.clean_candidate_name(n).alias("name")))
    return _named(clauses, F.concat(from_(pairs, 1000), from_(words, 2000)))


def _best_candidate(rows: DataFrame, cat: C.Catalogue, by: list[str]) -> DataFrame:
    """by and m: the first candidate that is in the catalogue. Distinct names are grounded once, whatever the number of
    clauses that say them."""
    tried = rows.select(*by, F.explode("candidates").alias("c")).select(*by, "c.step", F.col("c.name").alias("key"))
    grounded = L.ground_medicine(tried.select("key"), cat).join(cat.products.select("drug_id", "drug_name").hint("merge"), "drug_id")  # larger than its files
    best = tried.join(grounded, "key").groupBy(*by).agg(F.min(F.struct("step", "key", "drug_id", "confidence", "suggested", "drug_name")).alias("m"))
    return materialize(best, "grounded")


def extract_medicine(clauses: DataFrame, cat: C.Catalogue) -> DataFrame:
    """clauses and medicine, drug_id, did_you_mean, med_confidence. Equal clauses are looked up once."""
    return once(clauses, ["clause", "seed"], lambda each: _medicine(each, cat))


def _medicine(each: DataFrame, cat: C.Catalogue) -> DataFrame:
    """As extract_medicine, of distinct (clause, seed).

    Only clauses without a hit, and without a lead before a dose, are taken apart into words.
    """
    by = ["__n"]  # written with the rows, so that it stays as it is
    rows = materialize(first_candidates(each).withColumn("__n", F.monotonically_increasing_id()), "candidates")
    best = _best_candidate(rows, cat, by)
    # A lead before a dose that is no name of the catalogue is not passed over for later words.
    lead_ok = F.coalesce(N.is_valid_medication(F.col("lead")) & (F.length("lead") >= 3), F.lit(False))
    open_ = rows.where(~lead_ok).join(best, by, "left_anti").select(*by, "clause")
    if not open_.isEmpty():
        best = best.unionByName(_best_candidate(materialize(word_candidates(open_), "candidates"), cat, by))
    out = rows.join(best, by, "left")
    missed = lead_ok & (F.col("m").isNull() | (F.col("m.step") > 2))
    return out.select(
        KEY, F.when(missed, NOT_FOUND).otherwise(F.col("m.key")).alias("medicine"), F.when(~missed, F.col("m.drug_id")).alias("drug_id"),
        F.when(~missed & F.col("m.suggested"), F.col("m.drug_name")).alias("did_you_mean"), F.when(missed, 0.20).otherwise(F.coalesce("m.confidence", F.lit(0.0))).alias("med_confidence"),
    )


def doses_of(clause: Column) -> Column:
    """array of struct(text, number, unit, count): doses in order, without those that a titration names."""
    text = word_numbers(clause)
    kept = F.regexp_replace(text, TITRATION, " ")
    every = F.regexp_extract_all(kept, F.lit(DOSE), 1)
    unit = lambda d: F.regexp_extract(d, DOSE, 3)
    return F.transform(every, lambda d: F.struct(d.alias("text"), F.regexp_extract(d, DOSE, 2).alias("number"), unit(d).alias("unit"), has(unit(d), rf"^(?:{R.COUNTED_FORMS})$").alias("count")))


def extract_strength(clauses: DataFrame, cat: C.Catalogue, by: list[str], said: DataFrame | None = None) -> DataFrame:
    """clauses (with medicine, drug_id) and full_name, strength, dose, dose_unit, composite_id. said: the products of the clauses, where they are at hand.

    "a + b" that is a product's sum: both as the strength, no dose. Two doses or more: the first names the product and
    the last is the dose, unless they are alternatives. One dose: the product's, if the catalogue has the number under
    the name, else the dose. Counts (tablets, drops) give the dose alone. Else a number in the name, or behind it.
    """
    base = F.upper(F.col("medicine"))
    keys = cat.bases.unionByName(cat.index.where("kind = 'brand'").select(F.col("key").alias("base_key"), "drug_id", "ord"))
    entries = keys.join(cat.products.select("drug_id", "drug_name", "brand_name", "strength_values").hint("merge"), "drug_id")  # larger than its files
    numbers = F.concat("strength_values", F.regexp_extract_all(F.regexp_replace(F.concat_ws(" ", "drug_name", "brand_name"), r"\(.*?\)", ""), F.lit(r"(\d+(?:\.\d+)?)"), 1))
    # outer, as a base without a number must not fall back on its first word
    known = entries.select("base_key", F.explode_outer(numbers).alias("number")).groupBy("base_key").agg(F.collect_set("number").alias("numbers"))
    rows = clauses.withColumn("__first", F.split(base, r"\s+")[0])
    by_base = known.select(F.col("base_key").alias("__b"), F.col("numbers").alias("__nb"))
    by_first = known.select(F.col("base_key").alias("__f"), F.col("numbers").alias("__nf"))
    own = (cat.products if said is None else said).select(F.col("drug_id").alias("__id"), F.col("strength_values").alias("__ni"))
    rows = rows.join(by_base, base == F.col("__b"), "left").join(by_first, F.col("__first") == F.col("__f"), "left").join(own, F.col("drug_id") == F.col("__id"), "left")
    rows = rows.withColumn("__numbers", F.coalesce("__nb", "__nf", "__ni", F.array().cast("array<string>"))).withColumn("__doses", doses_of(F.col("clause")))
    text = word_numbers(F.col("clause"))
    ca, cb = F.regexp_extract(text, COMBINED, 1), F.regexp_extract(text, COMBINED, 3)
    unit = F.coalesce(F.nullif(F.regexp_extract(text, COMBINED, 4), F.lit("")), F.nullif(F.regexp_extract(text, COMBINED, 2), F.lit("")), F.lit("mg"))
    rows = rows.withColumn("__a", F.nullif(ca, F.lit("")).cast("double")).withColumn("__b2", F.nullif(cb, F.lit("")).cast("double")).withColumn("__cu", unit)
    asked = rows.where(F.col("__a").isNotNull() & F.col("__b2").isNotNull() & F.col("medicine").isNotNull()).select(F.col("medicine").alias("key"), F.col("__a").alias("a"), F.col("__b2").alias("b"))
    if asked.isEmpty():  # a plan for the sums takes longer than most extractions
        asked = asked.sparkSession.createDataFrame([], asked.schema)
        sums = asked.select("key", "a", "b", F.lit(None).cast("string").alias("drug_id"))
    else:
        sums = L.find_composite(asked, cat)
    sums = sums.select(F.col("key").alias("__k"), F.col("a").alias("__sa"), F.col("b").alias("__sb"), F.col("drug_id").alias("composite_id"))
    rows = rows.join(sums, (F.col("medicine") == F.col("__k")) & (F.col("__a") == F.col("__sa")) & (F.col("__b2") == F.col("__sb")), "left")
    substances = F.filter("__doses", lambda d: ~d["count"])
    counts = F.filter("__doses", lambda d: d["count"])
    first, last, counted = F.get(substances, F.lit(0)), F.get(substances, F.size(substances) - 1), F.get(counts, F.lit(0))
    either = has(text, r"\b\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml)?\s+or\s+\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml)?\b")
    in_name = F.regexp_extract("medicine", r"\b(\d+(?:\.\d+)?)\b", 1)
    loose = F.filter(F.regexp_extract_all(text, F.lit(UNTIMED), 1), lambda v: ~(v.rlike("^[01]{3,4}$") & has(text, "daily|day|twice|once|thrice")))
    bare = F.get(loose, F.lit(0))
    has_number = lambda n: F.array_contains("__numbers", n)
    name = F.col("medicine")
    named = lambda n, t: F.when(~F.contains(name, n), F.concat_ws(" ", name, t)).otherwise(name)
    null = F.lit(None).cast("string")
    pack = lambda full, strength, dose, u: F.struct(full.alias("full_name"), strength.alias("strength"), dose.alias("dose"), u.alias("unit"))
    whole = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    value = (
        F.when(F.col("composite_id").isNotNull(), pack(name, F.concat(whole(F.col("__a")), F.lit(" + "), whole(F.col("__b2")), F.lit(" "), F.col("__cu")), null, null))
        .when((F.size(substances) >= 2) & either, pack(name, first["text"], null, null))
        .when(F.size(substances) >= 2, pack(named(first["number"], first["text"]), last["text"], last["number"], last["unit"]))
        .when((F.size(substances) == 1) & has_number(first["number"]), pack(named(first["number"], first["text"]), first["text"], null, null))
        .when(F.size(substances) == 1, pack(name, first["text"], first["number"], first["unit"]))
        .when(F.size(counts) >= 1, pack(name, null, counted["number"], counted["unit"]))
        .when(in_name != "", pack(name, in_name, null, null))
        .when(bare.isNotNull() & has_number(bare), pack(named(bare, bare), bare, null, null))
        .when(bare.isNotNull(), pack(name, bare, bare, null))
        .otherwise(pack(name, null, null, null))
    )
    rows = rows.withColumn("__v", value)
    full = F.when(name == NOT_FOUND, name).otherwise(N.clean_full_name(F.col("__v.full_name")))
    return rows.select(*clauses.columns, full.alias("full_name"), F.col("__v.strength").alias("strength"), F.col("__v.dose").alias("dose"), F.col("__v.unit").alias("dose_unit"), "composite_id")


def fold_orphans(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Clauses without a medicine give their duration, instructions and doubts to the last clause before them that has
    one; those before any are dropped."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("__island", F.count("medicine").over(w)).where("__island > 0")
    own, orphan = F.col("medicine").isNotNull(), F.col("medicine").isNull()
    first = lambda c: F.min_by(c, order)
    keep = [c for c in rows.columns if c not in (*by, "__island", "duration", "frequency", "instruction", "additional_instruction", "confidence")]
    lists = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c])
    joined = lambda c: F.nullif(F.array_join(F.array_distinct(lists(c)), "; "), F.lit(""))
    strays = F.collect_list(F.when(orphan, F.lower("frequency")))
    out = rows.groupBy(*by, "__island").agg(
        *[first(c).alias(c) for c in keep], first("frequency").alias("frequency"), strays.alias("__strays"),
        F.min_by("duration", F.when(F.col("duration").isNotNull(), F.col(order))).alias("duration"), joined("instruction").alias("instruction"),
        joined("additional_instruction").alias("additional_instruction"), F.max(F.when(own, F.col("confidence"))).alias("confidence"),
    )
    clash = F.exists("__strays", lambda f: ~F.contains(F.lower("frequency"), f))
    out = out.withColumn("confidence", F.when(F.coalesce(clash, F.lit(False)), F.least("confidence", F.lit(0.60))).otherwise(F.col("confidence")))
    return out.drop("__island", "__strays")


def dedup_candidates(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Repeats of (first word, strength, frequency, duration) within by become the first one, instructions joined."""
    key = [*by, F.upper(F.split("full_name", r"\s+")[0]).alias("__word"), "strength", "frequency", "duration"]
    keep = [c for c in rows.columns if c not in (*by, "strength", "frequency", "duration", "instruction", "additional_instruction")]
    lists = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c])
    joined = lambda c: F.nullif(F.array_join(F.array_distinct(lists(c)), "; "), F.lit("")).alias(c)
    out = rows.groupBy(*key).agg(*[F.min_by(c, order).alias(c) for c in keep], joined("instruction"), joined("additional_instruction"))
    return out.drop("__word").select(*rows.columns)


def evidence(raw: Column, fields: dict[str, Column]) -> Column:
    """map<field, struct<start, end, verbatim>> of the fields whose value stands in the raw text."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), find_span(raw, c).alias("value")) for k, c in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def extract_fields(clauses: DataFrame, raw: str = "raw_text", policy: str = "stated") -> DataFrame:
    """clauses and the fields that need no catalogue."""
    clause, full = F.col("clause"), F.col(raw)
    rows = clauses.withColumn("__f", extract_frequency(clause, full)).withColumn("__d", extract_duration(clause, full)).withColumn("__i", extract_instructions(clause, F.col("advice"), full))
    return rows.select(
        *clauses.columns, F.col("__f.value").alias("frequency"), F.col("__f.raw").alias("frequency_raw"), F.col("__d.value").alias("duration"),
        F.col("__i.primary").alias("instruction"), F.col("__i.additional").alias("additional_instruction"),
    )


_ITEM = (
    "rx_id", "item_no", "medicine", "drug_id", "strength", "dose", "dose_unit", "frequency", "duration", "route", "instruction", "additional_instruction",
    "did_you_mean", "available_routes", "composite_id", "confidence", "raw_text", "norm_text",
)


def extract(transcripts: DataFrame, cat: C.Catalogue, policy: str = "stated") -> DataFrame:
    """rx_id, text -> one row an item: rx_id, item_no, medicine, drug_id, strength, dose, dose_unit, frequency, duration,
    route, instruction, additional_instruction, did_you_mean, available_routes, confidence, raw_text. Equal texts are worked on once."""
    rows = transcripts.select("rx_id", F.col("text").alias("raw_text"))
    return once(rows, ["raw_text"], lambda each: _items(each.withColumn("norm_text", normalize_text(F.col("raw_text"))), cat, policy, "norm_text")).select(*_ITEM)


def extract_normalized(rows: DataFrame, cat: C.Catalogue, policy: str = "stated") -> DataFrame:
    """As extract, of rx_id, raw_text, norm_text."""
    return once(rows.select("rx_id", "raw_text", "norm_text"), ["raw_text", "norm_text"], lambda each: _items(each, cat, policy)).select(*_ITEM)


def _items(texts: DataFrame, cat: C.Catalogue, policy: str, *kept: str) -> DataFrame:
    """The items of distinct (raw_text, norm_text) by KEY, without texts but those kept: the steps from clause to item carry none."""
    rows = texts.withColumnRenamed(KEY, "rx_id")
    made = materialize(extract_fields(S.segment_distinct(rows, "norm_text").drop("start_char", "end_char"), policy=policy), "clauses")
    rows = made.drop("raw_text", "norm_text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # joins put small rows together, but what follows is large against their size
    rows = extract_medicine(rows, cat).repartition(parts, F.xxhash64("rx_id", "clause_id"))
    # The products that are said, of known size: the whole catalogue would be broadcast by the size of its files.
    said = materialize(cat.products.join(rows.select("drug_id").distinct().hint("merge"), "drug_id", "left_semi"), "said-products")
    rows = extract_strength(rows, cat, ["rx_id", "clause_id"], said)
    rows = rows.withColumn("medicine", F.col("full_name")).withColumn("confidence", F.col("med_confidence"))
    routes = said.select("drug_id", F.col("routes").alias("available_routes"))
    rows = rows.join(routes, "drug_id", "left").withColumn("route", extract_route(F.col("clause"), F.col("available_routes"), policy)["value"])
    rows = dedup_candidates(fold_orphans(rows, ["rx_id"], "clause_id"), ["rx_id"], "clause_id")
    number = F.row_number().over(Window.partitionBy("rx_id").orderBy("clause_id"))
    rows = rows.withColumn("item_no", number).select(F.col("rx_id").alias(KEY), *[c for c in _ITEM[1:] if c not in ("raw_text", "norm_text")])
    return rows.join(made.where("clause_id = 1").select(F.col("rx_id").alias(KEY), *kept), KEY) if kept else rows
