"""Grounding checks of items against their text and the catalogue: per item, and as one row a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import ambiguous_frequency, contradictory_text, remove_commentary, removed_commentary
from ..storage import materialize
from . import formulary as C
from . import lookup as L
from .extract import NOT_FOUND


def recognized(items: DataFrame, cat: C.Catalogue, min_confidence: float = 0.68) -> DataFrame:
    """items and columns recognized: the name or its first word is in the catalogue, or sounds like it; and is_medication: the name
    may be a medicine. Names are worked on once each; their tables are of known size, so that items stay where they are if names are few."""
    first = F.split("medicine", r"\s+")[0]
    asked = materialize(items.select("medicine").distinct(), "recognized-asked")
    keys = asked.select(F.col("medicine"), F.explode(F.array("medicine", first)).alias("key"))
    names = materialize(L.resolve(keys, cat).select("key"), "recognized-names")
    near = L.find_fuzzy(keys.join(names, "key", "left_anti"), cat, min_confidence, 1).select("key")
    known = keys.join(names.unionByName(near).distinct(), "key", "left_semi").select("medicine").distinct().withColumn("recognized", F.lit(True))
    known = asked.join(known, "medicine", "left").select("medicine", F.coalesce("recognized", F.lit(False)).alias("recognized"), N.is_valid_medication(F.col("medicine")).alias("is_medication"))
    rows = items.drop("recognized", "is_medication").join(materialize(known, "recognized", asked), "medicine", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("recognized", "is_medication")})


def _said(words: Column, text: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def _heard(words: Column, text: Column) -> Column:
    """Some word sounds like a word of the text."""
    heard = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), 1)), N.phonetic_backbone)
    return F.exists(words, lambda w: (N.phonetic_backbone(w) != "") & F.array_contains(heard, N.phonetic_backbone(w)))


def _missing_numbers(value: Column, text: Column) -> Column:
    plain = F.regexp_replace(text, ",", "")
    numbers = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    return F.filter(numbers, lambda n: ~F.contains(text, n) & ~F.contains(plain, n))


def validate_items(items: DataFrame, raw: str = "raw_text", norm: str = "norm_text") -> DataFrame:
    """items (with recognized, did_you_mean, status, conflicts, review_reasons) and errors, warnings, is_valid,
    item_status, val_status; review_reasons grows, instruction loses foreign comment. A column is_medication, as recognized gives it,
    is taken as the check of the name, and goes."""
    text = F.concat_ws(" ", F.col(raw), F.col(norm))
    name, found = F.col("medicine"), F.col("medicine") != NOT_FOUND
    words = N.core_words(name)
    medication = F.col("is_medication") if "is_medication" in items.columns else N.is_valid_medication(name)
    unsaid = F.col("did_you_mean").isNull() & found & (F.size(words) > 0) & ~_said(words, text) & ~_heard(words, text)
    error = lambda when, *message: F.when(when, F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]))
    errors = F.array_compact(F.concat(
        F.array(
            error(found & ~medication, "Entity '", name, "' is not a valid pharmaceutical entity."),
            error(found & ~F.col("recognized") & F.col("did_you_mean").isNull(), "Medicine '", name, "' is not recognized in the master formulary."),
            error(unsaid, "Drug name '", name, "' was not found in the text."),
        ),
        F.transform(F.when(found, _missing_numbers(name, text)).otherwise(F.array().cast("array<string>")), lambda n: F.concat(F.lit("Dose number '"), n, F.lit("' in the name was not found in the text."))),
        F.transform(_missing_numbers(F.col("strength"), text), lambda n: F.concat(F.lit("Strength '"), F.col("strength"), F.lit("' was not found in the text."))),
    ))
    reasons = F.array_compact(F.array(
        F.when(ambiguous_frequency(F.col("frequency")), F.concat(F.lit("Ambiguous or contradictory frequency '"), F.col("frequency"), F.lit("' requires review."))),
        F.when(contradictory_text(F.lower(F.col(raw))), F.lit("The text has contradictory or alternative directives.")),
        F.when(~found, F.lit("Medicine not recognized in the master formulary.")),
    ))
    foreign = F.coalesce(removed_commentary(F.col("instruction"), F.col(raw)), F.array().cast("array<string>"))
    rows = items.withColumn("errors", errors).withColumn("__new", reasons).drop("is_medication")
    rows = rows.withColumn("warnings", F.concat("__new", F.transform(foreign, lambda c: F.concat(F.lit("Removed unsolicited commentary '"), c, F.lit("'.")))))
    rows = rows.withColumn("instruction", remove_commentary(F.col("instruction"), F.col(raw)))
    conflicts = F.transform("conflicts", lambda c: F.concat(F.lit("Extraction conflict: "), c))
    rows = rows.withColumn("review_reasons", F.array_distinct(F.concat("review_reasons", "__new", conflicts))).drop("__new")
    bad, conflict = F.size("errors") > 0, F.col("status") == "CONFLICT"
    review = (F.size("review_reasons") > 0) | (F.size("conflicts") > 0)
    return rows.withColumn("is_valid", ~bad).withColumn(
        "item_status", F.when(bad, "ERROR").when(conflict, "CONFLICT").when(review, "NEEDS_REVIEW").otherwise("VALIDATED")
    ).withColumn("val_status", F.when(bad, "ERROR").when(conflict | review, "NEEDS_REVIEW").otherwise("VALIDATED"))


def validate_findings(items: DataFrame, raw: str = "raw_text", norm: str = "norm_text") -> DataFrame:
    """rx_id, item_no, field_name, rule_id, severity, passed, rejected_value: one row a check of an item."""
    text = F.concat_ws(" ", F.col(raw), F.col(norm))
    name, found = F.col("medicine"), F.col("medicine") != NOT_FOUND
    words = N.core_words(name)
    said = (F.size(words) == 0) | F.col("did_you_mean").isNotNull() | _said(words, text) | _heard(words, text)
    foreign = F.coalesce(F.size(removed_commentary(F.col("instruction"), F.col(raw))), F.lit(0)) > 0
    check = lambda field, rule, severity, applies, passed, value: F.when(applies, F.struct(
        F.lit(field).alias("field_name"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), passed.alias("passed"), F.when(~passed, value).alias("rejected_value"),
    ))
    checks = F.array_compact(F.array(
        check("medicine_name", "RULE_PHARMACEUTICAL_ENTITY", "ERROR", found, N.is_valid_medication(name), name),
        check("medicine_name", "RULE_GROUNDED_DRUG_NAME", "ERROR", found, said, name),
        check("strength", "RULE_GROUNDED_STRENGTH", "ERROR", F.col("strength").isNotNull(), F.size(_missing_numbers(F.col("strength"), text)) == 0, F.col("strength")),
        check("instruction", "RULE_ANTI_HALLUCINATION_COMMENTARY", "WARNING", F.col("instruction").isNotNull(), ~foreign, F.col("instruction")),
    ))
    return items.select("rx_id", "item_no", F.explode(checks).alias("c")).select("rx_id", "item_no", "c.*")


def grounding_score(findings: DataFrame) -> DataFrame:
    """rx_id, checks, passed, grounding_score."""
    counts = findings.groupBy("rx_id").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"))
    return counts.withColumn("grounding_score", F.round(F.col("passed") / F.greatest(F.lit(1), F.col("checks")), 2))


def validate_blocks(blocks: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Seven-column blocks and feedback (map field -> message), verdict VALID or NEEDS_CORRECTION, in one pass."""
    low = F.lower(F.col(raw))
    lost = lambda field: (F.col(field) != "NONE") & (F.size(_missing_numbers(F.col(field), F.col(raw))) > 0)
    words = N.core_words(F.col("Drug_name"))
    entry = lambda when, field, message: F.when(when, F.struct(F.lit(field).alias("key"), F.lit(message).alias("value")))
    found = F.array_compact(F.array(
        entry(~N.is_valid_medication(F.col("Drug_name")), "Drug_name", "is no medicine"),
        entry(N.is_valid_medication(F.col("Drug_name")) & (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(low, F.lower(w))), "Drug_name_text", "is not in the text"),
        entry(lost("strength"), "strength", "has a number that the text lacks"), entry(lost("duration"), "duration", "has a number that the text lacks"),
    ))
    return blocks.withColumn("feedback", F.map_from_entries(found)).withColumn("verdict", F.when(F.size(found) > 0, "NEEDS_CORRECTION").otherwise("VALID"))


def drop_non_medication(items: DataFrame) -> DataFrame:
    """Items whose name may be a medicine; the only item of a prescription stays anyway."""
    alone = F.count("*").over(Window.partitionBy("rx_id")) == 1
    return items.withColumn("__alone", alone).where(N.is_valid_medication(F.col("medicine")) | F.col("__alone")).drop("__alone")
