"""Drug-name columns: cleaning, phonetic keys, strengths and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import has, replace, squeeze


def clean_base_name(name: Column) -> Column:
    """Upper-cased name without forms, doses and symbols; hyphens stay."""
    c = F.upper(F.coalesce(name, F.lit("")))
    c = F.regexp_replace(c, r"\b\d+['`]S\b", "")
    c = F.regexp_replace(c, r"\b(?:" + "|".join(R.FORM_WORDS) + r")(?!\w)", "")
    c = F.regexp_replace(c, r"\b\d+(?:\.\d+)?\s*(?:MG|G|MCG|ML|L|IU|%|GM)?(?!\w)", "")
    return squeeze(F.regexp_replace(c, r"[^\w\s-]", ""))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def soundex_ph(name: Column) -> Column:
    """Four characters; ph counts as f, and vowels, h and w part equal codes."""
    c = _letters(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "ph", "f"))
    codes = F.translate(c, "bfpvcgjkqsxzdtlmnraeiouyhw", "11112222222233455600000000")
    runs = F.regexp_replace(codes, r"(\d)\1+", "$1")
    # The first letter stands for its own code, so the run that it opens is left out; a vowel has no code.
    rest = F.regexp_replace(F.substring(runs, 2, 1 << 20), "0", "")
    code = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(F.concat(rest, F.lit("000")), 1, 3))
    return F.when(c == "", "").otherwise(code)


def phonetic_backbone(name: Column) -> Column:
    """Consonant classes P K T S L R M N; equal neighbours count once, other letters part them."""
    c = _letters(name)
    for a, b in (("ph", "f"), ("ck", "k"), ("th", "t"), ("sh", "s"), ("c(?=[eiy])", "s")):
        c = F.regexp_replace(c, a, b)
    c = F.translate(c, "bpvfwckqgjdtszxlrmnaeiouyh", "PPPPPKKKKKTTSSSLRMN0000000")
    return F.regexp_replace(F.regexp_replace(c, r"(.)\1+", "$1"), "0", "")


def levenshtein_ph(a: Column, b: Column) -> Column:
    """Edit distance with ph as f."""
    f = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "ph", "f")
    return F.levenshtein(f(a), f(b))


def extract_strengths(name: Column, code: Column) -> Column:
    """Distinct numbers in a product's name and code, and its percentages."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    named = F.regexp_extract_all(upper, F.lit(r"(\d+(?:\.\d+)?)\s*(?:MG|G|MCG|ML|L|IU|%|GM|TAB|TABS|CAP|CAPS)?(?!\w)"), 1)
    coded = F.regexp_extract_all(F.upper(F.coalesce(code, F.lit(""))), F.lit(r"(\d+(?:\.\d+)?)\b"), 1)
    shares = F.regexp_extract_all(upper, F.lit(r"(\d+(?:\.\d+)?%)"), 1)
    return sort_strengths(F.array_distinct(F.concat(named, coded, shares)))


def dosage_form(name: Column) -> Column:
    return F.regexp_substr(F.upper(name), F.lit(r"\b(" + "|".join(R.DOSAGE_FORMS) + r")\b"))


def sort_strengths(values: Column) -> Column:
    """By number, then text; what is no number comes last."""
    key = F.transform(
        values,
        lambda s: F.struct(F.when(s.rlike(r"^\d+(\.\d+)?$"), s.cast("double")).otherwise(F.lit(999999.0)).alias("n"), s.alias("s")),
    )
    return F.transform(F.array_sort(key), lambda k: k["s"])


def clean_candidate_name(name: Column) -> Column:
    """Spoken name without forms, leading verbs, counts and articles."""
    c = F.trim(F.regexp_replace(name, R.FORM_NOUN, ""))
    c = F.trim(F.regexp_replace(c, R.LEADING_WORDS, ""))
    c = F.trim(F.regexp_replace(c, r"(?i)\b(?:of|one|vial|sachet|combination)\b", ""))
    c = F.regexp_replace(c, r"[\s,;\-]+$", "")
    return squeeze(c)


def clean_full_name(name: Column) -> Column:
    c = replace(name, r"^(?:(?:take|administer|give|prescribe|start)\s+)?(?:(?:\d+|one|two|three)\s+)?(?:(?:of|an?|the)\s+)?", "")
    c = replace(F.trim(c), r"\s+(?:orally|topically|by\s+mouth|inhale|apply|combination)$", "")
    return squeeze(F.regexp_replace(F.trim(c), r"[\s,;\-]+(?=\s+\d)", ""))


def number_in_name(name: Column, number: Column) -> Column:
    """The number stands in the name outside parentheses and is no part of a longer number."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", ""), F.lit(" "))
    quoted = F.regexp_replace(number, r"\.", r"\\\\.")
    return F.coalesce(F.regexp_like(plain, F.concat(F.lit(r"(?<!\d)"), quoted, F.lit(r"(?!\d)"))), F.lit(False)) & (F.coalesce(number, F.lit("")) != "")


def core_words(name: Column) -> Column:
    words = F.regexp_extract_all(name, F.lit(r"([A-Za-z0-9\-]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*R.CORE_STOP))


def is_valid_medication(name: Column) -> Column:
    """The name may be a medicine: it is no other entity, and some word of it says more than filler."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9\-]+)"), 1)
    telling = F.filter(words, lambda w: ~w.isin(*R.FILLER_WORDS, *R.NOT_MEDICINE))
    part = has(low, "|".join(R.NOT_MEDICINE_PARTS)) & ~has(low, r"\d\s*(?:mg|mcg|ml|iu|%|g)")
    return ~low.isin("", "none", "null", "n/a", "unknown") & ~low.isin(*R.NOT_MEDICINE) & ~part & (F.size(telling) > 0)


def split_dose(strength: Column, name: Column) -> Column:
    """struct(dose, unit) from the strength, or from the name where there is none; 'NONE' if unknown."""
    own = F.trim(strength)
    known = own.isNotNull() & (own != "") & (own != "NONE")
    numeric = F.regexp_extract(own, r"^(\d+(?:\.\d+)?)\s*(.*)$", 1)
    unit = F.trim(F.regexp_extract(own, r"^(\d+(?:\.\d+)?)\s*(.*)$", 2))
    named = r"(?i)\b(\d+(?:\.\d+)?)\s*(mg|g|mcg|ml|l|iu|drops|tablets?|capsules?|puffs?|units?|%)"
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("NONE"))
    dose = F.when(known, F.when(numeric != "", numeric).otherwise(own)).otherwise(none(F.regexp_extract(name, named, 1)))
    of = F.when(known, none(unit)).otherwise(none(F.lower(F.regexp_extract(name, named, 2))))
    return F.struct(dose.alias("dose"), of.alias("unit"))
