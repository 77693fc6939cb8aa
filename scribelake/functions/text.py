"""Text columns: replacement chains, keys, spans, blocks and display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def replace(c: Column, pattern: str, by: str) -> Column:
    """Case aside."""
    return F.regexp_replace(c, pattern if pattern.startswith("(?i)") else "(?i)" + pattern, by)


def replace_all(c: Column, rules) -> Column:
    return reduce(lambda out, rule: replace(out, *rule), rules, c)


def has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern if pattern.startswith("(?i)") else "(?i)" + pattern)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def substring_of(c: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.regexp_substr(c, F.lit(pattern if pattern.startswith("(?i)") else "(?i)" + pattern))


def match_spans(c: Column, pattern: str) -> Column:
    """array<struct(start, end, text)> of all matches in order, case aside; start and end count characters from 0. The pattern
    must not match ''."""
    pattern = pattern if pattern.startswith("(?i)") else "(?i)" + pattern

    def place(between: Column, done: Column, text: Column) -> Column:
        start = done["end"] + F.length(F.get(between, F.size(done["spans"])))
        end = start + F.length(text)
        return F.struct(end.alias("end"), F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), text.alias("text")))).alias("spans"))

    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))
    spans = lambda between: F.aggregate(F.regexp_extract_all(c, F.lit(pattern), 0), none, lambda done, text: place(between, done, text), lambda done: done["spans"])
    return let(F.split(c, pattern, -1), spans)  # one part more than matches; without let, the text would be split for every match


def distinct_case(values: Column) -> Column:
    """The first of values that are equal case aside, in order."""
    # In lambdas, as the inner one evaluates for every value whatever it names that is no variable.
    first = lambda own, low: F.filter(own, lambda v, i: F.array_position(low, F.get(low, i)) == i + 1)
    return let(values, lambda own: let(F.transform(own, F.lower), lambda low: first(own, low)))


def any_of(c: Column, words) -> Column:
    """c contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def let(c: Column, f) -> Column:
    """f of c, with c evaluated once however often f names it."""
    return F.transform(F.array(c), f)[0]


def first_pattern(c: Column, patterns, group: int = 0) -> Column:
    """The match of the first pattern, in their order, that matches anywhere; null if none does."""
    if group == 0:
        return F.coalesce(*[F.regexp_substr(c, F.lit(p)) for p in patterns])
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def clean_empty_to_null(c: Column) -> Column:
    return F.when((F.trim(c) == "") | F.upper(F.trim(c)).isin(*R.PLACEHOLDERS), None).otherwise(c)


def is_placeholder(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    # What templates left in answers look like.
    signs = (
        "<exact drug name", "<second dose", "<verbatim", "<oral|", "<instruction", "primary dose>", "second dose or none", "verbatim frequency", "verbatim duration", "<drug name>",
    )
    return reduce(lambda a, b: a | b, [low.contains(s) for s in signs], low.rlike("^<.*>$"))


def is_pure_advice(c: Column) -> Column:
    return has(F.trim(c), "|".join(R.ADVICE))


def has_med_indicator(c: Column) -> Column:
    return has(c, R.MEDICATION_CUE)


def has_dose_or_schedule(c: Column) -> Column:
    return has(c, R.DOSE_OR_SCHEDULE)


def is_utterance_complete(c: Column) -> Column:
    """The text can stand as a sentence: it ends in a stop, or in no word, number or condition that wants more."""
    t = F.trim(F.coalesce(c, F.lit("")))
    # Words that a sentence does not end with.
    open_words = (
        "for|with|after|before|and|then|strictly|avoid|take|give|plus|or|at|to|in|on|if|when|whenever|in\\s+case|of|the|a|an|is|are|was|were|be|been|being|as|also|start|stop|do|does|did|not|no|so|"
        "because|although|unless"
    )
    condition = r"(?i)\b(?:if|in\s+case\s+(?:of\s+)?|whenever|when)\s+([^,;\n.]+)$"
    clause = F.trim(F.regexp_extract(t, condition, 1))
    return (
        F.when(~t.rlike("[a-zA-Z0-9]{2,}"), False)
        .when(t.rlike(r"[.!?\n]$"), True)
        .when(has(t, rf"\b(?:{open_words})\s*$"), False)
        .when(t.rlike(r"\b\d+(?:\.\d+)?\s*$"), False)
        .when(t.rlike(condition) & (F.size(F.split(clause, r"\s+")) < 3), False)
        .otherwise(True)
    )


def ambiguous_frequency(c: Column) -> Column:
    return F.coalesce(has(c, "|".join(R.AMBIGUOUS)), F.lit(False))


def contradictory_text(c: Column) -> Column:
    return F.coalesce(has(c, "|".join(R.CONTRADICTORY)), F.lit(False))


def removed_commentary(instruction: Column, raw: Column) -> Column:
    """Cues of comment that the instruction has and the text has not."""
    cues = F.array(*map(F.lit, R.COMMENTARY))
    return F.filter(cues, lambda q: F.contains(F.lower(instruction), q) & ~F.contains(F.lower(raw), q))


def remove_commentary(instruction: Column, raw: Column) -> Column:
    out = instruction
    for cue in R.COMMENTARY:
        foreign = F.lower(out).contains(cue) & ~F.lower(raw).contains(cue)
        out = F.when(foreign, F.regexp_replace(replace(out, cue, ""), r"^[; ]+|[; ]+$", "")).otherwise(out)
    return F.nullif(out, F.lit(""))


def canonical_frequency(c: Column) -> Column:
    raw = F.trim(c)
    clean = F.trim(replace(raw, r"\s+(?:before|after)\s+(?:food|breakfast|meals|lunch|dinner)$", ""))
    code = F.regexp_extract(clean, R.SCHEDULE_CODE, 1)
    by_code = F.create_map(*[F.lit(x) for pair in R.SCHEDULES.items() for x in pair])
    spoken = F.lit(None).cast("string")
    for label, words in reversed(R.SPOKEN_SCHEDULES):
        spoken = F.when(F.lower(raw).isin(*words), label).otherwise(spoken)
    return F.coalesce(F.when(code != "", by_code[code]), spoken, clean)


def normalize_schedule(c: Column) -> Column:
    """Display form; the rule for once comes before that for twice."""
    s = F.lower(F.trim(c))
    # Fixed values: (label, parts that may stand anywhere, whole values).
    labels = (
        ("Once a day (1-0-0)", ("1-0-0", "100", "once daily", "once a day"), ("od",)), ("Twice a day (1-0-1)", ("1-0-1", "101", "twice daily", "twice a day"), ("bd", "bid")),
        ("Thrice a day (1-1-1)", ("1-1-1", "111", "thrice daily", "three times"), ("tds", "tid")), ("Four times a day (1-1-1-1)", ("1-1-1-1", "1111", "four times"), ("qid",)),
        ("Once a day (bedtime)", ("0-0-1", "bedtime", "night", "hs"), ()), ("Twice a day (1-1-0)", ("1-1-0", "110"), ()), ("Twice a day (0-1-1)", ("0-1-1", "011"), ()),
        ("If Required (SOS)", ("sos", "as needed", "if required"), ()), ("Stat (Immediate single dose only)", ("stat", "immediate"), ()),
    )
    out = c
    for label, parts, whole in reversed(labels):
        hit = reduce(lambda a, b: a | b, [s.contains(p) for p in parts] + [s == w for w in whole])
        out = F.when(hit, label).otherwise(out)
    return F.when(c.isNull(), "").otherwise(out)


def cmp_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "-", " "))


def eval_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s]", " "))


def matches_expected(actual: Column, expected: Column) -> Column:
    a, e = eval_key(actual), eval_key(expected)
    return F.when(expected.isNull(), actual.isNull()).when(actual.isNull(), False).when(actual == expected, True).otherwise(F.contains(a, e) | F.contains(e, a))


def find_span(text: Column, part: Column) -> Column:
    """struct(start, end, verbatim): where part first stands in text, case aside; null if it does not."""
    at = F.instr(F.lower(text), F.lower(part))
    size = F.length(part)
    found = (at > 0) & (size > 0)
    return F.when(found, F.struct((at - 1).alias("start"), (at - 1 + size).alias("end"), F.substring(text, at, size).alias("verbatim")))


def numbered_list(values: Column) -> Column:
    lines = F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "NONE").otherwise(F.array_join(lines, " "))


def prune_contained(values: Column) -> Column:
    """Distinct values without those that another one contains, case aside."""
    kept = lambda own: F.filter(own, lambda x: ~F.exists(own, lambda y: (y != x) & F.contains(F.lower(y), F.lower(x))))
    return let(F.array_distinct(values), kept)


def align_overlap(committed: Column, new: Column, most: int = 8) -> Column:
    """new without the longest run of its first words (most at most) that ends committed, case aside."""
    done, fresh = F.split(F.trim(F.coalesce(committed, F.lit(""))), r"\s+"), F.split(F.trim(new), r"\s+")
    low_done, low_new = F.transform(done, F.lower), F.transform(fresh, F.lower)
    longest = F.least(F.size(done), F.size(fresh), F.lit(most))
    same = F.filter(F.sequence(F.lit(most), F.lit(1), F.lit(-1)), lambda i: (i <= longest) & (F.slice(low_done, -i, i) == F.slice(low_new, 1, i)))
    overlap = F.coalesce(F.get(same, F.lit(0)), F.lit(0))
    kept = F.array_join(F.slice(fresh, overlap + 1, F.size(fresh)), " ")
    return F.when((F.coalesce(committed, F.lit("")) == "") | (overlap == 0), F.trim(new)).otherwise(kept)


BLOCK_FIELDS = ("Drug_name", "strength", "frequency", "duration", "route", "instruction", "additional_instruction")


def parse_blocks(c: Column) -> Column:
    """array of structs of BLOCK_FIELDS from 'field: value' lines; a block opens at Drug_name. Without a block: one of NONE."""

    def value(block: Column, field: str) -> Column:
        found = F.regexp_extract(block, rf"(?im)^\s*{field}\s*:\s*(.*)$", 1)
        return let(F.trim(F.regexp_replace(F.trim(found), "^[\"']+|[\"']+$", "")), lambda bare: F.when((bare == "") | bare.rlike("^<.*>$"), "NONE").otherwise(bare))

    def fields(block: Column) -> Column:
        name = squeeze(replace(value(block, "Drug_name"), r"\b(tabs|tab|tablets|tablet|pills|pill|capsules|capsule)\b", ""))
        return F.struct(name.alias("Drug_name"), *[value(block, f).alias(f) for f in BLOCK_FIELDS[1:]])

    blocks = F.filter(F.split(F.trim(c), r"(?i)(?=Drug_name\s*:)"), lambda b: has(b, r"Drug_name\s*:"))
    parsed = F.filter(F.transform(blocks, fields), lambda b: b["Drug_name"] != "NONE")
    # The first block of each name stays.
    first = lambda own: F.filter(own, lambda b, i: ~F.exists(F.slice(own, 1, i), lambda p: F.lower(p["Drug_name"]) == F.lower(b["Drug_name"])))
    empty = F.array(F.struct(*[F.lit("NONE").alias(f) for f in BLOCK_FIELDS]))
    return let(let(parsed, first), lambda kept: F.when(F.coalesce(F.size(kept), F.lit(0)) <= 0, empty).otherwise(kept))


def attach_single_dose(query: Column, blocks: Column) -> Column:
    """For one block: a single dose in the query goes to the name, the second of two to the strength."""
    dose = r"(?i)\b(\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|l|drops))\b"
    doses = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(dose), 1)
    tidy = lambda d: F.concat_ws(" ", F.regexp_extract(d, r"(\d+(?:\.\d+)?)", 1), F.regexp_extract(d, r"([a-zA-Z]+)", 1))
    number = lambda d: F.regexp_extract(d, r"(\d+(?:\.\d+)?)", 1)
    one, two = F.get(doses, F.lit(0)), F.get(doses, F.lit(1))

    def attach(b: Column) -> Column:
        name = F.when(b["Drug_name"] == "NONE", tidy(one)).when(~F.contains(b["Drug_name"], number(one)), F.concat_ws(" ", b["Drug_name"], tidy(one))).otherwise(b["Drug_name"])
        second = (F.size(doses) >= 2) & (b["Drug_name"] != "NONE") & (b["strength"] == "NONE") & F.contains(b["Drug_name"], number(one))
        return F.struct(
            F.when(F.size(doses) == 1, name).otherwise(b["Drug_name"]).alias("Drug_name"),
            F.when(F.size(doses) == 1, F.lit("NONE")).when(second, tidy(two)).otherwise(b["strength"]).alias("strength"),
            *[b[f].alias(f) for f in BLOCK_FIELDS[2:]],
        )

    return F.when(F.size(blocks) == 1, F.transform(blocks, attach)).otherwise(blocks)


def extract_json(c: Column) -> Column:
    """The text as a VARIANT, or what stands in a fence, or the first array or object in it; null if none parses."""
    tries = (
        F.trim(c), F.trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), F.regexp_extract(c, r"(?s)(\[\s*\{.*\}\s*\])", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1),
    )
    return F.coalesce(*[F.try_parse_json(F.nullif(t, F.lit(""))) for t in tries])


def format_block(*fields: Column) -> Column:
    """'field: value' lines of BLOCK_FIELDS; NONE where there is no value."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.coalesce(c, F.lit("NONE"))) for f, c in zip(BLOCK_FIELDS, fields)])


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", "_")


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def clean_instruction_noise(c: Column) -> Column:
    out = replace_all(F.coalesce(c, F.lit("")), [(p, "") for p in R.NOISE])
    return F.coalesce(F.nullif(squeeze(out), F.lit("")), F.lit("NONE"))


def chronological(phrases: Column, source: Column) -> Column:
    """Phrases without those that another one contains, in the order in which they stand in the source; a phrase that does
    not is looked up by its first 15 characters, and goes to the end if these do not stand there either."""
    low = F.lower(source)

    def at(phrase: Column) -> Column:
        bare = F.lower(F.trim(F.regexp_replace(phrase, r"^\d+\.\s*", "")))
        whole, part = F.instr(low, bare), F.instr(low, F.substring(bare, 1, 15))
        return F.when(whole > 0, whole).when(part > 0, part).otherwise(1_000_000)

    kept = prune_contained(F.filter(F.transform(phrases, F.trim), lambda p: p != ""))
    placed = F.transform(kept, lambda p, i: F.struct(at(p).alias("at"), i.alias("i"), p.alias("phrase")))
    return F.transform(F.array_sort(placed), lambda x: x["phrase"])


def rule_value(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule (pattern, label), in their order, whose pattern is found, case aside; else null."""
    return F.coalesce(*[F.when(has(c, pattern), F.lit(label)) for pattern, label in rules]) if rules else F.lit(None).cast("string")


def ordered_union(*lists: Column) -> Column:
    """The distinct values of all lists, each where it first comes, joined by '; '."""
    return F.array_join(F.array_distinct(F.filter(F.concat(*lists), lambda v: v.isNotNull() & (v != ""))), "; ")
