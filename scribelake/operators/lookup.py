"""Lookups of a DataFrame of keys in a catalogue: one row a key, or the best few of each key.

keys has a column key; results have key and what is found. Equal keys are looked up once, null keys find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..storage import materialize
from . import formulary as C
from .containment import contained, either_contains


def top(df: DataFrame, by: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def _leading(products: DataFrame, by: list, limit: int, product: str = "drug_id") -> DataFrame:
    """The products of each name that can be among the first `limit` different ones of several names in a row, each name's in load
    order: while fewer are found, fewer than `limit` of a name's are repeats, so twice as many of a name are enough."""
    return top(products, by, [F.col("ord"), F.col(product)], 2 * limit, "__n").drop("__n")


def _asked(keys: DataFrame) -> DataFrame:
    return keys.select("key").where(F.trim("key") != "").distinct()


def find_exact(keys: DataFrame, cat: C.Catalogue) -> DataFrame:
    """key, drug_id, via: by code, then name, id (as written) and base name."""
    asked = _asked(keys).withColumn("q", F.trim("key"))
    wanted = asked.select("key", F.explode(F.array(
        F.struct(F.lit(1).alias("rung"), F.lit("code").alias("kind"), F.upper("q").alias("k")), F.struct(F.lit(2).alias("rung"), F.lit("name").alias("kind"), F.upper("q").alias("k")),
        F.struct(F.lit(3).alias("rung"), F.lit("id").alias("kind"), F.col("q").alias("k")), F.struct(F.lit(4).alias("rung"), F.lit("base").alias("kind"), F.upper("q").alias("k")),
    )).alias("w")).select("key", "w.*")
    return _rungs(wanted, cat)


def find_normalized(keys: DataFrame, cat: C.Catalogue, cleaned: Column | None = None) -> DataFrame:
    """key, drug_id, via: the cleaned name as base, then brand and generic name."""
    base = N.clean_base_name(F.col("key")) if cleaned is None else cleaned
    kinds = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(k).alias("kind")) for i, k in enumerate(("base", "brand", "generic"), 1)])
    wanted = _asked(keys).select("key", base.alias("k"), F.explode(kinds).alias("w")).where("k != ''").select("key", "k", "w.*")
    return _rungs(wanted, cat)


def _rungs(wanted: DataFrame, cat: C.Catalogue) -> DataFrame:
    """The product of the lowest rung, and of that rung the first in load order."""
    firsts = cat.firsts.select("kind", F.col("key").alias("k"), "drug_id").hint("merge")  # larger than its files
    found = wanted.join(firsts, ["kind", "k"])
    return found.groupBy("key").agg(F.min(F.struct("rung", "kind", "drug_id")).alias("f")).select("key", "f.drug_id", F.col("f.kind").alias("via"))


def find_fuzzy(keys: DataFrame, cat: C.Catalogue, min_confidence: float = 0.68, limit: int = 5) -> DataFrame:
    """key, drug_id, similarity, confidence, matched_via, rank.

    Candidates share a block with the key (phonetic class, soundex or first three letters, of the name or of the name
    without blanks) and are then compared by edit distance; the blocks are an equi-join, so no key meets the whole
    catalogue. Keys that are names themselves find these alone, with confidence 1.
    """
    asked = _based(_asked(keys))
    exact = find_normalized(asked, cat).select("key", "drug_id", F.lit("NORMALIZED").alias("matched_via"))
    left = asked.join(exact, "key", "left_anti")
    joined = find_normalized(left.where("many"), cat, F.regexp_replace(N.clean_base_name(F.col("key")), r"\s+", "")).select("key", "drug_id", F.lit("NORMALIZED_CONCAT").alias("matched_via"))
    left = materialize(left.join(joined, "key", "left_anti"), "fuzzy-asked")
    sure = exact.unionByName(joined).select("key", "drug_id", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("confidence"), "matched_via", F.lit(1).alias("rank"))
    return sure.unionByName(_near(left, cat, min_confidence, limit))


def _based(asked: DataFrame) -> DataFrame:
    """asked (key) and base, solid (without blanks), many (whether base has blanks), of names of three letters or more."""
    asked = asked.withColumn("base", N.clean_base_name(F.col("key"))).where(F.length("base") >= 3)
    return asked.withColumn("solid", F.regexp_replace("base", r"\s+", "")).withColumn("many", F.col("base").contains(" "))


def _near(left: DataFrame, cat: C.Catalogue, min_confidence: float, limit: int) -> DataFrame:
    """What find_fuzzy gives for keys (of _based) that are no names themselves."""
    left = left.withColumn("pb", N.phonetic_backbone(F.col("base"))).withColumn("pb2", N.phonetic_backbone(F.col("solid"))).withColumn("sx", N.soundex_ph(F.col("base")))
    block = lambda kind, c: F.struct(F.lit(kind).alias("bucket"), c.alias("bucket_key"))
    blocks = F.array_distinct(F.array(
        block("phonetic", F.col("pb")), block("phonetic", F.col("pb2")), block("soundex", F.col("sx")), block("prefix", F.substring("base", 1, 3)), block("prefix", F.substring("solid", 1, 3)),
    ))
    asked_blocks = left.select("*", F.explode(blocks).alias("b")).select("key", "base", "solid", "many", "pb", "pb2", "sx", "b.bucket", "b.bucket_key").where("bucket_key != ''")
    pairs = asked_blocks.join(cat.buckets, ["bucket", "bucket_key"]).drop("bucket", "bucket_key").distinct()
    cand = F.col("base_key")
    pairs = pairs.withColumn("d1", N.levenshtein_ph(F.col("base"), cand)).withColumn("d2", F.when(F.col("many"), N.levenshtein_ph(F.col("solid"), cand)).otherwise(999))
    size = F.greatest(F.when(F.col("many") & (F.col("d2") < F.col("d1")), F.length("solid")).otherwise(F.length("base")), F.length(cand))
    pairs = pairs.withColumn("similarity", 1.0 - F.least("d1", "d2") / size).withColumn("pc", N.phonetic_backbone(cand))
    heard = (F.col("pc") != "") & ((F.col("pc") == F.col("pb")) | (F.col("many") & (F.col("pc") == F.col("pb2"))))
    pairs = pairs.withColumn("heard", heard).withColumn("confidence", F.when(heard, F.greatest("similarity", F.lit(0.88))).otherwise(F.col("similarity")))
    pairs = pairs.where((F.col("confidence") >= min_confidence) | (F.col("heard") & (F.col("similarity") >= 0.5)))
    via = F.when(F.col("heard"), "PHONETIC").when(F.col("sx") == N.soundex_ph(cand), "SOUNDEX").otherwise("LEVENSHTEIN")
    scored = pairs.select("key", "base_key", "similarity", "confidence", via.alias("matched_via")).join(_leading(cat.bases, ["base_key"], limit), "base_key")
    order = [F.col("confidence").desc(), F.col("similarity").desc(), F.col("base_key"), F.col("ord"), F.col("drug_id")]
    single = top(scored, ["key", "drug_id"], order, 1, "__n").drop("__n")
    return top(single, ["key"], order, limit).select("key", "drug_id", "similarity", "confidence", "matched_via", "rank")


def _staged(found: DataFrame, limit: int) -> DataFrame:
    """The lowest stage of each product, the first `limit` products of each key."""
    single = top(found, ["key", "drug_id"], [F.col("stage"), F.col("place"), F.col("ord")], 1, "__n").drop("__n")
    return top(single, ["key"], [F.col("stage"), F.col("place"), F.col("ord"), F.col("drug_id")], limit).select("key", "drug_id", "stage", "rank")


def _named(cat: C.Catalogue, column: str) -> DataFrame:
    """Products by upper-cased name, with the place of the name (that of its first product)."""
    rows = cat.products.where(F.col(column).isNotNull()).select(F.upper(column).alias("name"), "drug_id", "drug_type", "ord")
    return rows.withColumn("place", F.min("ord").over(Window.partitionBy("name")))


def find_by_brand(keys: DataFrame, cat: C.Catalogue, limit: int = 10) -> DataFrame:
    """key, drug_id, stage, rank: brand products of the brand, then of brands that contain the key."""
    asked = _asked(keys).withColumn("q", N.clean_base_name(F.col("key"))).where("q != ''")
    names = _named(cat, "brand_name").where("drug_type = 'b'")
    pairs = contained(asked.select("q"), names.select("name")).toDF("q", "name")
    hits = asked.join(pairs, "q").join(names, "name")
    return _staged(hits.withColumn("stage", F.when(F.col("name") == F.col("q"), 1).otherwise(2)), limit)


def find_by_generic(keys: DataFrame, cat: C.Catalogue, limit: int = 10) -> DataFrame:
    """key, drug_id, stage, rank: products of the generic, then of generics that contain or are in it, then of the base name."""
    asked = _asked(keys).withColumn("q", N.clean_base_name(F.col("key"))).where("q != ''")
    names = _named(cat, "generic_name")
    pairs = either_contains(asked.select("q"), names.select("name")).toDF("q", "name")
    hits = asked.join(pairs, "q").join(names, "name")
    hits = hits.withColumn("stage", F.when(F.col("name") == F.col("q"), 1).otherwise(2)).select("key", "drug_id", "stage", "place", "ord")
    bases = cat.bases
    own = asked.join(bases, asked["q"] == bases["base_key"]).select("key", "drug_id", F.lit(3).alias("stage"), F.lit(0).cast("long").alias("place"), "ord")
    return _staged(hits.unionByName(own), limit)


def resolve(keys: DataFrame, cat: C.Catalogue) -> DataFrame:
    """key, drug_id: exact, or else normalized."""
    exact = find_exact(keys, cat).select("key", "drug_id")
    return exact.unionByName(find_normalized(keys.join(exact, "key", "left_anti"), cat).select("key", "drug_id"))


def strengths_for_base(keys: DataFrame, cat: C.Catalogue) -> DataFrame:
    """key, strengths of all base names that contain the key or are in it."""
    asked = _asked(keys).withColumn("q", N.clean_base_name(F.col("key"))).where("q != ''")
    pairs = either_contains(asked.select("q"), cat.strengths.select("base_key")).toDF("q", "base_key")
    hits = asked.join(pairs, "q").join(cat.strengths, "base_key")
    return hits.select("key", F.explode("strengths").alias("s")).groupBy("key").agg(N.sort_strengths(F.collect_set("s")).alias("strengths"))


def find_strengths(keys: DataFrame, cat: C.Catalogue) -> DataFrame:
    """key, strengths: of the product and its base, brand and generic name; without a product as strengths_for_base."""
    found = resolve(keys, cat).join(cat.products, "drug_id")
    known = cat.strengths
    names = found.select("key", F.explode(F.array_compact(F.array("base_name", "brand_name", "generic_name"))).alias("base_key"))
    own = found.select("key", F.explode("strength_values").alias("s"))
    shared = names.join(known, "base_key").select("key", F.explode("strengths").alias("s"))
    direct = own.unionByName(shared).groupBy("key").agg(N.sort_strengths(F.collect_set("s")).alias("strengths"))
    return direct.unionByName(strengths_for_base(keys.join(found, "key", "left_anti"), cat))


def check_strength(found: DataFrame, query: Column) -> DataFrame:
    """found of find_strengths with column valid: [number] of the query if it is a strength, else []."""
    sq = F.upper(F.trim(query))
    number = F.regexp_extract(sq, r"(\d+(?:\.\d+)?)", 1)
    ok = F.when((number != "") & F.array_contains("strengths", number), F.array(number)).when(F.array_contains("strengths", sq), F.array(sq))
    return found.withColumn("valid", F.coalesce(ok, F.array().cast("array<string>")))


def find_routes(keys: DataFrame, cat: C.Catalogue, route_map: DataFrame | None = None) -> DataFrame:
    """key, routes: of the product, or those mapped to the key as an id, or ORAL."""
    product = resolve(keys, cat).join(cat.products.select("drug_id", "routes"), "drug_id").select("key", "routes")
    asked = keys.select("key").where("key is not null").distinct().join(product, "key", "left")
    if route_map is not None:
        mapped = C.collect_routes(route_map).select(F.col("drug_id").alias("key"), F.array_distinct("routes").alias("mapped"))
        asked = asked.join(mapped, F.trim(asked["key"]) == mapped["key"], "left").select(asked["key"], F.coalesce("routes", "mapped").alias("routes"))
    return asked.select("key", F.coalesce("routes", F.array(F.lit("ORAL"))).alias("routes"))


def search_drugs(keys: DataFrame, cat: C.Catalogue, limit: int = 30) -> DataFrame:
    """key, drug_id, stage, rank: exact base name, then names in its prefix bucket that contain it, then its soundex bucket."""
    asked = _asked(keys).withColumn("q", N.clean_base_name(F.col("key"))).where("q != ''")
    rows = cat.bases.withColumn("place", F.min("ord").over(Window.partitionBy("base_key")))
    exact = asked.select("key", F.col("q").alias("base_key"), F.lit(1).alias("stage"))
    prefix = asked.where(F.length("q") >= 3).withColumn("bucket_key", F.substring("q", 1, 3)).join(cat.buckets.where("bucket = 'prefix'"), "bucket_key")
    prefix = prefix.where(F.contains("base_key", F.col("q"))).select("key", "base_key", F.lit(2).alias("stage"))
    sound = asked.withColumn("bucket_key", N.soundex_ph(F.col("q"))).join(cat.buckets.where("bucket = 'soundex'"), "bucket_key").select("key", "base_key", F.lit(3).alias("stage"))
    return _staged(exact.unionByName(prefix).unionByName(sound).join(rows, "base_key"), limit)


def dose_number(dose: Column) -> Column:
    """The first number of a dose, with its percent sign; null without one."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(dose), r"(\d+(?:\.\d+)?%?)", 1)), F.lit(""))


def numbers_in(text: Column) -> Column:
    """The numbers, as dose_number writes them, that stand in text as words: "2", "5" and "2.5" in "X 2.5 TAB"."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?=\b({n})\b)"), 1) for n in (r"\d+", r"\d+\.\d+", r"\d+%", r"\d+\.\d+%")]))


def _formulations(asked: DataFrame, cat: C.Catalogue, limit: int) -> DataFrame:
    """asked (drug_id, number) -> drug_id, number, other, rank: products of the base name, then of the brand, then of the generic name,
    that have the number as a strength or as a word of name or code; all of them if none has.

    Products are found by name and number in one equi-join, and the leading ones of a name are listed once for all products that share it.
    """
    asked = materialize(asked.distinct(), "formulations-asked")
    named = asked.select("drug_id").distinct().join(cat.products.select("drug_id", "base_name", "brand_name", "generic_name"), "drug_id")
    kinds = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.upper(f"{kind}_name").alias("name")) for i, kind in enumerate(("base", "brand", "generic"))])
    named = materialize(named.select("drug_id", F.explode(kinds).alias("n")).select("drug_id", "n.*").where("name is not null"), "formulations-names")
    wanted = asked.join(named, "drug_id")
    index = cat.index.select("kind", F.col("key").alias("name"), F.col("drug_id").alias("other"), "ord").join(named.select("kind", "name").distinct(), ["kind", "name"])
    has = F.array_distinct(F.concat(F.coalesce("strength_values", F.array().cast("array<string>")), numbers_in(F.upper("drug_name")), numbers_in(F.upper("drug_code"))))
    numbers = cat.products.select(F.col("drug_id").alias("other"), F.explode(has).alias("number"))
    of_number = index.join(numbers, "other").join(wanted.select("kind", "name", "number").distinct(), ["kind", "name", "number"])
    hits = materialize(wanted.join(_leading(of_number, ["kind", "name", "number"], limit, "other"), ["kind", "name", "number"]).select("drug_id", "number", "place", "ord", "other"), "formulations-hits")
    found = hits.select(F.col("drug_id").alias("__of"), F.col("number").alias("__number")).distinct()
    none = wanted.join(found, (F.col("drug_id") == F.col("__of")) & F.col("number").eqNullSafe(F.col("__number")), "left_anti")
    every = none.join(_leading(index.join(none.select("kind", "name").distinct(), ["kind", "name"]), ["kind", "name"], limit, "other"), ["kind", "name"])
    pool = hits.unionByName(every.select("drug_id", "number", "place", "ord", "other"))
    pool = pool.groupBy("drug_id", "number", "other", "ord").agg(F.min("place").alias("place"))
    return top(pool, ["drug_id", "number"], [F.col("place"), F.col("ord"), F.col("other")], limit).select("drug_id", "number", "other", "rank")


def same_dose(keys: DataFrame, cat: C.Catalogue, limit: int = 30) -> DataFrame:
    """key, dose -> key, dose, drug_id, rank: products that share the base, brand or generic name of the key's product and have
    the dose; all of them if none has. A key that is no name is looked up by sound."""
    asked = keys.select("key", "dose").where("key is not null").distinct().withColumn("number", dose_number(F.col("dose")))
    found = materialize(resolve(asked, cat), "resolved")
    left = asked.join(found, "key", "left_anti")
    if not left.isEmpty():
        found = found.unionByName(find_fuzzy(left, cat, 0.65, 1).select("key", "drug_id"))
    asked = asked.join(found, "key")
    each = _formulations(asked.select("drug_id", "number"), cat, limit).withColumnsRenamed({"drug_id": "__of", "number": "__number"})
    out = asked.join(each, (F.col("drug_id") == F.col("__of")) & F.col("number").eqNullSafe(F.col("__number")))
    return out.select("key", "dose", F.col("other").alias("drug_id"), "rank")


def with_available_drugs(items: DataFrame, cat: C.Catalogue, limit: int = 30) -> DataFrame:
    """items (drug_id, dose, strength, medicine) and available_drugs: what else there is of each item's product, as an array
    in order. The dose is the item's, or else its strength, or else the first number of its name. Items without a product have an empty array.
    Equal (product, dose) are looked up once."""
    number = F.coalesce(dose_number(F.coalesce(F.nullif("dose", F.lit("")), F.nullif("strength", F.lit("")), F.regexp_extract("medicine", r"\b(\d+(?:\.\d+)?)\b", 1))))
    rows = items.withColumn("__number", number)
    found = _formulations(rows.where("drug_id is not null").select("drug_id", F.col("__number").alias("number")), cat, limit)
    shown = cat.products.select(F.col("drug_id").alias("other"), F.struct("drug_id", "drug_code", "drug_name", "base_name", "drug_type", "routes", F.array_sort("strength_values").alias("strengths")).alias("drug"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "drug"))), lambda r: r["drug"])
    found = found.join(shown, "other").groupBy("drug_id", "number").agg(listed.alias("available_drugs")).withColumnsRenamed({"drug_id": "__of", "number": "__of_number"})
    found = materialize(found, "available-drugs")  # of known size, so that a short list is broadcast instead of dealing all items by product
    out = rows.join(found, (F.col("drug_id") == F.col("__of")) & F.col("__number").eqNullSafe(F.col("__of_number")), "left")
    return out.withColumn("available_drugs", F.coalesce("available_drugs", F.expr("filter(array(cast(null as struct<drug_id:string,drug_code:string,drug_name:string,base_name:string,drug_type:string,routes:array<string>,strengths:array<string>>)), x -> false)"))).drop("__number", "__of", "__of_number")


def did_you_mean(keys: DataFrame, cat: C.Catalogue, limit: int = 3, min_confidence: float = 0.55) -> DataFrame:
    """key, drug_id, base_name, dose, confidence, similarity, rank: like-sounding products of distinct (base, first
    strength) for keys that are no name themselves."""
    near = find_fuzzy(keys, cat, min_confidence, 15).where(~F.col("matched_via").isin("NORMALIZED"))
    near = near.join(cat.products.select("drug_id", "base_name", F.get("strength_values", F.lit(0)).alias("dose")), "drug_id")
    near = top(near, ["key", F.upper("base_name"), "dose"], [F.col("rank")], 1, "__n").drop("__n").withColumnRenamed("rank", "found")
    near = top(near, ["key"], [F.col("found")], limit)
    return near.select("key", "drug_id", "base_name", "dose", F.round("confidence", 3).alias("confidence"), F.round("similarity", 3).alias("similarity"), "rank")


def find_composite(asked: DataFrame, cat: C.Catalogue) -> DataFrame:
    """key, a, b -> key, a, b, drug_id: the first product of the name that has the rounded sum a + b as a strength or in
    its name or code. The name is looked up as base, brand, first word, and by sound."""
    total = F.round(F.col("a") + F.col("b")).cast("long").cast("string")
    rows = asked.where(F.trim("key") != "").distinct().withColumn("total", total).withColumn("q", N.clean_base_name(F.col("key")))
    keyed = rows.select("key", "q").distinct()
    ladder = ((1, "base", F.col("q")), (2, "brand", F.col("q")), (3, "base", F.split("q", " ")[0]))
    named = keyed.select("key", F.explode(F.array(*[F.struct(F.lit(r).alias("rung"), F.lit(k).alias("kind"), n.alias("name")) for r, k, n in ladder])).alias("n")).select("key", "n.*")
    named = named.join(cat.index.select("kind", F.col("key").alias("name")).distinct(), ["kind", "name"])
    named = materialize(named.groupBy("key").agg(F.min(F.struct("rung", "kind", "name")).alias("n")).select("key", "n.kind", "n.name"), "composite-names")
    code = F.col("drug_code")
    digits = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"\d+"), 0)
    parts = lambda d: F.flatten(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.transform(F.sequence(i, F.length(d)), lambda j: F.substring(d, i, j - i + 1))))
    fits = F.array_sort(F.array_distinct(F.concat(F.coalesce("strength_values", F.array().cast("array<string>")), numbers_in(F.col("drug_name")), F.flatten(F.transform(digits, parts)))))
    # The hint is for merging, as the catalogue is many times as large as its files, by which Spark would broadcast it.
    fitting = cat.products.select("drug_id", "ord", fits.alias("fits")).hint("merge")
    index = cat.index.select("kind", F.col("key").alias("name"), "drug_id").join(named.select("kind", "name").distinct(), ["kind", "name"])
    # Of a name's products that fit the same numbers one is enough, so the numbers are told apart for these alone.
    alike = index.join(fitting, "drug_id").groupBy("kind", "name", "fits").agg(F.min(F.struct("ord", "drug_id")).alias("f"))
    first = alike.select("kind", "name", "f", F.explode("fits").alias("total")).groupBy("kind", "name", "total").agg(F.min("f").alias("f"))
    found = rows.join(named, "key").join(first, ["kind", "name", "total"]).select("key", "a", "b", "f")
    left = materialize(keyed.join(named, "key", "left_anti"), "composite-left")
    if not left.isEmpty():
        heard = materialize(find_fuzzy(left, cat, 0.70, 3).select("key", "drug_id"), "composite-heard")
        near = rows.join(heard, "key").join(fitting, "drug_id").where(F.array_contains("fits", F.col("total")))
        found = found.unionByName(near.groupBy("key", "a", "b").agg(F.min(F.struct("ord", "drug_id")).alias("f")))
    return found.select("key", "a", "b", "f.drug_id")


def _names_of(name: Column, rung: int) -> Column:
    """What to look up for a name: as it is written (code, name, id, base), then cleaned (base, brand, generic)."""
    clean = N.clean_base_name(name)
    kinds = (("code", F.upper(F.trim(name))), ("name", F.upper(F.trim(name))), ("id", F.trim(name)), ("base", F.upper(F.trim(name))), ("base", clean), ("brand", clean), ("generic", clean))
    return F.array(*[F.struct(F.lit(rung).alias("rung"), F.lit(i).alias("place"), F.lit(kind).alias("kind"), k.alias("k")) for i, (kind, k) in enumerate(kinds)])


def ground_medicine(candidates: DataFrame, cat: C.Catalogue) -> DataFrame:
    """candidates (key) -> key, drug_id, confidence, rung, suggested: a name itself 0.95, joined 0.95, by sound, by its
    first word 0.90, or by the sound of that.

    All names that a key may be found by are looked up in one join with the catalogue's keys, of which the lowest rung
    counts; then one fuzzy search takes what is left.
    """
    rows = _asked(candidates).where(N.is_valid_medication(F.col("key")))
    first = F.split(F.trim("key"), r"\s+")[0]
    rows = rows.withColumn("first", F.when(F.trim("key").contains(" ") & (F.length(first) >= 4) & N.is_valid_medication(first), first)).withColumn("spaced", F.col("key").contains(" "))
    solid = F.regexp_replace(N.clean_base_name(F.col("key")), r"\s+", "")
    heard = F.filter(_names_of(solid, 3), lambda n: n["place"] >= 4)  # by sound, a name without blanks is a sure hit too
    heard = F.when(N.clean_base_name(F.col("key")).contains(" ") & (F.length(N.clean_base_name(F.col("key"))) >= 3), heard)
    joined, worded = F.when(F.col("spaced"), _names_of(F.regexp_replace("key", r"\s+", ""), 2)), F.when(F.col("first").isNotNull(), _names_of(F.col("first"), 4))
    every = F.flatten(F.array_compact(F.array(_names_of(F.col("key"), 1), joined, heard, worded)))
    wanted = rows.select("key", "first", F.explode(every).alias("n")).select("key", "first", "n.*").where("k != ''")
    firsts = cat.firsts.select("kind", F.col("key").alias("k"), "drug_id").hint("merge")  # larger than its files
    found = wanted.join(firsts, ["kind", "k"], "left").groupBy("key", "first")
    found = materialize(found.agg(F.min(F.when(F.col("drug_id").isNotNull(), F.struct("rung", "place", "drug_id"))).alias("f")), "ladder")
    sure = F.col("f.rung") <= 3
    left = found.where(F.coalesce(~sure, F.lit(True)))
    by_sound = F.array_compact(F.array(F.struct(F.lit(3).alias("rung"), F.col("key").alias("sound")), F.when(F.col("first").isNotNull() & F.col("f").isNull(), F.struct(F.lit(5).alias("rung"), F.col("first").alias("sound")))))
    asked = left.select("key", F.explode(by_sound).alias("s")).select("key", "s.*")
    near = _near(_based(_asked(asked.select(F.col("sound").alias("key")))), cat, 0.55, 1).select(F.col("key").alias("sound"), "drug_id", "confidence")
    near = asked.join(near, "sound").where((F.col("rung") == 3) | (F.col("confidence") >= 0.60))
    confidence = F.when(F.col("f.rung") == 3, 1.0).when(F.col("f.rung") == 4, 0.90).otherwise(0.95)
    rungs = found.where("f is not null").select("key", F.struct(F.col("f.rung").alias("rung"), F.col("f.drug_id").alias("drug_id"), confidence.alias("confidence"), (F.col("f.rung") == 3).alias("suggested")).alias("r"))
    rungs = rungs.unionByName(near.select("key", F.struct("rung", "drug_id", F.round("confidence", 3).alias("confidence"), F.lit(True).alias("suggested")).alias("r")))
    best = rungs.groupBy("key").agg(F.min("r").alias("r"))
    return best.select("key", "r.drug_id", "r.confidence", "r.rung", "r.suggested")


def composite_options(asked: DataFrame, cat: C.Catalogue, limit: int = 3) -> DataFrame:
    """key, a, b -> key, a, b, drug_id, confidence, rank: the product of the sum of both strengths first, and then other
    products of its base name in load order, `limit` in all; none where no product has the sum."""
    found = find_composite(asked, cat)
    product = cat.products.select("drug_id", "base_name", "ord").hint("merge")  # larger than its files
    leading = top(product, ["base_name"], [F.col("ord"), F.col("drug_id")], limit, "__n").drop("__n")
    sure = found.join(product, "drug_id").select("key", "a", "b", "drug_id", "base_name", F.lit(0).alias("place"), "ord")
    other = leading.withColumnRenamed("drug_id", "other_id")
    rest = sure.drop("ord", "place").join(other, "base_name").where("other_id != drug_id").select("key", "a", "b", F.col("other_id").alias("drug_id"), "base_name", F.lit(1).alias("place"), "ord")
    ranked = top(sure.unionByName(rest), ["key", "a", "b"], ["place", "ord", "drug_id"], limit)
    return ranked.select("key", "a", "b", "drug_id", F.when(F.col("place") == 0, 0.95).otherwise(0.85).alias("confidence"), "rank")
