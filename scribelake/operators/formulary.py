"""The drug catalogue: one row a product, its key tables and buckets.

A catalogue has drug_id, drug_code, drug_name, drug_type, generic_name, brand_name, routes, provenance and ord (its load
order), and what build_formulary derives: base_name, dosage_form, strength_values. Joins with it carry no hints; Spark
broadcasts it where its size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..storage import materialize

RAW = "drug_id string, drug_code string, drug_name string, drug_type string, generic_name string, brand_name string, provenance string, ord long"


def curated(spark: SparkSession) -> DataFrame:
    rows = [(i, c, n, t, g, b, "CLINICAL_CURATION", k - 10**6) for k, (i, c, n, t, g, b, _) in enumerate(R.CURATED)]
    return spark.createDataFrame(rows, RAW)


def curated_routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r, k) for i, *_, routes in R.CURATED for k, r in enumerate(routes)], "drug_id string, route_code string, pos int")


def union_absent(master: DataFrame, more: DataFrame) -> DataFrame:
    """master and the rows of more whose name it lacks, case aside."""
    have = master.select(F.upper("drug_name").alias("__name")).distinct()
    return master.unionByName(more.join(have, F.upper(more["drug_name"]) == have["__name"], "left_anti"), allowMissingColumns=True)


def collect_routes(route_map: DataFrame) -> DataFrame:
    """drug_id, routes in the order of column pos."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "route_code")))
    return route_map.groupBy("drug_id").agg(F.transform(rows, lambda r: r["route_code"]).alias("routes"))


def build_formulary(raw: DataFrame, route_map: DataFrame | None = None, with_curated: bool = False) -> DataFrame:
    spark = raw.sparkSession
    raw = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file of many products would be worked on in one task
    if with_curated:
        raw = union_absent(raw, curated(spark))
        mapped = route_map.select("drug_id").distinct() if route_map is not None else spark.createDataFrame([], "drug_id string")
        extra = curated_routes(spark).join(mapped, "drug_id", "left_anti")
        route_map = extra if route_map is None else route_map.unionByName(extra)
    name, kind = F.trim(F.col("drug_name")), F.when(F.lower("drug_type") == "g", "g").otherwise("b")
    base = N.clean_base_name(name)
    generic_of = F.create_map(*[F.lit(x) for pair in R.BRAND_GENERIC.items() for x in pair])
    stem = F.nullif(F.upper(F.trim(F.regexp_extract(name, r"^([^(]+)", 1))), F.lit(""))
    out = raw.select(
        F.col("drug_id").cast("string").alias("drug_id"), F.upper(F.trim(F.coalesce("drug_code", F.lit("")))).alias("drug_code"), name.alias("drug_name"), base.alias("base_name"),
        kind.alias("drug_type"), F.coalesce("generic_name", F.when(kind == "g", stem).otherwise(generic_of[base])).alias("generic_name"),
        F.coalesce("brand_name", F.when(kind == "b", F.nullif(base, F.lit("")))).alias("brand_name"), N.dosage_form(name).alias("dosage_form"),
        N.extract_strengths(name, F.col("drug_code")).alias("strength_values"), F.coalesce("provenance", F.lit("MASTER_FORMULARY")).alias("provenance"), "ord",
    )
    if route_map is None:
        return out.withColumn("routes", F.array(F.lit("ORAL")))
    return out.join(collect_routes(route_map), "drug_id", "left").withColumn("routes", F.coalesce("routes", F.array(F.lit("ORAL"))))


def base_keys(formulary: DataFrame) -> DataFrame:
    """base_key, drug_id, ord: base names, and first words of four letters or more."""
    first = F.split("base_name", " ")[0]
    keys = F.array_distinct(F.array_compact(F.array("base_name", F.when((F.length(first) >= 4) & (first != F.col("base_name")), first))))
    return formulary.where(F.col("base_name") != "").select(F.explode(keys).alias("base_key"), "drug_id", "ord")


def register_aliases(keys: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """base_keys and, for each alias pair of which one side alone is a key, the other side with the same products."""
    if pairs is None:
        pairs = keys.sparkSession.createDataFrame(list(R.ALIASES), "a string, b string")
    have = keys.select("base_key").distinct().hint("merge")  # of the keys' size at worst, and these are many times as large as their files
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    new = both.join(have, both["a"] == have["base_key"], "left_semi").join(have, both["b"] == have["base_key"], "left_anti").distinct()
    new = materialize(new, "aliases")  # of known size, so that the keys are not broadcast to it
    return keys.unionByName(new.join(keys, new["a"] == keys["base_key"]).select(F.col("b").alias("base_key"), "drug_id", "ord").distinct())


def key_index(formulary: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """kind, key, drug_id, ord. Of code, name and id the last product stays, of base, brand and generic all."""
    keys = register_aliases(base_keys(formulary)) if keys is None else keys
    last = Window.partitionBy("kind", "key").orderBy(F.col("ord").desc(), F.col("drug_id").desc())
    single = formulary.select(F.explode(F.array(
        F.struct(F.lit("code").alias("kind"), F.col("drug_code").alias("key")), F.struct(F.lit("name").alias("kind"), F.upper("drug_name").alias("key")),
        F.struct(F.lit("id").alias("kind"), F.col("drug_id").alias("key")),
    )).alias("k"), "drug_id", "ord").select("k.kind", "k.key", "drug_id", "ord")
    single = single.where(F.col("key") != "").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    of = lambda kind, c: formulary.where(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.upper(c).alias("key"), "drug_id", "ord")
    bases = keys.select(F.lit("base").alias("kind"), F.col("base_key").alias("key"), "drug_id", "ord")
    return single.unionByName(bases).unionByName(of("brand", "brand_name")).unionByName(of("generic", "generic_name"))


def first_formulation(index: DataFrame, by: str = "key") -> DataFrame:
    """The first product, in load order, of each kind and key."""
    first = Window.partitionBy("kind", by).orderBy("ord", "drug_id")
    return index.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def bucket_index(formulary: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """bucket, bucket_key, base_key: soundex and three-letter prefix of base names, phonetic class of all names."""
    keys = register_aliases(base_keys(formulary)) if keys is None else keys
    aliases = keys.select("base_key").distinct()
    bases = formulary.select(F.col("base_name").alias("base_key")).where("base_key != ''").distinct()
    # First words are in the phonetic buckets alone; aliases in all.
    firsts = base_keys(formulary).select("base_key").distinct().join(bases, "base_key", "left_anti")
    written = aliases.join(firsts, "base_key", "left_anti")
    spoken = aliases
    for c in ("brand_name", "generic_name"):
        spoken = spoken.unionByName(formulary.where(F.col(c).isNotNull()).select(F.upper(c).alias("base_key")))
    name = F.col("base_key")
    own = written.select(F.explode(F.array(
        F.struct(F.lit("soundex").alias("bucket"), N.soundex_ph(name).alias("bucket_key")), F.struct(F.lit("prefix").alias("bucket"), F.when(F.length(name) >= 3, F.substring(name, 1, 3)).alias("bucket_key")),
    )).alias("b"), "base_key").select("b.bucket", "b.bucket_key", "base_key")
    heard = spoken.distinct().select(F.lit("phonetic").alias("bucket"), N.phonetic_backbone(name).alias("bucket_key"), "base_key")
    return own.unionByName(heard).where("bucket_key != ''").distinct()


def strength_map(formulary: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """base_key, strengths of all its products."""
    keys = register_aliases(base_keys(formulary)) if keys is None else keys
    each = keys.join(formulary.select("drug_id", F.explode("strength_values").alias("strength")).hint("merge"), "drug_id")  # larger than its files
    return each.groupBy("base_key").agg(N.sort_strengths(F.collect_set("strength")).alias("strengths"))


def vocabulary(formulary: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """word: words of three letters or more of base names and aliases."""
    keys = register_aliases(base_keys(formulary)) if keys is None else keys
    words = F.filter(F.split("base_key", r"\s+"), lambda w: F.length(w) >= 3)
    return keys.select(F.explode(words).alias("word")).distinct()


def known_tokens(tokens: DataFrame, cat: "Catalogue", column: str = "token") -> DataFrame:
    """The rows of tokens whose word is in the vocabulary."""
    words = vocabulary(cat.products, cat.bases)
    return tokens.join(words, F.upper(tokens[column]) == words["word"], "left_semi")


def summary(formulary: DataFrame) -> DataFrame:
    return formulary.select("drug_id", "drug_code", "drug_name", "drug_type", "generic_name", "brand_name", "routes", N.sort_strengths(F.col("strength_values")).alias("strength_values"))


@dataclass(frozen=True)
class Catalogue:
    """A catalogue and its key tables, each written once and read by every lookup."""

    products: DataFrame
    bases: DataFrame
    index: DataFrame
    firsts: DataFrame
    buckets: DataFrame
    strengths: DataFrame


def catalogue(formulary: DataFrame) -> Catalogue:
    products = materialize(formulary, "products")
    bases = materialize(register_aliases(base_keys(products)), "bases")
    index = materialize(key_index(products, bases), "index")
    return Catalogue(
        products, bases, index, materialize(first_formulation(index), "firsts"), materialize(bucket_index(products, bases), "buckets"), materialize(strength_map(products, bases), "strengths")
    )
