"""URL filters (operator 6): association rules over URL tokens, mined from labels by Spark's FP-growth.

A URL's tokens are its scheme, host labels, host suffixes, path segments and query names; digits in a run of three or
more count as one token N. Labelled URLs are baskets of tokens with their label. Tokens below MIN_SUPPORT are left out
before mining, and so is a host label that stands wherever one host suffix that begins with it does, for it says the
same. Rules "tokens -> block" are kept whose confidence is MIN_LIFT times the share of blocked URLs and lies MIN_Z
standard errors above it, unless a rule with fewer of these tokens is as sure. A URL matches a rule that
has only tokens of the URL: an inverted index lists each rule under its rarest token, and the rest is compared there.
URLs without a matching rule are allowed.

Given rules (host, path) come first: one fits its host and all subdomains if the path starts with its path, and the
longest wins (of equally long ones that with the longer host, and then the first given). A null URL and one without "://"
have an empty host and path and no tokens. Very long URLs are taken whole. Repeated rows are judged alike, and rules of
equal confidence give one verdict. Without labels, nothing is mined. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

MIN_SUPPORT, MIN_LIFT, MIN_Z, BROADCAST_RULES = 0.005, 1.5, 4.0, 20_000  # MIN_Z is high, as many combinations are tried
BLOCK, LABEL = "block", "\0block"
#: Fixed values: (host, path, verdict).
GIVEN_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens, in order."""
    url = F.coalesce(url, F.lit(""))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    labels = F.split(host_of(url), r"\.")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, count), ".")))
    names = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d{3,}", "N")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.split(query, "[&;]"), lambda x: F.concat(F.lit("query:"), F.regexp_replace(F.split(x, "=")[0], r"\d{3,}", "N")))
    every = F.concat(F.array(F.concat(F.lit("scheme:"), scheme)), suffixes, names, segments, fields)
    kept = F.array_distinct(F.filter(every, lambda t: ~t.rlike(r"^\w+:$")))
    return F.when(url.contains("://"), kept).otherwise(F.array().cast("array<string>"))


def frequent_tokens(labelled: DataFrame, min_support: float) -> DataFrame:
    """token: those that MIN_SUPPORT of the URLs have, without host labels that a host suffix stands for."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = materialize(counts.join(labelled.agg(F.count("*").alias("n"))).where(F.col("count") >= F.ceil(min_support * F.col("n"))).select("token", "count"), "url-tokens")
    suffixes = counts.where(F.col("token").startswith("host:"))
    same = suffixes.select(F.concat(F.lit("label:"), F.split(F.substring("token", F.lit(6), F.length("token")), r"\.")[0]).alias("token"), "count").distinct()
    return counts.join(same, ["token", "count"], "left_anti").select("token")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, min_z: float = MIN_Z) -> DataFrame:
    """antecedent, confidence, support of the rules for blocking. labelled: tokens (array), blocked (boolean)."""
    from pyspark.ml.fpm import FPGrowth

    labelled = materialize(labelled.select("tokens", F.coalesce("blocked", F.lit(False)).alias("blocked")), "url-labelled")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    base = blocked / max(n, 1)
    numbered = labelled.withColumn("row", F.monotonically_increasing_id())
    kept = numbered.select("row", "blocked", F.explode("tokens").alias("token")).join(frequent_tokens(labelled, min_support), "token")
    # A basket has no more tokens than its URL.
    baskets = kept.groupBy("row", "blocked").agg(F.collect_set("token").alias("tokens"))
    items = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens"))
    # Support is of all labelled URLs, those without a frequent token too.
    share = min(1.0, min_support * n / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min(1.0, base * min_lift)).fit(baskets.select(items.alias("items")))
    found = model.associationRules.where(F.col("consequent")[0] == LABEL)
    holds = F.col("support") / F.col("confidence") * baskets.count()  # URLs with the antecedent
    error = F.sqrt(F.lit(base * (1 - base)) / holds)
    found = found.where((F.col("confidence") > base) & (F.col("confidence") - base >= min_z * error))
    rules = materialize(found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "url-rules")
    # A rule goes if another with a proper part of its tokens is as sure; parts are found by one of their tokens.
    parts = by_rarest_token(rules, rules.select("antecedent", F.explode("antecedent").alias("token"))).select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"), "token")
    wider = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(parts, "token")
    inside = (F.size(F.array_except("part", "antecedent")) == 0) & (F.size("part") < F.size("antecedent"))
    beaten = wider.where(inside & (F.col("part_confidence") >= F.col("confidence"))).select("antecedent").distinct()
    return rules.join(beaten, "antecedent", "left_anti")


def by_rarest_token(rules: DataFrame, holders: DataFrame) -> DataFrame:
    """The inverted index: each rule under that of its tokens that the fewest holders (token) have."""
    often = rules.select(F.explode("antecedent").alias("token")).distinct()
    counts = holders.select("token").join(F.broadcast(often) if rules.count() <= BROADCAST_RULES else often, "token").groupBy("token").count()
    postings = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    return postings.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))


def matched_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url and confidence of the surest rule whose tokens the URL has. pages: distinct url, tokens."""
    index = materialize(by_rarest_token(rules, pages.select(F.explode("tokens").alias("token"))), "url-index")
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    looked_up = pages.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, given=GIVEN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row of pages (page_id, url)."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    fits = sorted(given, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = verdict = None
    for host, path, what in fits:
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fit, host + path) if rule is None else rule.when(fit, host + path)
        verdict = F.when(fit, what) if verdict is None else verdict.when(fit, what)
    rows = rows.withColumn("rule", rule if fits else F.lit(None).cast("string")).withColumn("given", verdict if fits else F.lit(None).cast("string"))
    # The method judges distinct URLs, so a URL that repeats is looked up once; those without tokens match no rule.
    told = F.size("tokens") > 0
    distinct = rows.where(told).select("url", "tokens").dropDuplicates(["url"])
    found = materialize(matched_rules(distinct, rules), "url-matches")
    columns = ("page_id", "host", "path", "rule", "given", "confidence")
    judged = rows.where(told).join(found, "url", "left").select(*columns)
    judged = judged.unionByName(rows.where(~told).withColumn("confidence", F.lit(None).cast("double")).select(*columns))
    mined = F.when(F.col("confidence").isNotNull(), BLOCK).otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", mined).alias("verdict"), "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens, blocked of the pages whose document (the number in the path) has a label; bad or toxic ones are blocked."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    rows = pages.select(tokens_of(F.col("url")).alias("tokens"), F.when(number != "", number.cast("long")).alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked"))
    return rows.join(marks, "doc_id").select("tokens", "blocked")


def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine_rules(labelled_pages(pages, read_table(spark, sf_dir, "labels")))
    return judge(pages, rules)


QUERIES = {"op6_url_association_rules": op6_url_association_rules}
ORACLE_SQL: dict[str, str] = {}
