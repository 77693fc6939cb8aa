"""Document fingerprints (operator 9): one-permutation MinHash in DataFrame functions alone.

Words are what white space separates in the lower-cased, trimmed text; a shingle is five words, or all of them where
there are fewer (an empty or null text: the empty sequence). One hash a shingle: its top bits name the bin, and the bin
keeps its smallest hash. An empty bin takes the value of another one: the first non-empty bin on its own walk of
hashed bins, and where `WALK` steps meet none, the non-empty bin with the smallest hash of (bin, other). The walk hangs
on the bins alone, so like documents borrow alike. A fingerprint keeps the low `BITS` bits of each bin, as hex.
Likeness: the share m of equal bins, corrected for chance agreement of b bits, (m - 2^-b) / (1 - 2^-b), at least 0.

The next document is the one before in ascending doc_id (after the smallest, the largest). Nulls sort below all ids,
equal ids by descending text. Repeated rows are documents of their own. An empty table gives an empty one, and a single
document is its own next. Other columns of docs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

BINS_LOG2, BITS, SHINGLE, WALK = 8, 8, 5, 6
ROWS_A_BUCKET, MOST_BUCKETS = 1000, 1 << 16


def with_bins(df: DataFrame, text: str, out: str, bins_log2: int = BINS_LOG2, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Add column out: the low bits of the densified bins of column text, in bin order."""
    bins, low = 1 << bins_log2, 64 - bins_log2
    words, hashes, cells = f"__{out}_words", f"__{out}_hashes", f"__{out}_cells"
    top = 1 << (bins_log2 - 1)
    unused = (1 << low) - 1
    ends = F.expr("array(" + ",".join(f"{(b << low) + unused}L" for b in range(-top, top)) + ")")
    df = df.withColumn(words, F.transform(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: F.xxhash64(w)))
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
    df = df.withColumn(hashes, F.sort_array(F.concat(F.when(n < shingle, F.array(F.xxhash64(F.col(words)))).otherwise(each), ends)))
    # Each bin has its closing entry, so the first entry of each run of equal top bits is the bin's value or that entry.
    first = F.filter(hashes, lambda x, i: (i == 0) | (F.shiftright(x, low) != F.shiftright(F.get(hashes, i - 1), low)))
    df = df.withColumn(cells, F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(unused)) != unused, x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))))

    def borrowed(i: Column) -> list[Column]:
        walk = [F.get(cells, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(bins)).cast("int")) for k in range(WALK)]
        others = F.filter(F.transform(cells, lambda x, j: F.struct(F.xxhash64(i, j).alias("rank"), x.alias("value"))), lambda s: s["value"].isNotNull())
        return [*walk, F.array_min(others)["value"]]

    df = df.withColumn(out, F.transform(cells, lambda x, i: F.coalesce(x, *borrowed(i))))
    return df.drop(words, hashes, cells)


def packed(cells: Column, bits: int = BITS) -> Column:
    """The bins' low bits as hex digits."""
    return F.array_join(F.transform(cells, lambda x: F.lpad(F.lower(F.hex(x)), bits // 4, "0")), "")


def likeness(a: Column, b: Column, bins: int = 1 << BINS_LOG2, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of the shingle sets, corrected for bins that agree by chance."""
    chance = 2.0**-bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(bins))
    return F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance))


def with_bucket(df: DataFrame) -> DataFrame:
    """Add column bucket: ranges of doc_id with about ROWS_A_BUCKET rows, numbered in its order; -1 for null ids.

    The bounds are approximate quantiles, MOST_BUCKETS at most; a wrong quantile only makes a bucket larger or smaller.
    """
    n = df.count()
    wanted = max(4, min(MOST_BUCKETS, n // ROWS_A_BUCKET))
    shares = [k / wanted for k in range(1, wanted)]
    found = df.agg(F.percentile_approx("doc_id", shares, max(1000, 4 * wanted)).alias("at")).first()["at"] or []
    bounds = sorted(set(found))
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    if not groups:
        return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    firsts = F.expr("array(" + ",".join(f"{g[0]}L" for g in groups) + ")")
    inner = F.expr("array(" + ",".join("array(" + ",".join(f"{b}L" for b in g) + ")" for g in groups) + ")")
    df = df.withColumn("__group", below(firsts))
    place = F.when(F.col("__group") == 0, 0).otherwise((F.col("__group") - 1) * width + below(F.get(inner, F.col("__group") - 1)))
    return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(place)).drop("__group")


def with_ghosts(df: DataFrame) -> DataFrame:
    """Each bucket gets a copy of the first row of the bucket that follows it, marked ghost, so that all of a row's
    successors are in its own bucket."""
    heads = df.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    in_order = Window.orderBy("bucket")  # one row a bucket, without texts
    linked = heads.withColumn("to", F.lead("bucket").over(in_order)).withColumn("smallest", F.min("bucket").over(Window.partitionBy()))
    linked = linked.select("doc_id", F.col("bucket").alias("of"), F.coalesce("to", "smallest").alias("to"))
    head_rows = df.alias("d").join(F.broadcast(linked.alias("h")), (F.col("d.bucket") == F.col("h.of")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")))
    ghosts = head_rows.groupBy(F.col("h.to").alias("bucket")).agg(F.max(F.struct("d.doc_id", "d.text")).alias("head"))
    ghosts = ghosts.select("head.doc_id", "head.text", "bucket", F.lit(True).alias("ghost"))
    return df.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, edited and the bins of text (bins), edited text (edited_bins) and next text (next_bins)."""
    rows = with_ghosts(with_bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))))
    order = Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("doc_id").desc(), F.col("text").desc())
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut)
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), F.concat(kept, F.substring("next", F.lit(1), cut)))).drop("next")
    rows = with_bins(with_bins(rows, "text", "bins"), "edited", "edited_bins")
    return rows.withColumn("next_bins", F.lead("bins").over(order)).where(~F.col("ghost")).drop("bucket", "ghost")


def op9_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint_pairs(read_table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


QUERIES = {"op9_one_permutation_minhash": op9_one_permutation_minhash}
ORACLE_SQL: dict[str, str] = {}
