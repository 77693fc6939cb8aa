"""SimHash near-duplicates (operator 5): fingerprints, links within a Hamming radius by BK-trees, and components.

Two fingerprints that differ in at most `radius` of 64 bits agree in all but `radius` of any blocks the bits are cut
into. Distinct fingerprints are dealt by each pair of five blocks (three may differ, so one pair agrees); a shard is the
run of fingerprints of one key, and its task builds the shard's BK-tree and searches it for each of them. A shard
of more than `largest` fingerprints is dealt again by 13 of 16 blocks of 4 bits, which leaves 12 bits: 4096 fingerprints
a shard at most, however many documents there are. Only a spanning set of links leaves a shard.

Shard trees grow with the data in sum, so each is built where its searches run and is not broadcast.

Null and empty texts have fingerprint 0 and are linked like any other. Very long texts are hashed whole, the bits counted in
runs of hashes. Repeated rows stay. Documents with a null id
take part, and a component's id is the smallest id that is not null. An empty table gives an empty one. Other columns
of docs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_marked, read_table, unused

RADIUS, LARGEST_SHARD = 3, 8192
_UPPER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: bit j is set if it is set in over half the hashes of the word shingles, repeats included."""
    import xxhash

    words = _WORD.findall((text or "").translate(_UPPER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(" ".join(words).encode(), 42)
    runs = zip(*(words[k:] for k in range(shingle)))
    hashes = np.fromiter((digest(" ".join(r), 42) for r in runs), np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    total, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 14):
        octets = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Add column fp: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t if isinstance(t, str) else None) for t in texts], dtype="uint64").astype("int64")

    return docs.withColumn("fp", fp("text"))


# --- links ------------------------------------------------------------------------------------------------------------


def shard_keys(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that agree if `radius` of `blocks` blocks of the 64 bits may differ."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << j for j in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    return [sum(kept) for kept in combinations(masks, blocks - radius)]


def bk_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, edge, order): points[i] hangs under points[parent[i]] on the edge of their Hamming distance.

    Built level by level: the first point of each set becomes its root, and the others go down the edge of their
    distance to it. Points are distinct, so no edge is 0.
    """
    n = len(points)
    parent, edge, depth = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, group, level = np.arange(1, n), np.zeros(n - 1, np.int64), 0
    while len(left):
        level += 1
        far = np.bitwise_count(points[left] ^ points[group]).astype(np.int64)
        slot = group * 65 + far
        order = np.argsort(slot, kind="stable")
        slots, first = np.unique(slot[order], return_index=True)
        roots = left[order[first]]
        parent[roots], edge[roots], depth[roots] = slots // 65, slots % 65, level
        owner = roots[np.searchsorted(slots, slot)]
        stay = owner != left
        left, group = left[stay], owner[stay]
    return parent, edge, depth


def tree_links(points: np.ndarray, radius: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, within the radius: every point searches the tree and follows only edges within it."""
    n = len(points)
    parent, edge, _ = bk_tree(points)
    by_parent = np.argsort(parent * 65 + edge, kind="stable")[1:]
    keys = (parent * 65 + edge)[by_parent]
    a, b = [], []
    queries = np.arange(n)
    step = max(1, at_once // max(1, n))
    for i in range(0, n, step):
        who, node = queries[i : i + step], np.zeros(len(queries[i : i + step]), np.int64)
        while len(who):
            far = np.bitwise_count(points[who] ^ points[node]).astype(np.int64)
            hit = (far <= radius) & (who < node)
            a.append(who[hit])
            b.append(node[hit])
            low = np.searchsorted(keys, node * 65 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(keys, node * 65 + np.minimum(far + radius, 64), "right")
            count = high - low
            who = np.repeat(who, count)
            starts = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            node = by_parent[starts + np.arange(len(who))] if len(who) else node[:0]
    return np.concatenate(a), np.concatenate(b)


def spanning(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among points: (point, smallest linked root) index pairs."""
    if len(points) == 2:
        near = int(points[0] ^ points[1]).bit_count() <= radius
        return (np.array([1]), np.array([0])) if near else (np.zeros(0, int), np.zeros(0, int))
    a, b = tree_links(points, radius)
    label = np.arange(len(points))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(points)))
    return moved, label[moved]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _shard_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links within each key. Rows of a key come in a row; no more than one shard is held."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def closed(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            cuts = np.flatnonzero(np.diff(key)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            left, right = [], []
            for begin, end in zip(begins[ends - begins > 1], ends[ends - begins > 1]):
                points = np.unique(fp[begin:end])
                if len(points) > 1:
                    i, j = spanning(points, radius)
                    left.append(points[i])
                    right.append(points[j])
            none = [np.zeros(0, np.uint64)]
            return pd.DataFrame({"a": np.concatenate(left or none).view(np.int64), "b": np.concatenate(right or none).view(np.int64)})

        for batch in batches:
            key = np.concatenate((held_key, batch["key"].to_numpy(np.int64)))
            fp = np.concatenate((held_fp, batch["fp"].to_numpy(np.int64).view(np.uint64)))
            if not len(key):
                continue
            open_from = np.searchsorted(key, key[-1], "left")
            held_key, held_fp = key[open_from:], fp[open_from:]
            if open_from:
                yield closed(key[:open_from], fp[:open_from])
        if len(held_key):
            yield closed(held_key, held_fp)

    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(links, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, largest: int = LARGEST_SHARD) -> DataFrame:
    """a, b: links among the distinct fingerprints of column fp that connect all that are within the radius."""
    keyed = _keyed(fps, shard_keys(radius, radius + 2))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("key")
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        return _shard_links(keyed, radius).distinct()
    again = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    fine = _shard_links(_keyed(again, shard_keys(radius, 16)), radius)
    return _shard_links(keyed.join(crowded, "key", "left_anti"), radius).unionByName(fine).distinct()


# --- components ---------------------------------------------------------------------------------------------------------


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of distinct links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each linked node reaches, by alternating large-star and small-star steps.

    Each round rewrites the links so that nodes hang under their smallest neighbour; it ends when a round changes
    nothing, which takes a number of rounds that grows with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = materialize(edges, "edges")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", "m").unionByName(small.where("v != m").select(F.col("v").alias("u"), "m"))
        new = materialize(small.select("u", F.col("m").alias("v")).where("u != v").distinct(), "edges", edges)
        edges, after = new, _signature(new)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, radius: int = RADIUS, largest: int = LARGEST_SHARD) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    rows = materialize(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp"), "simhash")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(first.select("fp"), radius, largest))
    members = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = members.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, largest: int = LARGEST_SHARD) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id that is not null, and of rows alike in
    id the one with the smallest hash of its text. Rows alike in both are one document.

    What is decided is a short row for each (id, hash of text). A bitmap of bounded size tells which rows a decision may be
    about; only these and their texts meet the decisions by a join, all others stay where they are read.
    """
    text_key = F.xxhash64("text")
    rows = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = materialize(rows.select("doc_id", text_key.alias("text_key"), "fp"), "simhash")
    copies = materialize(rows.groupBy("fp", "doc_id", "text_key").agg(F.count("*").alias("n")), "simhash-copies", rows)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = materialize(copies.groupBy("fp").agg(F.min(place).alias("first")), "simhash-first")
    roots = components(fingerprint_links(first.select("fp"), radius, largest))
    members = first.join(roots, first["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = members.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    # All rows of a (doc_id, text_key) have one fingerprint. Those not kept go, and those kept more than once are set apart.
    here = copies["doc_id"].eqNullSafe(kept["doc_id"]) & (copies["text_key"] == kept["text_key"])
    gone = copies.join(kept, here, "left_anti").select("doc_id", "text_key", F.lit(False).alias("repeated"))
    again = copies.where("n > 1").join(kept, here, "left_semi").select("doc_id", "text_key", F.lit(True).alias("repeated"))
    decided = materialize(gone.unionByName(again), "simhash-decided", copies)
    discard(first)
    own, once, key = unused(docs.columns, "decided", "kept_id", "kept_key")
    maybe = maybe_marked(F.xxhash64(F.col("doc_id").cast("long"), text_key), decided.select(F.xxhash64("doc_id", "text_key")))
    sure, open_ = docs.where(~maybe), docs.where(maybe).withColumn(once, F.col("doc_id").cast("long")).withColumn(key, text_key)
    open_ = open_.join(decided.toDF("__id", "__key", own), F.col(once).eqNullSafe(F.col("__id")) & (F.col(key) == F.col("__key")), "left").drop("__id", "__key")
    left = open_.where(F.col(own).isNull()).select(*docs.columns)
    twice = open_.where(own).dropDuplicates([once, key]).select(*docs.columns)
    return sure.unionByName(left).unionByName(twice)


def op5_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_bk_trees": op5_simhash_bk_trees}
ORACLE_SQL: dict[str, str] = {}
