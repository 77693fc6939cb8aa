"""Ranked lexical search (operator 11): best-first document intervals over range-maximum sparse tables.

`build_index` writes an index of every document: segments of at most SEGMENT_DOCS documents or some SEGMENT_TERMS terms, made where
the documents are read. A segment's documents are placed by length, so that an interval holds documents of like scores. The
table has a row for each segment and term (places of the term's documents, and its occurrences in each), and a row without a term for the
segment's documents (ids, and their numbers of terms).

`search` deals the queries in blocks of bounded size; a block goes to every segment. There every posting list gets a sparse table that
answers where in any range its impact is highest. A document interval is bounded by the sum of these maxima over the query's terms. The
intervals with the highest bounds are split first, at the document that has the highest impact in them: this document is scored
exactly, and the intervals before and behind it are bounded in turn. An interval goes when its bound is below the k-th best
score so far, or equals it while all its ids are larger than that one's. The segments' best meet in two steps.

Null and empty texts, and those without a term, are indexed with no terms and found by no query. Very long texts are indexed whole. Equal rows are
documents of their own: each is found. Rows with a null doc_id are found too, behind equal scores with one. Queries without a term
find nothing; those with the same terms are searched once. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read_table

SEGMENT_DOCS, SEGMENT_TERMS = 1 << 13, 1 << 22
QUERIES_AT_ONCE, TERMS_AT_ONCE = 1000, 100_000  # of a block, on average; blocks hold different queries
SPLITS = 512  # intervals split at once
SALTS = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "segment long, term string, places array<int>, tfs array<int>, doc_ids array<bigint>"
LAST = np.iinfo(np.int64).max  # stands for a null id in comparisons
#: Bytes that are in a term, A-Z lower-cased; all others are blanks. Letters beyond ASCII are bytes from 128.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of all documents."""
    import pyarrow as pa

    fields = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])

    def rows(segment: int, vocabulary: dict, coded: list[np.ndarray], ids: list) -> Iterator[pa.RecordBatch]:
        n = np.array([len(c) for c in coded], np.int64)
        key = np.array([LAST if i is None else i for i in ids], np.int64)
        order = np.lexsort((key, -n))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        found, tf = np.unique(np.concatenate(coded) * len(n) + np.repeat(place, n), return_counts=True)
        ends = np.searchsorted(found, np.arange(len(vocabulary) + 1) * len(n))
        lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
        empty = lambda kind, many: lists(np.zeros(many + 1, np.int32), [], kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment]), pa.array([None], pa.string()), empty(pa.int32(), 1), lists([0, len(n)], n[order], pa.int32()), lists([0, len(n)], [ids[i] for i in order], pa.int64())], schema=fields
        )
        if vocabulary:
            many = len(vocabulary)
            terms = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(many, segment)), terms, lists(ends, found % len(n), pa.int32()), lists(ends, tf, pa.int32()), empty(pa.int64(), many)], schema=fields
            )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        fresh = lambda: (defaultdict(count().__next__), [], [])
        (vocabulary, coded, ids), held = fresh(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.translate(_WORDS).split()
                coded.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
                ids.append(doc_id)
                held += len(words)
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_TERMS:
                    yield from rows(segment, vocabulary, coded, ids)
                    (vocabulary, coded, ids), held, segment = fresh(), 0, segment + 1
        if ids:
            yield from rows(segment, vocabulary, coded, ids)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return materialize(texts.mapInArrow(segments, INDEX), "search-index")


class Segment:
    """The postings of a segment for the terms of a block, with their impacts and sparse tables."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        """ids: by place. Term t has the postings starts[t] to starts[t + 1], in order of place."""
        self.ids, self.starts, self.places, self.impacts = ids, starts, places, impacts
        sizes = np.diff(starts)
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * len(ids) + places
        # best[j][i]: where in the 2^j postings from i the impact is highest, the first of equals.
        self.best = self._table(impacts, int(sizes.max(initial=1)), np.greater)
        self.least = self._table(ids, len(ids), np.less)

    @staticmethod
    def _table(values: np.ndarray, longest: int, better) -> np.ndarray:
        table = np.zeros((max(1, longest.bit_length()), len(values)), np.int32)
        table[0] = np.arange(len(values))
        for j in range(1, len(table)):
            half = 1 << j - 1
            many = len(values) - 2 * half + 1
            if many > 0:
                one, two = table[j - 1, :many], table[j - 1, half : half + many]
                table[j, :many] = np.where(better(values[two], values[one]), two, one)
        return table

    @staticmethod
    def _range(table: np.ndarray, values: np.ndarray, better, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where values are best from lo to hi (exclusive), which must not be empty."""
        j = np.frexp(hi - lo)[1] - 1
        one, two = table[j, lo], table[j, hi - (1 << j)]
        return np.where(better(values[two], values[one]), two, one)

    def _bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals (rows) by term: the sum of the highest impacts, and the place of the highest of all."""
        some = lo < hi
        at = np.zeros(lo.shape, np.int64)
        at[some] = self._range(self.best, self.impacts, np.greater, lo[some], hi[some])
        highest = np.where(some, self.impacts[at], 0)
        top = highest.argmax(1)
        return highest.sum(1), self.places[at[np.arange(len(at)), top]]

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents (fewer if fewer have a score), highest first, then by id."""
        terms = terms[self.starts[terms] < self.starts[terms + 1]]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return found, scores
        lo, hi = self.starts[terms][None], self.starts[terms + 1][None]
        ends = np.array([[0, len(self.ids)]])
        bound, split = self._bounds(lo, hi)
        base = terms * len(self.ids)
        while len(bound):
            now = np.argpartition(-bound, SPLITS)[:SPLITS] if len(bound) > SPLITS else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[now] = False
            d = split[now]
            at = np.searchsorted(self.keys, base + d[:, None])
            at = np.minimum(at, hi[now])  # the first posting from d on
            here = at < hi[now]
            here[here] = self.places[at[here]] == np.broadcast_to(d[:, None], at.shape)[here]
            score = np.where(here, self.impacts[np.where(here, at, 0)], 0).sum(1)
            found, scores = np.concatenate([found, d]), np.concatenate([scores, score])
            best = np.lexsort((self.ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            lows, highs = np.concatenate([lo[now], at + here]), np.concatenate([at, hi[now]])
            sides = np.concatenate([np.stack([ends[now, 0], d], 1), np.stack([d + 1, ends[now, 1]], 1)])
            bounds, splits = self._bounds(lows, highs)
            lo, hi, ends = np.concatenate([lo[rest], lows]), np.concatenate([hi[rest], highs]), np.concatenate([ends[rest], sides])
            bound, split = np.concatenate([bound[rest], bounds]), np.concatenate([split[rest], splits])
            keep = bound > 0
            if len(found) == k:
                keep &= bound >= scores[-1]
                ties = np.flatnonzero(keep & (bound == scores[-1]))
                if len(ties):
                    least = self.ids[self._range(self.least, self.ids, np.less, ends[ties, 0], ends[ties, 1])]
                    keep[ties[least > self.ids[found[-1]]]] = False
            lo, hi, ends, bound, split = lo[keep], hi[keep], ends[keep], bound[keep], split[keep]
        return found[scores > 0], scores[scores > 0]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """queries (item_id, text) -> item_id, rank, doc_id, score of the k documents that score highest."""
    spark = index.sparkSession
    total = index.where("term is null").agg(F.sum(F.size(F.filter("tfs", lambda n: n > 0))), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))))
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0).distinct()
    asked = materialize(items.select("terms").distinct().withColumn("query", F.monotonically_increasing_id()), "search-queries")
    many = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, math.ceil(many[0] / QUERIES_AT_ONCE), math.ceil((many[1] or 0) / TERMS_AT_ONCE))
    known = asked.select(F.explode("terms").alias("term")).distinct()
    df = materialize(index.join(known, "term").groupBy("term").agg(F.sum(F.size("places")).alias("df")), "search-terms")
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = None
    for b in range(blocks):
        own = asked.where(block == b)
        part = _search_block(index, own, df.join(own.select(F.explode("terms").alias("term")).distinct(), "term"), n_docs, n_terms, k)
        part = materialize(part, "search-found")
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["query", F.pmod(F.xxhash64("segment"), F.lit(SALTS))], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    best = found.select("query", "rank", "doc_id", "score").join(asked, "query").join(items, "terms")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(index: DataFrame, asked: DataFrame, df: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, segment, doc_id, score: the k best of every segment for the queries of a block, which has a bounded size."""
    spark = index.sparkSession
    known = {r["term"]: (i, weight(n_docs, r["df"])) for i, r in enumerate(sorted(df.collect(), key=lambda r: r["term"]))}
    rows = sorted(asked.collect(), key=lambda r: r["query"])
    weights = np.array([w for _, w in known.values()], np.int64)
    block = spark.sparkContext.broadcast((weights, [(r["query"], np.array([known[t][0] for t in r["terms"] if t in known], np.int64)) for r in rows]))
    numbered = spark.createDataFrame([(t, i) for t, (i, _) in known.items()], "term string, t int")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        weights, queries = block.value
        rows = rows.sort_values("t", na_position="first", ignore_index=True)
        docs, rows = rows.iloc[0], rows.iloc[1:]
        null = pd.isna(pd.array(list(docs["doc_ids"]), dtype="Int64"))
        ids = np.array([LAST if x else i for i, x in zip(pd.array(list(docs["doc_ids"]), dtype="Int64"), null)], np.int64)
        m = 50 + (50 * docs["tfs"].astype(np.int64) * n_docs) // n_terms if n_terms else docs["tfs"]
        t = rows["t"].to_numpy(np.int64)
        sizes = np.array([len(p) for p in rows["places"]], np.int64)
        starts = np.zeros(len(weights) + 1, np.int64)
        starts[t + 1] = sizes
        none = [np.zeros(0, np.int32)]
        places = np.concatenate([*rows["places"], *none]).astype(np.int64)
        tf = np.concatenate([*rows["tfs"], *none]).astype(np.int64)
        impacts = np.repeat(weights[t], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
        segment, out = Segment(ids, np.cumsum(starts), places, impacts), []
        for query, own in queries:
            at, scores = segment.search(own, k)
            out.append(pd.DataFrame({"query": query, "segment": docs["segment"], "doc_id": pd.array(np.where(null[at], 0, ids[at]), "Int64").copy(), "score": scores}))
            out[-1].loc[null[at], "doc_id"] = pd.NA
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query": [], "segment": [], "doc_id": [], "score": []})

    # Neither terms nor queries of a block grow with the documents.
    postings = index.join(F.broadcast(numbered), "term").select("segment", "t", "places", "tfs", "doc_ids")
    documents = index.where("term is null").select("segment", F.lit(None).cast("int").alias("t"), "places", "tfs", "doc_ids")
    return postings.unionByName(documents).groupBy("segment").applyInPandas(best, "query long, segment long, doc_id long, score long")


def op11_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"), 50)


QUERIES = {"op11_interval_search": op11_interval_search}
ORACLE_SQL = {
    "op11_interval_search": rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
impacts AS (SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS impact
  FROM tfs t JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
}
