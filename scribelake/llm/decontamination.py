"""Benchmark decontamination (operator 3): SimHash over item-sized windows.

Text is lower-cased words (runs of letters, digits and underscores); a shingle is five words, or all words of an item
that has fewer. A shingle weighs 1 / (number of distinct texts, in words, of the whole benchmark that have it), and an
item's fingerprint is the weighted SimHash of its shingles, of BITS bits. Every window of a document that is as long as
some item is fingerprinted alike (shingles of no item weigh nothing there); for items longer than the document, the
window is the whole document. A multi-index finds the items of the window's length within RADIUS: the bits are cut into
BITS / 16 blocks of 16 bits, and two fingerprints within RADIUS differ by 2 bits at most in some block, so each item is listed
under all values that differ from one of its blocks by 2 bits at most. Candidates are verified by exact
weighted-shingle similarity, sum of minima / sum of maxima, which must reach SIMILARITY. There, a shingle that the item
lacks weighs the mean of the item's shingles that the window lacks, which it replaces. So the similarity hangs on the
item and the counts alone.

Only windows of equal fingerprints and similarities are passed over: a window is known by the benchmark's shingles that
lie in it, so those that hold the same ones are tried once, and those whose shingles weigh less than SIMILARITY of the
lightest item of that length cannot match. A near copy at SIMILARITY differs in about 28 of 256 bits (standard deviation
5), so RADIUS leaves out some 1 in 10,000 of those at the very edge; tests measure it.

The benchmark's distinct rows are numbered and shipped to the workers in blocks of ITEMS_AT_ONCE items at most; a worker holds
the index of one block. One block is one pass over the documents. Of several, each is a pass over the texts that writes what it finds, by the
hash of the text; a bitmap of bounded size then tells which documents may have a match, and only these meet the matches
in a join.

Null and empty texts contain nothing; items without a word match nothing. Equal items match alike, repeated rows too.
Of windows that match an item equally well, the first is reported. Very long texts are read whole; what is held of one
grows with its words. An empty table gives an empty result. Other columns of docs are kept by decontaminate and
with_matches (which replaces a column of the name of its result).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain, combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, materialize, maybe_marked, read_table, unused

SHINGLE, SIMILARITY, BITS, RADIUS, ITEMS_AT_ONCE, ITEM_CHARS = 5, 0.8, 256, 47, 2000, 5000
MEMO_ENTRIES, AT_ONCE = 170_000, 2048  # words kept by a worker; windows fingerprinted at a time
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of each word seen; bounded by its user."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word, 1)
        return value


def word_hashes(text: str, memo: _Hashes) -> np.ndarray:
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    words = _WORD.findall(text.lower())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * _PRIME
        out ^= out >> np.uint64(31)
    return out


def _bit_signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    quarters = [hashes]
    for _ in range(BITS // 64 - 1):
        quarters.append((quarters[-1] ^ (quarters[-1] >> np.uint64(33))) * _PRIME)
    bits = np.unpackbits(np.ascontiguousarray(np.stack(quarters, axis=1)).view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _near_values() -> np.ndarray:
    """The differences of a 16-bit block by BLOCK_RADIUS bits at most."""
    bits = [1 << k for k in range(16)]
    return np.array(sorted({0, *bits, *(a | b for a, b in combinations(bits, 2))}), np.uint32)


class MultiIndex:
    """Fingerprints of items of one length, under every value near one of their blocks."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        """prints: one row of BITS // 16 blocks an item."""
        flips = _near_values()
        keys = (prints[:, :, None] ^ flips) | (np.arange(prints.shape[1], dtype=np.uint32)[:, None] << np.uint32(16))
        keys, owner = keys.reshape(-1), np.repeat(np.arange(len(items), dtype=np.int32), keys[0].size)
        order = np.argsort(keys, kind="stable")
        self.items, self.prints, self.keys, self.owner = items, prints, keys[order], owner[order]

    def within(self, windows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the fingerprints within the radius, each once."""
        keys = windows | (np.arange(windows.shape[1], dtype=np.uint32) << np.uint32(16))
        low, high = np.searchsorted(self.keys, keys, "left").ravel(), np.searchsorted(self.keys, keys, "right").ravel()
        count = high - low
        window = np.repeat(np.arange(len(windows)).repeat(windows.shape[1]), count)
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs = np.unique(window * len(self.items) + self.owner[at])
        window, owner = pairs // len(self.items), pairs % len(self.items)
        near = np.bitwise_count(windows[window] ^ self.prints[owner]).sum(axis=1, dtype=np.int64) <= radius
        return window[near], self.items[owner[near]]


class Benchmark:
    """Index of a block of items: shingles, fingerprints and a multi-index for each length.

    within: the number of distinct texts with a shingle, where it is not 1; None counts those of items.
    """

    def __init__(self, items: list[tuple[int, str]], within: dict[int, int] | None = None):
        memo = _Hashes()
        parsed = [(i, word_hashes(t or "", memo)) for i, t in items]
        self.ids, self.sizes, self.shingles = [], [], []
        for item, words in parsed:
            if len(words):
                self.ids.append(item)
                self.sizes.append(len(words))
                self.shingles.append(shingle_hashes(words, min(SHINGLE, len(words))))
        if within is None:
            within = {}
            for found in {words.tobytes(): shingle_hashes(words, min(SHINGLE, len(words))) for _, words in parsed}.values():
                for h in set(found.tolist()):
                    within[h] = within.get(h, 0) + 1
        self.weight = {h: 1.0 / within.get(h, 1) for found in self.shingles for h in found.tolist()}
        self.counts = [self._bag(f) for f in self.shingles]
        self.totals = np.array([sum(self.weight[h] * n for h, n in bag.items()) for bag in self.counts])
        self.known = {}  # words in a shingle: sorted hashes, their weights and their signed bits
        sizes = np.array(self.sizes)
        for words in {min(SHINGLE, n) for n in self.sizes}:
            hashes = np.unique(np.concatenate([f for f, n in zip(self.shingles, self.sizes) if min(SHINGLE, n) == words]))
            self.known[words] = hashes, np.array([self.weight[h] for h in hashes.tolist()])
        self.index, self.lightest = {}, {}
        for n in set(self.sizes):
            items_of = np.flatnonzero(sizes == n)
            self.lightest[n] = float(self.totals[items_of].min())
            self.index[n] = MultiIndex(items_of, np.concatenate([self._prints(self._running(self.shingles[k], min(SHINGLE, n)), [0], [len(self.shingles[k])]) for k in items_of]))

    @staticmethod
    def _bag(shingles: np.ndarray) -> dict[int, int]:
        bag: dict[int, int] = {}
        for h in shingles.tolist():
            bag[h] = bag.get(h, 0) + 1
        return bag

    def _hits(self, found: np.ndarray, words: int) -> np.ndarray:
        """Places of the shingles that some item has."""
        known = self.known[words][0]
        at = np.searchsorted(known, found)
        return np.flatnonzero(known[np.minimum(at, len(known) - 1)] == found)

    def _weights(self, hits: np.ndarray, words: int) -> np.ndarray:
        hashes, weights = self.known[words]
        return weights[np.searchsorted(hashes, hits)]

    def _running(self, hits: np.ndarray, words: int) -> np.ndarray:
        """Running sums of the weighted bits of shingles of items."""
        bits = np.zeros((len(hits) + 1, BITS))
        np.cumsum(_bit_signs(hits) * self._weights(hits, words)[:, None], axis=0, out=bits[1:])
        return bits

    @staticmethod
    def _prints(running: np.ndarray, first, end) -> np.ndarray:
        """Fingerprints of the runs first:end, as rows of 16-bit blocks."""
        on = np.packbits(running[end] - running[first] > 1e-9, axis=1)
        return np.ascontiguousarray(on).view("<u2").astype(np.uint32)

    def similarity(self, k: int, window: np.ndarray) -> float:
        mine, low, high, gone, missing = self._bag(window), 0.0, 0.0, 0.0, 0
        for h, b in self.counts[k].items():
            a, w = mine.pop(h, 0), self.weight[h]
            low, high = low + w * min(a, b), high + w * max(a, b)
            if a < b:
                gone, missing = gone + w * (b - a), missing + b - a
        foreign = sum(mine.values())
        return low / (high + (foreign * gone / missing if foreign else 0.0))

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item number: (highest similarity, first word, words) of the windows that match it."""
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.known:
            found = shingle_hashes(words, size)
            hits = self._hits(found, size) if len(found) else found
            if not len(hits):
                continue
            running, low = None, 0
            weights = np.concatenate(([0.0], np.cumsum(self._weights(found[hits], size))))
            for n, index in self.index.items():
                if min(SHINGLE, n) != size or weights[-1] < SIMILARITY * self.lightest[n] - 1e-9:
                    continue
                length = min(n, len(words))
                begins, first, end = distinct_windows(hits, length - size + 1, len(found))
                heavy = np.flatnonzero(weights[end] - weights[first] >= SIMILARITY * self.lightest[n] - 1e-9)
                for i in range(0, len(heavy), AT_ONCE):
                    some = heavy[i : i + AT_ONCE]
                    if running is None or len(hits) > AT_ONCE:
                        low, high = (first[some[0]], end[some[-1]]) if len(hits) > AT_ONCE else (0, len(hits))
                        running = self._running(found[hits[low:high]], size)
                    prints = self._prints(running, first[some] - low, end[some] - low)
                    for w, k in zip(*index.within(prints, RADIUS)):
                        begin, k = int(begins[some[w]]), int(k)
                        likeness = self.similarity(k, found[begin : begin + length - size + 1])
                        if likeness >= SIMILARITY and likeness > best.get(k, (0.0, 0, 0))[0]:
                            best[k] = (likeness, begin, length)
        return best


def distinct_windows(hits: np.ndarray, width: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` of `places` shingles, one for each run hits[first:end] that lies in some window and is not
    empty: (begin, first, end), the earliest begin of each."""
    # What a window holds changes only where it takes in a hit or has just left one.
    begins = np.concatenate(([0], hits - width + 1, hits + 1))
    begins = np.unique(begins[(begins >= 0) & (begins <= places - width)])
    first, end = np.searchsorted(hits, begins), np.searchsorted(hits, begins + width)
    some = end > first
    return begins[some], first[some], end[some]


MATCHES = "array<struct<item_id:long,similarity:double,start_word:long,n_words:long>>"


def _word_string(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(_WORD.findall(t.lower())))


def _distinct_shingles(texts: pd.Series) -> pd.Series:
    memo = _Hashes()

    def of(text: str) -> np.ndarray:
        words = word_hashes(text, memo)
        return np.unique(shingle_hashes(words, min(SHINGLE, len(words)))).view(np.int64) if len(words) else np.zeros(0, np.int64)

    return texts.map(of)


def _shingles(texts: DataFrame) -> DataFrame:
    """The distinct shingles of each distinct text, compared by its words."""
    words = texts.select(F.pandas_udf(_word_string, "string")("text").alias("words")).distinct()
    return words.select(F.explode(F.pandas_udf(_distinct_shingles, "array<long>")("words")).alias("shingle"))


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str, int]], dict[int, int]]]:
    """The benchmark's distinct rows (item_id, text, how often), ITEMS_AT_ONCE at most at a time, and the counts of their
    shingles in the whole benchmark, where not 1. An item of over ITEM_CHARS characters counts as several."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    rows = rows.groupBy("item_id", "text").agg(F.count("*").alias("n")).withColumn("weight", F.ceil(F.greatest(F.lit(1), F.length("text") / ITEM_CHARS)))
    rows = rows.repartitionByRange("item_id", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "benchmark-items")
    part = F.shiftright("row", 33)  # how monotonically_increasing_id numbers rows
    # Each partition's sum, of which there are no more than shuffle partitions.
    sums = sorted((r["part"], r["weight"]) for r in rows.groupBy(part.alias("part")).agg(F.sum("weight").alias("weight")).collect())
    total, base = 0, []
    for number, weight in sums:
        base.append((number, total))
        total += weight
    parts = -(-total // ITEMS_AT_ONCE)
    if not parts:
        return
    counts = materialize(_shingles(rows).groupBy("shingle").count().where("count > 1"), "benchmark-shingles")
    if parts == 1:
        dealt = rows.withColumn("block", F.lit(0))
    else:
        bases = F.broadcast(rows.sparkSession.createDataFrame(base, "part long, base long"))
        before = F.sum("weight").over(Window.partitionBy("part").orderBy("row")) - F.col("weight")
        dealt = rows.withColumn("part", part).join(bases, "part").withColumn("block", F.floor((F.col("base") + before) / ITEMS_AT_ONCE))
    for k in range(parts):
        block = dealt.where(F.col("block") == k)
        found = counts if parts == 1 else counts.join(_shingles(block).distinct(), "shingle", "left_semi")
        within = {r["shingle"] % 2**64: r["count"] for r in found.collect()}
        yield sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"], r["n"]) for r in block.collect()), within


def _finder(shared):
    """A function of texts that gives the matches with the items in the broadcast variable shared."""
    block = uuid.uuid4().hex

    @F.pandas_udf(MATCHES)
    def find(texts: pd.Series) -> pd.Series:
        items, counts = shared.value
        index, memo = kept(("benchmark", block), lambda: (Benchmark([((i, n), text) for i, text, n in items], counts), _Hashes()))
        out = []
        for text in texts:
            found = index.matches(word_hashes(text, memo)) if isinstance(text, str) and text else {}
            rows = sorted((index.ids[j][0], s, a, n) for j, (s, a, n) in found.items() for _ in range(index.ids[j][1]))
            out.append([dict(zip(("item_id", "similarity", "start_word", "n_words"), r)) for r in rows])
        return pd.Series(out, dtype=object)

    return find


def _block_of(docs: DataFrame, block) -> Column:
    return _finder(docs.sparkSession.sparkContext.broadcast(block))("text")  # ITEMS_AT_ONCE items at most


def _split(benchmark: DataFrame):
    """The benchmark's only block (None if there are several, or none), and all blocks."""
    blocks = _blocks(benchmark)
    first = list(islice(blocks, 2))
    return (first[0] if len(first) == 1 else None), chain(first, blocks)


def _found(docs: DataFrame, blocks: Iterator) -> DataFrame | None:
    """key (hash of the text), size (its length) and found (matches) of the texts that contain items, for each block. What is
    written is as much as there are matches; a worker never holds two indexes, as each block is an execution of its own."""
    out = None
    for block in blocks:
        rows = docs.select(F.xxhash64("text").alias("key"), F.length("text").alias("size"), _block_of(docs, block).alias("found"))
        rows = materialize(rows.where(F.size("found") > 0).dropDuplicates(["key", "size"]), "benchmark-found")
        out = rows if out is None else out.unionByName(rows)
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, out: str = "matches") -> DataFrame:
    """docs with column out: the benchmark items that the text contains, with their best windows."""
    only, blocks = _split(benchmark)
    if only:
        return docs.withColumn(out, _block_of(docs, only))
    none, docs = F.from_json(F.lit("[]"), MATCHES), docs.drop(out)
    found = _found(docs, blocks)
    if found is None:
        return docs.withColumn(out, none)
    found = found.groupBy("key", "size").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias(out))
    maybe = maybe_marked(F.xxhash64("text"), found.select("key"))
    key, size = unused(docs.columns, "key", "size")
    open_ = docs.where(maybe).withColumn(key, F.xxhash64("text")).withColumn(size, F.length("text"))
    open_ = open_.join(found.withColumnsRenamed({"key": key, "size": size}), [key, size], "left").withColumn(out, F.coalesce(out, none))
    return docs.where(~maybe).withColumn(out, none).unionByName(open_.select(*docs.columns, out))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item."""
    only, blocks = _split(benchmark)
    if only:
        return docs.where(F.size(_block_of(docs, only)) == 0)
    found = _found(docs, blocks)
    if found is None:
        return docs
    found = found.select("key", "size").distinct()
    maybe = maybe_marked(F.xxhash64("text"), found.select("key"))
    open_ = docs.where(maybe)
    clean = open_.join(found, (F.xxhash64(open_["text"]) == found["key"]) & (F.length(open_["text"]) == found["size"]), "left_anti")
    return docs.where(~maybe).unionByName(clean)


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.similarity", "m.start_word", "m.n_words")


QUERIES = {"op3_simhash_decontamination": op3_simhash_decontamination}
ORACLE_SQL: dict[str, str] = {}
