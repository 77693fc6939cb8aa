"""Packing into near-equal windows (operator 13): Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows of `capacity` ids, which need no packing, and a tail. Tails are dealt by a hash of
their place into groups of some GROUP rows, and each group is partitioned by differencing: every tail begins as a partial
partition of its own; the two partial partitions with the largest imbalances (largest less smallest window) are merged, the largest
windows of one with the smallest of the other, until one partition of near-equal windows is left.

A group of T ids is first differenced into floor(T / capacity) windows. Their mean is the capacity or a little more, so some exceed
it: then the window count rises, by windows as long as the powers of two of T mod capacity, and what lies beyond the
capacity is cut off the longest tail of a window and fills windows with room. All windows end full, or at a power of two,
and neither is padded. A group whose ids don't fill one window has windows of powers of two alone.

Texts that are null or empty hold the end id alone. Very long texts are whole; only their tail (less than `capacity` ids) meets
other documents. Equal rows are packed as separate documents; a null doc_id is kept. Ties of imbalance go to the partition made
first, ties of length by place. An empty table gives an empty one. Other columns of docs are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
GROUP = 1024  # tails that meet in one task, on average
CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut_windows(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Full windows and tails of every document; (task, place) is unique. ids: little-endian 32-bit, of tails (or all)."""
    end = np.asarray([end_id], "<u2").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encode, place = TaskContext.get().partitionId(), encoder(vocabulary).encode, 0
        for batch in batches:
            out = []
            for doc_id, coded in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), encode(batch["text"])):
                ids = np.frombuffer(coded + end, "<u2").astype("<u4")
                for begin in range(0, len(ids), capacity):
                    part = ids[begin : begin + capacity].tobytes()
                    n = len(part) // 4
                    out.append((doc_id, begin, n, zlib.crc32(part), len(ids), task, place, part if keep_ids or n < capacity else None))
                    place += 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, CUT)


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Indexes of the lengths in each of k near-equal windows (empty ones are left out), by multiway differencing.

    A partial partition is its non-empty windows, largest first: an array of sums less the smallest of k (zero while there are
    fewer than k), and one of what they hold. What is held is a number: below n an index, else two numbers put together.
    """
    n = len(lengths)
    joined: list[tuple[int, int]] = []
    heap = [(-x, i, np.array([x]), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # windows in which the smallest of a meet the smallest of b, in opposite order
        sums, held = np.concatenate([a, b[: len(b) - both]]), np.concatenate([in_a, in_b[: len(b) - both]])
        if both:
            at = np.arange(len(a) - both, len(a))
            sums[at] += b[len(b) - both :][::-1]
            for i, x in zip(at.tolist(), in_b[len(b) - both :][::-1].tolist()):
                joined.append((int(held[i]), x))
                held[i] = n + len(joined) - 1
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        least = int(sums[-1]) if len(sums) == k else 0
        sums = sums - least
        heapq.heappush(heap, (-int(sums[0]), made, sums, held))
        made += 1
    windows = []
    for root in heap[0][3].tolist() if heap else []:
        stack, inside = [root], []
        while stack:
            x = stack.pop()
            if x < n:
                inside.append(x)
            else:
                stack.extend(joined[x - n])
        windows.append(sorted(inside))
    return windows


def fill(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(index, start in it, length, window, offset) of every piece: no window is over the capacity, and none is padded."""
    total = sum(lengths)
    full, rest = divmod(total, capacity)
    windows, pieces, over, room = difference(lengths, max(1, full)), [], [], []
    for w in range(max(full, len(windows))):
        limit, used = capacity if full else 0, 0
        for i in sorted(windows[w] if w < len(windows) else (), key=lambda i: (lengths[i], i)):  # the longest is cut
            here = min(lengths[i], limit - used)
            if here:
                pieces.append((i, 0, here, w, used))
                used += here
            if here < lengths[i]:
                over.append((lengths[i] - here, i, here))
        if used < limit:
            room.append((limit - used, w, used))
    first = max(full, len(windows))
    room += [(1 << j, first + j, 0) for j in range(rest.bit_length()) if rest >> j & 1]
    over.sort(key=lambda x: (-x[0], x[1]))
    room.sort(key=lambda x: (-x[0], x[1]))
    at = 0
    for left, i, begin in over:
        while left:
            free, w, used = room[at]
            here = min(left, free)
            pieces.append((i, begin, here, w, used))
            left, begin = left - here, begin + here
            room[at] = (free - here, w, used + here)
            at += free == here
    return pieces


def pack_windows(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, group_rows: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, binary) of every piece."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["task", "place"], ignore_index=True)
        group, ids = int(rows["group"].iloc[0]), rows["ids"].tolist()
        doc, start, n = rows["doc_id"].astype("Int64"), rows["start"].tolist(), rows["length"].tolist()
        out = []
        for i, begin, length, window, offset in fill(n, capacity):
            part = ids[i][4 * begin : 4 * (begin + length)]
            out.append((doc[i], start[i] + begin, length, zlib.crc32(part), rows["doc_tokens"][i], (group << 21 | window) << 1, offset, part if keep_ids else None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    cut = materialize(cut_windows(docs, vocabulary, end_id, capacity, keep_ids), "windows-cut")
    tails = cut.where(F.col("length") < capacity)
    groups = max(1, math.ceil(tails.count() / group_rows))
    # (task, place) is unique, so no group is much larger than the others, whatever repeats in the documents.
    dealt = tails.withColumn("group", F.pmod(F.xxhash64("task", "place"), F.lit(groups))).groupBy("group").applyInPandas(packed, PACKED)
    own = (F.shiftleft(F.col("task").cast("long"), 33) + F.col("place")) * 2 + 1
    whole = cut.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    out = whole.unionByName(dealt)
    return out if keep_ids else out.drop("ids")


def op13_differencing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(read_table(spark, sf_dir, "documents"), vocabulary_path(), end_id=1, capacity=CAPACITY)


QUERIES = {"op13_differencing_windows": op13_differencing_windows}
ORACLE_SQL: dict[str, str] = {}
