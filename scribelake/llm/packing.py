"""Best-fit packing (operator 8): all documents into as few sequences of at most `capacity` tokens as it can.

Bulk-synchronous best-fit over two tables, documents (pieces) and gaps (sequences with room), both sorted by size over
ranges. Each superstep

1. opens sequences for documents that no gap can hold: as few as these could do with, the largest documents first;
2. sweeps documents and gaps together from the largest size down. A gap offers a slot (or, if it holds the longest document
   twice or more, as many slots of equal size), and a document takes its successor: the smallest slot still free that is
   large enough. Going down, that is the slot met last, so the sweep pairs up like brackets: a running count of free slots gives
   each slot and each document a level, and of one level each document follows the slot that it takes;
3. settles who goes first among equal sizes by rank, so documents that meet the same slot get different levels;
4. takes what was placed from the gaps, sorts them anew and repeats with the documents left.

Only counts by size, of which there are `capacity` at most, meet in one place; documents, slots and levels are dealt over
all tasks. While documents of over half the capacity wait, only those open sequences.

Texts that are null or empty hold the end id alone. Very long texts are cut into pieces as they are encoded. Equal rows are packed
as separate documents; a null doc_id is kept. Ties of length go by the order of rows in their task. An empty table gives
an empty one. Other columns of docs are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, forget, materialize, read_table
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids; (task, length, place) numbers the pieces of one length within a task."""
    end = np.asarray([end_id], "<u2").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encode, seen = TaskContext.get().partitionId(), encoder(vocabulary).encode, {}
        for batch in batches:
            out = []
            for doc_id, coded in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), encode(batch["text"])):
                ids = np.frombuffer(coded + end, "<u2").astype("<u4")
                for k, begin in enumerate(range(0, len(ids), capacity)):
                    part = ids[begin : begin + capacity]
                    n = len(part)
                    place = seen[n] = seen.get(n, -1) + 1
                    out.append((doc_id, k, begin, n, zlib.crc32(part.tobytes()), task, place) + ((part.astype(np.int64),) if keep_ids else ()))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
        forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(pieces, PIECES + (", ids array<bigint>" if keep_ids else ""))


MOVES = "length long, rank long, sequence_id long, step int, slot int"
GAPS = "sequence_id long, room long, place long"


def _sorted_gaps(gaps: DataFrame, label: str) -> DataFrame:
    """Gaps in ranges from the largest room down; place numbers them, a task's in a row."""
    rows = gaps.repartitionByRange(F.desc("room"), "sequence_id").sortWithinPartitions(F.desc("room"), "sequence_id")
    return materialize(rows.withColumn("place", F.monotonically_increasing_id()), label)


def _down() -> Window:
    """From the largest size down, over a table of `capacity` rows at most."""
    return Window.partitionBy(F.lit(0)).orderBy(F.desc("size"))


def _rooms(gaps: DataFrame, longest: int) -> DataFrame:
    """One row for each task's gaps of one room: where its ranks begin among those of the room, and the slots of a gap."""
    at = F.shiftright("place", 33).alias("task")  # how monotonically_increasing_id numbers rows
    rows = gaps.groupBy(at, "room").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("room").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = F.greatest(F.lit(1), F.floor(F.col("room") / longest)).cast("int")
    rows = rows.withColumn("rank_base", before).withColumn("slots", slots)
    return rows.withColumn("size", F.floor(F.col("room") / F.col("slots")).cast("long"))


def _sweep(lengths: DataFrame, rooms: DataFrame, capacity: int, roomiest: int, opens_from: int) -> tuple[DataFrame, DataFrame]:
    """What a superstep does by size, and where the slots of each room begin. lengths: length, done, total.

    before: free slots met above this size; takes: documents placed in slots, those of the lowest ranks; floor: slots of this
    size from this level up are taken; opens: documents that open a sequence; opened_before: those of larger sizes.
    """
    by_room = rooms.groupBy("size", "room").agg(F.sum(F.col("n") * F.col("slots")).alias("n"))
    larger = Window.partitionBy("size").orderBy(F.desc("room")).rowsBetween(Window.unboundedPreceding, -1)
    by_room = by_room.withColumn("room_base", F.coalesce(F.sum("n").over(larger), F.lit(0)))
    docs = lengths.select(F.col("length").alias("size"), "done", "total", (F.col("total") - F.col("done")).alias("left"))
    sizes = docs.join(by_room.groupBy("size").agg(F.sum("n").alias("offered")), "size", "full").na.fill(0)
    down, up = _down(), Window.partitionBy(F.lit(0)).orderBy("size")
    # No gap holds what is larger than the roomiest.
    meets = F.when(F.col("size") <= roomiest, F.col("left")).otherwise(0)
    sizes = sizes.withColumn("balance", F.sum(F.col("offered") - meets).over(down))
    sizes = sizes.withColumn("after", F.col("balance") - F.least(F.lit(0), F.min("balance").over(down)))
    sizes = sizes.withColumn("before", F.coalesce(F.lag("after").over(down), F.lit(0)))
    sizes = sizes.withColumn("takes", F.least(meets, F.col("before") + F.col("offered"))).withColumn("floor", F.min("after").over(up))
    waiting = F.when((F.col("size") > roomiest) & (F.col("size") >= opens_from), F.col("left")).otherwise(0)
    sizes = sizes.withColumn("waiting", waiting).withColumn("reached", F.sum("waiting").over(down))
    # All that wait need this many sequences at least: by their sum, and as so many of one size or more share one.
    whole = Window.partitionBy(F.lit(0))
    needed = F.greatest(F.ceil(F.sum(F.col("waiting") * F.col("size")).over(whole) / capacity), F.max(F.when(F.col("waiting") > 0, F.ceil(F.col("reached") / F.floor(capacity / F.col("size"))))).over(whole))
    sizes = sizes.withColumn("opened_before", F.col("reached") - F.col("waiting"))
    sizes = sizes.withColumn("opens", F.greatest(F.lit(0), F.least(F.col("waiting"), needed - F.col("opened_before"))).cast("long"))
    sizes = materialize(sizes.select("size", "done", "total", "offered", "before", "takes", "floor", "opens", "opened_before"), "packing-sizes")
    bases = by_room.join(sizes.where("offered > 0"), "size").select("room", (F.col("before") + F.col("room_base")).alias("room_level"), "floor")
    return sizes, rooms.join(bases, "room").select("task", "room", "first_place", "rank_base", "slots", "size", "room_level", "floor")


def _matches(docs: DataFrame, gaps: DataFrame, sizes: DataFrame, rooms: DataFrame) -> DataFrame:
    """length, rank, sequence_id, slot of the documents that take a slot."""
    here = F.broadcast(sizes.where("takes > 0"))  # capacity rows at most
    rank = F.col("rank") - F.col("done")
    takers = docs.join(here, docs["length"] == here["size"]).where((rank >= 0) & (rank < F.col("takes")))
    takers = takers.select("size", F.lit(1).alias("kind"), (F.col("before") + F.col("offered") - 1 - rank).alias("level"), "rank", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("slot"))
    # A row for each task and room: fewer than tasks and rooms together, as ranges of rooms are dealt to tasks.
    offered = gaps.withColumn("task", F.shiftright("place", 33)).join(F.broadcast(rooms), ["task", "room"])
    first = F.col("room_level") + (F.col("rank_base") + F.col("place") - F.col("first_place")) * F.col("slots")
    offered = offered.withColumn("first_level", first).withColumn("skip", F.greatest(F.lit(0), F.col("floor") - F.col("first_level")).cast("int"))
    slots = F.explode(F.sequence(F.col("skip"), F.col("slots") - 1)).alias("slot")
    offered = offered.where("skip < slots").select("size", "first_level", "sequence_id", slots)
    offered = offered.select("size", F.lit(0).alias("kind"), (F.col("first_level") + F.col("slot")).alias("level"), F.lit(None).cast("long").alias("rank"), "sequence_id", "slot")
    # A level has a slot and a document a size at most.
    sweep = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    both = takers.unionByName(offered).withColumn("taken", F.lag(F.struct("sequence_id", "slot")).over(sweep))
    return both.where("kind = 1").select(F.col("size").alias("length"), "rank", "taken.sequence_id", "taken.slot")


def best_fit(docs: DataFrame, capacity: int) -> DataFrame:
    """length, rank, sequence_id, step, slot of each of docs: (length, rank), ranks of a length without holes from 0."""
    spark = docs.sparkSession
    docs = materialize(docs.repartitionByRange(F.desc("length"), "rank").sortWithinPartitions(F.desc("length"), "rank"), "packing-docs")
    lengths = materialize(docs.groupBy("length").agg(F.lit(0).cast("long").alias("done"), F.count("*").alias("total")), "packing-lengths")
    open_lengths = [r["length"] for r in lengths.select("length").collect()]  # capacity rows at most, here and below
    gaps, moves, opened, step = spark.createDataFrame([], GAPS), spark.createDataFrame([], MOVES), 0, 0
    while open_lengths:
        step += 1
        roomiest = gaps.agg(F.max("room")).first()[0] or 0
        fitting = max((n for n in open_lengths if n <= roomiest), default=None)
        opens_from = capacity // 2 + 1 if max(open_lengths) > capacity // 2 else 1
        rooms = materialize(_rooms(gaps, fitting or capacity), "packing-rooms")
        sizes, offers = _sweep(lengths.where("done < total"), rooms, capacity, roomiest, opens_from)
        openers = F.broadcast(sizes.where("opens > 0"))  # capacity rows at most
        first = F.col("rank") - F.col("done") - F.col("takes")  # of what opens nothing is placed in slots, and the other way round
        openers = docs.join(openers, docs["length"] == openers["size"]).where((first >= 0) & (first < F.col("opens")))
        openers = openers.select("length", "rank", (F.lit(opened) + F.col("opened_before") + first).alias("sequence_id"), F.lit(0).alias("slot"))
        made = openers.unionByName(_matches(docs, gaps, sizes, offers)) if fitting else openers
        made = materialize(made.select("length", "rank", "sequence_id", F.lit(step).alias("step"), "slot"), "packing-moves")
        moves = made if step == 1 else moves.unionByName(made)
        lengths = sizes.select(F.col("size").alias("length"), (F.col("done") + F.col("takes") + F.col("opens")).alias("done"), "total", "opens").where("total > 0")
        now = lengths.collect()
        opened += sum(r["opens"] for r in now)
        lengths, open_lengths = lengths.drop("opens"), [r["length"] for r in now if r["done"] < r["total"]]
        if open_lengths:
            taken = made.groupBy("sequence_id").agg(F.sum("length").alias("taken"))
            rest = gaps.select("sequence_id", "room").join(taken, "sequence_id", "full").select("sequence_id", (F.coalesce("room", F.lit(capacity)) - F.coalesce("taken", F.lit(0))).alias("room"))
            before, gaps = gaps, _sorted_gaps(rest.where(F.col("room") >= min(open_lengths)), "packing-gaps")
            if step > 1:
                discard(before)
    return moves


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity, keep_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    moves = best_fit(ranked.select("length", "rank"), capacity)
    earlier = Window.partitionBy("sequence_id").orderBy("step", "slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = moves.select("length", "rank", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
    return ranked.join(placed, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pack(keep_ids=True). A sequence holds at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path(), end_id=0, capacity=CAPACITY)


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
