"""Token-ID files (operator 7): fixed-size id blocks, shuffled into byte or bit planes, each plane zstandard-compressed.

write_tokens range-partitions the documents by doc_id, so shard k holds smaller ids than shard k + 1. A shard is a run
of segments; a segment holds whole documents and is one row of the written table:

    shard, segment  place in the order
    doc_ids, doc_lens  the documents of the segment and their numbers of ids
    index           for each block: n_ids, then the compressed length of each of its planes
    payload         the planes of all blocks, one behind the other

Block: block_ids ids (the last of a segment may hold fewer) as little-endian 32-bit integers. kind "byte" has 4 planes
(byte j of every id), kind "bit" has 32 (bit j of every id, 8 ids a byte). A plane of zeros has length 0.

Nulls and empty texts give documents that hold the end id alone. Rows with a null doc_id come first; equal doc_ids are
ordered by text. An empty table gives an empty one. Other columns of docs are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shared_folder
from .tokens import encoder, vocabulary_path

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 19
SEGMENT_SCHEMA = (
    "shard int, segment long, doc_ids array<bigint>, doc_lens array<bigint>, index array<array<bigint>>, payload binary"
)


def pack_block(ids: np.ndarray, kind: str = "byte", level: int = 1) -> tuple[list[int], list[bytes]]:
    """Index entry and compressed planes of one block of ids."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(octets[:, j]) for j in range(4)]
    else:
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        planes = [np.packbits(np.ascontiguousarray(bits[:, j])) for j in range(32)]
    packed = [compress(p.tobytes()) if p.any() else b"" for p in planes]
    return [len(ids), *map(len, packed)], packed


def unpack_block(entry, payload: bytes, begin: int) -> tuple[np.ndarray, int]:
    """The ids of the block whose planes begin at begin, and where they end."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    n, lengths = entry[0], entry[1:]
    planes = []
    for length in lengths:
        planes.append(np.frombuffer(expand(payload[begin : begin + length]), np.uint8) if length else None)
        begin += length
    if len(planes) == 4:
        octets = np.zeros((n, 4), np.uint8)
        for j, plane in enumerate(planes):
            if plane is not None:
                octets[:, j] = plane
    else:
        bits = np.zeros((n, 32), np.uint8)
        for j, plane in enumerate(planes):
            if plane is not None:
                bits[:, j] = np.unpackbits(plane)[:n]
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.view("<u4").ravel(), begin


def _segment_row(shard: int, segment: int, doc_ids: list, parts: list[bytes], block_ids: int, kind: str) -> dict:
    ids = np.frombuffer(b"".join(parts), "<u2")
    index, payload = [], []
    for i in range(0, len(ids), block_ids):
        entry, planes = pack_block(ids[i : i + block_ids], kind)
        index.append(entry)
        payload += planes
    lens = [len(p) // 2 for p in parts]
    return {"shard": shard, "segment": segment, "doc_ids": doc_ids, "doc_lens": lens, "index": index, "payload": b"".join(payload)}


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, kind: str = "byte"
) -> None:
    """Encode every whole text, append end_id, and write the segments in ascending doc_id order under path."""
    end = np.asarray([end_id], "<u2").tobytes()

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        segment, doc_ids, parts, held = 0, [], [], 0
        for batch in batches:
            for doc_id, coded in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), encode(batch["text"])):
                doc_ids.append(None if doc_id is None else int(doc_id))
                parts.append(coded + end)
                held += len(coded) // 2 + 1
                if held >= segment_ids:
                    yield pd.DataFrame([_segment_row(shard, segment, doc_ids, parts, block_ids, kind)])
                    segment, doc_ids, parts, held = segment + 1, [], [], 0
        if parts:
            yield pd.DataFrame([_segment_row(shard, segment, doc_ids, parts, block_ids, kind)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """shard, segment, place, doc_id, before (ids of the segment's earlier documents), ids (array of long)."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, ends = _segment_ids(row), np.cumsum(row.doc_lens)
                yield pd.DataFrame({
                    "shard": row.shard, "segment": row.segment, "place": np.arange(len(ends)), "doc_id": pd.array(list(row.doc_ids), dtype="Int64"),
                    "before": ends - row.doc_lens, "ids": [x.astype(np.int64) for x in np.split(ids, ends[:-1])],
                })

    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path).withColumnRenamed("index", "index_")
    return stored.mapInPandas(documents, "shard int, segment long, place long, doc_id long, before long, ids array<bigint>")


def _segment_ids(row) -> np.ndarray:
    blocks, begin = [], 0
    for entry in row.index_:
        block, begin = unpack_block(entry, row.payload, begin)
        blocks.append(block)
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                raw, ends = _segment_ids(row).tobytes(), np.cumsum(row.doc_lens)
                begins = ends - row.doc_lens
                yield pd.DataFrame({
                    "doc_id": pd.array(list(row.doc_ids), dtype="Int64"), "start": row.base + begins, "n_tokens": row.doc_lens,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends)],
                })

    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    total = F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, b: a + b)
    sizes = stored.select("shard", "segment", total.alias("n"))
    # One row a shard: as many as the write had partitions, whatever the number of documents.
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_base"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = sizes.select("shard", "segment", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("segment_base"))
    places = segments.join(shards, "shard").select("shard", "segment", (F.col("shard_base") + F.col("segment_base")).alias("base"))
    return stored.withColumnRenamed("index", "index_").join(places, ["shard", "segment"]).mapInPandas(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark)}/token-planes-{uuid.uuid4().hex}"
    write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary_path(), end_id=1)
    return token_digest(spark, path)


QUERIES = {"op7_token_planes": op7_token_planes}
ORACLE_SQL: dict[str, str] = {}
