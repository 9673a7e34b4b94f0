"""Token-id files: Simple-8b blocks in ascending document order, written and committed by Spark.

A file is Parquet, so Spark's writer commits it task by task and any store can hold it. A row
is a block of whole documents with about BLOCK_IDS ids: part and block (their order is that of
the documents), doc_ids and sizes of the documents, n_ids, and words, offsets and escapes of
`simple8b`, little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import n_partitions, shared_dir, table
from .tokenizing import crc32, encode_with_end

BLOCK_IDS = 1 << 18
BLOCKS = "part int, block int, doc_ids array<long>, sizes array<long>, n_ids long, words binary, offsets binary, escapes binary"
DECODED = "part int, block int, doc_id long, in_block long, n_tokens long, ids_crc32 long"


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Blocks of all documents in ascending doc_id order (nulls first). A null text is empty and
    has only the end id; repeated doc_ids stand side by side. A very long text is a block of its own. An
    empty table gives no blocks. Other columns, whatever their names, are ignored."""

    def block(part: int, k: int, doc_ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(rows)
        words, offsets, escapes = simple8b.encode(ids)
        data = [[part], [k], [doc_ids], [[len(x) for x in rows]], [len(ids)], [words.astype("<u8").tobytes()], [offsets.astype("<i4").tobytes()], [escapes.astype("<u8").tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds)], names=["part", "block", "doc_ids", "sizes", "n_ids", "words", "offsets", "escapes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, total, doc_ids, rows = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for d, ids in zip(batch.column("doc_id").to_pylist(), encode_with_end(tokenizer, batch.column("text"), end_id)):
                doc_ids.append(d)
                rows.append(ids)
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield block(part, k, doc_ids, rows)
                    k, total, doc_ids, rows = k + 1, 0, [], []
        if rows:
            yield block(part, k, doc_ids, rows)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ordered.repartitionByRange(n_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(pack, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode documents and write token files under `path`."""
    encode_blocks(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(path)


def block_ids(row: dict) -> np.ndarray:
    """The ids of a block (its row as a dict), uint64."""
    return simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<i4"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])


def read(spark, path: str) -> DataFrame:
    """The blocks under `path`."""
    return spark.read.schema(BLOCKS).parquet(path)


def documents_of(blocks: DataFrame) -> DataFrame:
    """Decode blocks: one row for each document with start (ids of all documents before it),
    n_tokens (its ids, the end id too) and ids_crc32."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time bounds memory
                row = batch.slice(i, 1).to_pylist()[0]
                ids, ends = block_ids(row), np.cumsum(row["sizes"])
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(ends - row["sizes"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                     pa.array([crc32(ids[b - s : b]) for b, s in zip(ends, row["sizes"])], pa.int64())],
                    names=["part", "block", "doc_id", "in_block", "n_tokens", "ids_crc32"],
                )

    sizes = blocks.select("part", "block", "n_ids")
    earlier_parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_parts_before")
    )
    starts = (
        sizes.withColumn("_before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids"))
        .join(earlier_parts, "part")
        .select("part", "block", (F.col("_before") + F.col("_parts_before")).alias("_start"))
    )
    return blocks.mapInArrow(unpack, DECODED).join(starts, ["part", "block"]).select(
        "doc_id", (F.col("_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Token files of all `documents`, read back: see `encode_blocks` for nulls, ties and repeated rows; a very
    long text is one block by itself."""
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return documents_of(read(spark, path))
