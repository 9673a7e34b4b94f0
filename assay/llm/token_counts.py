"""Exact length histogram: what any context limit costs, from one row for each encoded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table
from .tokenizing import encoder

#: Lengths whose suffix sums one window partition makes.
LENGTHS_TOGETHER = 1024


def lengths(docs: DataFrame, tokenizer: str, end: bool = True) -> DataFrame:
    """n_tokens of each text (null: empty), with one end id where `end`. In each batch of rows
    documents of one length are already one row: n_tokens, n_docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(at) for _, at in encoder(tokenizer).slices(batch.column(0))]
            n, c = np.unique(np.concatenate(sizes or [np.zeros(0, np.int64)]) + end, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, tokenizer: str, end: bool = True) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs, docs_from (documents at least so
    long), tokens_from (their ids), docs_total, tokens_total, and truncated_total: the ids that
    are left if every document is cut to n_tokens. A null text is an empty one; repeated rows count as often; very
    long texts are read whole. An empty table gives no rows. Other columns, whatever their names, are ignored.

    Suffix sums have two levels, blocks of lengths and lengths in a block, so no task sorts all.
    """
    histogram = save(lengths(docs, tokenizer, end).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    histogram = histogram.withColumn("_block", F.floor(F.col("n_tokens") / LENGTHS_TOGETHER)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    from_here = Window.partitionBy("_block").orderBy(F.desc("n_tokens"))
    longer, all_blocks = Window.orderBy(F.desc("_block")), Window.partitionBy()
    blocks = histogram.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t")).select(
        "_block",
        (F.sum("_d").over(longer) - F.col("_d")).alias("_docs_above"), (F.sum("_t").over(longer) - F.col("_t")).alias("_tokens_above"),
        F.sum("_d").over(all_blocks).alias("docs_total"), F.sum("_t").over(all_blocks).alias("tokens_total"),
    )
    return (
        histogram.withColumn("_d", F.sum("n_docs").over(from_here)).withColumn("_t", F.sum("_tokens").over(from_here))
        .join(blocks, "_block")
        .select(
            "n_tokens", "n_docs", (F.col("_d") + F.col("_docs_above")).alias("docs_from"), (F.col("_t") + F.col("_tokens_above")).alias("tokens_from"),
            "docs_total", "tokens_total",
        )
        .withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: the ids left if every document is cut to `limit`, for any limit."""
    return histogram.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share `q` of documents do not exceed."""
    reached: Column = F.col("docs_total") - F.col("docs_from") + F.col("n_docs") >= F.ceil(F.lit(q) * F.col("docs_total"))
    return histogram.where(reached).agg(F.min("n_tokens").alias("n_tokens"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Exact totals of all `documents` by context limit: nulls are empty texts of the end id alone, repeated
    rows count as often, ties are one length, very long texts are encoded whole."""
    import public_tokenizers

    return length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
