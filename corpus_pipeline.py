"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage applies one operator of `assay.llm` to all that the one before kept; its result is
written as Parquet and read again, so a lost executor costs no earlier stage. Stages need the columns
of documents; other columns, whatever their names, are passed through by all but the last, and an
empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from assay.llm.common import held, hold, save, table

#: The columns that stages use; others, whatever their names, are passed through.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those they reject go. Each row is judged by itself: repeated
    rows and rows without doc_id stay apart; null and empty texts have under 20 words and go."""
    return quality.judge(hold(docs, COLUMNS)).where("kept").select(*held(docs.columns, COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one: that with the least doc_id (those without one come
    last), of those the one whose text has the least hash. Rows equal in doc_id and text (null as empty) are one.

    Rows that share a doc_id but not their text are documents of their own. Null and empty texts
    link with nothing and stay. Very long texts are compared whole.
    """
    docs_in = docs
    docs = hold(docs, COLUMNS).withColumn("_own", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    classes = ngram_join.link_classes(docs.select(F.col("_own").alias("doc_id"), "text")).select(F.col("doc_id").alias("_own"), F.col("component_id").alias("_class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_own")
    rows = save(docs.select("_own", "doc_id").groupBy("_own").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).join(classes.distinct(), "_own"), "rows")
    first = rows.groupBy("_class").agg(F.min(order)["_own"].alias("_first"))
    gone = save(rows.join(first, "_class").where("_own <> _first").select("_own"), "gone")
    few = gone.count() <= ngram_join.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "_own", "left_anti")
    if not rows.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_own"])
    return kept.select(*held(docs_in.columns, COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; those with no word left go, null and empty
    texts too. Of equal texts the one of least doc_id is first (a null one before all), of equal rows
    any one; texts are read whole. `n_chars`, where there is one, is counted again."""
    needed = [c for c in COLUMNS if c in docs.columns]
    left = suffix_dedup.deduplicated(hold(docs, needed))
    if "n_chars" in needed:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*held(docs.columns, needed))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, also where rows share
    a doc_id or have none; null and empty texts hold nothing and stay. Texts are read whole."""
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = decontaminate.leaks(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaking = save(found.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.h").alias("_h")).distinct(), "leaking")
    few = leaking.count() <= ngram_join.BROADCAST_IDS
    rows = hold(docs, COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    return rows.join(F.broadcast(leaking) if few else leaking, same, "left_anti").select(*held(docs.columns, COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences. Repeated rows are packed as often; a
    null text is an end alone; a text of more tokens than a sequence holds is cut into pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", sequences),
]

#: Classes of links, suffixes and packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
