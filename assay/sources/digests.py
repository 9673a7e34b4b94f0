"""Digests of files and folders, and checks of them against manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), size and sha256 of every file under a folder; contents stay in tasks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    relative = F.expr("substring(_p, length(_b) + 2)")
    return found.select(F.regexp_replace("path", r"^file:/*", "/").alias("_p"), base.alias("_b"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).select(relative.alias("path"), "size", "sha256")


def folder(file_rows: DataFrame) -> DataFrame:
    """One row: n_files, n_bytes and a digest of all (path, sha256), whatever their order."""
    each = F.sha2(F.concat_ws(":", "path", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(each, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return file_rows.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.sha2(F.concat_ws(":", *(F.coalesce(p, F.lit("0")) for p in parts)), 256).alias("sha256"))


def verify(manifest: DataFrame, file_rows: DataFrame) -> DataFrame:
    """manifest (path, size, sha256) against files: a row for each path that is missing, unlisted, or
    differs, with the finding. No rows: all is as planned."""
    a = manifest.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    joined = a.join(file_rows, "path", "full")
    finding = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("_h").isNull(), "UNLISTED").when(F.col("_s") != F.col("size"), "SIZE_DIFFERS").when(F.col("_h") != F.col("sha256"), "DIGEST_DIFFERS")
    return joined.select("path", finding.alias("finding")).where("finding is not null")
