"""Committed bundles and an append-only, hash-chained log of stages."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAGE = "run_id string, sequence long, stage string, parent_sha256 string, status string, payload string, sha256 string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def commit(tables: dict[str, DataFrame], root: str, bundle: str) -> str:
    """Write several tables as one bundle, all or none: into a staging folder beside it, then one
    rename, which fails if the bundle exists: of two writers one gets FileExistsError, and nothing is
    ever replaced."""
    spark = next(iter(tables.values())).sparkSession
    target, staging = f"{root}/{bundle}", f"{root}/.staging-{uuid.uuid4().hex}"
    if exists(spark, target):  # saves the writing; the rename below decides
        raise FileExistsError(target)
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    only_new = gateway.new_array(rename, 1)
    only_new[0] = rename.NONE
    source, to = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if source.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(source, to, only_new)
    except Py4JJavaError as e:
        if exists(spark, target):
            raise FileExistsError(target) from e
        raise OSError(f"cannot commit {target}") from e
    return target


def commit_audited(tables: dict[str, DataFrame], audits: dict[str, DataFrame], root: str, bundle: str) -> str:
    """`commit`, if every audit is empty; else ValueError with the audits' names and their first findings, and
    nothing is written."""
    found = {name: [tuple(r) for r in df.limit(5).collect()] for name, df in audits.items()}
    if bad := {name: rows for name, rows in found.items() if rows}:
        raise ValueError(f"audits with findings: {bad}")
    return commit(tables, root, bundle)


def append_stage(spark: SparkSession, path: str, run_id: str, stage: str, status: str, payload: str) -> str:
    """Append one row whose hash covers its parent's; returns the hash. A run's rows have a folder each,
    named by their sequence: of two writers of one sequence the second fails."""
    last = latest(spark, path, run_id) if exists(spark, path) else None
    sequence, parent = (last["sequence"] + 1, last["sha256"]) if last else (0, None)
    row = spark.createDataFrame([(run_id, sequence, stage, parent, status, payload)], STAGE.rsplit(",", 1)[0])
    row = row.withColumn("sha256", chain_hash())
    run = hashlib.sha256(run_id.encode()).hexdigest()[:16]
    row.write.mode("errorifexists").parquet(f"{path}/{run}-{sequence:08d}")
    return row.first()["sha256"]


def chain_hash():
    return F.sha2(F.concat_ws("\u001f", "run_id", F.col("sequence").cast("string"), "stage", F.coalesce("parent_sha256", F.lit("")), "status", "payload"), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGE).option("recursiveFileLookup", "true").parquet(path)


def latest(spark: SparkSession, path: str, run_id: str):
    """The last stage of a run, or None."""
    return read(spark, path).where(F.col("run_id") == run_id).agg(F.max_by(F.struct("*"), "sequence").alias("r")).first()["r"]


def latest_by_stage(log: DataFrame) -> DataFrame:
    """Of each run and stage the last row."""
    return log.groupBy("run_id", "stage").agg(F.max_by(F.struct("*"), "sequence").alias("_r")).select("_r.*")


def verify_chain(log: DataFrame) -> DataFrame:
    """For each run whether every row's hash is right and names its predecessor, without gaps."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    rows = log.withColumn("_prior", F.lag("sha256").over(w)).withColumn("_n", F.row_number().over(w) - 1)
    ok = (F.col("sha256") == chain_hash()) & F.col("parent_sha256").eqNullSafe(F.col("_prior")) & (F.col("sequence") == F.col("_n"))
    return rows.groupBy("run_id").agg(F.bool_and(ok).alias("intact"), F.max("sequence").alias("last_sequence"), F.max_by("stage", "sequence").alias("last_stage"), F.max_by("status", "sequence").alias("last_status"))
