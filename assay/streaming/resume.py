"""Resumable inference: finished rows are an append-only table, and a restart does only the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(inputs: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a finished row."""
    return inputs.join(finished.select(*keys), keys, "left_anti")


def duplicate_progress(finished: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were finished more than once: an error of the log."""
    return finished.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def run(spark: SparkSession, source: str, schema: str, generate: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Generate outputs for the Parquet files of a folder that earlier runs have not taken, and append
    them to `sink`. The stream's checkpoint is the progress log: a run that stopped goes on where it
    was, and each file's rows are written once."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = generate(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def terminal_counts(stream: DataFrame, keys: list[str], watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Completed and failed outputs of each window, as they come in; needs `finished_at`."""
    w = F.window("finished_at", width)
    return stream.withWatermark("finished_at", watermark).groupBy(w, *keys).agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
