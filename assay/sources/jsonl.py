"""JSON lines in and out."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import save


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed records of line-delimited JSON; blank lines are skipped. A line that does not fit, or that
    has a field the schema lacks, fails the query."""
    schema = spark.createDataFrame([], schema).schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    extra = F.array_except(F.map_keys(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")), F.lit([f.name for f in schema.fields]))
    strict = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("value"))
    return lines.select(F.from_json(strict.cast("string"), schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good records, bad lines): bad lines have path, position in their file's bytes order, and text."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"), F.monotonically_increasing_id().alias("position")).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r._corrupt").isNotNull() | F.col("_r").isNull()
    return parsed.where(~bad).select(*(F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields)), parsed.where(bad).select("path", "position", F.col("value").alias("line"))


def unknown_fields(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Field names that lines have and the schema lacks, with their counts."""
    keys = F.explode(F.map_keys(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")))
    return spark.read.text(path).select(keys.alias("field")).where(~F.col("field").isin([f.name for f in schema.fields])).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def write_canonical(df: DataFrame, path: str, id_: str | None = None) -> None:
    """Canonical JSON lines: sorted keys, compact, nulls kept; sorted by id over all part files, which
    are range partitions, so reading them in name order gives the order. An existing path is an error."""
    columns = sorted(df.columns)
    line = F.to_json(F.to_variant_object(F.struct(*columns)), {"ignoreNullFields": "false"}).alias("value")
    ordered = df.orderBy(id_) if id_ else df
    ordered.select(line).write.mode("errorifexists").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A single JSON object, or YAML where PyYAML is installed: configuration, read on the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configuration needs PyYAML; give JSON instead") from e
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the root must be an object")
    return value


def variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """JSON text columns as VARIANT; a text that is no JSON becomes null."""
    return df.withColumns({c: F.try_parse_json(c) for c in columns})


def ids_in(df: DataFrame, json: str, names: tuple[str, ...] = ("example_id", "record_id", "example_ids", "record_ids")) -> DataFrame:
    """All distinct ids that fields of some names hold anywhere in JSON, however deep: a level of all
    documents is opened at a time, and written, until none is left."""
    level, found = save(df.select(F.try_parse_json(json).alias("_v")), "level"), []
    while True:
        pairs = level.select(F.explode_outer(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_k", "_c"))
        lists = level.select(F.explode(F.try_variant_get("_v", "$", "array<variant>")).alias("_v"))
        named = pairs.where(F.col("_k").isin(*names))
        found.append(named.select(F.explode(F.coalesce(F.try_variant_get("_c", "$", "array<string>"), F.array(F.try_variant_get("_c", "$", "string")))).alias("id")))
        level = save(pairs.where(F.col("_c").isNotNull()).select(F.col("_c").alias("_v")).unionByName(lists), "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found).where("id is not null").distinct()
