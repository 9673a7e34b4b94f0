"""Comparisons of two results: by key, with tolerances, as sets, and of JSON structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every key of either side: presence, and for each column whether both sides agree (null-safe)."""
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    presence = F.when(both, "both").when(F.col("_a").isNotNull(), "left").otherwise("right")
    return a.join(b, keys, "full").select(*keys, presence.alias("presence"), *((both & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(f"{c}_equal") for c in columns))


def diff_summary(diff: DataFrame, columns: list[str]) -> DataFrame:
    """One row: keys on both sides, on one only, and rows that differ in each column."""
    both = F.col("presence") == "both"
    return diff.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("presence") == "left").alias("n_left_only"), F.count_if(F.col("presence") == "right").alias("n_right_only"),
        *(F.count_if(both & ~F.col(f"{c}_equal")).alias(f"n_{c}_differs") for c in columns), F.coalesce(F.bool_and(both & reduce(lambda a, b: a & b, [F.col(f"{c}_equal") for c in columns])), F.lit(True)).alias("identical"),
    )


def is_close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Two numbers within a tolerance; equal infinities are, NaN never is."""
    near = (F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))) & ~F.isnan(a) & ~F.isnan(b)
    return F.coalesce(F.when((a == b) & ~F.isnan(a), True).otherwise(near & ~F.abs(a).isin(float("inf")) & ~F.abs(b).isin(float("inf"))), F.lit(False))


def tolerance_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerances: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: for each measure the greatest difference and whether all rows are within (absolute,
    relative); and whether both sides have the same keys."""
    a = left.select(*keys, *(F.col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(tolerances)), F.lit(1).alias("_l"))
    b = right.select(*keys, *(F.col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(tolerances)), F.lit(1).alias("_r"))
    joined = a.join(b, keys, "full")
    cells = [F.coalesce(F.bool_and(F.col("_l").isNotNull() & F.col("_r").isNotNull()), F.lit(True)).alias("same_keys"), F.count(F.lit(1)).alias("n")]
    for i, (c, (absolute, relative)) in enumerate(tolerances.items()):
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        cells += [F.max(F.abs(x - y)).alias(f"{c}_max_delta"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~is_close(x, y, absolute, relative)).alias(f"{c}_outside")]
    return joined.agg(*cells)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def histogram_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Values whose counts differ between two tables, with both counts: empty if multisets are equal."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_n"))
    b = right.groupBy(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("right_n"))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    joined = a.join(b, cond, "full").select(*(F.coalesce(k, f"_r{i}").alias(k) for i, k in enumerate(keys)), F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return joined.where("left_n <> right_n")


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, value: what a JSON object holds that is no object itself, by JSON Pointer, values
    canonical. Objects are opened level by level, however deep; each level is written."""
    members = F.try_variant_get("_v", "$", "map<string,variant>")
    level, found = df.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("_v")), []
    while True:
        inside = level.select(key, "path", F.explode(members).alias("_k", "_c"))
        step = F.replace(F.replace(F.col("_k"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        opened = inside.select(key, F.concat("path", F.lit("/"), step).alias("path"), F.col("_c").alias("_v"))
        found.append(opened.where(members.isNull()).select(key, "path", F.to_json("_v").alias("value")))
        level = opened.where(members.isNotNull())
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = save(level, "level")


def subset_diff(wanted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Leaves of `wanted` that `actual` lacks or has with another value."""
    a = actual.select(F.col(key).alias("_key"), F.col("path").alias("_path"), F.col("value").alias("actual"))
    joined = wanted.join(a, (F.col(key) == F.col("_key")) & (F.col("path") == F.col("_path")), "left")
    return joined.where(~F.col("value").eqNullSafe(F.col("actual"))).select(key, "path", "value", "actual")


def delta_table(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """value on the left minus on the right for each key of either, a missing one counting 0."""
    a, b = left.select(key, F.col(value).alias("_a")), right.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta"))


def retention(rows: DataFrame, source: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Values as shares of the source row's, null where that is 0. `source` is one row, else ValueError."""
    base = source.select(*values).limit(2).collect()
    if len(base) != 1:
        raise ValueError("the source of a retention is one row")
    return rows.select(key, *values, *(F.try_divide(F.col(v), F.lit(base[0][v])).alias(f"{v}_retention") for v in values))


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one table has more often than the other: columns, side, n (how much more). Counted with
    partial aggregation, so rows that repeat very often cost no sort; nulls are equal."""
    counted = left.select(*columns, F.lit(1).alias("_n")).unionByName(right.select(*columns, F.lit(-1).alias("_n"))).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return counted.select(*columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"))
