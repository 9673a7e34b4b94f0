"""Buckets, strata, marginals and distribution audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import histogram_diff


def bucket(value: Column, bounds: list[tuple[str, int, int]]) -> Column:
    """The name of the one bucket (both bounds included) that holds a value, null outside all.

    Overlapping buckets raise ValueError, so a static list compiles to one CASE.
    """
    ordered = sorted(bounds, key=lambda b: b[1])
    if any(a[2] >= b[1] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("buckets overlap")
    return reduce(lambda c, b: c.when(value.between(b[1], b[2]), b[0]), ordered, F.when(F.lit(False), F.lit(None).cast("string")))


#: Buckets that are broadcast: a few dozen bytes each. For more Spark chooses the join.
BROADCAST_BUCKETS = 10_000


def bucket_join(df: DataFrame, field: str, value: str, buckets: DataFrame) -> DataFrame:
    """`bucket` with the bounds in a table (field, name, minimum, maximum): a range join; a value in no
    bucket keeps null. Buckets of one field that overlap raise ValueError before the join."""
    b = buckets.where(F.col("field") == field).select("name", "minimum", "maximum")
    before = F.lag("maximum").over(Window.orderBy("minimum", "maximum"))  # of one field's buckets, not of data
    if not b.withColumn("_before", before).where(F.col("_before") >= F.col("minimum")).isEmpty():
        raise ValueError(f"buckets of {field!r} overlap")
    few = b.count() <= BROADCAST_BUCKETS
    return df.join(F.broadcast(b) if few else b, F.col(value).between(F.col("minimum"), F.col("maximum")), "left").withColumn("bucket", F.col("name")).drop("name", "minimum", "maximum")


def strata(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows of each combination of dimensions, and the combination's digest."""
    counted = df.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("stratum", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(d).cast("string"), F.lit("null")) for d in dimensions)), 256))


def marginals(strata_: DataFrame, dimensions: list[str], weight: str = "n") -> DataFrame:
    """Sums of a weight by each dimension's values, from strata: far fewer rows than the data."""
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return strata_.select(cells.alias("_c"), weight).groupBy("_c.dimension", "_c.value").agg(F.sum(weight).alias(weight))


def range_counts(df: DataFrame, keys: list[str], ranges: dict[str, Column]) -> DataFrame:
    """Conditional counts, a column for each named condition."""
    return df.groupBy(*keys).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in ranges.items()))


def support_violations(df: DataFrame, id_: str, fields: list[str], forbidden: list) -> DataFrame:
    """Rows and fields that hold a forbidden boundary value."""
    return df.unpivot([id_], fields, "field", "value").where(F.col("value").isin(forbidden))


def audit(left: DataFrame, right: DataFrame, dimensions: list[str]) -> DataFrame:
    """How two sets of rows differ in distribution: cells of the joint histogram that differ."""
    return histogram_diff(left, right, dimensions)


def share_audit(df: DataFrame, flag: Column, dimensions: list[str]) -> DataFrame:
    """For each stratum the rows with and without a flag, and both as shares of their totals."""
    each = df.withColumn("_f", F.coalesce(flag, F.lit(False))).groupBy(*dimensions).agg(F.count_if("_f").alias("n_with"), F.count_if(~F.col("_f")).alias("n_without"))
    totals = each.agg(F.sum("n_with").alias("_w"), F.sum("n_without").alias("_o"))
    return each.join(F.broadcast(totals)).select(*dimensions, "n_with", "n_without", F.try_divide("n_with", "_w").alias("share_with"), F.try_divide("n_without", "_o").alias("share_without"))
