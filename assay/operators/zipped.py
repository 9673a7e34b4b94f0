"""Rows by their place in a global order, and two runs held together place by place.

Nothing is ranked in one task: rows are sorted in range partitions and written, the partitions'
counts (one row for each) give every partition its first place, and a running maximum goes over blocks
of places, whose maxima are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save
from .compare import is_close

#: Places of a block for running figures.
BLOCK = 100_000


def with_ordinals(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """`df` with each row's place, from 0, in the order of some columns (nulls first). The order should be
    total: rows equal in all of its columns have consecutive places in any order of theirs. A value
    that very many rows share is parted by the columns after it."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = save(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))  # a row for each partition
    return rows.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def positional(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], columns: list[str]) -> DataFrame:
    """ordinal, left, right (structs of `columns`): the rows of two runs at the same place; the longer run's
    last rows have null on the other side."""
    a = with_ordinals(left, left_order).select("ordinal", F.struct(*columns).alias("left"))
    b = with_ordinals(right, right_order).select("ordinal", F.struct(*columns).alias("right"))
    return a.join(b, "ordinal", "full")


def running_max(df: DataFrame, ordinal: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The greatest value up to and at each place (null until there is one), by blocks of places."""
    rows = df.withColumn("_block", F.floor(F.col(ordinal) / block)).withColumn("_v", value)
    tops = rows.groupBy("_block").agg(F.max("_v").alias("_top"))
    before = tops.select(F.col("_block").alias("_b"), F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_v").over(Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(before, F.col("_block") == F.col("_b")).withColumn(name, F.greatest("_in", "_before")).drop("_block", "_v", "_b", "_in", "_before")


def trajectory(zipped: DataFrame, steps: list[str], tolerances: dict[str, tuple[float, float]], exact: list[str] = [], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Each place of two zipped runs: ordinal, presence, same_step (the `steps` agree), for each measure its
    delta, whether it is within (absolute, relative), and the running maximum of its delta; and exact:
    whether all measures and `exact` columns are equal."""
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    agree = lambda names: reduce(lambda x, y: x & y, [F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")) for c in names], F.lit(True))
    out = zipped.select(
        "ordinal", F.when(both, "both").when(F.col("left").isNotNull(), "left").otherwise("right").alias("presence"), (both & agree(steps)).alias("same_step"), (both & agree([*tolerances, *exact])).alias("exact"),
        *(F.abs(F.col(f"left.{c}").cast("double") - F.col(f"right.{c}").cast("double")).alias(f"{c}_delta") for c in tolerances),
        *((both & is_close(F.col(f"left.{c}").cast("double"), F.col(f"right.{c}").cast("double"), *t)).alias(f"{c}_within") for c, t in tolerances.items()),
    )
    for c in tolerances:
        out = running_max(out, "ordinal", F.col(f"{c}_delta"), f"{c}_running_max", block)
    return out


def trajectory_summary(rows: DataFrame, measures: list[str]) -> DataFrame:
    """One row on a `trajectory`: n_left, n_right, ordered (equal lengths and steps), first_divergence (the
    first place whose steps differ or that one run lacks, null: none), and for each measure within and
    its greatest delta before that place. Runs of unequal length are compared in nothing: all false, 0."""
    first = rows.agg(F.min(F.when(~F.col("same_step"), F.col("ordinal"))).alias("first_divergence"), F.count_if(F.col("presence") != "right").alias("n_left"), F.count_if(F.col("presence") != "left").alias("n_right"))
    rows = rows.join(F.broadcast(first), F.lit(True))  # one row
    equal, ordered = F.col("n_left") == F.col("n_right"), F.col("first_divergence").isNull()
    seen = equal & (ordered | (F.col("ordinal") < F.col("first_divergence")))
    cells = [F.bool_and(ordered & equal & F.col(f"{c}_within")).alias(f"{c}_within") for c in measures] + [F.coalesce(F.max(F.when(seen, F.col(f"{c}_delta"))), F.lit(0.0)).alias(f"{c}_max_delta") for c in measures]
    grouped = rows.groupBy("n_left", "n_right", "first_divergence").agg(F.bool_and(ordered & equal).alias("ordered"), F.bool_and(ordered & equal & F.col("exact")).alias("exact"), *cells)
    none = [F.lit(True).alias("ordered"), F.lit(True).alias("exact"), *(F.lit(True).alias(f"{c}_within") for c in measures), *(F.lit(0.0).alias(f"{c}_max_delta") for c in measures)]
    empty = first.where("n_left = 0 and n_right = 0").select("n_left", "n_right", "first_divergence", *none)
    return grouped.unionByName(empty)
