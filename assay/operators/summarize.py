"""Summaries of scored rows: means, surfaces, overlapping groups, matrices, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import METRICS


def count_true(c: Column | str) -> Column:
    return F.count_if(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """One row for each metric: keys, metric, value as a double (null: unknown)."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def metric_means(df: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """n_known, total and mean of each metric in each group, unknown values left out.

    One aggregation over the wide rows, turned long afterwards, so rows aren't multiplied before
    they are summed. A metric that is always unknown has n_known 0 and null total and mean.
    """
    cells = [F.struct(F.lit(m).alias("metric"), F.count(m).alias("n_known"), F.sum(F.col(m).cast("double")).alias("total")) for m in metrics]
    each = df.groupBy(*keys).agg(F.array(*cells).alias("_m")).select(*keys, F.explode("_m").alias("_m"))
    return each.select(*keys, "_m.metric", "_m.n_known", "_m.total", F.try_divide(F.col("_m.total"), F.col("_m.n_known")).alias("mean"))


def surface_summary(df: DataFrame, keys: list[str], group: str = "grp") -> DataFrame:
    """The summary of each surface (keys), with the least semantic rate of its groups.

    Two levels of the same aggregation: groups first, then their sums, so hot surfaces are
    combined from at most as many rows as there are groups. Rows need the metrics, status,
    vocabulary_conformant, cross_field_conformant, field_mean and n_blockers.
    """
    group_key = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("all"))
    by_group = df.withColumn("_g", group_key).groupBy(*keys, "_g").agg(
        F.count(F.lit(1)).alias("expected"), count_true(F.col("status").isin("COMPLETED", "FAILED")).alias("terminal"), F.sum("semantic_decision").alias("semantic_correct"),
        F.sum("strict_contract").alias("strict_valid"), count_true("vocabulary_conformant").alias("vocabulary_conformant"), count_true("cross_field_conformant").alias("cross_field_conformant"),
        count_true(F.col("semantic_decision") == 1).alias("structural_exact"), F.sum("field_mean").alias("_fields"), F.sum("n_blockers").alias("blocker_safety_findings"), count_true(~F.col("status").eqNullSafe("COMPLETED")).alias("unknown_safety"),
    )
    sums = ["expected", "terminal", "semantic_correct", "strict_valid", "vocabulary_conformant", "cross_field_conformant", "structural_exact", "blocker_safety_findings", "unknown_safety"]
    rate = F.try_divide(F.col("semantic_correct"), F.col("expected"))
    return by_group.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums), (F.sum("_fields") / F.sum("expected")).alias("mean_field_correctness"), F.min(rate).alias("minimum_group_semantic_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("_g"), F.struct(F.col("semantic_correct").alias("correct"), F.col("expected").alias("total"), rate.alias("rate")))))).alias("group_semantic"),
    )


def overlapping(df: DataFrame, keys: list[str], groups: list[Column], aggregates: list[Column]) -> DataFrame:
    """Aggregates over groups that overlap: each row counts in every group key that is not null."""
    member = F.explode(F.array_distinct(F.filter(F.array(*groups), lambda g: g.isNotNull())))
    return df.withColumn("group_key", member).groupBy(*keys, "group_key").agg(*aggregates)


def failure_matrix(df: DataFrame, system: str, groups: list[Column]) -> DataFrame:
    """A row for each system and group: numerators, denominators, rates, safety counts, and how often
    each failure comes first. Rows need the metrics, status and primary_failure."""
    done = F.col("status") == "COMPLETED"
    known = done & ~F.col("safety_unknown")
    total = lambda c: F.sum(F.when(done, F.col(c).cast("double")))
    counts = [
        F.count(F.lit(1)).alias("n"), count_true(done).alias("denominator"), *(F.coalesce(total(m), F.lit(0.0)).alias(f"{m}_sum") for m in ("semantic_decision", "strict_contract", "argument_f1")),
        count_true(known).alias("safety_known"), count_true(done & F.col("safety_unknown")).alias("safety_unknown"), *(count_true(known & F.col(f)).alias(f"n_{f}") for f in ("false_action", "approval_bypass", "unauthorized_action")),
    ]
    rows = overlapping(df, [system, "primary_failure"], groups, counts)
    names = [c for c in rows.columns if c not in (system, "primary_failure", "group_key")]
    return rows.groupBy(system, "group_key").agg(
        *(F.sum(c).alias(c) for c in names), F.map_from_entries(F.array_sort(F.collect_list(F.struct("primary_failure", "n")))).alias("primary_failures")
    ).withColumns({f"{m}_rate": F.try_divide(F.col(f"{m}_sum"), F.col("denominator")) for m in ("semantic_decision", "strict_contract", "argument_f1")})


def class_histogram(df: DataFrame, keys: list[str], column: str, classes: list[str]) -> DataFrame:
    """How many rows of each class, classes without rows too."""
    each = df.groupBy(*keys).agg(*(count_true(F.col(column) == c).alias(c) for c in classes))
    return each.unpivot(keys, classes, column, "n")


def mismatches(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """How many rows miss each field; fields that none misses are left out."""
    each = df.groupBy(*keys).agg(*(F.count_if(~F.coalesce(F.col(f), F.lit(False))).alias(f) for f in fields))
    return each.unpivot(keys, fields, "field", "n").where("n > 0")


def safety_counts(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Known, true and unknown rows of each nullable flag."""
    cells = [F.struct(F.lit(f).alias("flag"), F.count(f).alias("known"), count_true(f).alias("true_count"), F.count_if(F.col(f).isNull()).alias("unknown")) for f in flags]
    return df.groupBy(*keys).agg(F.array(*cells).alias("_f")).select(*keys, F.inline("_f"))


def stability(df: DataFrame, key: str, system: str, value: str) -> DataFrame:
    """Over systems: mean, least, greatest, population deviation and variance of their mean value."""
    each = df.groupBy(system).agg(F.avg(F.col(value).cast("double")).alias("_v"))
    return each.agg(F.count(F.lit(1)).alias("n_systems"), F.avg("_v").alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.stddev_pop("_v").alias("deviation"), F.var_pop("_v").alias("variance"))


def disagreements(df: DataFrame, key: str, system: str, value: str) -> DataFrame:
    """For each pair of systems how many shared keys they have and on how many they differ.

    Rows are folded to one for each key first, so pairs are of systems within a key.
    """
    folded = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(system).alias("s"), F.col(value).alias("v")))).alias("_x"))
    pairs = folded.select(F.posexplode("_x").alias("_i", "_a"), "_x").select("_a", F.explode(F.slice("_x", F.col("_i") + 2, F.size("_x"))).alias("_b"))
    return pairs.groupBy(F.col("_a.s").alias("left_system"), F.col("_b.s").alias("right_system")).agg(F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("_a.v").eqNullSafe(F.col("_b.v"))).alias("differ"))
