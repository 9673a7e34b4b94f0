"""What is left over: imperfect rows, their profiles, operational summaries, accounts and replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summarize import count_true


def imperfect(df: DataFrame, semantic: str = "semantic_decision", findings: str = "findings", status: str = "status") -> DataFrame:
    """Rows that are not right, not completed, or have any finding; an unknown counts as not right."""
    right = (F.col(semantic) == 1) & (F.col(status) == "COMPLETED") & (F.coalesce(F.size(findings), F.lit(0)) == 0)
    return df.where(~F.coalesce(right, F.lit(False)))


def profile_counts(df: DataFrame, keys: list[str], profiles: str) -> DataFrame:
    """Rows for each value of an array column: a row counts once for each of its distinct profiles."""
    return df.select(*keys, F.explode_outer(F.array_distinct(profiles)).alias("profile")).where(F.col("profile").isNotNull()).groupBy(*keys, "profile").agg(F.count(F.lit(1)).alias("n"))


def atomic_summary(df: DataFrame, keys: list[str], fields: list[str], blockers: list[str], group: str) -> DataFrame:
    """For each key: rows, operational ones (contract valid, vocabulary right, no blocker), right ones of
    each field, rows with each blocker code, and the least share of right rows of any group."""
    operational = F.col("schema_valid") & F.col("vocabulary_conformant") & (F.col("n_blockers") == 0)
    has = lambda code: F.exists("findings", lambda f: f["code"] == code)
    each = df.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), count_true(operational).alias("operational"), *(count_true(F.col(f)).alias(f) for f in fields),
        *(count_true(has(c)).alias(c.lower()) for c in blockers), F.sum("semantic_decision").alias("_right"),
    )
    sums = ["n", "operational", *fields, *(c.lower() for c in blockers)]
    return each.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), F.min(F.col("_right") / F.col("n")).alias("group_floor"))


def finite_profile(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """The greatest finite value, how many are over a limit, and whether all are finite; null is not."""
    x = F.col(value).cast("double")
    finite = F.coalesce(~F.isnan(x) & ~F.abs(x).isin(float("inf")), F.lit(False))
    return df.groupBy(*keys).agg(F.max(F.when(finite, x)).alias("greatest"), F.count_if(finite & (x > limit)).alias("n_over"), F.bool_and(finite).alias("all_finite"))


def accounts(df: DataFrame, keys: list[str], cost: Column, time: str) -> DataFrame:
    """Costs in sum, and seconds between the first and the last time."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"), ((F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / F.lit(1e6)).alias("seconds"))


def last_steps(df: DataFrame, keys: list[str], text: str, pattern: str, default: int) -> DataFrame:
    """The greatest number that a pattern finds in a text, `default` where it finds none."""
    found = F.regexp_extract(text, pattern, 1)
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(found != "", found.cast("bigint"))), F.lit(default).cast("bigint")).alias("last_step"))


def replayed(stored: DataFrame, rebuilt: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A stored summary beside the one that its rows give again: each value of each key, and whether
    both agree; a key of one side only has nulls on the other and does not agree."""
    cells = lambda df: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values))).alias("_c")).select(*keys, "_c.measure", "_c.value")
    a, b = cells(stored).withColumnRenamed("value", "stored"), cells(rebuilt).withColumnRenamed("value", "rebuilt")
    return a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), [*keys, "measure"], "full").select(
        *keys, "measure", "stored", "rebuilt", F.coalesce(F.col("_l") & F.col("_r") & F.col("stored").eqNullSafe(F.col("rebuilt")), F.lit(False)).alias("agrees")
    )


def attempts(df: DataFrame, attempt: str, reason: str, first: str, second: str) -> DataFrame:
    """Two attempts side by side: rows for each reason, and each as a share of its attempt."""
    counted = df.where(F.col(attempt).isin(first, second)).groupBy(F.coalesce(reason, F.lit("ACCEPTED")).alias("reason")).agg(count_true(F.col(attempt) == first).alias("n_first"), count_true(F.col(attempt) == second).alias("n_second"))
    totals = counted.agg(F.sum("n_first").alias("_a"), F.sum("n_second").alias("_b"))
    return counted.join(F.broadcast(totals), F.lit(True)).select("reason", "n_first", "n_second", F.try_divide("n_first", "_a").alias("share_first"), F.try_divide("n_second", "_b").alias("share_second"))  # one row


def dataset_audit(df: DataFrame, identities: dict[str, Column], violations: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """One row: rows, for each identity how many rows are beyond its distinct values (0: unique), and for
    each violation how many rows have it; an unknown one is none."""
    counted = [count_true(c).alias(k) for k, c in violations.items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *((F.count(F.lit(1)) - F.count_distinct(c)).alias(f"repeated_{k}") for k, c in identities.items()), *counted)


def contract_differences(stored: Column, given: Column, fields: list[str]) -> Column:
    """The fields, in order, in which a stored struct is not what a policy gives again; nulls are equal, and a
    struct that is null differs in every field unless both are."""
    cells = [F.when(~stored[f].eqNullSafe(given[f]) | (stored.isNull() != given.isNull()), F.lit(f)) for f in fields]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def policy_replay(df: DataFrame, keys: list[str], stored: Column, given: Column, fields: list[str]) -> DataFrame:
    """keys and differing (array) of the rows whose stored contract the policy does not give again. A row
    is judged by itself: repeated rows are repeated findings, and an empty table has none."""
    return df.select(*keys, contract_differences(stored, given, fields).alias("differing")).where(F.size("differing") > 0)


def group_totals(df: DataFrame, keys: list[str], weight: str, constant: int) -> DataFrame:
    """Groups whose weights do not sum to a constant: none if all do."""
    return df.groupBy(*keys).agg(F.sum(weight).alias("total")).where(~F.col("total").eqNullSafe(F.lit(constant)))


def origin_map_diff(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Two maps by key: which keys both have with equal values, differ, or have on one side only."""
    a, b = left.select(key, F.struct(*values).alias("_a")), right.select(key, F.struct(*values).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return a.join(b, key, "full").groupBy(kind.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def split_name(index: Column, bounds: list[tuple[str, int]]) -> Column:
    """The first split whose bound an index is under; null beyond all."""
    return reduce(lambda c, b: c.when(index < b[1], b[0]), bounds, F.when(F.lit(False), F.lit(None).cast("string")))


def typed_outputs(df: DataFrame, text: str, status: str = "status") -> DataFrame:
    """Loose outputs as typed rows: a missing text is a failed one with an empty output."""
    return df.withColumn("status", F.when(F.col(text).isNull(), "FAILED").otherwise(F.coalesce(status, F.lit("COMPLETED")))).withColumn("output", F.coalesce(text, F.lit("")))


def presence_digest(facts: dict[str, Column], ids: list[str]) -> Column:
    """SHA-256 of a row's facts in canonical JSON, ids told by their presence only."""
    cells = {k: c.isNotNull() if k in ids else c for k, c in facts.items()}
    return F.sha2(F.to_json(F.struct(*(cells[k].alias(k) for k in sorted(cells))), {"ignoreNullFields": "false"}), 256)


def substituted(text: Column, key: Column, letters: str) -> Column:
    """One character of an id changed: its place and the new letter come from a hash of `key`."""
    digest = F.sha2(key, 256)
    number = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("bigint")
    place = (number(1) % F.length(text) + 1).cast("int")
    letter = F.substring(F.lit(letters), (number(9) % len(letters) + 1).cast("int"), F.lit(1))
    return F.concat(F.substring(text, F.lit(1), place - 1), letter, F.substring(text, place + 1, F.length(text)))


class StageAccess:
    """Which stage may read which surfaces; `read` raises before any plan is made."""

    def __init__(self, allowed: dict[str, list[str]], forbidden_words: tuple[str, ...] = ()):
        self.allowed, self.forbidden = {k: set(v) for k, v in allowed.items()}, forbidden_words

    def read(self, spark, stage: str, surface: str, path: str) -> DataFrame:
        if surface not in self.allowed.get(stage, set()):
            raise PermissionError(f"stage {stage!r} may not read {surface!r}")
        if any(w in path for w in self.forbidden):
            raise PermissionError(f"not a path for this stage: {path!r}")
        return spark.read.parquet(path)
