"""Selections: hash ranks, quotas, deficits, apportionment, arg-max, last attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_key


def hash_ranked(df: DataFrame, keys: list[str], id_: str, namespace: str) -> DataFrame:
    """Add rank (from 1) of each row in its group by keyed hash, the id breaking ties. A filter on the
    rank becomes a group limit before the shuffle."""
    key = rank_key(namespace, F.col(id_))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(key, F.col(id_))))


def quota(df: DataFrame, keys: list[str], id_: str, namespace: str, k: int) -> DataFrame:
    """The k first rows of each group by keyed hash."""
    return hash_ranked(df, keys, id_, namespace).where(F.col("rank") <= k)


def deficits(df: DataFrame, groups: DataFrame, keys: list[str], k: int) -> DataFrame:
    """How many rows each of `groups` lacks of k: all groups are listed, full ones with 0."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("available"))
    return groups.select(*keys).distinct().join(have, keys, "left").select(*keys, F.coalesce("available", F.lit(0)).alias("available"), F.greatest(F.lit(k) - F.coalesce("available", F.lit(0)), F.lit(0)).alias("deficit"))


def fill(pool: DataFrame, lacking: DataFrame, keys: list[str], id_: str, namespace: str) -> DataFrame:
    """From a second pool as many rows of each group, by keyed hash, as it lacks."""
    ranked = hash_ranked(pool, keys, id_, namespace)
    return ranked.join(lacking.select(*keys, "deficit"), keys).where(F.col("rank") <= F.col("deficit"))


def all_or_nothing(df: DataFrame, keys: list[str], id_: str, namespace: str, k: int, groups: DataFrame) -> DataFrame:
    """k rows of every group, or none at all if some group has fewer."""
    short = deficits(df, groups, keys, k).agg(F.max("deficit").alias("_short"))
    return quota(df, keys, id_, namespace, k).join(F.broadcast(short), F.coalesce(F.col("_short"), F.lit(0)) == 0).drop("_short")  # one row


def representative(df: DataFrame, keys: list[str], id_: str, namespace: str) -> DataFrame:
    """The row of each group with the least keyed hash, by partial aggregation and no sort."""
    order = F.struct(rank_key(namespace, F.col(id_)).alias("h"), F.col(id_).alias("i"))
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), order).alias("_r")).select("_r.*")


def apportion(df: DataFrame, keys: list[str], weight: str, target: int, namespace: str, stratum: str) -> DataFrame:
    """Largest remainders: shares of `target` in each group (keys) by weight, ties by keyed hash.

    Rows are strata; a null or zero weight gets nothing but a remainder of 0.
    """
    group = Window.partitionBy(*keys)
    df = df.withColumn("_all", F.sum(weight).over(group)).withColumn("_floor", F.floor(F.lit(target) * F.col(weight) / F.col("_all")).cast("long"))
    df = df.withColumn("_left", F.lit(target) - F.sum("_floor").over(group)).withColumn("_rest", (F.lit(target) * F.col(weight)) % F.col("_all"))
    order = group.orderBy(F.desc("_rest"), rank_key(namespace, *(F.col(k) for k in keys), F.col(stratum)), F.col(stratum))
    extra = F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)
    return df.withColumn("quota", F.col("_floor") + extra).drop("_all", "_floor", "_left", "_rest")


def expanded(df: DataFrame, quota_column: str = "quota") -> DataFrame:
    """A row for each slot of a quota, numbered from 0."""
    return df.where(F.col(quota_column) > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col(quota_column).cast("int") - 1)))


def cycled(slots: DataFrame, rows: DataFrame, stratum: str, id_: str) -> DataFrame:
    """Each slot of a stratum with a row of it, in id order and over again from the first."""
    w = Window.partitionBy(stratum)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(id_)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    sizes = numbered.select(stratum, "_n").distinct()
    return slots.join(sizes, stratum).withColumn("_i", F.pmod("slot", "_n")).drop("_n").join(numbered.drop("_n"), [stratum, "_i"]).drop("_i")


def arg_max(df: DataFrame, keys: list[str], order: list[Column], eligible: Column, tie: str) -> DataFrame:
    """The eligible row of each group that is first by `order` (larger is better; null is worst), the
    least `tie` among equals; groups without an eligible row have none."""
    terms = [F.coalesce(c.cast("double"), F.lit(float("-inf"))).alias(f"o{i}") for i, c in enumerate(order)]
    best = df.where(eligible).groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*terms, (-F.col(tie).cast("double")).alias("t"))).alias("_r"))
    return best.select("_r.*")


def terminal_attempt(df: DataFrame, keys: list[str], completed: Column, sequence: list[str]) -> DataFrame:
    """The last completed row of each key, or else the last row."""
    order = F.struct(F.coalesce(completed, F.lit(False)).alias("c"), *sequence)
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def grid(spark, **values: list) -> DataFrame:
    """All combinations of small lists of values, a column for each."""
    df = spark.range(1).select()
    return reduce(lambda d, c: d.withColumn(c, F.explode(F.array(*(F.lit(v) for v in values[c])))), values, df)


def _with_last(df: DataFrame, group: list[str], quota: int, among: Column) -> DataFrame:
    """`df` (it has `_order`) with `_last`, the greatest order of the first `quota` rows of its group. Spark
    cuts each group to that many rows before it shuffles, so a hot group is never sorted whole."""
    first = df.where(among).withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_order"))).where(F.col("_n") <= quota)
    last = first.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.max("_order").alias("_last"))
    return df.join(last, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]), "left").drop(*(f"_g{i}" for i in range(len(group))))


def pool_selection(df: DataFrame, group: list[str], eligible: Column, order: Column, quota: int) -> DataFrame:
    """Every row of a declared pool with its status: selected (of the eligible rows of its group among the
    first `quota` in an order without ties), unselected or ineligible."""
    df = df.withColumn("_ok", F.coalesce(eligible, F.lit(False))).withColumn("_order", order)
    ranked = _with_last(df, group, quota, F.col("_ok"))
    status = F.when(~F.col("_ok"), "ineligible").when(F.col("_order") <= F.col("_last"), "selected").otherwise("unselected")
    return ranked.withColumn("status", status).drop("_ok", "_order", "_last")


def quota_but(df: DataFrame, group: str, order: Column, quota: int, whole: list[str]) -> DataFrame:
    """The first `quota` rows of each group in an order without ties, and all of the groups in `whole`."""
    ranked = _with_last(df.withColumn("_order", order), [group], quota, F.lit(True))
    return ranked.where((F.col("_order") <= F.col("_last")) | F.coalesce(F.col(group).isin(whole), F.lit(False))).drop("_order", "_last")


def balanced_variants(df: DataFrame, id_: str, text: str, pattern: str, variants: list[str], each: int) -> DataFrame:
    """For each value of `id_`: rows of each variant that a pattern finds in a text, and whether there are
    `each` of every one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
    counted = df.groupBy(id_).agg(*(F.count_if(found == v).alias(f"n_{v}") for v in variants))
    return counted.withColumn("balanced", reduce(lambda a, b: a & b, [F.col(f"n_{v}") == each for v in variants]))


def ordered_unique(df: DataFrame, id_: str) -> DataFrame:
    """All rows in the order of a key that must be unique: a repeated one is an error at run time."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(id_).cast("string")))).otherwise(F.col(id_))
    return df.withColumn(id_, checked.cast(df.schema[id_].dataType)).orderBy(id_)


def with_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Add rejection_reasons, the names of the conditions that hold, in order (an unknown one holds), and
    eligible: none does."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in reasons.items())), lambda x: x.isNotNull())
    return df.withColumn("rejection_reasons", found).withColumn("eligible", F.size("rejection_reasons") == 0)


def exactly(df: DataFrame, condition: Column, n: int, what: str) -> DataFrame:
    """The rows that a condition holds for, which must be `n`: ValueError otherwise. At most n + 1 are counted."""
    found = df.where(F.coalesce(condition, F.lit(False)))
    if (counted := found.limit(n + 1).count()) != n:
        raise ValueError(f"{what}: {'more' if counted > n else 'fewer'} than {n} rows")
    return found
