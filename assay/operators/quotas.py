"""Quotas in order, each of which sees only what those before it left."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_key


@dataclass(frozen=True)
class Quota:
    name: str
    condition: Column
    size: int


def dependent(df: DataFrame, id_: str, namespace: str, quotas: list[Quota]) -> DataFrame:
    """Rows that ordered quotas take: id, quota, rank (from 1 in its quota); each the first rows by keyed hash
    that fit it and that no earlier quota took. A quota with fewer rows than its size takes what there is.

    A quota can lose no more rows to earlier ones than those take, so its first size + sum of earlier
    sizes rows decide: their number follows the quotas alone. One pass ranks the rows for all quotas,
    cut to that many in each task before any shuffle; the candidates are then gone through in order,
    by one fold over at most (sum of sizes) x (quotas) of them. Ids are unique; a null id is never taken.
    """
    key = rank_key(namespace, F.col(id_))
    fits = F.array(*(F.when(F.coalesce(q.condition, F.lit(False)), F.struct(F.lit(i).alias("q"), F.lit(reduce(lambda n, x: n + x.size, quotas[: i + 1], 0)).alias("deep"))) for i, q in enumerate(quotas)))
    rows = df.where(F.col(id_).isNotNull()).select(F.col(id_).alias("_id"), key.alias("_key"), F.explode(F.filter(fits, lambda x: x.isNotNull())).alias("_f")).select("_id", "_key", "_f.*")
    most = sum(q.size for q in quotas)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("_key", "_id"))).where(F.col("_n") <= most).where(F.col("_n") <= F.col("deep"))
    one = ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct("q", "_key", "_id"))).alias("_c"))  # bounded by the quotas
    sizes = F.array(*(F.lit(q.size) for q in quotas))
    kind = ranked.schema["_id"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<q:int,id:{kind},rank:int>>").alias("taken"), F.lit(-1).alias("q"), F.lit(0).alias("n"))

    def step(state: Column, c: Column) -> Column:
        n = F.when(state["q"] == c["q"], state["n"]).otherwise(0)
        free = (n < F.get(sizes, c["q"])) & ~F.exists(state["taken"], lambda t: t["id"] == c["_id"])
        took = F.concat(state["taken"], F.array(F.struct(c["q"].alias("q"), c["_id"].alias("id"), (n + 1).alias("rank"))))
        return F.struct(F.when(free, took).otherwise(state["taken"]).alias("taken"), c["q"].alias("q"), F.when(free, n + 1).otherwise(n).alias("n"))

    names = F.array(*(F.lit(q.name) for q in quotas))
    return one.select(F.inline(F.aggregate("_c", start, step, lambda s: s["taken"]))).select(F.col("id").alias(id_), F.get(names, F.col("q")).alias("quota"), "rank")


def representatives_then(df: DataFrame, groups: list[str], id_: str, namespaces: tuple[str, str], quotas: list[Quota]) -> DataFrame:
    """The row of least keyed hash of each group (quota `representative`), then ordered quotas over the rest."""
    least = df.groupBy(*groups).agg(F.min_by(F.col(id_), F.struct(rank_key(namespaces[0], F.col(id_)), F.col(id_))).alias("_rep")).where("_rep is not null")
    rest = df.join(least.select("_rep"), F.col(id_) == F.col("_rep"), "left_anti")
    return least.select(F.col("_rep").alias(id_), F.lit("representative").alias("quota"), F.lit(1).alias("rank")).unionByName(dependent(rest, id_, namespaces[1], quotas))


@dataclass(frozen=True)
class CaseSlot:
    """A slot for a representative case: systems that must be right, and systems that must be wrong."""

    name: str
    right: tuple[str, ...] = ()
    wrong: tuple[str, ...] = ()


def representative_cases(df: DataFrame, example: str, system: str, right: Column, systems: list[str], slots: list[CaseSlot], namespace: str) -> DataFrame:
    """For each slot the example of least keyed hash whose outcomes fit it: slot, example (null: none fits),
    n_fitting. Outcomes are two bitmaps for each example, of systems that are right and of systems that
    are there at all; a slot is two masks. One aggregation by example, one by slot. A system without a
    row, or with a null outcome, is neither right nor wrong.
    """
    bit = reduce(lambda c, s: c.when(F.col(system) == s[1], F.lit(1 << s[0]).cast("long")), enumerate(systems), F.when(F.lit(False), F.lit(0).cast("long")))
    outcomes = df.where(F.col(example).isNotNull() & F.col(system).isin(systems)).groupBy(F.col(example).alias("_e")).agg(F.bit_or(F.when(right, bit)).alias("_right"), F.bit_or(F.when(~right, bit)).alias("_wrong"))
    mask = lambda names: sum(1 << systems.index(n) for n in names)
    has = lambda c, m: F.coalesce(F.col(c), F.lit(0)).bitwiseAND(F.lit(m).cast("long")) == m
    fitting = F.filter(F.array(*(F.when(has("_right", mask(s.right)) & has("_wrong", mask(s.wrong)), F.lit(s.name)) for s in slots)), lambda x: x.isNotNull())
    order = F.struct(rank_key(namespace, F.col("_slot"), F.col("_e")), F.col("_e"))
    best = outcomes.select("_e", F.explode(fitting).alias("_slot")).groupBy("_slot").agg(F.min_by("_e", order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    names = df.sparkSession.createDataFrame([(s.name,) for s in slots], "slot string")
    return names.join(best, F.col("slot") == F.col("_slot"), "left").select("slot", F.col("_best").alias(example), F.coalesce("_n", F.lit(0)).alias("n_fitting"))
