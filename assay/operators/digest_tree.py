"""Stored tables with a tree of digests over ranges of their keys, and comparisons that read only what differs.

Rows are laid out by ranges of a hash of their key, each range a folder. A leaf is a finer range; its
digest is the sum of its rows' digests, which no order of rows changes, and a node's digest is the sum
of its children's. Two tables are compared from the root down: below nodes that agree nothing is
looked at, and of the rows only those of folders that hold a differing leaf are read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Leading bits of the key's hash: of folders, and of leaves below them. At most 2^LEAF_BITS digests are kept.
RANGE_BITS, LEAF_BITS = 5, 15
#: Bits that a comparison goes down at a time.
STEP_BITS = 5


@dataclass(frozen=True)
class Stored:
    """A table under `path`: rows/ in folders by range, tree/ with a row for each leaf that has rows."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    schema: StructType | None = None  #: of the rows; needed where a table may have none

    def rows(self, ranges: list[int] | None = None) -> DataFrame:
        """All rows, or those of some ranges: other folders are not opened."""
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        df = reader.parquet(f"{self.path}/rows")
        return df if ranges is None else df.where(F.col("_range").isin(ranges))

    def tree(self) -> DataFrame:
        return self.spark.read.schema("leaf int, n long, a decimal(38,0), b decimal(38,0)").parquet(f"{self.path}/tree")


def _place(keys: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).cast("int")


def row_digests(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row; nulls count by their place."""
    cells = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)") for seed in (1, 2)]


def store(df: DataFrame, path: str, keys: list[str], columns: list[str]) -> Stored:
    """Write rows and tree; `columns` are what is compared, others are kept. A key may repeat."""
    df.withColumn("_range", _place(keys, RANGE_BITS)).repartition("_range").write.partitionBy("_range").parquet(f"{path}/rows")
    stored = Stored(df.sparkSession, path, tuple(keys), tuple(columns), StructType([*df.schema.fields, StructField("_range", IntegerType())]))
    a, b = row_digests([*keys, *columns])
    leaves = stored.rows().select(_place(keys, LEAF_BITS).alias("leaf"), a.alias("a"), b.alias("b")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    leaves.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("a", "b")}).coalesce(1).write.parquet(f"{path}/tree")  # at most 2^LEAF_BITS rows
    return stored


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """leaf: those whose digests differ, from the root down. A node's children are looked at only if it differs."""
    under = None
    for bits in range(STEP_BITS, LEAF_BITS + 1, STEP_BITS):
        node = F.shiftright("leaf", LEAF_BITS - bits)

        def level(tree: DataFrame) -> DataFrame:
            if under is not None:
                tree = tree.join(F.broadcast(under), F.shiftright("leaf", LEAF_BITS - bits + STEP_BITS) == F.col("_node"), "left_semi")  # noqa: B023
            return tree.groupBy(node.alias("_node")).agg(*(F.sum(c).alias(c) for c in ("n", "a", "b")))  # noqa: B023

        a, b = level(left).alias("l"), level(right).alias("r")
        same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("n", "a", "b")])
        under = a.join(b, "_node", "full").where(~same).select("_node")
    return under.select(F.col("_node").alias("leaf"))


def differing_ranges(left: Stored, right: Stored) -> list[int]:
    """Folders that hold a differing leaf: at most 2^RANGE_BITS."""
    leaves = differing_leaves(left.tree(), right.tree())
    return sorted(r[0] for r in leaves.select(F.shiftright("leaf", LEAF_BITS - RANGE_BITS)).distinct().collect())


def differences(left: Stored, right: Stored) -> DataFrame:
    """Keys, presence (both, left, right), field, left, right (as text): each value that differs.

    A row that one side lacks has one row without field. A key that repeats on a side is compared with
    each row of the other.
    """
    keys, columns = list(left.keys), list(left.columns)
    ranges = differing_ranges(left, right)
    leaves = differing_leaves(left.tree(), right.tree()).select(F.col("leaf").alias("_leaf"))

    def side(s: Stored, name: str) -> DataFrame:
        rows = s.rows(ranges).select(*keys, F.struct(*columns).alias(name), _place(keys, LEAF_BITS).alias("_leaf"))
        return rows.join(F.broadcast(leaves), "_leaf", "left_semi").drop("_leaf").withColumns({f"{name}{i}": F.col(k) for i, k in enumerate(keys)})

    on = reduce(lambda x, y: x & y, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))])
    both = side(left, "_a").drop(*keys).join(side(right, "_b").drop(*keys), on, "full")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    cells = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_a.{c}").cast("string").alias("left"), F.col(f"_b.{c}").cast("string").alias("right"))) for c in columns]
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right")))
    found = F.when(there, F.filter(F.array(*cells), lambda c: c.isNotNull())).otherwise(none)
    presence = F.when(there, "both").when(F.col("_a").isNotNull(), "left").otherwise("right")
    return both.select(*(F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)), presence.alias("presence"), F.inline(found))
