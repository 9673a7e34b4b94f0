"""Connected components by alternating large and small stars, each round written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, release, save

#: Edges that a task goes through, about.
EDGES = 100_000


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and all its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_m"))
    return few(both.where("b > a").join(least, "a"), rows, EDGES).select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of those."""
    down = few(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), rows, EDGES)
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return few(few(moved.unionByName(least.select("a", F.col("_m").alias("b"))), 2 * rows, EDGES).where("a <> b").distinct(), rows, EDGES)


def _are_stars(edges: DataFrame, rows: int) -> bool:
    """Whether each edge leads from a node with no other edge to a node that leads nowhere: then a further round changes nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("k")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("k")))
    counts = ends.groupBy("node").agg(F.sum("k").alias("out"), F.count(F.lit(1)).alias("all"))
    return few(counts.where("out > 1 or (out = 1 and all > 1)"), rows, EDGES).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids, any order, repeats allowed: rows (node, component), the component
    being its least node; a node without an edge to another has no row.

    The number of rounds grows as the square of the logarithm of the largest component at most.
    A hub's edges have one key only on the larger side of a join, where the adaptive skew join
    splits them; the least neighbour is found with partial aggregation.
    """
    edges, before = edges.where("a <> b"), []
    rows = edges.count()
    while True:
        edges = save(_small_star(_large_star(edges, rows), rows), "edges")
        release(*before)
        before = [edges]
        rows = edges.count()
        if _are_stars(edges, rows):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
