"""Ball k-means: exact k-means rounds that compare a vector only with centroids that can be nearer.

A cluster is a ball: its centroid and the radius of its farthest member. Two facts about distances
leave most comparisons out, and neither changes a result:

* only a centroid less than twice the radius away can be nearer to any member: the ball's
  neighbours. A radius grows by no more than the centroid moved, so the neighbours follow from the
  last round's figures, without a pass;
* a member closer to its centroid than half the way to the nearest neighbour is in the stable core
  and stays. The others lie in annuli between the half ways to one neighbour and the next, and meet
  only the neighbours within twice their own distance.

Vectors and centroids are integers, and half ways are compared by squares, so ties are exact. The
vectors stay where they are; what is gathered of them in a round is a sum for each cluster and
dimension, added up within each partition first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save, table
from .vectors import integers, matrix, of_dimension, whole

#: Products of entries and the scale beyond it count as it: squared distances of 64 such entries fit a long.
BOUND = 2**27
_EXACT = 2**52  # whole numbers under it are exact as doubles
SUMS = "cluster int, dim int, n long, total long, radius2 long, compared long"


@dataclass
class Balls:
    """Centroids as rows; each ball's squared radius (an upper bound, None: unknown); vectors in each."""

    centroids: np.ndarray
    radius: np.ndarray | None = None

    def between(self) -> np.ndarray:
        """Squared distances between centroids, exact."""
        c = self.centroids
        return np.array([[((a - b) ** 2).sum() for b in c] for a in c], np.int64)

    def neighbours(self, apart: np.ndarray) -> list[np.ndarray]:
        """For each ball the other centroids that can be nearest to a member, nearest first."""
        out = []
        for j, row in enumerate(apart):
            order = np.argsort(row, kind="stable")
            order = order[order != j]
            if self.radius is not None:
                order = order[np.sqrt(row[order].astype(float)) <= 2 * self.radius[j] * (1 + 1e-9) + 1e-9]
            out.append(order)
        return out


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, balls: Balls, home: np.ndarray | None, apart: np.ndarray, neighbours: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest centroid (of equally near ones the smallest number), the squared
    distance, and how many distances were computed. `home`: the cluster each row was in."""
    if home is None:
        home = np.zeros(len(x), np.int64)
    cluster, best, compared = home.astype(np.int64), np.zeros(len(x), np.int64), 0
    for j in np.unique(cluster):
        at = np.flatnonzero(home == j)
        own = _squared(x[at], balls.centroids[j])
        compared += len(at)
        where, least = np.full(len(at), j), own.copy()
        # Neighbours from near to far: one at squared distance a reaches members with 4 * own >= a.
        # Sorted by own distance, each annulus and all outside it is a tail of the order.
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        for i in neighbours[j]:
            tail = order[np.searchsorted(4 * ranked, apart[j, i], side="left") :]
            if not len(tail):
                break
            to = _squared(x[at[tail]], balls.centroids[i])
            compared += len(tail)
            nearer = (to < least[tail]) | (to == least[tail]) & (i < where[tail])
            moved = tail[nearer]
            where[moved], least[moved] = i, to[nearer]
        cluster[at], best[at] = where, least
    return cluster, best, compared


def assign(vectors: DataFrame, balls: Balls) -> DataFrame:
    """`vectors` (vec_id, x, and cluster from the second round on) with cluster and distance, its
    square. Without a radius every vector starts from centroid 0 and all others are neighbours."""
    apart = balls.between()
    neighbours = balls.neighbours(apart)
    known = balls.radius is not None

    def map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            cluster, distance, compared = nearest(x, balls, np.asarray(batch.column("cluster")) if known else None, apart, neighbours)
            counts = np.zeros(len(x), np.int64)
            counts[:1] = compared
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(counts)], names=["vec_id", "x", "cluster", "distance", "compared"])

    columns = ["vec_id", "x", "cluster"] if known else ["vec_id", "x"]
    return vectors.select(*columns).mapInArrow(map_batches, "vec_id long, x array<long>, cluster int, distance long, compared long")


def sums(assigned: DataFrame, k: int, dimension: int) -> list:
    """For each cluster with vectors and each dimension: n, the sum, the largest squared distance. k x dimension rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, radius, compared = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            x, cluster, distance = matrix(batch.column("x")), np.asarray(batch.column("cluster")), np.asarray(batch.column("distance"))
            compared += int(np.asarray(batch.column("compared")).sum())
            n += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, distance)
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            total[present] += np.add.reduceat(x[order], first, axis=0) if len(first) else 0
        there = np.repeat(np.flatnonzero(n), dimension)
        if len(there):
            dims = np.tile(np.arange(dimension, dtype=np.int32), len(there) // dimension)
            counted = np.zeros(len(there), np.int64)
            counted[0] = compared
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), pa.array(dims), pa.array(n[there]), pa.array(total[there, dims]), pa.array(radius[there]), pa.array(counted)],
                names=["cluster", "dim", "n", "total", "radius2", "compared"],
            )

    parts = assigned.select("x", "cluster", "distance", "compared").mapInArrow(add, SUMS)
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("radius2").alias("radius2"), F.sum("compared").alias("compared")).collect()


def moved(balls: Balls, found: list) -> Balls:
    """New centroids: the exact floor of the mean of each ball's vectors; an empty ball stays. The new
    radius is at most the old and the move."""
    centroids, radius = balls.centroids.copy(), np.zeros(len(balls.centroids))
    for r in found:
        centroids[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        radius[r["cluster"]] = r["radius2"]
    move = np.sqrt(((centroids - balls.centroids) ** 2).sum(axis=1).astype(float))
    return Balls(centroids, np.sqrt(radius) + move)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string, cluster_size long"


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64) -> DataFrame:
    """The cluster of each vector in `rows` (vec_id, embedding) of `dimension` entries, none null, NaN or
    infinite; others are left out, so that an empty table gives none.

    Entries become floor(scale * c); products beyond BOUND count as it. The first centroids are the k
    vectors with the smallest SHA-256 of `1:<vec_id>`; of equal ids that with the smaller entries; a null
    id has no digest and comes last. With fewer vectors than k there are fewer centroids. Repeated rows are
    vectors of their own. Of equally near centroids the smaller number is taken. Other columns are
    not read. Each round's table is written, and the one before is deleted.
    """
    spark = rows.sparkSession
    good = of_dimension(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), "embedding", dimension).where(whole(F.col("embedding")))
    vectors = save(good.select("vec_id", integers(F.col("embedding"), scale, 0, BOUND).alias("x")), "vectors")
    first = vectors.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], CLUSTERED)
    balls = Balls(np.array([r["x"] for r in first], np.int64))
    assigned = save(assign(vectors, balls), "assigned")
    release(vectors)
    for _ in range(rounds):
        balls = moved(balls, sums(assigned, len(first), dimension))
        before, assigned = assigned, save(assign(assigned, balls), "assigned")
        release(before)
    inertia = {r["cluster"]: (int(r["inertia"]), r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count(F.lit(1)).alias("n")).collect()}
    whole_sum = sum(v for v, _ in inertia.values())
    figures = spark.createDataFrame([(c, Decimal(v), Decimal(whole_sum), digest(balls.centroids[c]), n) for c, (v, n) in inertia.items()], "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string, cluster_size long")
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")  # k rows


def op12_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all `embeddings` of 64 entries after three rounds: see `cluster` for nulls, empty
    vectors, ties, repeated rows and empty tables. An inertia that no long holds is null."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumns({c: F.col(c).try_cast("long") for c in ("cluster_inertia", "inertia")})


def _oracle(k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64) -> str:
    """The same clusters in DuckDB: every vector held against every centroid in each round."""
    near = "SELECT v.r, any_value(vec_id) AS vec_id, any_value(v.x) AS x, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (SELECT v.*, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n} c) v GROUP BY v.r"
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS k, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) <= {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS ({near.format(n=n)})")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, CAST(floor(sum(e) / count(*)) AS BIGINT) AS m FROM (SELECT k, unnest(x) AS e, unnest(range({dimension})) AS i FROM a{n}) GROUP BY k, i) GROUP BY k)")
            steps.append(f"c{n + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.k = m.k)")
    last = rounds
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, a.k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY a.k) AS cluster_size "
        f"FROM a{last} a JOIN c{last} c ON a.k = c.k"
    )


OP12_SQL = _oracle()
