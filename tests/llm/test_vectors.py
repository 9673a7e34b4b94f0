"""Whitening and ball k-means against plain numpy and plain Python over whole tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import ball_kmeans, whitening
from assay.llm.ball_kmeans import cluster, op12_ball_kmeans
from assay.llm.whitening import block_lanczos, op11_embedding_whitening, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x string, cluster string, dim int"


def odd_rows(spark, extra=(), dimension=64):
    """Nulls, other lengths, repeats, and columns whose names clash with the operators' own."""
    rng = np.random.default_rng(5)
    some = [(i, rng.normal(size=dimension).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [None] + [0.5] * (dimension - 1)), (103, [math.nan] * dimension), (104, [math.inf] + [0.0] * (dimension - 1)), (105, [1.0] * (dimension - 1))]
    rows = some + [some[0], some[0], (None, some[3][1]), (None, some[3][1])] + bad + list(extra)
    return some, spark.createDataFrame([(i, v, "x", "c", 9) for i, v in rows], SCHEMA)


def plain_whitening(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s).astype(float) / n
    values, inside = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, ((x * n - s) ** 2).sum(axis=1), centred @ inside[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def held_against(got, ids, vectors):
    n, deviation, z, explained = plain_whitening(vectors)
    rows = {}
    for r in got:
        rows.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == n * z.shape[1]
    for c in range(z.shape[1]):
        sign = np.sign(rows[ids[0], c + 1][0]["whitened"] * z[0, c])
        for i, d, w in zip(ids, deviation, z[:, c]):
            for r in rows[i, c + 1]:
                assert (r["n"], int(r["deviation"])) == (n, d)
                assert abs(r["whitened"] * sign - w) < 1e-6 and abs(r["explained"] / explained[c] - 1) < 1e-9
                assert r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held_against(op11_embedding_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_odd_rows(spark):
    some, rows = odd_rows(spark)
    fit = [v for _, v in some] + [some[0][1]] * 2 + [some[3][1]] * 2
    held_against(whiten(rows).collect(), [i for i, _ in some] + [0, 0, None, None], fit)
    assert whiten(rows.limit(0)).collect() == [] and whiten(rows.where("vec_id = 0")).collect() == []  # equal vectors vary in nothing
    assert whiten(rows.where("vec_id in (100, 101)")).collect() == []


def test_whitening_without_full_rank(spark):
    """Components without variance have no rows; two vectors vary in one direction."""
    rows = spark.createDataFrame([(0, [0.0, 1.0, 2.0]), (1, [1.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = whiten(rows).collect()
    assert {r["component"] for r in got} == {1} and sorted(round(abs(r["whitened"]), 9) for r in got) == [1, 1]
    assert all(abs(r["explained"] - 1) < 1e-9 for r in got)


def test_exact_deviations_beyond_longs():
    x = np.array([[2**50, -(2**50)], [3, 4]], np.int64)
    sums = (2**50 + 3, 4 - 2**50)
    assert whitening._deviations(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]


@pytest.mark.parametrize("spectrum", ["spread", "equal", "low rank"])
def test_lanczos(spectrum):
    """Eigenpairs by their definition; ranks below the block's width make it break down and restart."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(90, 90)))
    values = {"spread": np.geomspace(1e4, 1e-3, 90), "equal": np.ones(90), "low rank": np.r_[[7.0, 5.0, 3.0], np.zeros(87)]}[spectrum]
    v = q * values @ q.T
    found = block_lanczos(lambda b: v @ b, 90, 8, 8)
    assert np.allclose(found.values, np.sort(values)[::-1][:8], atol=1e-10 * values[0])
    assert np.allclose(v @ found.vectors, found.vectors * found.values, atol=1e-9 * values[0])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(8), atol=1e-12)
    assert (found.restarts > 0) == (spectrum == "low rank")
    assert spectrum == "equal" or found.passes < 12


def plain_kmeans(pairs, k=16, rounds=3):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in pairs]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    inertia = [sum(d for c, d in found if c == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for (i, _), (c, d) in zip(kept, found)), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], int(r["cluster_inertia"]), int(r["inertia"]), r["centroid_sha256"]) for r in df.collect()), key=str)


def test_kmeans_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert rows_of(op12_ball_kmeans(spark, SF)) == plain_kmeans([(r["vec_id"], r["embedding"]) for r in rows])


def test_kmeans_of_odd_rows(spark):
    some, rows = odd_rows(spark)
    kept = [*some, some[0], some[0], (None, some[3][1]), (None, some[3][1])]
    assert rows_of(cluster(rows)) == plain_kmeans(kept)
    few = rows.where("vec_id < 5")
    assert rows_of(cluster(few)) == plain_kmeans([r for r in kept if r[0] is not None and r[0] < 5])
    assert cluster(rows.limit(0)).collect() == []


def test_kmeans_ties_and_empty_balls(spark):
    """Vectors of small entries: many equal distances, equal centroids, balls that stay empty."""
    rng = np.random.default_rng(3)
    pairs = [(i, (rng.integers(0, 2, 64) * (rng.random() < 0.7) / 64).tolist()) for i in range(120)]
    df = spark.createDataFrame(pairs, "vec_id long, embedding array<double>")
    assert rows_of(cluster(df)) == plain_kmeans(pairs)


def test_stable_cores_are_not_compared(spark):
    """Well parted clusters: from the second round on nearly only own distances are computed."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 64)) * 5
    x = np.floor(64 * (np.repeat(centres, 50, axis=0) + rng.normal(size=(200, 64)) * 0.01)).astype(np.int64)
    balls = ball_kmeans.Balls(np.floor(64 * centres).astype(np.int64), np.full(4, 64 * 0.2))
    apart = balls.between()
    found, _, compared = ball_kmeans.nearest(x, balls, np.repeat(np.arange(4), 50), apart, balls.neighbours(apart))
    assert compared == 200 and found.tolist() == np.repeat(np.arange(4), 50).tolist()


def test_saturated_entries(spark):
    df = spark.createDataFrame([(0, [1e300] * 64), (1, [-1e300] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["distance"] for r in cluster(df).collect()} == {0: 0, 1: 0, 2: 0}
    assert whiten(df).select(F.max("component")).first()[0] == 1
