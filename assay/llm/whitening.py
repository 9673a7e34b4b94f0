"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance of the vectors is never formed. A pass over them, spread over the partitions, sends
a block of directions through it: with the centred vectors as rows of X, the block Q becomes
X'(XQ)/n. Each partition adds up its part and Spark sums the parts by dimension, so what moves is a
dimension times the block's width for each partition, whatever the number of vectors.

The blocks span a Krylov space. Each new block is made orthogonal to all before it, twice; columns
that vanish in that (the space is invariant: a breakdown) are replaced by fresh directions
orthogonal to everything so far. After each pass the covariance as seen in the space is solved, and
the method ends when the residuals of all wanted pairs, from the passes' own results, are small.

Vectors are integers. Their sums and squared deviations are exact, and the trace of the covariance
comes from the deviations; so the explained shares need no eigenvalue but their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, table
from .vectors import integers, matrix, of_dimension, whole

#: Products of entries and the scale beyond it count as it: such numbers are exact as doubles.
BOUND = 2**53
#: A pair has converged when its residual is under so much of the largest eigenvalue.
TOLERANCE = 1e-13
#: A direction has vanished when orthogonalising leaves so little of it, relative to the covariance.
VANISHED = 1e-12
#: An eigenvalue of less, relative to the largest, is no variance: there is nothing to whiten.
NO_VARIANCE = 1e-12

_LIMB = 26  # sums are added up in two halves of the numbers, so that neither overflows
PRODUCTS = "dim int, col int, part double"


@dataclass(frozen=True)
class Moments:
    """Exact figures of the vectors: how many, the sum of each dimension, and the total of
    (n * x - S) squared over rows and dimensions."""

    n: int
    sums: tuple[int, ...]
    deviation: int

    @property
    def mean(self) -> np.ndarray:
        """S / n, correctly rounded."""
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        """Of the covariance with divisor n."""
        return self.deviation / self.n**3


@dataclass(frozen=True)
class Components:
    """Eigenvalues, falling, and unit eigenvectors as columns; passes over the vectors; restarted directions."""

    values: np.ndarray
    vectors: np.ndarray
    passes: int
    restarts: int


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The sum of (n * x - S) squared of each row, exact."""
    if not len(x):
        return []
    s = np.array(sums, object)
    most = max(abs(n * int(x.max())), abs(n * int(x.min())), 1) + max(abs(v) for v in sums)
    if most < 2**62 and most * most * len(sums) < 2**63:
        d = n * x - s.astype(np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    if most < 2**62:  # usual differences are far smaller than both terms
        d = n * x - s.astype(np.int64)
        if (peak := int(np.abs(d).max())) * peak * len(sums) < 2**63:
            return np.einsum("ij,ij->i", d, d).tolist()
    d = n * x.astype(object) - s
    return (d * d).sum(axis=1).tolist()


def moments(vectors: DataFrame, dimension: int) -> Moments:
    """`vectors` has x, an array of longs of that dimension. Two passes: sums, then deviations."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"))
            n, high, low = n + len(x), high + (x >> _LIMB).sum(axis=0), low + (x & (2**_LIMB - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([n] * dimension), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = vectors.select("x").mapInArrow(add, "dim int, n long, high long, low long").groupBy("dim").agg(*map(wide, ("n", "high", "low"))).orderBy("dim").collect()
    if not parts:
        return Moments(0, (0,) * dimension, 0)
    n, sums = int(parts[0]["n"]), tuple((int(r["high"]) << _LIMB) + int(r["low"]) for r in parts)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(_deviations(matrix(b.column("x")), n, sums)) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["total"])

    # In two halves as well: a partition's total may have more digits than a decimal adds up safely.
    limb = 10**18
    halves = vectors.select("x").mapInArrow(square, "total string").select(F.col("total").cast("decimal(38,0)").alias("t"))
    got = halves.agg(F.sum(F.floor(F.col("t") / F.lit(limb))).alias("high"), F.sum(F.col("t") % F.lit(limb)).alias("low")).first()
    return Moments(n, sums, int(got["high"]) * limb + int(got["low"]))


def covariance_times(vectors: DataFrame, found: Moments, block: np.ndarray) -> np.ndarray:
    """One pass: the covariance times `block`, with the vectors centred before they are multiplied."""
    mean, (dimension, width) = found.mean, block.shape

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, width))
        for batch in batches:
            centred = matrix(batch.column("x")) - mean
            total += centred.T @ (centred @ block)
        dims, cols = np.divmod(np.arange(dimension * width, dtype=np.int32), width)
        yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(total.ravel())], names=["dim", "col", "part"])

    out = np.zeros(block.shape)
    for r in vectors.select("x").mapInArrow(product, PRODUCTS).groupBy("dim", "col").agg(F.sum("part").alias("part")).collect():  # dimension x width rows
        out[r["dim"], r["col"]] = r["part"]
    return out / found.n


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """The block's directions, orthonormal and orthogonal to `basis`, as far as the space has room;
    those that vanish are replaced by random ones. Also how many were replaced."""
    kept, restarts = basis, 0
    room = min(block.shape[1], len(basis) - basis.shape[1])
    for k in range(room):
        v, size = block[:, k], scale
        while True:
            for _ in range(2):  # once more removes what rounding left
                v = v - kept @ (kept.T @ v)
            if (norm := np.linalg.norm(v)) > VANISHED * size:
                # A short rest is mostly rounding in the directions removed; after scaling it is removed again.
                v = v / norm
                v = v - kept @ (kept.T @ v)
                kept = np.column_stack((kept, v / np.linalg.norm(v)))
                break
            v, size, restarts = rng.standard_normal(len(basis)), 1.0, restarts + 1
    return kept[:, basis.shape[1] :], restarts


def block_lanczos(times, dimension: int, wanted: int, width: int, seed: int = 0, tolerance: float = TOLERANCE) -> Components:
    """The `wanted` largest eigenpairs of a symmetric map of nonnegative eigenvalues; `times(Q)` applies it to a block."""
    rng, wanted = np.random.default_rng(seed), min(wanted, dimension)
    basis, images = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    block, restarts = _orthonormal(rng.standard_normal((dimension, min(width, dimension))), basis, 1.0, rng)
    passes = 0
    while True:
        image = times(block)
        passes += 1
        basis, images = np.column_stack((basis, block)), np.column_stack((images, image))
        seen = basis.T @ images
        values, inside = np.linalg.eigh((seen + seen.T) / 2)
        values, inside = values[::-1], inside[:, ::-1]
        have = min(wanted, len(values))
        chosen = inside[:, :have]
        residuals = np.linalg.norm(images @ chosen - basis @ chosen * values[:have], axis=0)
        if basis.shape[1] == dimension or have == wanted and residuals.max() <= tolerance * max(values[0], np.finfo(float).tiny):
            vectors = basis @ chosen
            return Components(np.maximum(values[:have], 0), vectors / np.linalg.norm(vectors, axis=0), passes, restarts)
        block, more = _orthonormal(image, basis, max(abs(values[0]), np.finfo(float).tiny), rng)
        restarts += more


def _projection(found: Moments, components: Components, keep: int) -> np.ndarray:
    return components.vectors[:, :keep] / np.sqrt(components.values[:keep])


def identity_error(vectors: DataFrame, found: Moments, to: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity: one pass."""
    mean, k = found.mean, to.shape[1]

    def moments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = (matrix(batch.column("x")) - mean) @ to
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        dims, cols = np.divmod(np.arange((k + 1) * k, dtype=np.int32), k)
        yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(total.ravel())], names=["dim", "col", "part"])

    total = np.zeros((k + 1, k))
    for r in vectors.select("x").mapInArrow(moments_of, PRODUCTS).groupBy("dim", "col").agg(F.sum("part").alias("part")).collect():
        total[r["dim"], r["col"]] = r["part"]
    centre = total[k] / found.n
    return float(np.abs(total[:k] / found.n - np.outer(centre, centre) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, width: int | None = None) -> DataFrame:
    """Whitened components of the vectors in `rows` (vec_id, embedding), one row for each.

    Vectors that are null or hold a null, NaN or infinite entry are left out; entries become
    floor(scale * c) + shift, products beyond BOUND count as it. The dimension is the most frequent one
    of what is left (of equally frequent ones the largest); vectors of others, empty ones too, can't be
    projected and are left out. A component whose eigenvalue is under NO_VARIANCE of the largest has no
    rows, so vectors that are all equal, a single one, and an empty table give none. Null and repeated
    vec_ids and equal rows are kept, each with rows of its own. Other columns are not read.
    `width`: directions in a pass, as many as components unless given.
    """
    spark = rows.sparkSession
    vectors = save(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole(F.col("embedding"))).select("vec_id", integers(F.col("embedding"), scale, shift, BOUND).alias("x")), "vectors")
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None or sizes["d"] == 0:
        return spark.createDataFrame([], WHITENED)
    dimension = sizes["d"]
    vectors = of_dimension(vectors, "x", dimension)
    found = moments(vectors, dimension)
    if not found.deviation:
        return spark.createDataFrame([], WHITENED)
    width = min(width or components, dimension)
    pairs = block_lanczos(lambda block: covariance_times(vectors, found, block), dimension, components, width)
    keep = int((pairs.values > NO_VARIANCE * pairs.values[0]).sum())
    to, mean = _projection(found, pairs, keep), found.mean
    error = identity_error(vectors, found, to)
    explained, values = pairs.values[:keep] / found.trace, pairs.values[:keep]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            z, rows_in = (x - mean) @ to, len(x)
            deviation = pa.array([str(v) for v in _deviations(x, found.n, found.sums)]).cast(pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(rows_in), keep))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), rows_in)), pa.array(np.full(rows_in * keep, found.n)),
                    deviation.take(each), pa.array(z.ravel()), pa.array(np.tile(values, rows_in)), pa.array(np.tile(explained, rows_in)), pa.array(np.full(rows_in * keep, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "eigenvalue", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, WHITENED)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Eight whitened components of all `embeddings`: see `whiten` for nulls, empty vectors, ties, repeated
    rows and empty tables. A deviation that no long holds (very many vectors) is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long")).drop("eigenvalue")
