"""Vectors as exact integers, and Arrow columns of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column) -> Column:
    """Whether a vector is there and has no null, NaN or infinite entry. An empty one is whole."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def integers(vector: Column, scale: int, shift: int, bound: int) -> Column:
    """floor(scale * c) + shift of each entry c of a whole vector, as long; products beyond `bound`
    on either side count as that bound."""
    edge = float(bound)
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(edge)), F.lit(-edge))) + F.lit(shift).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length (and no nulls) as the rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def of_dimension(df: DataFrame, column: str, dimension: int) -> DataFrame:
    return df.where(F.size(column) == dimension)
