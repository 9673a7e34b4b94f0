"""Comparison modes of fields: exact, list, set, numeric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import kind

MODES = ("exact", "list", "set", "numeric")


def equal(a: Column, b: Column) -> Column:
    """Typed equality of two values; two missing ones are equal, and true is not 1. Equal texts are of
    one kind but for numbers, where 1.0 is written 1."""
    text = F.to_json(a)
    return text.eqNullSafe(F.to_json(b)) & (~F.coalesce(text.rlike("^[-0-9]"), F.lit(False)) | kind(a).eqNullSafe(kind(b)))


def items(v: Column) -> Column:
    """The elements of a list as canonical texts; null if it is no list."""
    return F.when(kind(v) == "array", F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))


def matches(predicted: Column, expected: Column, mode: str, tolerance: float | None = None) -> Column:
    """Whether a field is right. Missing on either side never is."""
    present = predicted.isNotNull() & expected.isNotNull()
    if mode in ("exact", "list"):
        same = equal(predicted, expected)
    elif mode == "set":
        same = F.array_sort(F.array_distinct(items(predicted))) == F.array_sort(F.array_distinct(items(expected)))
    elif mode == "numeric":
        number = kind(predicted).isin("integer", "number") & kind(expected).isin("integer", "number")
        same = number & (F.abs(F.try_variant_get(predicted, "$", "double") - F.try_variant_get(expected, "$", "double")) <= F.lit(float(tolerance or 0.0)))
    else:
        raise ValueError(f"unsupported comparison mode {mode}")
    return F.coalesce(present & same, F.lit(False))
