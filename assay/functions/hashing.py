"""Digests, keyed ranks and seeds as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_text(c: Column) -> Column:
    return F.sha2(c, 256)


def rank_key(namespace: str, *parts: Column) -> Column:
    """The keyed hash that orders rows for a selection: SHA-256 of namespace:part:part."""
    return F.sha2(F.concat_ws(":", F.lit(namespace), *(p.cast("string") for p in parts)), 256)


def int_list_digest(ids: Column) -> Column:
    """SHA-256 of a list of integers as big-endian signed 64-bit words."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i.cast("long")), 16, "0")), "")), 256)


def seed(*parts: Column | str) -> Column:
    """An unsigned 64-bit seed: the first 16 hex digits of the digest of parts joined by colons."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seed32(digests: list[Column], tag: str, index: Column) -> Column:
    """An unsigned 32-bit seed from the raw bytes of digests, a tag and an index in decimal."""
    data = F.concat(*(F.unhex(d) for d in digests), F.encode(F.concat(F.lit(tag), index.cast("string")), "utf-8"))
    return F.conv(F.substring(F.sha2(data, 256), 1, 8), 16, 10).cast("long")


def bucket_draw(key: Column, low: Column, high: Column) -> Column:
    """A uniform integer from low to high, both included, decided by a key."""
    return low + F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long"), high - low + 1)


def content_digest(df: DataFrame, exclude: tuple[str, ...] = ("content_sha256",)) -> Column:
    """SHA-256 of a row's canonical JSON without some columns; keys sorted, nulls kept."""
    kept = sorted(c for c in df.columns if c not in exclude)
    return F.sha2(F.to_json(F.to_variant_object(F.struct(*kept)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows and a digest of all rows that no order of rows changes.

    Row digests are added up in four parts of 15 hex digits, so partial sums merge and no task
    sorts or holds all rows.
    """
    columns = columns or df.columns
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [key, *[c for c in columns if c != key]])), 256)
    parts = [F.sum(F.conv(F.substring("_row", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return df.select(row.alias("_row")).agg(F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(p, F.lit(0)).cast("string").alias(f"_p{i}") for i, p in enumerate(parts))).select("n_rows", F.sha2(F.concat_ws(":", "_p0", "_p1", "_p2", "_p3"), 256).alias("digest"))


def group_digests(df: DataFrame, keys: list[str], identities: dict[str, list[Column]]) -> DataFrame:
    """For each group of rows: n_rows, and for each identity a digest of the group's values that no order of rows
    changes: row digests are added up in four parts, as in `table_digest`."""
    rows = df.select(*keys, *(F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cells)), 256).alias(f"_{n}") for n, cells in identities.items()))
    part = lambda n, i: F.sum(F.conv(F.substring(f"_{n}", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sha2(F.concat_ws(":", *(part(n, i) for i in range(4))), 256).alias(n) for n in identities))
