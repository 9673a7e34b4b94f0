"""Replays of stored runs: rows are parsed, scored and summed up again, and held against what was stored."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import table_digest
from . import digest_tree
from .digest_tree import Stored


def replay_rows(stored: Stored, again: Callable[[DataFrame], DataFrame], path: str, parser_fields: list[str]) -> DataFrame:
    """What a run's stored rows say of themselves that scoring their outputs again does not: keys,
    finding (PARSER_MISMATCH, METRICS_MISMATCH, ROW_LOST), fields (sorted).

    `again` gives the rows their columns anew from the outputs; a row whose status is FAILED is taken
    as it is. The rebuilt table is written with a digest tree under `path`; rows of ranges that agree
    are not read again. `parser_fields`: columns that parsing decides, the others being metrics.
    """
    rows = stored.rows().drop("_range")
    done = F.coalesce(F.col("status"), F.lit("FAILED")) != "FAILED"
    own = [*stored.keys, *stored.columns]
    rebuilt = again(rows.where(done)).select(*own).unionByName(rows.where(~done).select(*own))
    found = digest_tree.differences(stored, digest_tree.store(rebuilt, path, list(stored.keys), list(stored.columns)))
    kind = F.when(F.col("presence") != "both", "ROW_LOST").when(F.col("field").isin(parser_fields), "PARSER_MISMATCH").otherwise("METRICS_MISMATCH")
    return found.groupBy(*stored.keys, kind.alias("finding")).agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def replay_artifacts(stored: dict[str, DataFrame], rebuild: dict[str, Callable[[DataFrame], DataFrame]], keys: dict[str, list[str]], rows: DataFrame, surface: str | None = None) -> DataFrame:
    """One row for each kind of artifact: kind, status (PASSED, FAILED), n_stored, n_rebuilt, n_differing
    (keys whose rows differ or that one side lacks), single_surface (all rows of the run have one).

    Each kind is built again from the run's rows by its function. Tables are held together by digests
    that no order changes; only where those differ are rows joined.
    """
    missing = set(stored) ^ set(rebuild)
    if missing:
        raise ValueError(f"artifacts without a stored table or a function: {sorted(missing)}")
    spark, out = rows.sparkSession, []
    single = rows.agg(F.count_distinct(surface) <= 1).first()[0] if surface else None
    for kind, old in sorted(stored.items()):
        new, k = rebuild[kind](rows).select(*old.columns), keys[kind]
        a, b = (table_digest(d, k[0]).first() for d in (old, new))
        differing = 0
        if tuple(a) != tuple(b):
            own = F.struct(*[c for c in old.columns if c not in k])
            left = old.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(k)), own.alias("_l"))
            right = new.select(*(F.col(c).alias(f"_j{i}") for i, c in enumerate(k)), own.alias("_r"))
            on = reduce(lambda x, y: x & y, [F.col(f"_k{i}").eqNullSafe(F.col(f"_j{i}")) for i in range(len(k))])
            differing = left.join(right, on, "full").where(~F.col("_l").eqNullSafe(F.col("_r"))).count()
        out.append((kind, "PASSED" if tuple(a) == tuple(b) else "FAILED", a["n_rows"], b["n_rows"], differing, single))
    return spark.createDataFrame(out, "kind string, status string, n_stored long, n_rebuilt long, n_differing long, single_surface boolean")
