"""Many sides that must each match once, and what of them disagrees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Side:
    """One table of a star: its rows, its key, and the columns that are kept of it."""

    df: DataFrame
    key: str
    columns: tuple[str, ...]


def matched(sides: dict[str, Side], key: str = "key") -> DataFrame:
    """One row for each key of any side: key, n_<side>, and <side>, a struct of the side's row (of several,
    that of the least values).

    All sides are tagged and united, and one aggregation by key puts them together, partly before the
    shuffle: neither the number of sides nor repeated rows make more shuffles or products. Rows without
    a key are left out.
    """
    parts = []
    for name, s in sides.items():
        own = F.struct(*(F.col(c) for c in s.columns)).alias(name)
        parts.append(s.df.where(F.col(s.key).isNotNull()).select(F.col(s.key).cast("string").alias(key), own))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return united.groupBy(key).agg(*(F.count(n).alias(f"n_{n}") for n in sides), *(F.min(n).alias(n) for n in sides))


def findings(star: DataFrame, sides: list[str], lineage: dict[str, Column], optional: tuple[str, ...] = (), key: str = "key") -> DataFrame:
    """(key, code) for each fault of a star: MISSING_<SIDE>, DUPLICATE_<SIDE>, and the code of each lineage
    condition that holds, a condition being a disagreement. Conditions are asked where all sides that are not
    `optional` match once; a null one is a disagreement too, as nothing shows that the sides agree,
    unless it is of an optional side that is not there."""
    once = reduce(lambda a, b: a & b, [F.col(f"n_{s}") == 1 for s in sides if s not in optional], F.lit(True))
    codes = [F.when(F.col(f"n_{s}") == 0, F.lit(f"MISSING_{s.upper()}")) for s in sides if s not in optional]
    codes += [F.when(F.col(f"n_{s}") > 1, F.lit(f"DUPLICATE_{s.upper()}")) for s in sides]
    for code, wrong in lineage.items():
        absent = reduce(lambda a, b: a | b, [(F.col(f"n_{s}") == 0) for s in optional], F.lit(False))
        codes.append(F.when(once & F.coalesce(wrong, ~absent), F.lit(code)))
    return star.select(key, F.explode(F.filter(F.array(*codes), lambda c: c.isNotNull())).alias("code"))


def complete(star: DataFrame, sides: list[str]) -> DataFrame:
    """Rows that every side matches exactly once."""
    return star.where(reduce(lambda a, b: a & b, [F.col(f"n_{s}") == 1 for s in sides]))


def rollups(df: DataFrame, groups: list[str], sums: dict[str, Column], separator: str = ":") -> DataFrame:
    """Sums overall (`all`), for each value of each group (`group:value`), and for all but it
    (`not group:value`): level, and the sums.

    GROUPING SETS give all levels in one shuffle; what is left of a total without a part is the total
    minus the part, so no row is counted again. A null value is a value, written `null`. An empty table
    has no levels.
    """
    narrow = df.select(*groups, *(c.alias(k) for k, c in sums.items()))
    marks = [F.grouping(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    rows = narrow.groupingSets([*([F.col(g)] for g in groups), []], *(F.col(g) for g in groups)).agg(*marks, *(F.sum(k).alias(k) for k in sums))
    level = reduce(lambda c, ig: c.when(F.col(f"_g{ig[0]}") == 0, F.concat(F.lit(ig[1] + separator), F.coalesce(F.col(ig[1]).cast("string"), F.lit("null")))), enumerate(groups), F.when(F.lit(False), F.lit("")))
    rows = rows.select(F.coalesce(level, F.lit("all")).alias("level"), *sums)
    whole = rows.where("level = 'all'").select(*(F.col(k).alias(f"_{k}") for k in sums))
    rest = rows.where("level <> 'all'").join(F.broadcast(whole), F.lit(True))  # one row
    return rows.unionByName(rest.select(F.concat(F.lit("not "), "level").alias("level"), *((F.col(f"_{k}") - F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums)))
