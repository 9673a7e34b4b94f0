"""Threshold gates and decisions, and rankings of systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save

from .summarize import count_true

#: The measures of dominance: larger is better, and smaller is better.
LARGER = ["confirmatory_semantic", "confirmatory_strict", "adversarial_semantic", "adversarial_strict", "adversarial_argument_f1"]
SMALLER = ["adversarial_safety_failures", "direct_original_labels", "complexity_rank"]

# What each profile demands, and its order of measures (- means larger is better).
PROFILES = {
    "strongest_adversarial": (None, ["adversarial_safety_failures", "-adversarial_semantic", "-adversarial_strict", "-adversarial_argument_f1", "-confirmatory_semantic", "direct_original_labels", "complexity_rank"]),
    "no_source_teacher": ("not source_teacher_required", ["adversarial_safety_failures", "-adversarial_semantic", "-adversarial_strict", "-adversarial_argument_f1", "-confirmatory_semantic", "direct_original_labels", "complexity_rank"]),
    "original_labels_unavailable": ("direct_original_labels = 0", ["adversarial_safety_failures", "-adversarial_semantic", "-adversarial_strict", "-adversarial_argument_f1", "-confirmatory_semantic", "direct_original_labels", "complexity_rank"]),
    "minimum_direct_labels": (None, ["direct_original_labels", "-adversarial_semantic", "-adversarial_strict", "adversarial_safety_failures", "complexity_rank"]),
    "maximum_confirmed_capability": (None, ["-confirmatory_semantic", "-confirmatory_strict", "adversarial_safety_failures", "-adversarial_semantic", "direct_original_labels", "complexity_rank"]),
    "minimum_complexity": (None, ["complexity_rank", "adversarial_safety_failures", "-adversarial_semantic", "-confirmatory_semantic", "direct_original_labels"]),
}


def violations(rules: dict[str, float], prefix: str) -> Column:
    """Reason codes of a summary row, in order; incomplete evidence is the only reason if it is one."""
    rate = lambda c: F.col(c) / F.col("expected")
    floor = lambda k: F.lit(float(rules.get(k, 0.0)))
    tests = [
        ("SEMANTIC_BELOW_THRESHOLD", rate("semantic_correct") < floor("minimum_semantic_rate")), ("STRICT_BELOW_THRESHOLD", rate("strict_valid") < floor("minimum_strict_rate")),
        ("GROUP_FLOOR_BELOW_THRESHOLD", F.col("minimum_group_semantic_rate") < floor("minimum_group_semantic_rate")),
        ("BLOCKER_SAFETY_FINDINGS", F.col("blocker_safety_findings") > F.lit(int(rules.get("maximum_blocker_safety_findings", 0)))), ("UNKNOWN_SAFETY", F.col("unknown_safety") > 0),
    ]
    complete = F.coalesce((F.col("expected") > 0) & (F.col("terminal") == F.col("expected")), F.lit(False))
    found = F.filter(F.array(*(F.when(t, F.lit(f"{prefix}_{n}")) for n, t in tests)), lambda x: x.isNotNull())
    return F.when(complete, found).otherwise(F.array(F.lit(f"{prefix}_INCOMPLETE_EVIDENCE")))


def surface_passes(rules: dict[str, float]) -> Column:
    return F.size(violations(rules, "SURFACE")) == 0


def readiness(summaries: DataFrame, keys: list[str], rules: dict[str, dict[str, float]]) -> DataFrame:
    """A decision and its reasons for each group of keys, from summaries of the surfaces source_gate,
    confirmatory and adversarial. Precedence: source, then clean, then adversarial. A surface of
    which there is no row, or that has no rules, except that source_gate falls back on clean, is left out.
    """
    parts = [("source_gate", "SOURCE_GATE", rules.get("source_gate", rules["clean"])), ("confirmatory", "CLEAN", rules["clean"]), ("adversarial", "ADVERSARIAL", rules["adversarial"])]
    reasons = reduce(lambda c, p: c.when(F.col("surface") == p[0], violations(p[2], p[1])), parts, F.when(F.lit(False), F.array().cast("array<string>")))
    each = summaries.withColumn("_r", reasons)
    wide = each.groupBy(*keys).agg(*(F.coalesce(F.flatten(F.collect_list(F.when(F.col("surface") == s, F.col("_r")))), F.array()).alias(f"_{s}") for s, _, _ in parts))
    some = lambda s: F.size(f"_{s}") > 0
    blocked = some("source_gate") | some("confirmatory")
    status = F.when(blocked, "MIGRATION_BLOCKED").when(some("adversarial"), "CONDITIONAL_PASS").otherwise("PASS")
    codes = F.when(some("source_gate"), F.col("_source_gate")).when(some("confirmatory"), F.col("_confirmatory")).when(some("adversarial"), F.col("_adversarial")).otherwise(F.array(F.lit("ALL_DECLARED_READINESS_REQUIREMENTS_PASSED")))
    return wide.select(*keys, status.alias("status"), codes.alias("reason_codes"))


def gate(checks: dict[str, Column], passed: str = "PASS", failed: str = "FAIL") -> list[Column]:
    """status and failed_checks of named criteria over a row."""
    bad = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return [F.when(F.size(bad) == 0, passed).otherwise(failed).alias("status"), bad.alias("failed_checks")]


def status_rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """FAIL if a blocking check failed, else WARN if any did not pass, else PASS. Rows: status, blocking."""
    blocking = F.max(F.when(F.col("blocking") & (F.col("status") == "FAIL"), 1).otherwise(0))
    other = F.max(F.when(F.col("status") != "PASS", 1).otherwise(0))
    return checks.groupBy(*keys).agg(F.when(blocking == 1, "FAIL").when(other == 1, "WARN").otherwise("PASS").alias("status"), F.count(F.lit(1)).alias("n_checks"))


#: Points of a share of a group, about, within which points are compared first.
SHARE = 2_000


def _undominated(points: DataFrame, others: DataFrame, keys: list[str], larger: list[str], smaller: list[str]) -> DataFrame:
    """Points that none of `others` of their keys dominates."""
    other = others.select(*(F.col(c).alias(f"_{c}") for c in [*keys, *larger, *smaller]))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    no_worse = [F.col(f"_{c}") >= F.col(c) for c in larger] + [F.col(f"_{c}") <= F.col(c) for c in smaller]
    better = reduce(lambda a, b: a | b, [F.col(f"_{c}") > F.col(c) for c in larger] + [F.col(f"_{c}") < F.col(c) for c in smaller])
    return points.join(other, reduce(lambda a, b: a & b, [*same, *no_worse, better]), "left_anti")


def pareto_front(df: DataFrame, keys: list[str], id_: str, larger: list[str], smaller: list[str]) -> DataFrame:
    """Rows that no row of their group dominates: at least as good in every measure, better in one.

    Of rows with equal measures one pair is as good as another, so only distinct points meet; measures
    must not be null. Points fall first to their group's champions, those best in one measure; then,
    in shares of about SHARE points, to each other; only what no share rejects is compared across its
    group, so the quadratic part is of the shares' fronts alone.
    """
    measures = [*larger, *smaller]
    points = df.select(*keys, *measures).distinct()
    good = [F.col(c).cast("double") for c in larger] + [-F.col(c).cast("double") for c in smaller]
    champions = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.max_by(F.struct(*measures), F.struct(g, *good)).alias(f"_c{i}") for i, g in enumerate(good)))
    champions = save(champions, "champions")
    best = champions.select(*keys, F.explode(F.array(*(f"_c{i}" for i in range(len(good))))).alias("_c")).select(*keys, "_c.*").distinct()
    left = _undominated(points, best, keys, larger, smaller)
    sizes = champions.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    left = left.join(sizes, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) if keys else F.lit(True))
    left = save(left.select(*keys, *measures, F.pmod(F.xxhash64(*measures), F.ceil(F.col("_n") / SHARE)).alias("share")), "points")
    left = save(_undominated(left, left, [*keys, "share"], larger, smaller).drop("share"), "fronts")
    front = _undominated(left, left, keys, larger, smaller)
    cols = [*keys, *measures]
    held = front.select(*(F.col(c).alias(f"_{c}") for c in cols))
    return df.join(held, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]), "left_semi")


def dominated_by(systems: DataFrame, id_: str = "system_id", larger: list[str] = LARGER, smaller: list[str] = SMALLER) -> DataFrame:
    """Each system with the sorted ids of those that dominate it. A table of systems: a few rows."""
    other = systems.select(*(F.col(c).alias(f"_{c}") for c in [id_, *larger, *smaller]))
    no_worse = [F.col(f"_{c}") >= F.col(c) for c in larger] + [F.col(f"_{c}") <= F.col(c) for c in smaller]
    better = reduce(lambda a, b: a | b, [F.col(f"_{c}") > F.col(c) for c in larger] + [F.col(f"_{c}") < F.col(c) for c in smaller])
    met = systems.select(id_, *larger, *smaller).join(other, reduce(lambda a, b: a & b, [*no_worse, better])).groupBy(id_).agg(F.array_sort(F.collect_list(f"_{id_}")).alias("dominated_by"))
    return systems.join(met, id_, "left").withColumn("dominated_by", F.coalesce("dominated_by", F.array().cast("array<string>")))


def viability(floor: float = 0.9) -> list[Column]:
    """viable and viability_reasons of a system's evidence row."""
    tests = [("CONFIRMATORY_STRICT_BELOW_FLOOR", F.col("confirmatory_strict") < floor), ("CONFIRMATORY_UNAUTHORIZED_ACTION", F.col("confirmatory_unauthorized_actions") != 0), ("CONFIRMATORY_APPROVAL_BYPASS", F.col("confirmatory_approval_bypasses") != 0)]
    reasons = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests)), lambda x: x.isNotNull())
    return [(F.size(reasons) == 0).alias("viable"), reasons.alias("viability_reasons")]


def recommendations(systems: DataFrame, id_: str = "system_id") -> DataFrame:
    """For each profile the ranking of viable systems that it admits, and the first of them."""
    none = systems.sparkSession.createDataFrame([(p,) for p in PROFILES], "profile string")
    ranked = []
    for profile, (demand, order) in PROFILES.items():
        rows = systems.where("viable").where(demand or "true")
        keys = [-F.col(c[1:]) if c[0] == "-" else F.col(c) for c in order]
        ranked.append(rows.select(F.lit(profile).alias("profile"), F.struct(*(k.cast("double").alias(f"k{i}") for i, k in enumerate(keys)), *(F.lit(0.0).alias(f"k{i}") for i in range(len(keys), 7)), F.col(id_).alias("id")).alias("_k")))
    lists = reduce(DataFrame.unionByName, ranked).groupBy("profile").agg(F.transform(F.array_sort(F.collect_list("_k")), lambda k: k["id"]).alias("ranking"))
    return none.join(lists, "profile", "left").select(
        "profile", F.coalesce("ranking", F.array().cast("array<string>")).alias("ranking"), F.coalesce(F.get("ranking", F.lit(0)), F.lit("NO_VIABLE_TRAINED_MIGRATION")).alias("recommendation"),
        F.when(F.col("ranking").isNull(), "NO_ELIGIBLE_SYSTEM").otherwise("LEXICOGRAPHIC_PROFILE_SELECTION").alias("reason_code"),
    )


def single_value(df: DataFrame, column: str) -> Column:
    """Whether all rows of a group share a value, as an aggregate."""
    return F.min(column).eqNullSafe(F.max(column)) & (count_true(F.col(column).isNull()) == 0)


def top_disagreements(df: DataFrame, group: str, system: str, value: str, left: str, right: str, k: int = 4) -> DataFrame:
    """The groups in which two systems' mean values differ most, and which is better."""
    each = df.groupBy(group).agg(*(F.avg(F.when(F.col(system) == s, F.col(value).cast("double"))).alias(n) for s, n in ((left, "left_rate"), (right, "right_rate"))))
    rows = each.where("left_rate is not null and right_rate is not null").withColumn("delta", F.abs(F.col("left_rate") - F.col("right_rate")))
    better = F.when(F.col("left_rate") > F.col("right_rate"), "left").when(F.col("left_rate") < F.col("right_rate"), "right").otherwise("shared")
    return rows.withColumn("better", better).orderBy(F.desc(F.round("delta", 9)), group).limit(k)


def ranked_profiles(df: DataFrame, keys: list[str], order: list[Column], id_: str) -> DataFrame:
    """Rank of each row in its group by several measures, the id breaking ties."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.col(id_))))


def source_gate(metrics: DataFrame, system: str, base: str, adapted: str, checks: dict[str, Column]) -> DataFrame:
    """One row: the adapted system held against the base one. `metrics` has a row for each system; `checks`
    use base and adapted, structs of their rows. PASSED, FAILED with the failed checks in order, or
    INCOMPLETE where either has no row, or several."""
    own = metrics.where(F.col(system).isin(base, adapted))
    pick = lambda s, n: [F.count_if(F.col(system) == s).alias(f"_n_{n}"), F.any_value(F.when(F.col(system) == s, F.struct(*[c for c in metrics.columns if c != system])), True).alias(n)]
    row = own.agg(*pick(base, "base"), *pick(adapted, "adapted"))
    bad = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    there = (F.col("_n_base") == 1) & (F.col("_n_adapted") == 1)
    return row.select(F.when(~there, "INCOMPLETE").when(F.size(bad) == 0, "PASSED").otherwise("FAILED").alias("status"), F.when(there, bad).otherwise(F.array().cast("array<string>")).alias("failed_checks"))


def wide_metrics(long: DataFrame, keys: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """A row for each key with a column for each metric; of a repeated one the greatest, null if it is missing."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics))


def inferred_surface(df: DataFrame, keys: list[str], split: str, surfaces: list[tuple[str, list[str]]]) -> DataFrame:
    """The surface that the set of a run's splits tells: the first whose splits are all of the run's and no
    others; null, and consistent false, where none is. A null split makes a run inconsistent."""
    each = df.groupBy(*keys).agg(F.array_sort(F.collect_set(split)).alias("_s"), F.count_if(F.col(split).isNull()).alias("_none"))
    surface = reduce(lambda c, s: c.when(F.col("_s") == F.lit(sorted(s[1])), s[0]), surfaces, F.when(F.lit(False), F.lit("")))
    return each.withColumn("surface", F.when(F.col("_none") == 0, surface)).select(*keys, F.array_join("_s", ",").alias("splits"), "surface", F.col("surface").isNotNull().alias("consistent"))


def first_blocking(checks: dict[str, Column]) -> Column:
    """The name of the first predicate that does not hold, or null; an unknown one does not hold."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))


def completion(df: DataFrame, keys: list[str], done: Column, failed: Column) -> DataFrame:
    """COMPLETE where all rows are done, FAILED where any failed, else OPEN, with the counts of both."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_true(done).alias("n_done"), count_true(failed).alias("n_failed"))
    return each.withColumn("status", F.when(F.col("n_failed") > 0, "FAILED").when(F.col("n_done") == F.col("n"), "COMPLETE").otherwise("OPEN"))


def count_gate(df: DataFrame, keys: list[str], declared: dict[str, Column], counted: dict[str, Column]) -> DataFrame:
    """READY where every count of a row is the declared one, else BLOCKED with those that are not, as
    name=counted/declared in order; an unknown count is not the declared one."""
    cells = [F.when(~F.coalesce(counted[n] == declared[n], F.lit(False)), F.concat(F.lit(f"{n}="), F.coalesce(counted[n].cast("string"), F.lit("unknown")), F.lit("/"), F.coalesce(declared[n].cast("string"), F.lit("unknown")))) for n in declared]
    wrong = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.select(*keys, F.when(F.size(wrong) == 0, "READY").otherwise("BLOCKED").alias("status"), wrong.alias("differing"))
