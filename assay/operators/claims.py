"""Checks of claims against evidence rows, and filters over outputs and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that claim a cause, which evidence of outcomes can't support.
CAUSAL_WORDS = r"(?i)\b(?:because|caused?|causes|causing|due to|leads? to|led to|results? in|therefore|thanks to)\b"
_NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?%?"


def renderings(value: Column) -> Column:
    """How a number may stand in a claim: as it is, with 2 or 3 decimals, and as a percentage with none, 1 or 2."""
    x = value.cast("double")
    raw = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    percent = F.array(*(F.concat(F.format_string(f"%.{k}f", 100 * x), F.lit("%")) for k in (0, 1, 2)))
    return F.array_distinct(F.concat(F.array(raw, F.format_string("%.2f", x), F.format_string("%.3f", x)), percent))


def check_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims: claim_id, text, evidence_ids (array). evidence: evidence_id, value, numerator, denominator.

    For each claim: unknown_evidence (ids without a row), unsupported_numbers (numbers of the text
    that no cited value renders), and causal (it speaks of causes). Evidence that many claims cite
    meets each once.
    """
    cited = claims.select("claim_id", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"))
    numbers = F.flatten(F.array(*(F.when(F.col(c).isNotNull(), renderings(F.col(c))).otherwise(F.array().cast("array<string>")) for c in ("value", "numerator", "denominator"))))
    met = cited.join(evidence.select("evidence_id", numbers.alias("_n"), F.lit(True).alias("_known")), "evidence_id", "left")
    each = met.groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_known").isNull() & F.col("evidence_id").isNotNull(), F.col("evidence_id")))).alias("unknown_evidence"),
        F.flatten(F.collect_list("_n")).alias("_allowed"),
    )
    said = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(_NUMBER), F.lit(0)))
    return claims.join(each, "claim_id").select(
        "claim_id", "unknown_evidence", F.array_sort(F.array_except(said, "_allowed")).alias("unsupported_numbers"), F.col("text").rlike(CAUSAL_WORDS).alias("causal")
    )


def comparison_supported(relation: Column, values: Column) -> Column:
    """Whether ordered values (the claimed system's first) support HIGHER, LOWER, BEST, WORST or TIE."""
    first, rest = F.get(values, F.lit(0)), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    some = F.size(rest) > 0
    tests = {"HIGHER": first > F.get(rest, F.lit(0)), "LOWER": first < F.get(rest, F.lit(0)), "BEST": first >= F.array_max(rest), "WORST": first <= F.array_min(rest), "TIE": F.forall(rest, lambda x: x == first)}
    out = F.when(F.lit(False), F.lit(False))
    for name, test in tests.items():
        out = out.when(relation == name, some & test)
    return F.coalesce(out.otherwise(False), F.lit(False))


def evidence_rows(df: DataFrame, surface: Column, system: Column, key: Column, measures: dict[str, tuple[Column, Column | None, Column | None]]) -> DataFrame:
    """Nested results as rows: evidence_id, surface, system, json_path, value, numerator, denominator."""
    cells = [F.struct(F.lit(n).alias("m"), v.cast("double").alias("value"), (F.lit(None) if a is None else a).cast("double").alias("numerator"), (F.lit(None) if b is None else b).cast("double").alias("denominator")) for n, (v, a, b) in measures.items()]
    rows = df.select(surface.alias("surface"), system.alias("system"), key.alias("_k"), F.inline(F.array(*cells)))
    path = F.concat(F.lit("/"), F.col("_k"), F.lit("/"), F.col("m"))
    return rows.select(F.concat_ws(":", "surface", "system", "_k", "m").alias("evidence_id"), "surface", "system", path.alias("json_path"), "value", "numerator", "denominator")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose test holds, or null."""
    return F.coalesce(*(F.when(t, F.lit(n)) for n, t in reasons))


def rejection(df: DataFrame) -> DataFrame:
    """Add accepted, primary_reason (the first that holds) and secondary_reasons (sorted) to scored rows
    of a teacher: status, raw_output, classification, errors, the safety flags and metrics."""
    prose = F.array_contains("errors", "PROSE_OR_MULTIPLE_OBJECTS")
    flags = ["unauthorized_action", "approval_bypass", "false_action", "hallucinated_arguments"]
    unsafe = ~(~F.coalesce(F.col(flags[0]), F.lit(True)) & ~F.coalesce(F.col(flags[1]), F.lit(True)) & ~F.coalesce(F.col(flags[2]), F.lit(True)) & ~F.coalesce(F.col(flags[3]), F.lit(True)))
    reason = first_reason([
        ("TEACHER_INFERENCE_FAILED", ~F.col("status").eqNullSafe("COMPLETED")), ("EMPTY_OUTPUT", F.coalesce(F.trim("raw_output"), F.lit("")) == ""), ("NORMALIZED_NOT_STRICT", F.col("classification") == "NORMALIZED_VALID"),
        ("PROSE_OR_MULTIPLE_OBJECTS", ~F.col("valid_json") & prose), ("INVALID_JSON", ~F.col("valid_json")), ("SCHEMA_INVALID", F.col("classification") != "STRICT_VALID"),
        ("SAFETY_VIOLATION", unsafe), ("POLICY_CONTRACT_MISMATCH", F.col("semantic_decision") == 0),
    ])
    named = F.array(*(F.when(F.col(f), F.lit(f)) for f in flags))
    secondary = F.array_sort(F.array_distinct(F.concat("errors", F.filter(named, lambda x: x.isNotNull()))))
    return df.withColumn("primary_reason", reason).withColumn("accepted", F.col("primary_reason").isNull()).withColumn("secondary_reasons", secondary)


def repeated_keys(text: Column, times: int = 3) -> Column:
    """Whether a JSON key stands in a text so often, valid or not."""
    keys = F.regexp_extract_all(text, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1))
    return F.coalesce(F.exists(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) >= times), F.lit(False))


def search(df: DataFrame, columns: list[str], needle: str, **facets) -> DataFrame:
    """Rows whose columns hold a text, ignoring case, and that have the given facet values."""
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    rows = df.where(text.contains(needle.lower()))
    for column, value in facets.items():
        rows = rows.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return rows
