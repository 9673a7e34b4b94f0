"""The generic evaluator: outputs against declared schemas, vocabularies, comparisons and rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointer, rules
from ..functions.compare import matches
from ..functions.jsontext import GENERIC_FENCE, fence_body, is_object, strict_value, strip
from ..functions.schema import valid


@dataclass(frozen=True)
class Comparison:
    name: str
    pointer: str
    mode: str = "exact"
    tolerance: float | None = None
    semantic: bool = True


@dataclass(frozen=True)
class Evaluator:
    """What is declared once and compiled into one projection."""

    output_schema: Any
    cross_field_schema: Any = True
    comparisons: list[Comparison] = field(default_factory=list)
    required_pointers: list[str] = field(default_factory=list)
    vocabularies: dict[str, list] = field(default_factory=dict)
    safety_rules: list[dict] = field(default_factory=list)
    whole_output_json_fence: bool = False
    strict_requires_cross_field: bool = True


def _vocabulary_ok(v: Column, e: Evaluator) -> Column:
    parts = [pointer.exists(v, p) for p in e.required_pointers]
    for p, allowed in e.vocabularies.items():
        parts.append(F.coalesce(valid(pointer.resolve(v, p), {"enum": list(allowed)}), F.lit(False)) & pointer.exists(v, p))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def evaluate(df: DataFrame, e: Evaluator) -> DataFrame:
    """Add to rows of raw_output, expected, payload and safety_context (the last three VARIANT, or null):
    parsed, classification, the conformance flags, field_correctness, field_mean, semantic_match,
    structural_exact, strict_valid, safety_findings and n_blockers. A null output is an empty one.
    """
    df = df.withColumn("_raw", F.coalesce(F.col("raw_output"), F.lit(""))).withColumn("_sv", strict_value(strip(F.col("_raw"))))
    fence = strict_value(fence_body(F.col("_raw"), GENERIC_FENCE)) if e.whole_output_json_fence else F.parse_json(F.lit(None).cast("string"))
    df = df.withColumn("_fv", F.when(~is_object(F.col("_sv")), fence))
    df = df.withColumn("parsed", F.when(is_object(F.col("_sv")), F.col("_sv")).when(is_object(F.col("_fv")), F.col("_fv")))
    df = df.withColumn("classification", F.when(is_object(F.col("_sv")), "STRICT_VALID").when(F.col("parsed").isNotNull(), "NORMALIZED_VALID").otherwise("UNPARSEABLE"))
    v, yes = F.col("parsed"), lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumn("schema_valid", yes(v.isNotNull() & valid(v, e.output_schema)))
    df = df.withColumn("vocabulary_conformant", F.col("schema_valid") & yes(_vocabulary_ok(v, e))).withColumn("cross_field_conformant", F.col("schema_valid") & yes(valid(v, e.cross_field_schema)))
    able = F.col("schema_valid") & (F.col("cross_field_conformant") if e.strict_requires_cross_field else F.lit(True))
    fields = {c.name: able & matches(pointer.resolve(v, c.pointer), pointer.resolve(F.col("expected"), c.pointer), c.mode, c.tolerance) for c in e.comparisons}
    df = df.withColumn("field_correctness", F.create_map(*(x for n, c in fields.items() for x in (F.lit(n), c))) if fields else F.create_map().cast("map<string,boolean>"))
    right = lambda n: F.element_at("field_correctness", n)
    semantic = [right(c.name) for c in e.comparisons if c.semantic]
    n_right = reduce(lambda a, b: a + b, (right(c.name).cast("int") for c in e.comparisons), F.lit(0))
    df = df.withColumns({
        "field_mean": n_right / F.lit(float(max(1, len(fields)))),
        "semantic_match": able & (reduce(lambda a, b: a & b, semantic) if semantic else F.lit(False)),
        "structural_exact": able & yes(F.to_json(v) == F.to_json("expected")),
        "strict_valid": able & (F.col("classification") == "STRICT_VALID"),
    })
    metrics = F.to_variant_object(F.struct("semantic_match", "structural_exact", "schema_valid"))
    documents = {"prediction": v, "expected": F.col("expected"), "input": F.col("payload"), "oracle": F.col("safety_context"), "metrics": metrics}
    none = F.array().cast("array<struct<code:string,severity:string,message:string>>")
    df = df.withColumn("safety_findings", F.when(v.isNotNull(), rules.findings(e.safety_rules, documents)).otherwise(none))
    return df.withColumn("n_blockers", F.size(F.filter("safety_findings", lambda f: f["severity"] == "blocker"))).drop("_raw", "_sv", "_fv")
