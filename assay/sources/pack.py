"""A capability pack: declared schemas, rules, vocabularies and tables, as one object."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import records
from ..operators.evaluate import Comparison, Evaluator
from ..operators.leakage import union
from . import digests, jsonl
from .stages import exists

SURFACES = ["source_gate", "transfer_pool", "validation", "confirmatory", "adversarial"]


@dataclass(frozen=True)
class Pack:
    root: str
    evaluator: Evaluator
    readiness: dict[str, Any] = field(default_factory=dict)
    oracles: DataFrame | None = None

    def files(self, spark: SparkSession) -> DataFrame:
        return digests.files(spark, self.root)


def load_oracles(spark: SparkSession, root: str, surfaces: list[str] = SURFACES) -> DataFrame:
    """Oracle rows of all surfaces, with `surface`; JSON lines."""
    parts = []
    for s in surfaces:
        lines = spark.read.text(f"{root}/oracles/{s}.jsonl").where(F.trim("value") != "")
        doc = F.parse_json("value")
        get = lambda p, k="string": F.try_variant_get(doc, f"$.{p}", k)  # noqa: B023, E731
        parts.append(lines.select(F.lit(s).alias("surface"), get("record_id").alias("record_id"), get("input_content_sha256").alias("input_content_sha256"), get("expected", "variant").alias("expected"), get("safety_context", "variant").alias("safety_context"), get("coverage", "map<string,string>").alias("coverage"), get("content_sha256").alias("content_sha256")))
    return union(parts)


def load(spark: SparkSession, root: str, evaluator: dict, output_schema: Any, cross_field_schema: Any, vocabularies: dict[str, list], safety_rules: list[dict], readiness: dict) -> Pack:
    """A pack from its declarations (dicts read by `jsonl.read_config` or given) and its oracle tables.

    Rules are checked here, so a bad declaration fails before any job.
    """
    for r in safety_rules:
        rules.validate(r["when"])
    comparisons = [Comparison(c["name"], c["pointer"], c.get("mode", "exact"), c.get("tolerance"), c.get("semantic", True)) for c in evaluator.get("comparisons", [])]
    e = Evaluator(output_schema, cross_field_schema, comparisons, evaluator.get("required_pointers", []), vocabularies, safety_rules, evaluator.get("whole_output_json_fence", False), evaluator.get("strict_requires_cross_field", True))
    return Pack(root, e, readiness, load_oracles(spark, root))


_INPUT = "record_id string, `group` string, payload variant, coverage variant, semantic_signature string, content_sha256 string"
_ORACLE = "record_id string, expected variant, input_content_sha256 string, content_sha256 string"
_LABELED = "record_id string, `group` string, payload variant, coverage variant, semantic_signature string, content_sha256 string, assistant_label string, label_sha256 string, label_origin string, surface string"
#: Statuses of a capability that may be executed.
EXECUTABLE = ("READY", "REFERENCE")


@dataclass(frozen=True)
class Bundle:
    """A pack read from its folder: configuration, declarations, and its records as tables."""

    root: str
    config: dict[str, Any]
    schemas: dict[str, Any]
    safety_rules: list[dict]
    readiness: dict[str, Any]
    vocabularies: dict[str, list]
    inputs: DataFrame
    oracles: DataFrame
    labeled: DataFrame

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """pointer, value (JSON text): what each controlled pointer may hold."""
        return spark.createDataFrame([(p, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for p, values in sorted(self.vocabularies.items()) for v in values], "pointer string, value string")

    def register(self, spark: SparkSession, prefix: str = "") -> list[str]:
        """Temporary views of the pack's tables: inputs, oracles, labeled, vocab, rules."""
        listed = spark.createDataFrame([(r["code"], r["severity"], r["message"], json.dumps(r["when"], sort_keys=True)) for r in self.safety_rules], "code string, severity string, message string, condition string")
        views = {"inputs": self.inputs, "oracles": self.oracles, "labeled": self.labeled, "vocab": self.vocabulary(spark), "rules": listed}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in views]

    def findings(self) -> DataFrame:
        """surface, record_id, finding: everything that bars the pack from use; none if it is sound."""
        key, known = self.config["coverage_group_key"], self.vocabularies
        parts = []
        for s in SURFACES:
            mine, answers = self.inputs.where(F.col("surface") == s), self.oracles.where(F.col("surface") == s)
            found = records.input_findings(mine, self.schemas["input"], key).unionByName(records.oracle_findings(mine, answers, self.schemas["output"], known))
            parts.append(found.withColumn("surface", F.lit(s)))
        labeled = records.labeled_findings(self.labeled, self.schemas["input"], self.schemas["output"], key, known)
        anchors = self.labeled.where("source = 'anchors'")
        leaks = records.anchor_findings(anchors, self.inputs.where("surface <> 'transfer_pool'"))
        return union([*parts, labeled.withColumn("surface", F.lit("labeled")), leaks.withColumn("surface", F.lit("anchors"))]).select("surface", "record_id", "finding")


def open_bundle(spark: SparkSession, root: str, require_executable: bool = False, allow_fixture: bool = False) -> Bundle:
    """Read a pack's folder: capability.json (id, version, status, coverage_group_key, strategies, paths) and
    what its paths name: input_schema, output_schema, cross_field_schema, safety_rules, readiness_rules,
    vocabularies (pointer to a file of values), inputs and oracles of each surface, direct_train, anchors.

    A path that is missing, a configuration without a key, an ill-formed rule, a repeated strategy or a
    status that may not be executed is an error here, before any record is read; a record that does
    not fit its type is one when it is read. Records stay distributed; payloads are canonical JSON text.
    """
    config = jsonl.read_config(spark, f"{root}/capability.json")
    lacking = {"id", "version", "status", "coverage_group_key", "paths"} - set(config)
    if lacking:
        raise ValueError(f"{root}/capability.json lacks {sorted(lacking)}")
    if require_executable and config["status"] not in EXECUTABLE and not (allow_fixture and config["status"] == "FIXTURE_ONLY"):
        raise ValueError(f"capability status {config['status']} is not executable")
    paths = config["paths"]
    named = ["input_schema", "output_schema", "cross_field_schema", "safety_rules", "readiness_rules", "direct_train", "anchors", *(f"{s}_{k}" for s in SURFACES for k in ("inputs", "oracle"))]
    if absent := [n for n in named if n not in paths]:
        raise ValueError(f"paths lack {absent}")
    files = {n: f"{root}/{paths[n]}" for n in named} | {p: f"{root}/{f}" for p, f in paths.get("vocabularies", {}).items()}
    if gone := sorted(f for f in files.values() if not exists(spark, f)):
        raise FileNotFoundError(", ".join(gone))
    strategies = [s["strategy_id"] for s in config.get("strategies", [])]
    if len(set(strategies)) < len(strategies):
        raise ValueError("DUPLICATE_STRATEGY_ID: strategy ids must be unique")
    safety = jsonl.read_config(spark, files["safety_rules"]).get("rules")
    if not isinstance(safety, list):
        raise ValueError("safety rules must contain a list of rules")
    for r in safety:
        if set(r) != {"code", "severity", "message", "when"} or r["severity"] not in ("info", "warning", "blocker"):
            raise ValueError(f"ill-formed safety rule: {r}")
        rules.validate(r["when"])
    vocabularies = {p: jsonl.read_config(spark, files[p])["values"] for p in paths.get("vocabularies", {})}
    schemas = {k: jsonl.read_config(spark, files[f"{k}_schema"]) for k in ("input", "output", "cross_field")}
    texts = lambda df, *names: df.withColumns({c: F.to_json(c) for c in names})
    inputs = union([texts(jsonl.read(spark, files[f"{s}_inputs"], _INPUT), "payload", "coverage").withColumn("surface", F.lit(s)) for s in SURFACES])
    oracles = union([texts(jsonl.read(spark, files[f"{s}_oracle"], _ORACLE), "expected").withColumn("surface", F.lit(s)) for s in SURFACES])
    labeled = union([texts(jsonl.read(spark, files[n], _LABELED), "payload", "coverage").withColumn("source", F.lit(n)) for n in ("direct_train", "anchors")])
    return Bundle(root, config, schemas, safety, jsonl.read_config(spark, files["readiness_rules"]), vocabularies, inputs, oracles, labeled)
