"""Findings on a bundle's records: inputs, their oracles, labeled records and added anchors.

Each function gives (record_id, finding), a row for each finding; a record can have several. Row
checks are one projection; what needs other rows is an aggregate or a join by key.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointer
from ..functions.schema import valid


def _found(df: DataFrame, tests: dict[str, Column], id_: str = "record_id") -> DataFrame:
    codes = F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests.items()))
    return df.select(F.col(id_), F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("finding"))


def _repeated(df: DataFrame, code: str) -> DataFrame:
    return df.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("record_id", F.lit(code).alias("finding"))


def _bad(v: Column, schema: Any) -> Column:
    return ~F.coalesce(valid(v, schema), F.lit(False))


def _uncontrolled(v: Column, vocabularies: dict[str, list]) -> Column:
    """Whether a value at some pointer is outside its vocabulary; a missing one is not."""
    wrong = F.lit(False)
    for p, allowed in vocabularies.items():
        at = pointer.resolve(v, p)
        wrong = wrong | F.coalesce(pointer.exists(v, p) & ~F.coalesce(valid(at, {"enum": list(allowed)}), F.lit(False)), F.lit(False))
    return wrong


def _group_differs(coverage: Column, group: Column, key: str) -> Column:
    return ~F.try_variant_get(F.try_parse_json(coverage), f"$.{key}", "string").eqNullSafe(group)


def input_findings(inputs: DataFrame, input_schema: Any, coverage_key: str) -> DataFrame:
    """inputs: record_id, group, payload and coverage (JSON text), content_sha256 (of the payload)."""
    df = inputs.withColumn("_v", F.try_parse_json("payload"))
    tests = {
        "COVERAGE_GROUP_MISMATCH": _group_differs(F.col("coverage"), F.col("group"), coverage_key),
        "INPUT_SCHEMA_INVALID": _bad(F.col("_v"), input_schema),
        "INPUT_CONTENT_HASH_MISMATCH": ~F.col("content_sha256").eqNullSafe(F.sha2("payload", 256)),
    }
    return _found(df, tests).unionByName(_repeated(inputs, "DUPLICATE_RECORD_ID"))


def oracle_findings(inputs: DataFrame, oracles: DataFrame, output_schema: Any, vocabularies: dict[str, list]) -> DataFrame:
    """oracles: record_id, expected (JSON text), input_content_sha256, content_sha256 (of expected). Of an
    oracle without an input only the join is reported, as of an input without one."""
    a = inputs.select("record_id", F.col("content_sha256").alias("_input"), F.lit(True).alias("_l"))
    b = oracles.withColumn("_r", F.lit(True))
    both = F.col("_l") & F.col("_r")
    df = a.join(b, "record_id", "full").withColumn("_v", F.try_parse_json("expected"))
    tests = {
        "ORACLE_JOIN_MISMATCH": F.col("_l").isNull() | F.col("_r").isNull(),
        "ORACLE_INPUT_HASH_MISMATCH": both & ~F.col("_input").eqNullSafe(F.col("input_content_sha256")),
        "ORACLE_CONTENT_HASH_MISMATCH": both & ~F.col("content_sha256").eqNullSafe(F.sha2("expected", 256)),
        "ORACLE_SCHEMA_INVALID": both & _bad(F.col("_v"), output_schema),
        "CONTROLLED_VOCABULARY_INVALID": both & _uncontrolled(F.col("_v"), vocabularies),
    }
    return _found(df, tests).unionByName(_repeated(oracles, "DUPLICATE_ORACLE_ID"))


def labeled_findings(labeled: DataFrame, input_schema: Any, output_schema: Any, coverage_key: str, vocabularies: dict[str, list]) -> DataFrame:
    """labeled: the columns of inputs, assistant_label (text) and label_sha256."""
    df = labeled.withColumn("_v", F.try_parse_json("payload")).withColumn("_y", F.try_parse_json("assistant_label"))
    tests = {
        "COVERAGE_GROUP_MISMATCH": _group_differs(F.col("coverage"), F.col("group"), coverage_key),
        "INPUT_CONTENT_HASH_MISMATCH": ~F.col("content_sha256").eqNullSafe(F.sha2("payload", 256)),
        "ASSISTANT_LABEL_HASH_MISMATCH": ~F.col("label_sha256").eqNullSafe(F.sha2("assistant_label", 256)),
        "TRAINING_INPUT_SCHEMA_INVALID": _bad(F.col("_v"), input_schema),
        "TRAINING_LABEL_INVALID_JSON": F.col("_y").isNull(),
        "TRAINING_LABEL_SCHEMA_INVALID": F.col("_y").isNotNull() & _bad(F.col("_y"), output_schema),
        "CONTROLLED_VOCABULARY_INVALID": F.col("_y").isNotNull() & _uncontrolled(F.col("_y"), vocabularies),
    }
    return _found(df, tests).unionByName(_repeated(labeled, "DUPLICATE_LABELED_RECORD_ID"))


def anchor_findings(anchors: DataFrame, evaluation: DataFrame) -> DataFrame:
    """anchors: record_id, label_origin, surface, content_sha256, semantic_signature; evaluation: the last
    two and record_id. A collision of any of the three is a leak."""
    keys = ("record_id", "content_sha256", "semantic_signature")
    cells = lambda df: F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in keys)))
    known = evaluation.select(cells(evaluation).alias("_c")).select("_c.*").distinct()
    mine = anchors.select(F.col("record_id").alias("_id"), cells(anchors).alias("_c")).select("_id", "_c.*")
    leaking = mine.join(known, ["kind", "key"], "left_semi").select(F.col("_id").alias("record_id"), F.lit("ANCHOR_EVALUATION_LEAKAGE").alias("finding")).distinct()
    tests = {"ANCHOR_ORIGIN_INVALID": ~F.col("label_origin").eqNullSafe(F.lit("anchor")), "ANCHOR_SURFACE_INVALID": ~F.col("surface").eqNullSafe(F.lit("anchor"))}
    return _found(anchors, tests).unionByName(leaking)


def input_records(df: DataFrame, record_id: Column, surface: Column, group: Column, payload: Column, coverage: dict[str, Column], signature: Column) -> DataFrame:
    """Input records: record_id, surface, group, payload and coverage (canonical JSON text), semantic_signature,
    content_sha256 (of the payload). A payload that is no JSON has nulls there, and fails validation."""
    rows = df.select(record_id.cast("string").alias("record_id"), surface.alias("surface"), group.cast("string").alias("group"), F.to_json(F.try_parse_json(payload)).alias("payload"), F.to_json(F.struct(*(coverage[k].alias(k) for k in sorted(coverage)))).alias("coverage"), signature.alias("semantic_signature"))
    return rows.withColumn("content_sha256", F.sha2("payload", 256))


def oracle_records(inputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Oracles of input records: record_id, expected (canonical), input_content_sha256, content_sha256.
    `expected`: record_id, expected (JSON text); a record of one side only has none."""
    own = expected.select(F.col("record_id").alias("_id"), F.to_json(F.try_parse_json("expected")).alias("expected"))
    return inputs.join(own, F.col("record_id") == F.col("_id")).select("record_id", "expected", F.col("content_sha256").alias("input_content_sha256"), F.sha2("expected", 256).alias("content_sha256"))


def labeled_records(inputs: DataFrame, oracles: DataFrame, origin: str) -> DataFrame:
    """Input records with their oracles' answers as canonical labels: assistant_label, label_sha256, label_origin.
    An oracle of another content than the input's raises at run time."""
    own = oracles.select(F.col("record_id").alias("_id"), F.col("expected").alias("assistant_label"), F.col("input_content_sha256").alias("_of"))
    joined = inputs.join(own, F.col("record_id") == F.col("_id"))
    checked = F.when(F.col("_of").eqNullSafe(F.col("content_sha256")), F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("oracle of another input: "), F.col("record_id"))).cast("string"))
    return joined.withColumn("record_id", checked).drop("_id", "_of").withColumns({"label_sha256": F.sha2("assistant_label", 256), "label_origin": F.lit(origin)})


def identity_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of some fields of a row as canonical JSON, nulls kept: the identity of a plan."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def normalized_id(text: Column, pattern: str, replacement: str) -> Column:
    """An id of one naming scheme in another; one that does not fit stays as it is."""
    return F.regexp_replace(text, f"^(?:{pattern})$", replacement)


def mutated(df: DataFrame, id_: str, text: str, kinds: dict[str, tuple[Column, Column]], namespace: str) -> DataFrame:
    """For each kind of mutation the compatible row of least keyed hash with its text corrupted: kind, id,
    mutated. `kinds`: name to (compatible, new text); null conditions don't hold. Kinds without a row
    have none."""
    rows = df.select(F.col(id_), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(ok, F.lit(False)).alias("ok"), to.alias("mutated")) for k, (ok, to) in kinds.items()))).alias("_m")).where("_m.ok")
    order = F.struct(F.sha2(F.concat_ws(":", F.lit(namespace), "_m.kind", F.col(id_).cast("string")), 256), F.col(id_))
    return rows.groupBy("_m.kind").agg(F.min_by(F.struct(F.col(id_), F.col("_m.mutated").alias("mutated")), order).alias("_r")).select("kind", "_r.*")
