"""Policies replayed on stored rows, and audits that bar a surface, on odd rows."""

import pytest
from pyspark.sql import functions as F

from assay.operators import distribution, leakage, residuals, select

PAIR = "struct<a:string,b:int>"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, f"k long, stored {PAIR}, given {PAIR}")


def test_policy_replay_names_fields_in_order(spark):
    rows = [(1, ("x", 1), ("x", 1)), (2, ("x", 1), ("y", 2)), (2, ("x", 1), ("y", 2)), (3, (None, 1), (None, 1)), (4, ("x", None), ("x", 1)), (5, None, ("x", 1)), (6, None, (None, None)), (7, None, None)]
    found = residuals.policy_replay(_pairs(spark, rows), ["k"], F.col("stored"), F.col("given"), ["a", "b"])
    assert sorted((r.k, r.differing) for r in found.collect()) == [(2, ["a", "b"]), (2, ["a", "b"]), (4, ["b"]), (5, ["a", "b"]), (6, ["a", "b"])]


def test_policy_replay_of_nothing(spark):
    assert residuals.policy_replay(_pairs(spark, []), ["k"], F.col("stored"), F.col("given"), ["a", "b"]).collect() == []


def test_dataset_audit_counts_violations(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), (None, True)], "k string, bad boolean")
    audit = lambda d: tuple(residuals.dataset_audit(d, {"k": F.col("k")}, {"n_bad": F.col("bad")}).first())
    assert audit(df) == (4, 2, 2)
    assert audit(df.limit(0)) == (0, 0, 0)
    assert residuals.dataset_audit(df, {"k": F.col("k")}).columns == ["n_rows", "repeated_k"]


def test_audit_findings(spark):
    keys = lambda rows: spark.createDataFrame(rows, "key_class string, key string")
    audit = leakage.leakage_audit(keys([("content", "a"), ("content", "a"), ("content", "b"), ("signature", "c")]), keys([("content", "b"), ("content", "b"), ("signature", "b")]))
    rows = spark.createDataFrame([("en", 1), ("en", 5), ("de", None), (None, 5)], "lang string, n int")
    coverage = distribution.range_counts(rows, ["lang"], {"low": F.col("n") < 3, "high": F.col("n") > 3})
    found = leakage.audit_findings(audit, coverage, ["lang"], {"low": 1, "high": 1})
    assert sorted(tuple(r) for r in found.collect()) == [
        ("BOUNDARY_BELOW_MINIMUM", "de|high", 0), ("BOUNDARY_BELOW_MINIMUM", "de|low", 0), ("BOUNDARY_BELOW_MINIMUM", "null|low", 0), ("COLLISION", "content", 1), ("REPETITION", "content", 1),
    ]


def test_audit_findings_unknown_counts_and_nothing(spark):
    audit = spark.createDataFrame([], "key_class string, n_excluded long, n_repeated long, n_keys long")
    coverage = spark.createDataFrame([("en", None), ("de", 7)], "lang string, low long")
    assert [tuple(r) for r in leakage.audit_findings(audit, coverage, ["lang"], {"low": 7}).collect()] == [("BOUNDARY_BELOW_MINIMUM", "en|low", 0)]
    assert leakage.audit_findings(audit, coverage.limit(0), ["lang"], {"low": 7}).collect() == []


def test_exactly(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (3, "b")], "k int, c string")
    assert sorted(r.k for r in select.exactly(df, F.col("c") == "a", 2, "cases").collect()) == [1, 2]
    with pytest.raises(ValueError, match="cases: more than 1 rows"):
        select.exactly(df, F.col("c") == "a", 1, "cases")
    with pytest.raises(ValueError, match="fewer than 3 rows"):
        select.exactly(df, F.col("c") == "a", 3, "cases")
    assert select.exactly(df.limit(0), F.col("c") == "a", 0, "cases").count() == 0
