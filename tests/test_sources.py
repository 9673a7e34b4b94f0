"""Sources, stages and joins that check their input."""

import pytest
from pyspark.sql import functions as F

from assay.operators import compare, distribution, residuals, select
from assay.sources import jsonl, stages


def test_strict_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in jsonl.read(spark, str(path), "a long").collect()) == [1, 2]
    path.write_text('{"a": 1, "b": 2}\n')
    with pytest.raises(Exception, match="unknown fields: b"):
        jsonl.read(spark, str(path), "a long").collect()
    path.write_text('{"a": "x"}\n')
    with pytest.raises(Exception):
        jsonl.read(spark, str(path), "a long").collect()


def test_stage_log(spark, tmp_path):
    path = str(tmp_path / "log")
    first = stages.append_stage(spark, path, "run", "plan", "COMPLETED", "{}")
    second = stages.append_stage(spark, path, "run", "fit", "COMPLETED", "{}")
    stages.append_stage(spark, path, "other", "plan", "FAILED", "{}")
    assert first != second and stages.latest(spark, path, "run")["stage"] == "fit"
    found = {r["run_id"]: (r["intact"], r["last_sequence"]) for r in stages.verify_chain(stages.read(spark, path)).collect()}
    assert found == {"run": (True, 1), "other": (True, 0)}


def test_overlapping_buckets_and_sources_of_several_rows_are_errors(spark):
    df = spark.createDataFrame([(5,)], "v long")
    buckets = spark.createDataFrame([("f", "a", 0, 5), ("f", "b", 5, 9)], "field string, name string, minimum long, maximum long")
    with pytest.raises(ValueError):
        distribution.bucket_join(df, "f", "v", buckets)
    with pytest.raises(ValueError):
        compare.retention(df.withColumn("k", F.lit(1)), df.union(df), "k", ["v"])


def test_repeated_keys_and_forbidden_surfaces_are_errors(spark):
    with pytest.raises(Exception, match="repeated key"):
        select.ordered_unique(spark.createDataFrame([(1,), (1,)], "k long"), "k").collect()
    access = residuals.StageAccess({"fit": ["train"]}, ("sealed",))
    with pytest.raises(PermissionError):
        access.read(spark, "fit", "test", "/data/test")
    with pytest.raises(PermissionError):
        access.read(spark, "fit", "train", "/data/sealed")


def test_commits_never_replace(spark, tmp_path):
    """A bundle is there whole or not at all; a second one of its name is an error, also where the first test is passed."""
    root = f"file://{tmp_path}"
    df = spark.range(3)
    path = stages.commit({"a": df, "b": df}, root, "one")
    assert spark.read.parquet(f"{path}/a").count() == 3 and spark.read.parquet(f"{path}/b").count() == 3
    with pytest.raises(FileExistsError):
        stages.commit({"a": df}, root, "one")
    seen = iter([False, True])
    real, stages.exists = stages.exists, lambda *_: next(seen)
    try:
        with pytest.raises(FileExistsError):
            stages.commit({"a": df.limit(1)}, root, "one")
    finally:
        stages.exists = real
    assert spark.read.parquet(f"{path}/a").count() == 3


def test_audited_commits(spark, tmp_path):
    root, df = f"file://{tmp_path}", spark.range(2)
    with pytest.raises(ValueError, match="leaks"):
        stages.commit_audited({"a": df}, {"counts": df.limit(0), "leaks": df}, root, "pool")
    assert not (tmp_path / "pool").exists()
    assert spark.read.parquet(f"{stages.commit_audited({'a': df}, {'counts': df.limit(0)}, root, 'pool')}/a").count() == 2
