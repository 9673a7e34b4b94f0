"""Every query of the catalogue against its DuckDB SQL, and the schedules against brute force."""

import pytest

from assay.operators import schedule
from assay.plans import audits, bundles, leftovers, runs  # noqa: F401
from assay.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF, QUERIES[name], ORACLE_SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_schedule_holds(spark):
    items = QUERIES["greedy_schedule"](spark, SF)
    lengths = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(doc_id as string) as record_id", "n_chars as sequence_tokens")
    found = schedule.check(items, lengths, 8, 400_000).first()
    assert tuple(found) == (0, 0, 0, True, True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_keyed_diff_holds_every_output(spark):
    """Outputs that failed are compared too: each record has both sides."""
    got = {r["presence"]: r["count"] for r in QUERIES["keyed_diff"](spark, SF).groupBy("presence").count().collect()}
    assert got == {"both": spark.read.parquet(f"{SF}/orders.parquet").count()}
