"""Schedules against the reference's loop, written out."""

import hashlib

import pytest

from assay.operators import schedule

SF = "/root/testdata/sf0.001"


def loop(sizes, budget, seed=7, namespace="schedule"):
    items, used, cycle = [], 0, 0
    while True:
        added = False
        for i in sorted(sizes, key=lambda i: hashlib.sha256(f"{seed}:{namespace}:{cycle}:{i}".encode()).hexdigest()):
            if used + sizes[i] <= budget:
                items.append((len(items), i, sizes[i], cycle, len(items) // 8, len(items) // 8 + 1))
                used, added = used + sizes[i], True
        if not added or used >= budget:
            return items
        cycle += 1


def scheduled(spark, sizes, budget):
    rows = schedule.greedy(spark.createDataFrame(list(sizes.items()), "id string, n long"), "id", "n", budget, 7, "schedule", 8)
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("sizes, budget", [([10, 10, 500], 400), ([10, 10, 30], 400), ([7, 11, 13], 100), ([3, 5, 0], 16), ([0, 0], 0), ([9], 5), ([4, 9, 9, 30, 2], 61)])
def test_cycles_go_on_until_none_fits(spark, sizes, budget):
    sizes = {str(k): n for k, n in enumerate(sizes)}
    assert scheduled(spark, sizes, budget) == loop(sizes, budget)


@pytest.mark.parametrize("folded", [0, 20, 10_000])
def test_documents_in_rounds(spark, monkeypatch, folded):
    monkeypatch.setattr(schedule, "FOLDED", folded)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").collect()
    sizes = {str(r["doc_id"]): r["n_chars"] for r in docs}
    for budget in (60_000, 700_001):
        assert scheduled(spark, sizes, budget) == loop(sizes, budget)


def test_too_many_cycles_are_an_error(spark):
    for sizes, budget in (({"a": 1}, 10_002), ({"a": 0}, 5), ({"a": 3, "b": 0}, 7), ({"a": 2}, 20_003)):
        with pytest.raises(RuntimeError):
            scheduled(spark, sizes, budget)


def test_query_schedules_all_documents(spark):
    from assay.plans.catalogue import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").collect()
    want = loop({str(r["doc_id"]): r["n_chars"] for r in docs}, 400_000)
    assert sorted(tuple(r) for r in QUERIES["greedy_schedule"](spark, SF).collect()) == want
