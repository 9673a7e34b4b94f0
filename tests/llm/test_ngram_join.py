"""The Jaccard join against all pairs of a small table."""

import random
import re

from assay.llm import components as stars
from assay.llm import ngram_join
from assay.llm.ngram_join import link_classes, op2_ngram_jaccard_join

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = root(i)
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=key)


def key(r):
    return tuple((x is None, x or 0) for x in r)


def got(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=key)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(op2_ngram_jaccard_join(spark, SF)) == brute(docs)


def planted(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = []
    for _ in range(40):
        base = text(r.choice([1, 3, 5, 6, 9, 30, 80, 200]))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                k = r.randrange(len(copy) + 1)
                copy[k : k + r.randint(0, 1)] = text(r.randint(0, 2))
            rows.append(r.choice([" ", "\n", "\t "]).join(copy))
    base = text(150)
    chain = list(base)
    for i in range(40):  # a chain: neighbours are similar, ends are not
        chain[3 * i : 3 * i + 3] = text(3)
        rows.append(" ".join(chain))
    passage = text(60)
    rows += [" ".join(text(20) + passage + text(20)) for _ in range(30)] + [" ".join(passage + text(3)) for _ in range(10)]
    rows += [None, "", " \n\t", "one", "ONE", "one\x0btwo", "one\xa0two", "x " * 5000]
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_planted_cases(spark, monkeypatch):
    rows = planted(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(link_classes(df)) == brute(rows)


def test_small_batches_and_leaves(spark, monkeypatch):
    """The constants travel with the functions that tasks get."""
    for name, value in (("GATHERED", 50), ("LEAF", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = planted(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(link_classes(df)) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(None, t), (5, t), (5, t), (9, t + " w50"), (None, None), (7, "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, set_id string, n_shingles int")
    assert got(link_classes(df)) == brute(rows)
    assert link_classes(df.limit(0)).collect() == []


def test_components_of_stars_take_one_round_and_few_tasks(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(stars, "save", lambda df, name, f=stars.save: saved.append(f(df, name)) or saved[-1])
    settings = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = stars.components(spark.createDataFrame([(i, i % 3) for i in range(3, 400)], "a long, b long"))
        assert sorted(map(tuple, found.collect())) == [(i, i % 3) for i in range(400)]
        assert len(saved) == 1
        assert len(saved[0].inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        chain = stars.components(spark.createDataFrame([(i + 1, i) for i in range(60)] + [(7, 7), (90, 91)], "a long, b long"))
        assert sorted(map(tuple, chain.collect())) == [*((i, 0) for i in range(61)), (90, 90), (91, 90)]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
