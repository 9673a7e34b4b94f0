"""Passages that several corpora have: hashes, batches and buckets, records without an id."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assay.operators import leakage, passages

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_hashes_tell_passages_apart():
    """Equal passages have equal hashes and others not, for words of all lengths, empty and very long ones."""
    words = ["", "a", "ab", "ba", "b" * 7, "b" * 8, "b" * 9, "c" * 16, "c" * 17, "d" * 63, "d" * 64, "d" * 65, "d" * 66, "e" * 300, "é"]
    rng, texts = random.Random(3), [words, words[::-1]]
    texts += [[rng.choice(words) for _ in range(k)] for k in (1, 2, 5, 12, 400)]
    blob = b"".join(" ".join(t).encode() + b"\xff" for t in texts)
    for n in (1, 2, 3, 10):
        raw, starts, ends, text, begins = passages._cuts(blob, n)
        want = [tuple(t[k : k + n]) for t in texts for k in range(len(t) - n + 1)]
        assert [blob[i:j].decode().split(" ") for i, j in zip(starts[begins], ends[begins + n - 1])] == [list(w) for w in want]
        for h in passages._hashes(raw, starts, ends, begins, n):
            assert len(set(zip(h.tolist(), want))) == len(set(want)) == len(set(h.tolist()))


def test_owners_of_one_bucket():
    """Equal hashes whose second parts differ are two keys; the owner is the last record of the first corpus."""
    cells = lambda h, g, pos, of: np.array(h, np.uint64).tobytes() + np.array(g, np.uint16).tobytes() + passages._planes(np.array(pos)) + passages._planes(np.array(of))
    rows = [("b", 100, cells([7, 7, 8], [1, 2, 1], [3, 4, 900], [0, 0, 2])), ("a", 10, cells([7, 9], [1, 1], [0, 70000], [0, 1])), ("a", 20, cells([7, 8], [1, 2], [5, 6], [0, 0])), ("c", 200, cells([7, 7, 9], [2, 1, 1], [1, 2, 3], [0, 1, 1]))]
    found = passages._owned(pa.table({"batch": [r[1] for r in rows], "corpus": [r[0] for r in rows], "cells": pa.array([r[2] for r in rows], pa.binary())}))
    assert found.to_pylist() == [{"batch": 100, "pos": [3], "owner": [20]}, {"batch": 200, "pos": [1, 2, 3], "owner": [100, 20, 11]}]


def test_counts_of_one_bucket():
    """Keys count once for a pair of corpora, however many records of them have it."""
    cells = lambda h, g: np.array(h, np.uint64).tobytes() + np.array(g, np.uint16).tobytes() + bytes(8 * len(h))
    rows = [("c", cells([5, 6, 7], [0, 0, 0])), ("a", cells([5, 5, 6, 9], [0, 1, 0, 0])), ("a", cells([5, 9], [0, 0])), ("b", cells([5, 6], [1, 0])), ("c", cells([5, 9], [2, 0]))]
    found = passages._pairs(pa.table({"corpus": [r[0] for r in rows], "cells": pa.array([r[1] for r in rows], pa.binary())}))
    assert [tuple(r.values()) for r in found.to_pylist()] == [("a", "b", 2), ("a", "c", 3), ("b", "c", 1)]


def test_collision_counts_of_texts(spark):
    """Nulls, empty texts, texts equal but for marks, passages that repeat in a text, records without an id."""
    ten = [" ".join(f"{c}{i}" for i in range(10)) for c in "pqr"]
    rows = [("a", 1, f"{ten[0]} {ten[1]}"), ("b", 1, f"X {ten[1].upper()}! {ten[1]}"), ("b", None, ten[0]), ("c", 3, ten[1].replace(" ", ", ")), ("c", 4, ten[2]), ("d", 1, "Short, text"), ("a", 2, "short text"), ("a", 2, "short text"), ("d", 2, ""), ("b", 9, ""), ("c", 9, None)]
    rows += [("d", None, ten[2]), ("d", None, ten[2])]
    has = {}
    for c, _, t in rows:
        if t is not None:
            w = "".join(x if x.isalnum() else " " for x in t.lower()).split()
            for key in [("content", t), ("signature", " ".join(w))] + [("passage", " ".join(w[k : k + 10])) for k in range(len(w) - 9)]:
                has.setdefault(key, set()).add(c)
    want = {}
    for (kind, _), corpora in has.items():
        for a in corpora:
            for b in corpora:
                if a < b:
                    want[kind, a, b] = want.get((kind, a, b), 0) + 1
    texts = spark.createDataFrame(rows, "corpus string, record_id long, text string")
    found = lambda t: {(r["key_class"], r["left_corpus"], r["right_corpus"]): r["n_keys"] for r in leakage.text_collision_counts(t, 10).collect()}
    assert found(texts) == want and len(want) >= 6
    assert found(texts.limit(0)) == {}


def test_audit_and_candidates_of_texts(spark):
    """Rows that share an id count once for a passage; others' keys exclude a record, its own repeats don't."""
    ten = [" ".join(f"{c}{i}" for i in range(10)) for c in "pqrs"]
    rows = [("d", 1, ten[0]), ("d", 1, ten[0]), ("d", 2, f"{ten[1]}"), ("d", 3, f"y {ten[1]}"), ("d", 4, f"z, {ten[2]}"), ("a", 1, f"other {ten[2]}"), ("d", 5, "few words"), ("e", 9, "FEW words"), ("d", 6, ""), ("d", None, ten[3])]
    texts = spark.createDataFrame(rows, "corpus string, record_id long, text string")
    audit = {r["key_class"]: (r["n_excluded"], r["n_repeated"], r["n_keys"]) for r in leakage.text_leakage_audit(texts, "d", 10).collect()}
    assert audit == {"content": (0, 1, 7), "signature": (1, 1, 7), "passage": (1, 1, 6)}
    kept = leakage.without_text_collisions(texts.where("corpus = 'd'").select("record_id").distinct(), "record_id", texts, "d", 10)
    assert {r[0] for r in kept.collect()} == {1, 2, 3, 6, None}
    assert leakage.text_leakage_audit(texts.where("corpus <> 'd'"), "d", 10).collect() == []


def test_passages_of_many_batches(spark):
    """Texts of several batches, records with several texts and without an id: against every passage held together."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(40000)}" for _ in range(n))
    pool = [text(60) for _ in range(40)]
    rows = [(c, i, " ".join([rng.choice(pool), text(900), *rng.sample(pool, 2)])) for c in "abc" for i in range(400)]
    rows += [("a", None, pool[0]), ("b", None, pool[1]), ("b", None, pool[1] + " " + pool[2]), ("c", 7, pool[3]), ("c", 7, pool[3]), ("d", None, text(30) + " x"), ("d", 5, None)]
    rows += [("d", None, rows[-2][2]), ("e", 1, rows[-2][2]), ("e", None, rows[-2][2])]
    has = {}
    for c, i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 9):
            has.setdefault(" ".join(w[k : k + 10]), set()).add((c, None if i is None else str(i)))
    want = set()
    for key, records in has.items():
        own = min(c for c, _ in records)
        if any(c != own for c, _ in records):
            want |= {(SHA(key), own, max((i for c, i in records if c == own and i is not None), default=None), c, i) for c, i in records if c != own}
    texts = spark.createDataFrame(rows, "corpus string, record_id long, text string").coalesce(3)
    packs = passages.packed(texts, 10)
    assert packs.groupBy("corpus").count().where("count > 1").count() >= 2
    for found in (passages.collisions(packs, 10), leakage.passage_collisions(texts, F.split("text", " "), 10)):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
