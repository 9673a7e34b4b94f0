"""Quotas, cases, places, stage machines, open JSON, stars and rollups on odd rows against plain Python."""

import hashlib
import json
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from assay.functions import openjson
from assay.operators import machine, quotas, star, zipped
from assay.operators.quotas import CaseSlot, Quota

SF = "/root/testdata/sf0.001"


def key(namespace, *parts):
    return hashlib.sha256(":".join([namespace, *map(str, parts)]).encode()).hexdigest()


def test_dependent_quotas_equal_the_sequence(spark):
    """Overlapping quotas in order; too few rows; null conditions and ids; an empty table."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 1, None])) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, "a", 1)], "id long, g string, v long")
    wanted = [("v in a", "g = 'a' and v = 1", 5), ("a", "g = 'a'", 7), ("v", "v = 1", 60), ("v again", "v = 1", 60), ("none", "g = 'z'", 3), ("zero", "true", 0), ("rest", "true", 4)]
    tests = [lambda r: r[1] == "a" and r[2] == 1, lambda r: r[1] == "a", lambda r: r[2] == 1, lambda r: r[2] == 1, lambda r: False, lambda r: True, lambda r: True]
    taken, want = set(), set()
    for (name, _, size), fits in zip(wanted, tests):
        for n, r in enumerate(sorted((r for r in rows if fits(r) and r[0] not in taken), key=lambda r: key("q", r[0]))[:size], 1):
            taken.add(r[0])
            want.add((r[0], name, n))
    qs = [Quota(n, F.expr(c), k) for n, c, k in wanted]
    assert {tuple(r) for r in quotas.dependent(df, "id", "q", qs).collect()} == want
    assert quotas.dependent(df.limit(0), "id", "q", qs).collect() == []
    both = quotas.representatives_then(df, ["g"], "id", ("rep", "q"), qs[:1]).collect()
    reps = {r["id"] for r in both if r["quota"] == "representative"}
    assert reps == {min((r[0] for r in rows if r[1] == g), key=lambda i: key("rep", i)) for g in ("a", "b", None)}
    assert not reps & {r["id"] for r in both if r["quota"] != "representative"}


def test_representative_cases(spark):
    rows = [(e, s, (e * 7 + k) % 3 == 0) for e in range(30) for k, s in enumerate("xyz")] + [(90, "x", True), (91, "x", None), (None, "x", True), (5, "other", True)]
    df = spark.createDataFrame(rows, "e long, s string, ok boolean")
    slots = [CaseSlot("x only", ("x",), ("y", "z")), CaseSlot("x", ("x",)), CaseSlot("never", ("x", "y"), ("x",)), CaseSlot("any")]
    got = {r["slot"]: (r["e"], r["n_fitting"]) for r in quotas.representative_cases(df, "e", "s", F.col("ok"), ["x", "y", "z"], slots, "c").collect()}
    only = [e for e in range(30) if e * 7 % 3 == 0]
    assert got["x only"] == (min(only, key=lambda e: key("c", "x only", e)), len(only))
    assert got["x"] == (min([*only, 90], key=lambda e: key("c", "x", e)), len(only) + 1)
    assert got["never"] == (None, 0) and got["any"][1] == 32
    none = quotas.representative_cases(df.limit(0), "e", "s", F.col("ok"), ["x", "y", "z"], slots, "c").collect()
    assert {(r["e"], r["n_fitting"]) for r in none} == {(None, 0)} and len(none) == 4


def test_ordinals_and_running_maxima(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(50), i, rng.choice([None, 1.0, rng.random() * 9])) for i in range(400)] + [(None, 1000, 2.0)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r["i"]: r["ordinal"] for r in zipped.with_ordinals(df, ["k", "i"]).collect()}
    assert got == {r[1]: n for n, r in enumerate(order)}
    best, want = None, {}
    for n, r in enumerate(order):
        best = r[2] if best is None else best if r[2] is None else max(best, r[2])
        want[n] = best
    ran = zipped.running_max(zipped.with_ordinals(df, ["k", "i"]), "ordinal", F.col("v"), "top", block=16).collect()
    assert {r["ordinal"]: r["top"] for r in ran} == want
    assert zipped.with_ordinals(df.limit(0), ["k"]).collect() == []


RUN = "step long, loss double, tokens long"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda r: r, (50, 50, None, True, True, True, 0.0)), (lambda r: [(s, x + 0.25, t) for s, x, t in r], (50, 50, None, True, False, True, 0.25)),
        (lambda r: [(s, x + (s == 20), t) for s, x, t in r], (50, 50, None, True, False, False, 1.0)), (lambda r: [(s + 1000 * (s >= 30), x + (s == 10) + 5 * (s == 40), t) for s, x, t in r], (50, 50, 30, False, False, False, 1.0)),
        (lambda r: r[:-1], (50, 49, 49, False, False, False, 0.0)), (lambda r: [], (50, 0, 0, False, False, False, 0.0)), (lambda r: [(s, math.nan if s == 3 else x, t) for s, x, t in r], (50, 50, None, True, False, False, math.nan)),
    ],
)
def test_trajectories(spark, change, want):
    """Equal runs, small and large differences, other steps, a shorter and an empty run, NaN."""
    run = [(s, s / 4, s) for s in range(50)]
    rows = zipped.positional(spark.createDataFrame(run, RUN), spark.createDataFrame(change(run), RUN), ["step"], ["step"], ["step", "loss", "tokens"])
    (got,) = zipped.trajectory_summary(zipped.trajectory(rows, ["step", "tokens"], {"loss": (0.5, 0.0)}, block=7), ["loss"]).collect()
    found = tuple(got[c] for c in ("n_left", "n_right", "first_divergence", "ordered", "exact", "loss_within", "loss_max_delta"))
    assert found == want or math.isnan(want[-1]) and found[:-1] == want[:-1] and math.isnan(found[-1])


def test_two_empty_trajectories_agree(spark):
    none = spark.createDataFrame([], RUN)
    rows = zipped.positional(none, none, ["step"], ["step"], ["step", "loss", "tokens"])
    assert [tuple(r) for r in zipped.trajectory_summary(zipped.trajectory(rows, ["step"], {"loss": (0.5, 0.0)}), ["loss"]).collect()] == [(0, 0, None, True, True, True, 0.0)]


LINE = machine.Machine.line(["plan", "train", "check"])


def plain_runs(rows):
    out = {}
    for u, _, e in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state, n, bad, first = out.get(u, ("new", 0, 0, None))
        to = LINE.legal.get((state, e))
        out[u] = (to or state, n + 1, bad + (to is None), first if first is not None or to else n)
    return {u: (*r, LINE.resume.get(r[0])) for u, r in out.items()}


def test_stage_machine(spark):
    """Hot runs over several partitions, illegal and null events, a null run, an empty table."""
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.5 else rng.choice([None, *range(40)]), i, rng.choice(["plan", "train", "check", "failed", "other", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "u long, t long, e string").repartition(9)
    got = {r["u"]: tuple(r)[1:] for r in machine.runs(df, "u", ["t"], "e", LINE).collect()}
    assert got == plain_runs(rows)
    assert machine.runs(df.limit(0), "u", ["t"], "e", LINE).collect() == []
    one = spark.createDataFrame([(1, 5, "plan")], "u long, t long, e string")
    assert [tuple(r) for r in machine.runs(one, "u", ["t"], "e", LINE).collect()] == [(1, "plan", 1, 0, None, "train")]


def test_stream_equals_batch(spark):
    """The events in files by time, a file for each trigger: each run's last row is the batch's."""
    from assay.plans.runs import FUNNEL

    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type")
    root = tempfile.mkdtemp()
    for k in range(4):
        events.where(F.floor(F.col("event_id") * 4 / (events.count() + 1)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    seen = []
    query = machine.stream(rows, "user_id", ["event_id"], "event_type", FUNNEL).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(df.collect())).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r["user_id"]: tuple(r) for batch in seen for r in batch}
    assert len(seen) >= 4
    assert last == {r["user_id"]: tuple(r) for r in machine.runs(events, "user_id", ["event_id"], "event_type", FUNNEL).collect()}


def strip(v, names):
    if isinstance(v, dict):
        return {k: strip(x, names) for k, x in v.items() if k not in names}
    return [strip(x, names) for x in v] if isinstance(v, list) else v


def test_fields_removed_at_any_depth(spark):
    docs = [
        {"a": 1, "h": 2, "b": {"h": {"h": 1}, "c": [1, {"h": 3, "d": [[{"h": 1}], [], "é\n\"q\""]}]}}, [], {}, [[{"h": 1}]], 5, "text", None, True, {"h": 1}, {"z": None, "a": {"": {"h": 1}, "k\"y": 2, "é": 3, "Z": 4}},
        {"deep": {"d": {"d": {"d": {"d": [{"d": {"h": 1, "x": [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 11]}}]}}}}},
    ]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(docs)] + [(100, "{broken"), (101, None)]
    df = spark.createDataFrame(rows, "id long, j string")
    got = {r["id"]: r["json"] for r in openjson.without_fields(df, "id", "j", ["h"]).collect()}
    want = {i: json.dumps(strip(d, {"h"}), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, d in enumerate(docs)}
    assert got == want | {100: None, 101: None}
    digests = {r["id"]: r["sha256"] for r in openjson.content_digests(df, "id", "j", ["h"]).collect()}
    assert all(digests[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items())
    assert openjson.without_fields(df.limit(0), "id", "j", ["h"]).collect() == []


def test_volatile_fields_do_not_make_documents_differ(spark):
    a = spark.createDataFrame([(1, '{"x":1,"t":5}'), (2, '{"x":{"t":1,"y":2}}'), (3, '{"x":1}')], "id long, j string")
    b = spark.createDataFrame([(1, '{"t":6,"x":1}'), (2, '{"x":{"t":1,"y":3}}'), (4, "{}")], "id long, j string")
    assert {tuple(r) for r in openjson.differing(a, b, "id", "j", ["t"]).collect()} == {(2, "both"), (3, "left"), (4, "right")}


def test_star(spark):
    a = spark.createDataFrame([(1, "h1"), (2, "h2"), (2, "h2"), (3, "h3"), (None, "h"), (5, None)], "id long, h string")
    b = spark.createDataFrame([("1", "h1"), ("2", "h2"), ("3", "other"), ("4", "h4"), ("5", "h5")], "run string, h string")
    c = spark.createDataFrame([(1, "h1")], "id long, h string")
    sides = {"input": star.Side(a, "id", ("h",)), "output": star.Side(b, "run", ("h",)), "extra": star.Side(c, "id", ("h",))}
    table = star.matched(sides)
    lineage = {"HASH_DIFFERS": F.col("input.h") != F.col("output.h"), "EXTRA_DIFFERS": F.col("extra.h") != F.col("input.h")}
    got = {tuple(r) for r in star.findings(table, list(sides), lineage, ("extra",)).collect()}
    assert got == {("2", "DUPLICATE_INPUT"), ("3", "HASH_DIFFERS"), ("4", "MISSING_INPUT")}
    strict = {tuple(r) for r in star.findings(star.matched({k: sides[k] for k in ("input", "output")}), ["input", "output"], {"HASH_DIFFERS": lineage["HASH_DIFFERS"]}).collect()}
    assert ("5", "HASH_DIFFERS") in strict  # a null hash shows no agreement
    assert [r["key"] for r in star.complete(table, list(sides)).collect()] == ["1"]
    empty = star.matched({k: star.Side(s.df.limit(0), s.key, s.columns) for k, s in sides.items()})
    assert star.findings(empty, list(sides), lineage).collect() == []


def test_rollups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 4), ("b", None, None)], "g string, h string, v long")
    got = {r["level"]: (r["n"], r["t"]) for r in star.rollups(df, ["g", "h"], {"n": F.lit(1), "t": F.col("v")}).collect()}
    assert got == {
        "all": (4, 7), "g:a": (2, 3), "g:b": (1, None), "g:null": (1, 4), "h:x": (2, 5), "h:y": (1, 2), "h:null": (1, None),
        "not g:a": (2, 4), "not g:b": (3, 7), "not g:null": (3, 3), "not h:x": (2, 2), "not h:y": (3, 5), "not h:null": (3, 7),
    }
    assert [tuple(r) for r in star.rollups(df.limit(0), ["g"], {"n": F.lit(1)}).collect()] == []
