"""Replays, plugins and slots on odd rows: nulls, ties, repeats, empty tables."""

import hashlib
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from assay.functions import plugins
from assay.operators import digest_tree, matching, replay

ROWS = [(f"k{i}", i % 7, f"v{i}" if i % 5 else None, i / 4 if i % 3 else None) for i in range(3000)]
SCHEMA = "id string, grp long, text string, x double"


def stored(spark, rows, name="t"):
    return digest_tree.store(spark.createDataFrame(rows, SCHEMA), f"{tempfile.mkdtemp()}/{name}", ["id", "grp"], ["text", "x"])


def found(a, b):
    return {tuple(r) for r in digest_tree.differences(a, b).collect()}


def test_digest_tree_names_what_differs(spark):
    """Values, nulls and lost rows; equal tables, in another order too, have no differences."""
    changed = [r for r in ROWS if r[0] != "k7"] + [("new", 1, "a", 1.0), (None, 2, "b", None)]
    changed = [(i, g, "other" if i == "k11" else None if i == "k12" else t, None if i == "k13" else x) for i, g, t, x in changed]
    random.Random(1).shuffle(changed)
    left, right = stored(spark, ROWS), stored(spark, changed)
    assert found(left, right) == {
        ("k7", 0, "left", None, None, None), ("new", 1, "right", None, None, None), (None, 2, "right", None, None, None),
        ("k11", 4, "both", "text", "v11", "other"), ("k12", 5, "both", "text", "v12", None), ("k13", 6, "both", "x", "3.25", None),
    }
    shuffled = ROWS[::-1]
    assert found(left, stored(spark, shuffled)) == set()
    assert found(stored(spark, []), stored(spark, [])) == set()
    assert {r[2] for r in found(left, stored(spark, []))} == {"left"} and len(found(left, stored(spark, []))) == len(ROWS)


def test_digest_tree_reads_only_what_differs(spark):
    """One changed row: of each side one folder is read again."""
    changed = [(i, g, "other" if i == "k11" else t, x) for i, g, t, x in ROWS]
    left, right = stored(spark, ROWS), stored(spark, changed)
    ranges = digest_tree.differing_ranges(left, right)
    assert len(ranges) == 1
    scanned = left.rows(ranges).select(F.input_file_name()).distinct().collect()
    assert scanned and all(f"_range={ranges[0]}/" in r[0] for r in scanned)
    assert re.search(r"PartitionFilters: \[[^\]]*_range", digest_tree.differences(left, right)._jdf.queryExecution().toString())


def test_repeated_rows_and_swapped_nulls_have_other_digests(spark):
    assert digest_tree.differing_ranges(stored(spark, ROWS), stored(spark, [*ROWS, ROWS[5]])) != []
    a, b = stored(spark, [("a", 1, None, 2.0)]), stored(spark, [("a", 1, "2.0", None)])
    assert {r[3] for r in found(a, b)} == {"text", "x"}


def test_replay_takes_failed_rows_as_they_are(spark):
    rows = spark.createDataFrame([("a", "DONE", 3, 9), ("b", "DONE", 4, 16), ("c", "FAILED", 5, 0), ("d", None, 6, 0), ("e", "DONE", 7, 50)], "id string, status string, v long, square long")
    path = tempfile.mkdtemp()
    kept = digest_tree.store(rows, f"{path}/a", ["id"], ["square"])
    again = lambda df: df.drop("square").withColumn("square", F.col("v") * F.col("v"))
    assert [tuple(r) for r in replay.replay_rows(kept, again, f"{path}/b", []).collect()] == [("e", "METRICS_MISMATCH", "square")]
    lossy = lambda df: again(df).where("id <> 'a'")
    assert ("a", "ROW_LOST", "") in [tuple(r) for r in replay.replay_rows(kept, lossy, f"{path}/c", ["square"]).collect()]


def test_replay_of_artifacts(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 3)], "g string, surface string, v long")
    build = lambda df: df.groupBy("g").agg(F.sum("v").alias("s"))
    good, bad = build(rows), spark.createDataFrame([("a", 3), ("c", 3)], "g string, s long")
    got = replay.replay_artifacts({"one": good, "two": bad}, {"one": build, "two": build}, {"one": ["g"], "two": ["g"]}, rows, "surface").collect()
    assert [tuple(r) for r in got] == [("one", "PASSED", 2, 2, 0, True), ("two", "FAILED", 2, 2, 2, True)]
    with pytest.raises(ValueError, match="three"):
        replay.replay_artifacts({"three": good}, {}, {}, rows)


CODE = b'''
PLUGIN_ID, PLUGIN_VERSION = "half", "2"
def evaluate(n, name):
    if n == 0: raise ZeroDivisionError("no half")
    if n == 1: return "not a dict"
    return {"half": None if n is None else n / 2, "name": name}
'''


def test_plugin_rows(spark):
    path = f"{tempfile.mkdtemp()}/half.py"
    with open(path, "wb") as f:
        f.write(CODE)
    plugin = plugins.load(spark, path, "half", "2", hashlib.sha256(CODE).hexdigest(), "half double, name string")
    df = spark.createDataFrame([(4, "a"), (0, "b"), (1, "c"), (None, None), (4, "a")], "n long, name string")
    judged = df.withColumn("r", plugins.evaluate(plugin, n=F.col("n"), name=F.col("name")))
    got = sorted(((r["n"], r["r"]["status"], r["r"]["error"], r["r"]["value"] and r["r"]["value"]["half"]) for r in judged.collect()), key=str)
    assert got == sorted([(4, "COMPLETED", None, 2.0), (4, "COMPLETED", None, 2.0), (0, "FAILED", "ZeroDivisionError: no half", None), (1, "FAILED", "TypeError: evaluate returned str", None), (None, "COMPLETED", None, None)], key=str)
    assert {tuple(r) for r in plugins.failures(judged, "r", []).collect()} == {("ZeroDivisionError", 1), ("TypeError", 1)}
    assert judged.limit(0).collect() == []


def test_plugin_is_refused(spark):
    """A changed file, another version or id, no evaluate, no file: refused before any row is read."""
    path = f"{tempfile.mkdtemp()}/half.py"
    with open(path, "wb") as f:
        f.write(CODE)
    pin = hashlib.sha256(CODE).hexdigest()
    for i, v, sha in (("half", "3", pin), ("third", "2", pin), ("half", "2", "0" * 64)):
        with pytest.raises(plugins.PluginError):
            plugins.load(spark, path, i, v, sha, "half double")
    with open(path, "ab") as f:
        f.write(b"# changed\n")
    with pytest.raises(plugins.PluginError, match="SHA-256"):
        plugins.load(spark, path, "half", "2", pin, "half double")
    with pytest.raises(plugins.PluginError, match="one file"):
        plugins.load(spark, path + ".none", "half", "2", pin, "half double")
    changed = plugins.Plugin("half", "2", pin, "half double, name string", CODE + b"#")
    with pytest.raises(Exception, match="SHA-256"):
        spark.range(3).select(plugins.evaluate(changed, n=F.col("id"), name=F.lit("x"))).collect()


def plain_slots(rows, taken):
    held, out = set(taken), {}
    for s, a, keys in sorted(rows, key=lambda r: r[:2]):
        keys = {k for k in keys if k is not None}
        if s not in out and not held & keys:
            out[s] = a
            held |= keys
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slots_equal_the_loop(spark, seed):
    """Random attempts of one to three keys: rounds only, and rounds that end in the loop."""
    rng = random.Random(seed)
    n = 60
    rows = [(s, a, [rng.choice([f"k{rng.randrange(n)}", None, f"k{s % 5}"]) for _ in range(rng.randrange(4))]) for s in range(n) for a in range(rng.randrange(5))]
    taken = [f"k{i}" for i in range(0, n, 9)]
    attempts, gone = spark.createDataFrame(rows, "slot long, attempt int, keys array<string>"), spark.createDataFrame([(k,) for k in [*taken, taken[0], None]], "key string")
    want = plain_slots(rows, taken)
    for few in (0, 40):
        got = matching.first_free(attempts, gone, few).collect()
        assert {r["slot"]: r["attempt"] for r in got if r["status"] == "ACCEPTED"} == want
        assert {r["slot"] for r in got} == {s for s, _, _ in rows}
        for r in got:
            assert r["n_rejected"] == sum(s == r["slot"] and (r["attempt"] is None or a < r["attempt"]) for s, a, _ in rows)


def test_later_slots_take_what_is_left(spark):
    """A slot's unused attempts hold no key."""
    rows = [(1, 0, ["x"]), (1, 1, ["y"]), (2, 0, ["x"]), (2, 1, ["y"]), (3, 0, ["y"])]
    attempts, none = spark.createDataFrame(rows, "slot long, attempt int, keys array<string>"), spark.createDataFrame([], "key string")
    got = {r["slot"]: (r["attempt"], r["status"]) for r in matching.first_free(attempts, none).collect()}
    assert got == {1: (0, "ACCEPTED"), 2: (1, "ACCEPTED"), 3: (None, "EXHAUSTED")}
    assert matching.first_free(attempts.limit(0), none).collect() == []


def test_pool_audits(spark):
    quotas = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "g string, quota int")
    slots = matching.quota_slots(quotas, ["g"], "quota", ["g"])
    assert sorted((r["g"], r["slot_in_group"]) for r in slots.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    attempts = slots.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("keys", F.array(F.concat("g", F.col("attempt").cast("string"))))
    none = spark.createDataFrame([("b0",), ("b1",)], "key string")
    filled = matching.first_free(attempts, none).join(slots, "slot")
    found = {tuple(r) for r in matching.audits(filled, quotas, ["g"], "quota", none).collect()}
    assert found == {("QUOTA_NOT_MET", "b", 1), ("ATTEMPTS_EXHAUSTED", "b", 1)}
    sound = matching.first_free(attempts, none.limit(0)).join(slots, "slot")
    assert matching.audits(sound, quotas, ["g"], "quota", none.limit(0)).collect() == []
