"""Packs, constructed records, gates and mutations on odd rows."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from assay.operators import claims, compare, gates, leakage, records
from assay.plans import bundles
from assay.sources import pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark):
    return bundles._written_pack(spark, SF)


def copy(root, tmp_path, **changed):
    """The pack with some of its configuration files changed; the records stay where they are."""
    path = root.removeprefix("file://")
    for name in os.listdir(path):
        if name not in changed:
            os.symlink(f"{path}/{name}", tmp_path / name)
    for name, value in changed.items():
        (tmp_path / name).write_text(json.dumps(value))
    return f"file://{tmp_path}"


def config(spark, root):
    from assay.sources import jsonl

    return jsonl.read_config(spark, f"{root}/capability.json")


def test_pack_views(spark, root):
    bundle = pack.open_bundle(spark, root)
    views = bundle.register(spark, "p_")
    assert views == ["p_inputs", "p_oracles", "p_labeled", "p_vocab", "p_rules"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM p_vocab ORDER BY value").collect()] == [("/d", '"no"'), ("/d", '"yes"')]
    assert spark.sql("SELECT code FROM p_rules").collect()[0][0] == "MAYBE"
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert spark.table("p_inputs").count() == n and spark.table("p_inputs").select("surface").distinct().count() == 5


def test_bad_packs_are_refused(spark, root, tmp_path_factory):
    good = config(spark, root)
    cases = {
        "status": (good | {"status": "DRAFT"}, ValueError, "not executable"), "key": ({k: v for k, v in good.items() if k != "coverage_group_key"}, ValueError, "coverage_group_key"),
        "path": (good | {"paths": good["paths"] | {"anchors": "nowhere"}}, FileNotFoundError, "nowhere"), "paths": (good | {"paths": {}}, ValueError, "paths lack"),
        "strategies": (good | {"strategies": [{"strategy_id": "a"}, {"strategy_id": "a"}]}, ValueError, "DUPLICATE_STRATEGY_ID"),
    }
    for value, kind, text in cases.values():
        with pytest.raises(kind, match=text):
            pack.open_bundle(spark, copy(root, tmp_path_factory.mktemp("pack"), **{"capability.json": value}), require_executable=True)
    for rule in ({"code": "X"}, {"code": "X", "severity": "fatal", "message": "", "when": {"exists": "/a"}}, {"code": "X", "severity": "info", "message": "", "when": {"between": 1}}):
        with pytest.raises(ValueError):
            pack.open_bundle(spark, copy(root, tmp_path_factory.mktemp("pack"), **{"safety.json": {"rules": [rule]}}))
    fixture = copy(root, tmp_path_factory.mktemp("pack"), **{"capability.json": good | {"status": "FIXTURE_ONLY"}})
    assert pack.open_bundle(spark, fixture, require_executable=True, allow_fixture=True).config["status"] == "FIXTURE_ONLY"
    with pytest.raises(ValueError):
        pack.open_bundle(spark, fixture, require_executable=True)


def test_a_record_of_another_shape_fails(spark, root, tmp_path):
    target = copy(root, tmp_path)
    os.unlink(tmp_path / "anchors")
    (tmp_path / "anchors").write_text('{"record_id":"a","surprise":1}\n')
    with pytest.raises(Exception, match="unknown fields: surprise"):
        pack.open_bundle(spark, target).labeled.collect()


def test_records_of_odd_rows(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": [2]}', "x"), (2, "no json", None), (3, None, "x")], "id long, p string, g string")
    rows = records.input_records(df, F.col("id"), F.lit("s"), F.col("g"), F.col("p"), {"group": F.col("g")}, F.lit("sig"))
    got = {r["record_id"]: r for r in rows.collect()}
    assert got["1"]["payload"] == '{"a":[2],"b":1}' and got["1"]["content_sha256"] == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()
    assert got["2"]["payload"] is None and got["2"]["content_sha256"] is None
    answers = spark.createDataFrame([("1", '{ "d": "é" }'), ("9", "{}")], "record_id string, expected string")
    oracles = records.oracle_records(rows, answers)
    assert [(r["record_id"], r["expected"]) for r in oracles.collect()] == [("1", '{"d":"é"}')]
    assert records.labeled_records(rows, oracles, "o").collect()[0]["label_sha256"] == hashlib.sha256('{"d":"é"}'.encode()).hexdigest()
    with pytest.raises(Exception, match="oracle of another input"):
        records.labeled_records(rows, oracles.withColumn("input_content_sha256", F.lit("x")), "o").collect()
    assert records.input_records(df.limit(0), F.col("id"), F.lit("s"), F.col("g"), F.col("p"), {"group": F.col("g")}, F.lit("sig")).collect() == []


def test_gates_of_odd_rows(spark):
    m = spark.createDataFrame([("a", 0.9, 3), ("b", 0.5, 3), ("c", None, 3)], "s string, x double, n long")
    gate = lambda df, base, new: tuple(gates.source_gate(df, "s", base, new, {"FLOOR": F.expr("adapted.x >= 0.8"), "GAIN": F.expr("adapted.x > base.x")}).collect()[0])
    assert gate(m, "b", "a") == ("PASSED", []) and gate(m, "a", "b") == ("FAILED", ["FLOOR", "GAIN"])
    assert gate(m, "a", "c") == ("FAILED", ["FLOOR", "GAIN"]) and gate(m, "a", "none") == ("INCOMPLETE", []) and gate(m.union(m), "b", "a") == ("INCOMPLETE", [])
    assert gate(m.limit(0), "a", "b") == ("INCOMPLETE", [])
    long = spark.createDataFrame([("a", "f", 1.0), ("a", "f", 2.0), ("b", "g", None)], "s string, m string, v double")
    assert {tuple(r) for r in gates.wide_metrics(long, ["s"], "m", "v", ["f", "g"]).collect()} == {("a", 2.0, None), ("b", None, None)}
    runs = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (3, None), (3, "y"), (4, None)], "r long, s string")
    got = {r["r"]: (r["surface"], r["consistent"]) for r in gates.inferred_surface(runs, ["r"], "s", [("both", ["y", "x"]), ("one", ["y"])]).collect()}
    assert got == {1: ("both", True), 2: ("one", True), 3: (None, False), 4: (None, False)}
    assert [r[0] for r in m.select(gates.first_blocking({"X": F.col("x") > 0.6, "N": F.col("n") > 5})).collect()] == ["N", "X", "X"]
    done = spark.createDataFrame([(1, True, False), (1, None, False), (2, True, None), (3, False, True)], "k long, d boolean, f boolean")
    assert {r["k"]: r["status"] for r in gates.completion(done, ["k"], F.col("d"), F.col("f")).collect()} == {1: "OPEN", 2: "COMPLETE", 3: "FAILED"}


def test_multisets_mutations_and_claims(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (3, "y")], "k long, v string")
    assert {tuple(r) for r in compare.multiset_diff(a, b, ["k", "v"]).collect()} == {(1, None, "left", 1), (2, "x", "right", 1), (3, "y", "right", 1)}
    assert compare.multiset_diff(a, a, ["k", "v"]).collect() == [] and compare.multiset_diff(a.limit(0), a.limit(0), ["k"]).collect() == []
    kinds = {"UP": (F.col("v") == "x", F.upper("v")), "NONE": (F.lit(None).cast("boolean"), F.col("v"))}
    assert [tuple(r) for r in records.mutated(b, "k", "v", kinds, "n").collect()] == [("UP", 2, "X")]
    texts = spark.createDataFrame([('{"a":1,"a":2,"a":3',), ('{"a":1,"b":{"a":2}}',), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(claims.repeated_keys(F.col("t"))).collect()] == [True, False, False, False]
    said = spark.createDataFrame([("BEST", [3, 1, 3]), ("WORST", [3, 1]), ("TIE", [2, 2]), ("HIGHER", [2]), ("OTHER", [1, 2]), (None, [1, 2]), ("TIE", [])], "r string, v array<long>")
    assert [r[0] for r in said.select(claims.comparison_supported(F.col("r"), F.col("v"))).collect()] == [True, False, True, False, False, False, False]


def test_window_hashes_tell_windows_apart(spark):
    """Equal windows have equal hashes and others not, for every length of windows and of texts."""
    texts = [[], ["a"], ["a", "b"] * 9, [f"w{i % 5}" for i in range(40)], [None, "a"] * 6]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, w array<string>")
    for n in (1, 2, 3, 5, 8, 10, 13):
        seen, back = {}, {}
        for r in df.select("w", leakage.window_hashes(F.col("w"), n).alias("h")).collect():
            want = [tuple(r["w"][k : k + n]) for k in range(len(r["w"]) - n + 1)]
            assert len(r["h"]) == len(want)
            for w, h in zip(want, r["h"]):
                assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_collisions_by_hashed_keys(spark):
    """Nulls, empty and short texts, repeated rows: keys of several corpora, with their digests."""
    ten = " ".join(f"w{i}" for i in range(10))
    rows = [("a", 1, f"Start {ten} end"), ("b", 7, f"other {ten.upper()}! more"), ("b", 8, None), ("a", 2, ""), ("b", 9, ""), ("a", 3, "short text"), ("b", 10, "Short, text"), ("b", 10, "Short, text"), ("a", 4, ten), ("a", 4, ten)]
    texts = spark.createDataFrame(rows, "corpus string, record_id long, text string")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    keys = leakage.shared(leakage.hashed_keys(texts, words, 10))
    got = {(r["corpus"], r["record_id"], r["key_class"], r["key"]) for r in leakage.digested(texts, words, 10, keys).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(c, i, "passage", sha(ten)) for c, i in (("a", "1"), ("b", "7"), ("a", "4"))} | {(c, i, "signature", sha("short text")) for c, i in (("a", "3"), ("b", "10"))}
    want |= {(c, i, k, sha("")) for c, i in (("a", "2"), ("b", "9")) for k in ("content", "signature")}
    assert got == want


def test_passage_collisions(spark):
    """Nulls, short texts, repeated rows, one id with two texts, passages that repeat: against every passage held together."""
    rng = __import__("random").Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(3 if n % 2 else 400)}" for _ in range(n))
    pool = [text(n) for n in (0, 3, 9, 10, 11, 25, 60, 61, 300, 1500)]
    rows = [(c, i, t) for i, t in enumerate(pool) for c in "abc" if rng.random() < 0.8] + [("a", 3, None), ("b", 7, pool[6] + " " + pool[6].upper()), ("b", 7, pool[9]), ("c", 7, pool[8]), ("c", 7, pool[8])]
    rows += [(c, 50 + k, " ".join(pool[9].split()[k * 90 : k * 90 + 40] + text(31).split())) for k in range(8) for c in "bc"]
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    has = {}
    for c, i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - 9):
            has.setdefault(hashlib.sha256(" ".join(w[k : k + 10]).encode()).hexdigest(), set()).add((c, str(i)))
    want = []
    for key, records in has.items():
        own = min(records)[0]
        want += [(key, own, max(i for c, i in records if c == own), c, i) for c, i in records if c != own]
    got = leakage.passage_collisions(spark.createDataFrame(rows, "corpus string, record_id long, text string"), words, 10)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert leakage.passage_collisions(spark.createDataFrame(rows, "corpus string, record_id long, text string").limit(0), words, 10).collect() == []


def test_counts_reasons_and_group_digests(spark):
    """Unknown counts and conditions, rows in another order, nulls, repeats, empty tables."""
    from assay.functions.hashing import group_digests
    from assay.operators import select

    m = spark.createDataFrame([("a", 3, 3), ("b", 2, 3), ("c", None, 3)], "s string, n long, want long")
    got = {r["s"]: (r["status"], r["differing"]) for r in gates.count_gate(m, ["s"], {"rows": F.col("want")}, {"rows": F.col("n")}).collect()}
    assert got == {"a": ("READY", []), "b": ("BLOCKED", ["rows=2/3"]), "c": ("BLOCKED", ["rows=unknown/3"])}
    rows = select.with_reasons(m, {"FEW": F.col("n") < 3, "MANY": F.col("want") > 9}).collect()
    assert {r["s"]: (r["rejection_reasons"], r["eligible"]) for r in rows} == {"a": ([], True), "b": (["FEW"], False), "c": (["FEW"], False)}
    data = [("x", 1, "p"), ("x", 2, None), ("x", 2, None), (None, 3, "q")]
    of = lambda d: {r["g"]: tuple(r)[1:] for r in group_digests(spark.createDataFrame(d, "g string, i long, t string"), ["g"], {"ids": [F.col("i")], "all": [F.col("i"), F.col("t")]}).collect()}
    assert of(data) == of(data[::-1]) and of(data)["x"][0] == 3
    other = of([("x", 1, None), ("x", 2, "p"), ("x", 2, None), (None, 3, "q")])
    assert other["x"][1] == of(data)["x"][1] and other["x"][2] != of(data)["x"][2] and other[None] == of(data)[None]
    assert of([]) == {}
