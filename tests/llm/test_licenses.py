"""Licences: whole texts of the common ones, and notices of a caller's own list."""

import hashlib
from pathlib import Path

import regex

from assay.llm import licenses


def scanned(spark, texts, **known):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **known).collect()
    return [(r["license_id"], r["n_notices"], r["notice_ids"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_whole_licences(spark):
    files = sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))
    assert {"Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MPL-2.0"} <= {f.stem for f in files}
    got = scanned(spark, ["Copyright 2020 A. Person\n\n" + " ".join(f.read_text().upper().split(" ")) for f in files])
    assert [g[0] for g in got] == [f.stem for f in files]


def test_notices_of_a_list_of_ones_own(spark):
    known = [("Own", "Free for all to copy."), ("Other", "Released under the MIT License.")]
    got = scanned(spark, ["a line\n * Free for all, to copy!\nreleased under the MIT licence", "free for all to copy it", None], known=known)
    assert got == [(None, 2, ["Other", "Own"]), (None, 0, []), (None, 0, [])]


def plain(text, known):
    """The canonical form, whole and by lines, without Spark."""
    c = regex.sub(licenses.COPYRIGHT_LINE, "", (text or "").lower())
    c = regex.sub(r"[^\p{L}\p{N}\n]+", " ", c)
    for variant, spelling in licenses.SPELLINGS:
        c = regex.sub(rf"\b{variant}\b", spelling, c)
    of = lambda x: hashlib.sha256(regex.sub(r"[\n ]+", " ", x).strip(" ").encode()).hexdigest()
    if known is None:
        return of(c)
    found = [known[of(x)] for x in c.split("\n") if of(x) in known]
    return of(c), known.get(of(c)), len(found), sorted(set(found))


def check(spark, df, known):
    digests = {}
    for i, t in sorted(known, reverse=True):
        digests[plain(t, None)] = i  # of equal texts the least id
    got = licenses.scan(df, known).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["digest"], r["license_id"], r["n_notices"], r["notice_ids"]) == plain(r["text"], digests)


def test_whole_table(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), licenses.KNOWN)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, and empty tables."""
    known = [("B", "Use it freely."), ("A", "use it, FREELY"), ("C", "Do what you like\nand tell nobody.")]
    texts = [None, "", "Use it freely!", "use it\nfreely", "do what you LIKE and tell nobody", "(c) 2020 me\nDo what you like\n\nand tell nobody", "x\nuse it freely\n# Use it freely.\n", "word " * 100_000 + "\nuse it freely", "no licence here"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])]
    df = spark.createDataFrame([(*r, "clash", "mine", 1) for r in rows], "doc_id long, text string, _lines string, license_id string, _known int")
    check(spark, df, known)
    assert licenses.scan(df.limit(0), known).collect() == []
    assert {(r["license_id"], r["n_notices"]) for r in licenses.scan(df, []).collect()} == {(None, 0)}


def test_known_texts_beyond_the_bound_and_as_a_table(spark):
    """Joins find what the broadcast map finds: whole texts, repeated notices, nulls, clashing columns, no rows."""
    from pyspark.sql import functions as F

    known = [("Own", "Free for all to copy."), ("Other", "Released under the MIT License."), ("Later", "free for ALL, to copy"), ("Blank", " \n"), ("Two", "First line.\nSecond line.")]
    texts = ["a line\n * Free for all, to copy!\nreleased under the MIT licence\nfree for all to copy", "free for all to copy", "first line\n\n second line", None, "", "copyright 2020 A\nfree for all to copy", "x " * 50_000 + "\nReleased under the MIT License."]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").withColumn("license_id", F.lit("mine")).withColumn("_uid", F.lit(1)).withColumn("_known", F.lit("k"))
    of = lambda df: sorted((str(r["doc_id"]), str(r["text"])[:40], r["digest"], str(r["license_id"]), r["n_notices"], tuple(r["notice_ids"])) for r in df.collect())
    want = of(licenses.scan(docs, known[:3] + known[4:]))
    assert [r[3] for r in want].count("Later") == 4 and sum(r[4] for r in want) == 12
    table = spark.createDataFrame(known, "license_id string, text string")
    assert of(licenses.scan(docs, known, most=2)) == want == of(licenses.scan(docs, table))
    assert licenses.scan(docs.limit(0), table).collect() == [] and licenses.scan(docs, table.limit(0)).where("license_id is not null or n_notices > 0").collect() == []
    assert "_uid" in licenses.scan(docs, table).columns
