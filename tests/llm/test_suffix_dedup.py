"""Removal of repeated bytes against a dictionary of all windows."""

import hashlib
import random

import pytest

from assay.llm import suffix_dedup
from assay.llm.suffix_dedup import op10_suffix_dedup, removed_bytes

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """rows of (doc_id, text), in order of documents."""
    first, out = {}, []
    for k, (d, t) in enumerate(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in first:
                gone[s : s + length] = b"\1" * length
            else:
                first[w] = (k, s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_texts(rows, length=100):
    """The texts left, in order of documents, of rows with a word left; whole copies go."""
    first, out, seen = {}, [], set()
    for k, (d, t) in enumerate(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if first.setdefault(w, (k, s)) != (k, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        if kept.strip(" \t\n\v\f\r") and not (len(data) >= length and t in seen):
            out.append((d, kept))
        seen.add(t)
    return out


def order(r):
    return (r[0] is not None, r[0] or 0, r[1:])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op10_suffix_dedup(spark, SF).collect())) == brute(docs)


@pytest.mark.parametrize("hot", [3, 5000])
def test_planted_cases(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(hot)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), text(20)
    rows = [(i, f"{text(r.randint(0, 60))} {passage if i % 3 else ''} {text(r.randint(0, 30))}{line if i % 2 else ''}") for i in range(60)]
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, "a" * 1000), (103, "ab" * 300), (104, "x" + passage[:99]), (105, passage[:100]), (106, passage[:101])]
    rows += [(107, (text(30) + "\n") * 5), (108, None), (109, ""), (110, "short"), (111, "short"), (112, passage * 3)]
    rows = [(None, passage + text(20)), *rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, removed_bytes(df).collect()), key=order) == sorted(brute(rows), key=order)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 500)
    r = random.Random(5)
    part = "".join(r.choice("abcdef") for _ in range(400))
    rows = [(0, "".join(r.choice("abcdef") for _ in range(3000)) + part), (1, "zz" + part + "".join(r.choice("abcdef") for _ in range(2000)) + part[50:300])]
    # One row a batch: each is a slice of its own, so it comes in parts.
    monkeypatch.setattr(suffix_dedup, "slices", lambda texts, f=suffix_dedup.slices: ((k, d, a) for i in range(len(texts)) for k, d, a in ((i + x[0], x[1], x[2]) for x in f(texts.slice(i, 1)))))
    import pyarrow as pa

    got = [(row, a.tolist()) for row, _, a, _, _, _ in suffix_dedup.anchors_of(pa.array([t for _, t in rows]))]
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 1 << 22)
    want = {row: a.tolist() for row, _, a, _, _, _ in suffix_dedup.anchors_of(pa.array([t for _, t in rows]))}
    assert {row: sorted({x for k, a in got if k == row for x in a}) for row in want} == want


def test_equal_rows_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, long, 3), (1, long, 3), (1, "other " + long, 3), (2, "x", 4), (2, "x", 4)], "doc_id long, text string, n_bytes int")
    got = [tuple(r) for r in removed_bytes(df).collect()]
    assert len(got) == 5 and sorted(r[1] - r[2] for r in got if r[0] == 1)[0] == 0
    assert sum(r[1] - r[2] for r in got if r[0] == 1) in (len(long) + 6, len(long) + 5)
    assert removed_bytes(df.limit(0)).collect() == []


def test_hot_anchors_without_a_repetition_in_the_batch(spark):
    """A batch whose hot anchors' windows are all different has first windows and no runs."""
    import random

    import pyarrow as pa

    from assay.llm.suffix_dedup import _hot_windows, anchors_of

    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    ((_, _, at, *_),) = list(anchors_of(pa.array([text])))
    rows = spark.createDataFrame([(1, 2, text, [int(at[0])])], "_d long, _h long, text string, hot array<long>")
    got = _hot_windows(rows).collect()
    assert got and all(r["w"] is not None and r["b"] is None for r in got)
    twice = _hot_windows(rows.unionByName(rows.selectExpr("_d + 1 as _d", "_h + 1 as _h", "text", "hot")).coalesce(1)).collect()
    assert [r["w"] is None for r in twice].count(True) == 1
