"""Quality rules on odd rows, against a plain count of each text."""

import re
from collections import Counter

from pyspark.sql import functions as F

from assay.llm.quality import judge


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


CLEAN = [f"A plain text number {i} of twenty and more words, which says nothing new but has no fault that a rule could find in it at all." for i in range(60)]
ODD = [None, "", " \n\t ", "one word", "same line\nsame line\n" * 20, "a b c d e f g h " * 30, "w | " * 60, "é#ß " * 40, "x" * 200_000, ("long text with words %d " % 7) * 9_000, "\x0b".join(f"w{i}" for i in range(30))]


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [(i, t, "en", "a") for i, t in enumerate(CLEAN + ODD)] + [(None, CLEAN[0], None, None), (0, CLEAN[0], "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"kept": F.lit("mine"), "n_words": F.lit(-1), "_max": F.lit(1), "extra": F.lit(2)})
    got = judge(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    kept = {r["text"] for r in got if r["kept"]}
    assert set(CLEAN) <= kept and not kept & {ODD[0], ODD[1], ODD[2], ODD[3], ODD[4], ODD[5], ODD[6], ODD[7]}
    assert judge(docs.limit(0)).collect() == []


def test_cutoffs_follow_the_group(spark):
    """What is common in one source is kept there and rejected in another; a small group takes its language's."""
    many = [f"{i} $ price of thing number {i} is {i} $ and that of the next one, as they all say here, is one more $ than it" for i in range(60)]
    rows = [(i, t, "en", "prices") for i, t in enumerate(many)] + [(100 + i, t, "en", "prose") for i, t in enumerate(CLEAN)] + [(200, many[0], "en", "prose"), (201, many[0], "en", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in judge(docs).where("kept").collect()}
    assert set(range(60)) | set(range(100, 160)) <= kept and 200 not in kept
    few = {r["doc_id"] for r in judge(docs, min_group=1).where("kept").collect()}
    assert 201 in few


def test_long_words_are_no_fault_of_a_group(spark):
    """Texts without spaces between most words: values far beyond a thousand have their own cells, and none is cut off."""
    texts = [" ".join("x" * (150 + (7 * i + 13 * k) % 100) for k in range(25)) for i in range(80)]
    docs = spark.createDataFrame([(i, t + str(i), "zh", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert judge(docs).where("kept").count() == 80


def test_cutoffs_follow_the_spread(spark):
    """No constant decides: a source of wider spread has a higher cutoff, and equal values only the sketch's slack."""
    wide = [CLEAN[i].replace(" ", " $ ", i % 7) for i in range(60)]
    rows = [(i, t, "en", "wide") for i, t in enumerate(wide)] + [(100 + i, t, "en", "narrow") for i, t in enumerate(CLEAN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cut = {r["source"]: r["max_symbols"] for r in judge(docs).select("source", "max_symbols").distinct().collect()}
    values = sorted(1000 * (i % 7) // (plain(wide[i])[1] + 200) for i in range(60))
    assert cut == {"narrow": 2, "wide": values[53] + 3 * (values[53] - values[5]) + 2}


def test_cells(spark):
    """Three leading digits beyond a thousand: bounded numbers of cells, an error under a hundredth."""
    from assay.llm.quality import cell

    got = {r["v"]: r["c"] for r in spark.createDataFrame([(v,) for v in (0, 7, 999, 1000, 1009, 12_345, 9_876_543_210)], "v long").select("v", cell(F.col("v")).alias("c")).collect()}
    assert got == {0: 0, 7: 7, 999: 999, 1000: 1000, 1009: 1000, 12_345: 12_300, 9_876_543_210: 9_870_000_000}
