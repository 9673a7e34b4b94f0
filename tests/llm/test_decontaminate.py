"""Decontamination: planted leaks of all kinds, and the whole small table by brute force."""

import re

from assay.llm.decontaminate import leaks, op1_decontamination

SF = "/root/testdata/sf0.001"


def plain(text):
    """Tokens of texts without numbers; names as one placeholder, as the tables need."""
    named = re.sub(r"(?<=[a-zà-öø-ÿ,;0-9] )[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+", "\x01", text or "")
    return [w for w in re.sub(r"[^\w\x01]+|_", " ", named.replace("\x01", " \x01 ")).lower().split(" ") if w]


def brute_leaks(docs, bench, enough=5):
    grams = lambda w: [tuple(w[i : i + 8]) for i in range(len(w) - 7)] if len(w) >= 8 else [tuple(w)] * bool(w)
    where = {}
    for item, text in bench:
        for g in set(grams(plain(text))):
            if sum(x != "\x01" for x in g) >= min(5, len(g)):
                where.setdefault(g, set()).add(item)
    size = {i: len(grams(plain(t))) for i, t in bench}
    out = set()
    for d, text in docs:
        found = {}
        for g in set(grams(plain(text))):
            for item in where.get(g, ()):
                found[item] = found.get(item, 0) + 1
        out |= {(d, i) for i, n in found.items() if n >= min(enough, size[i])}
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {(r["doc_id"], r["item_id"]) for r in op1_decontamination(spark, SF).collect()} == brute_leaks(docs, bench)


ITEM = "A farmer sells 12 apples to Maria for 3 dollars each and then gives 12 pears to his neighbour who lives 5 km away, how much money is left?"
OTHER = "It is said that the river was crossed at dawn by those who had waited all night without a fire, in fear of the guards."


def found(spark, texts, bench=((1, ITEM), (2, OTHER), (3, None), (4, "too short here"))):
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, window string")
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in leaks(docs, spark.createDataFrame(list(bench), "item_id long, text string")).collect()}


def test_kinds_of_leaks(spark):
    before, after = "Some words before it stand. ", " And more words after it."
    other_values = ITEM.replace("12", "77").replace("Maria", "Chen").replace("3 dollars", "9 euros").replace("5 km", "40 miles")
    inconsistent = ITEM.replace("12 apples", "77 apples").replace("12 pears", "78 pears")
    got = found(spark, [
        (1, before + ITEM + after), (2, before + other_values + after), (3, ITEM.upper()), (4, OTHER), (5, OTHER.replace(",", "").lower() + after),
        (6, inconsistent), (7, None), (8, ""), (9, before + after), (10, "Too short, here!"), (11, before + "too short here" + after),
        (None, OTHER), (12, " ".join(OTHER.split()[:14])), (13, " ".join(OTHER.split()[:9])), (14, (before * 500) + OTHER), (14, "second text of this id"),
    ])
    assert got == {(1, 1): False, (2, 1): True, (4, 2): False, (5, 2): False, (10, 4): False, (11, 4): False, (None, 2): False, (12, 2): False, (14, 2): False} | {k: v for k, v in got.items() if k == (3, 1) or k == (6, 1)}
    assert (9, 1) not in got and (6, 1) not in got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks(docs.limit(0), bench).collect() == [] and leaks(docs, bench.limit(0)).collect() == []
    assert [tuple(r)[:2] for r in leaks(docs.union(docs), bench.union(bench)).collect()] == [(1, 1)]


def test_texts_that_share_an_id(spark):
    """Two items, and two documents, with one id are judged each by its own text."""
    bench = ((1, ITEM), (1, OTHER), (None, ITEM), (None, OTHER))
    assert set(found(spark, [(1, ITEM), (2, OTHER)], bench)) == {(1, 1), (2, 1), (1, None), (2, None)}
    half = OTHER.split()
    assert found(spark, [(1, " ".join(half[:10])), (1, " ".join(half[10:20]))], ((2, OTHER),)) == {}


SLOTTED = ((1, "Convert 5 km, 12 miles and 3 feet to metres"), (2, "What is 15 + 27 * 3?"), (3, "wir sahen Anna, Bernd und Clara, Dora und Emil, Franz mit Gerda, Heinz"))


def test_items_full_of_slots(spark):
    before, after = "Some words before it stand. ", " And more words after it."
    texts = [(i, before + t + after) for i, t in SLOTTED if i != 2] + [
        (4, "what is 15 + 27 * 3"), (5, "What is 15 + 28 * 3?"), (6, before + SLOTTED[0][1].replace("12", "13") + after), (7, before + SLOTTED[2][1].replace("Emil", "Ernst") + after),
    ]
    texts += [(8, before + SLOTTED[1][1] + after), (9, before + SLOTTED[1][1].replace("27", "28") + after)]
    assert found(spark, texts, SLOTTED) == {(1, 1): False, (3, 3): False, (4, 2): False, (8, 2): False}


def test_short_items_are_found_inside(spark):
    """Planted items of three to seven words: every one, in long documents too, and none where a word or value differs."""
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("alo", "emi", "oru", "ine", "uta")]
    items = {i: " ".join(rng.sample(words, 3 + i % 5)) + "?" for i in range(50)}
    items |= {50: "What is the capital of France?", 51: "Who wrote Hamlet?", 52: "Is 17 prime?", 53: "ok then"}
    filler = lambda n: " ".join(rng.choice(words).upper().lower() + "x" for _ in range(n))
    texts = [(i, f"{filler(40)}. {t} {filler(rng.choice((3, 4000)))}") for i, t in items.items()]
    texts += [(100, f"{filler(9)}. What is the capital of Spain? {filler(9)}"), (101, f"{filler(9)}. Is 19 prime? {filler(9)}"), (102, "What is the capital of Spain?"), (103, "ok then"), (104, None), (105, "")]
    texts += [(200 + i, " ".join(t.rstrip("?").split()[:-1]) + " " + filler(30)) for i, t in items.items() if i < 50]
    got = found(spark, texts + texts[:3], tuple(items.items()))
    assert {k for k in got if k[0] < 100} == {(i, i) for i in items if i != 53}
    assert {k: v for k, v in got.items() if 100 <= k[0] < 200} == {(102, 50): True, (103, 53): False}
    assert not [k for k in got if k[0] >= 200]


def test_values_stand_behind_their_placeholders(spark):
    from pyspark.sql import functions as F

    from assay.llm.decontaminate import canonical, valued

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in (ITEM, OTHER, None, "", "we saw McTwo and Seven at 5 Km, 3.5 kg or 7% of\x04 two\x05 tons", *(t for _, t in SLOTTED))], "text string"))
    bare = F.transform(valued(F.col("text")), lambda w: F.when(w.rlike("^[\x01\x02\x03]"), F.substring(w, 1, 1)).otherwise(w))
    assert docs.where(~bare.eqNullSafe(canonical(F.col("text")))).count() == 0
