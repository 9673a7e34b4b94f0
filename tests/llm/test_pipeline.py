"""The pipeline against the same stages by brute force."""

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from assay.llm.quality import OP4_SQL

from .test_decontaminate import brute_leaks
from .test_ngram_join import brute as brute_links
from .test_suffix_dedup import brute_texts
from .test_tokens import brute_pieces, check_places

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = con.execute(f"select d.doc_id, d.text from documents d join ({OP4_SQL}) q using (doc_id) where kept order by 1").fetchall()
    stay = {d for d, _, c in brute_links(rows) if d == c}
    rows = brute_texts([r for r in rows if r[0] in stay])
    bench = con.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    leaking = {d for d, _ in brute_leaks(rows, bench)}
    rows = [r for r in rows if r[0] not in leaking]
    want = brute_pieces(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), rows)
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_places(got, 4096)


def test_stages_with_awkward_rows(spark):
    """Nulls in any column, empty and repeated rows, extra columns, and an empty table."""
    text = " ".join(f"word{i}." for i in range(60))
    rows = [
        (1, text, "en", "a", 10, "x"), (1, text, "en", "a", 10, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, ""), (None, text + " more", None, "a", 1, "y"),
        (None, "other " * 3 + " ".join(f"term{i}," for i in range(40)), "fr", "b", 1, "y"), (4, " ".join(f"name{i} of" for i in range(30)) + text[:200], "en", "a", 5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumns({c: F.lit(1) for c in ("_id", "_h", "_d", "_w", "_words", "sequence_id", "max_symbols")})
    counts = []
    for docs_in in (docs, docs.limit(0)):
        step = docs_in
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, SF)
            counts.append((name, step.count()))
            if name != "best-fit packing":
                assert step.columns == docs.columns
    assert [n for _, n in counts] == [5, 3, 3, 3, 3, 0, 0, 0, 0, 0]


def test_rows_that_share_an_id(spark):
    """Unrelated texts under one id stay; of near copies one goes; a leak takes its own row only."""
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("left", "right"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = [(1, one), (1, two), (1, two + " more"), (5, one), (5, one), (None, None), (None, None), (None, ""), (7, item), (7, "A clean text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text")})
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert len(kept) == 5 and {t for d, t in kept if d == 1} in ({one, two}, {one, two + " more"}) and not any(d == 5 for d, _ in kept)
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.benchmark_leaks(spark, docs, SF).collect())
    assert len(left) == len(rows) - 1 and (7, "A clean text.") in left and (7, item) not in left


def test_entry_has_the_subpackage():
    import __spark_entry__

    assert {"pipeline", "op1_decontamination", "op10_suffix_dedup"} <= set(__spark_entry__.queries())
