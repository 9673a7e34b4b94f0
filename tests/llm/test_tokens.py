"""Token operators against whole texts through the library, one at a time."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm import simple8b
from assay.llm.packing import op3_best_fit_packing, pack, pack_documents, placement_rules
from assay.llm.token_counts import length_histogram, quantile, truncated_total
from assay.llm.token_files import documents_of, encode_blocks, op6_token_files, read, write
from assay.llm.tokenizing import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " \t\n", "The CAT's hat, isn't it?", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é, É! ÉCOLE", "a b c\x1cd\x1fe",
    "12.5% of $3,000!!", "İstanbul ΣΑΣ ßẞ", "x" * 5000, "한국어 中文, \U0001f600!", "don't we'll they've I'm he'd", "a,b.c;d a'!s !'s ,,x", "Å Ω", "word " * 6000,
]
SCHEMA = "doc_id long, text string, sequence_id long, part string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library_on_odd_texts(library):
    import pyarrow as pa

    ids, at = WordEncoder(PATH).encode(pa.array(ODD, pa.string()))
    for k, t in enumerate(ODD):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(library, t), t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aBé,.'!? \n\t\x1ć <|>endoftxsT1Σ")), max_size=30), min_size=1, max_size=5))
def test_encoder_equals_library(texts):
    import pyarrow as pa

    library = Tokenizer.from_file(PATH)
    ids, at = _shared().encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(library, t) for t in texts]


def _shared(cache=[]):  # noqa: B006
    if not cache:
        cache.append(WordEncoder(PATH))
    return cache[0]


def test_simple8b_whole_chunks():
    """Numbers of ids that fill their chunks exactly."""
    for size in (simple8b.CHUNK, 2 * simple8b.CHUNK, 5 * simple8b.CHUNK):
        ids = np.random.default_rng(size).integers(0, 50_000, size)
        assert (simple8b.decode(*simple8b.encode(ids), size) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=3000))
def test_simple8b_round_trip(ids):
    words, offsets, escapes = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets, escapes, len(ids)).tolist() == ids


def odd_docs(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(ODD)] + [(None, "no id here", 1, None), (3, "same id", 2, "y"), (3, "same id", 2, "y")]
    return spark.createDataFrame(rows, SCHEMA)


def brute_pieces(library, rows, capacity=4096):
    out = []
    for d, t in rows:
        ids = ids_of(library, t) + [1]
        out += [(d, k, i, len(ids[i : i + capacity]), zlib.crc32(np.array(ids[i : i + capacity], "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), capacity))]
    return out


def check_places(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        here = 0
        for o, n in sorted(places):
            assert o == here
            here += n
        assert here <= capacity
    return len(at)


def key(t):
    return tuple((x is None, x) for x in t)


def test_packing_odd_documents(spark, library):
    docs = odd_docs(spark)
    got = pack_documents(docs, PATH).collect()
    want = brute_pieces(library, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    check_places(got, 4096)
    assert pack_documents(docs.limit(0), PATH).collect() == []


def test_packing_whole_table(spark, library):
    rows = op3_best_fit_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(brute_pieces(library, docs))
    assert check_places(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_hot_length_and_other_columns(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "case when id % 3 = 0 then 1 else id % 97 + 1 end as length", "'kept' as note")
    got = pack(rows, 100).collect()
    assert len(got) == 5000 and {r["note"] for r in got} == {"kept"}
    assert check_places(got, 100) <= -(-sum(r["length"] for r in got) // 100) + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), min_size=1, max_size=25))
def test_rules_place_all_and_never_need_more_than_best_fit(histogram):
    bins, seen = defaultdict(list), defaultdict(set)
    for length, a, b, first, per, offset in placement_rules(histogram, 60):
        for r in range(a, b):
            seen[length].add(r)
            bins[first + (r - a) // per].append((offset + (r - a) % per * length, length))
    assert {k: len(v) for k, v in seen.items()} == histogram
    for places in bins.values():
        here = 0
        for o, n in sorted(places):
            assert o == here
            here += n
        assert here <= 60
    plain = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fit = [(room, i) for i, room in enumerate(plain) if room >= length]
        if fit:
            plain[min(fit)[1]] -= length
        else:
            plain.append(60 - length)
    assert len(bins) <= len(plain)


def brute_files(library, rows):
    start, out = 0, []
    for d, t in rows:
        ids = ids_of(library, t) + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op6_token_files(spark, SF).collect())) == brute_files(library, docs)


def test_token_files_odd_documents(spark, library, tmp_path):
    docs = odd_docs(spark)
    write(docs, f"file://{tmp_path}/t", PATH)
    got = sorted(map(tuple, documents_of(read(spark, f"file://{tmp_path}/t")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: (d is not None, d))
    want = {(r["doc_id"], n, c) for r in docs.collect() for _, _, n, c in brute_files(library, [(r["doc_id"], r["text"])])}
    assert {(d, n, c) for d, _, n, c in got} == want
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()
    assert encode_blocks(docs.limit(0), PATH).collect() == []


def test_length_histogram(spark, library):
    docs = odd_docs(spark)
    n = [len(ids_of(library, r["text"])) + 1 for r in docs.collect()]
    h = length_histogram(docs, PATH)
    rows = h.collect()
    assert sorted((r["n_tokens"], r["n_docs"]) for r in rows) == sorted((x, n.count(x)) for x in set(n))
    for r in rows:
        assert r["docs_from"] == sum(x >= r["n_tokens"] for x in n) and r["tokens_from"] == sum(x for x in n if x >= r["n_tokens"])
        assert r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in n) and r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
    for limit in (1, 5, 100, 10**6):
        assert truncated_total(h, limit).first()[0] == sum(min(x, limit) for x in n)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert quantile(h, q).first()[0] == sorted(n)[max(0, int(np.ceil(q * len(n))) - 1)]
    assert length_histogram(docs.limit(0), PATH).collect() == []
