"""Window cuts against every possible cutting of short streams, and whole tables through the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm.window_cuts import Costs, Stream, op13_window_cuts, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ENDS = np.array([False, True])  # id 1 ends a sentence


def plain_cost(docs, capacity, costs):
    """The least cost by looking at all windows before each place."""
    ids = [i for d in docs for i in d]
    free = set(np.cumsum([len(d) for d in docs]).tolist())
    step = min(costs.step, capacity)
    cut = [0 if p in free else costs.sentence if ids[p - 1] == 1 else costs.inside if p % step == 0 else None for p in range(1, len(ids) + 1)]
    f = [0] + [None] * len(ids)
    for p in range(1, len(ids) + 1):
        if cut[p - 1] is not None:
            f[p] = cut[p - 1] + costs.open + min(f[i] + (0 if (n := p - i) & (n - 1) == 0 else capacity - n) for i in range(max(0, p - capacity), p) if f[i] is not None)
    return f[-1]


def cost_of(docs, rows, capacity, costs):
    ids, free = [i for d in docs for i in d], set(np.cumsum([len(d) for d in docs]).tolist())
    size = defaultdict(int)
    for _, _, n, *_, s, _ in rows:
        size[s] += n
    place, total = 0, 0
    for s in sorted(size):
        place += size[s]
        total += costs.open + (0 if size[s] & (size[s] - 1) == 0 else capacity - size[s])
        total += 0 if place in free else costs.sentence if ids[place - 1] == 1 else costs.inside
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 0, 1]), min_size=1, max_size=60), min_size=1, max_size=12), st.sampled_from([12, 16]), st.integers(0, 6), st.booleans())
def test_least_cost(docs, capacity, sentence, early):
    """The cuts cost what the best of all cost; given out in parts or at the end."""
    costs = Costs(sentence=sentence, inside=9, open=1, step=4)
    stream, rows = Stream(capacity, costs, ENDS, 0), []
    for k, d in enumerate(docs):
        stream.add(k, np.array(d, np.uint32))
        if early and stream.held >= 16 * capacity:
            rows += stream.cut(False)
    rows += stream.cut(True)
    assert cost_of(docs, rows, capacity, costs) == plain_cost(docs, capacity, costs)
    placed = [(d, start, n) for d, start, n, *_ in rows]
    assert placed == sorted(placed) and sum(n for _, _, n in placed) == sum(map(len, docs))


def check(rows, texts, capacity):
    """Every id in one piece, places gapless, windows in order; the share of padding and the cuts inside documents."""
    library = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]))
    size, places, starts = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in rows:
        size[r["sequence_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        starts[r["doc_id"]].append(r)
    for s, parts in places.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == size[s] <= capacity
    assert set(starts) == set(want)
    for i, parts in starts.items():
        left = {d: 0 for d in want[i]}
        if len(want[i]) == 1:
            (ids,) = want[i]
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                a, b = r["start"], r["start"] + r["length"]
                assert a == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
                at = b
            assert at == len(ids)
        else:
            assert sum(r["length"] for r in parts) == sum(len(d) for d in want[i]) and left
    return sum(capacity - n for n in size.values() if n & (n - 1)) / max(1, sum(size.values()))


def test_whole_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check(op13_window_cuts(spark, SF).collect(), texts, 4096) < 0.003


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, an empty table."""
    texts = [(1, None), (2, ""), (3, "One. Two! Three? " * 5000), (4, "word " * 30_000), (None, "no id."), (None, "no id."), (5, "again"), (5, "again"), (6, "x" * 40_000), (7, ". " * 300)]
    docs = spark.createDataFrame([(i, t, 7, "o") for i, t in texts], "doc_id long, text string, sequence_id long, offset string").coalesce(1)
    rows = windows(docs, PATH, horizon=20_000).collect()
    assert check(rows, texts, 4096) < 0.003
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert [d for k, d in enumerate(order) if not k or d != order[k - 1]] == [1, 2, 3, 4, None, 5, 6, 7]
    assert windows(docs.limit(0), PATH).collect() == []
    assert check(windows(docs.repartition(5), PATH, capacity=100).collect(), texts, 100) < 0.2


def test_sentences_are_preferred(spark):
    """Of places that pad as little, one between sentences is cut."""
    text = " ".join("a b c d e f ." for _ in range(100))
    rows = windows(spark.createDataFrame([(0, text)], "doc_id long, text string"), PATH, capacity=16).collect()
    assert all((r["start"] + r["length"]) % 7 == 0 or r["start"] + r["length"] == 701 for r in rows)
