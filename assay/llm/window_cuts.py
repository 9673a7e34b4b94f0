"""Order-preserving packing: sequences are windows of the token stream, cut by dynamic programming.

The documents' tokens, one document after the other as the table has them, are a stream, and a
sequence is a window of it. A window of `capacity` tokens or of a power of two is stored as it is;
a shorter one is padded to the capacity. A cut between documents is free, one between sentences
costs a little, and one inside a sentence more. The cuts chosen have the least total cost.

With f(j) the least cost of all tokens before place j,

    f(j) = cut(j) + open + min( min over i in [j - capacity, j) of f(i) + capacity - (j - i),
                                min over powers of two of f(j - 2^k) )

The first minimum is that of f(i) + i over a sliding window: a monotone queue keeps it at constant
cost for each place. The second has a dozen terms, and only places that can be cut count.

A task cuts the stream of its own partition, so nothing is shuffled and the order of documents
stays. It holds about HORIZON tokens: when the best ways to all places that can still matter have a
cut in common, what lies before it is final and is given out. So the result is the exact optimum of
the partition's stream unless no such cut appears in HORIZON tokens; then the best way so far stands.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, give_back, save, table
from .tokenizing import encode_with_end

WINDOWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens a task holds before it gives out what is final; a longer document is held whole.
HORIZON = 1 << 20


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: a cut between sentences, one inside a sentence, a sequence more. `step`:
    inside sentences the stream can be cut at its multiples."""

    sentence: int = 2
    inside: int = 24
    open: int = 32
    step: int = 64


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id of the vocabulary whether it is a word of full stops, exclamation or question marks."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for word, i in vocabulary.items() if re.fullmatch(r"[.!?…]+</w>", word)]] = True
    return out


def places(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray, costs: Costs, capacity: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream can be cut after its start, ascending, and each cut's cost. `document_ends`:
    places behind a document's last token; `first`: the stream's place of ids[0]."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    step = min(costs.step, capacity)
    cost[(-first) % step :: step] = costs.inside
    known = ids < len(ends)
    cost[1:][known & ends[np.where(known, ids, 0)]] = costs.sentence
    cost[document_ends] = 0
    cost[0] = -1
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_ways(at: np.ndarray, cost: np.ndarray, capacity: int, open_cost: int) -> tuple[list[int], list[int]]:
    """f and the place before, for the start (index 0) and each place that can be cut (from 1)."""
    at = np.concatenate(([0], at))
    index = np.full(at[-1] + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    here, there = [], []
    size = 1
    while size <= capacity:
        back = at - size
        ok = back >= 0
        found = np.where(ok, index[np.where(ok, back, 0)], -1)
        here.append(np.flatnonzero(found >= 0))
        there.append(found[found >= 0])
        size *= 2
    here, there = np.concatenate(here), np.concatenate(there)
    order = np.argsort(here, kind="stable")
    exact, bounds = there[order].tolist(), np.searchsorted(here[order], np.arange(len(at) + 1)).tolist()
    place, cut = at.tolist(), [0, *cost.tolist()]
    f, before, slid = [0] * len(place), [0] * len(place), [0] * len(place)
    queue, head = [0], 0
    for c in range(1, len(place)):
        p = place[c]
        while place[queue[head]] < p - capacity:
            head += 1
        i = queue[head]
        least = slid[i] + capacity - p
        for k in range(bounds[c], bounds[c + 1]):
            e = exact[k]
            if f[e] < least:
                least, i = f[e], e
        f[c] = least = least + cut[c] + open_cost
        before[c] = i
        slid[c] = least = least + p
        while len(queue) > head and slid[queue[-1]] >= least:
            queue.pop()
        queue.append(c)
    return f, before


def _way(before: list[int], c: int) -> list[int]:
    out = [c]
    while c:
        c = before[c]
        out.append(c)
    return out[::-1]


def _common(before: list[int], alive: range) -> int:
    """The last place that the ways to all of `alive` go through."""
    heap, seen = [-c for c in alive], set(alive)
    heapq.heapify(heap)
    while len(heap) > 1:
        c = before[-heapq.heappop(heap)]
        if c not in seen:
            seen.add(c)
            heapq.heappush(heap, -c)
    return -heap[0]


@dataclass
class Stream:
    """The tokens of one partition that are not given out yet."""

    capacity: int
    costs: Costs
    ends: np.ndarray
    horizon: int
    first: int = 0
    sequences: int = 0
    held: int = 0
    documents: list[tuple] = field(default_factory=list)  # doc_id, tokens in all, tokens given out, ids left

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Pieces (doc_id, start, length, crc32, doc_tokens, sequence, offset) of the windows that are final."""
        if not self.held:
            return []
        sizes = np.array([len(d[3]) for d in self.documents])
        ids, until = np.concatenate([d[3] for d in self.documents]), np.cumsum(sizes)
        at, cost = places(ids, until, self.ends, self.costs, self.capacity, self.first)
        f, before = best_ways(at, cost, self.capacity, self.costs.open)
        full = np.concatenate(([0], at))
        if last:
            way = _way(before, len(at))
        else:
            alive = range(int(np.searchsorted(full, len(ids) - self.capacity, side="right")), len(full))
            common = _common(before, alive)
            if common:
                way = _way(before, common)
            else:
                way = _way(before, min(alive, key=f.__getitem__))
                way = [c for c in way if full[c] <= len(ids) - 8 * self.capacity]
        cuts = full[way]
        starts = until - sizes
        breaks = np.union1d(cuts, starts[starts < cuts[-1]])
        rows = []
        data = np.ascontiguousarray(ids, "<u4").view(np.uint8)
        doc = np.searchsorted(starts, breaks[:-1], side="right") - 1
        sequence = np.searchsorted(cuts, breaks[:-1], side="right") - 1
        for a, b, d, s in zip(breaks[:-1].tolist(), breaks[1:].tolist(), doc.tolist(), sequence.tolist()):
            doc_id, tokens, given, _ = self.documents[d]
            rows.append((doc_id, given + a - int(starts[d]), b - a, zlib.crc32(data[4 * a : 4 * b]), tokens, self.sequences + s, a - int(cuts[s])))
        end = int(cuts[-1])
        keep = int(np.searchsorted(until, end, side="right"))
        rest = self.documents[keep:]
        if rest and (gone := end - int(starts[keep])) > 0:
            doc_id, tokens, given, left = rest[0]
            rest[0] = (doc_id, tokens, given + gone, left[gone:].copy())
        self.documents, self.held = rest, len(ids) - end
        self.first, self.sequences = self.first + end, self.sequences + len(cuts) - 1
        return rows


def windows(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, costs: Costs = Costs(), horizon: int = HORIZON) -> DataFrame:  # noqa: B008
    """Encode each text of `docs` (doc_id, text), append `end_id`, and cut each partition's stream into
    sequences of at most `capacity` tokens.

    One row for each piece of a document in a sequence: doc_id, start (ids of the document before it),
    length, ids_crc32, doc_tokens (all of the document's), sequence_id, offset (place in the sequence,
    gapless from 0). Documents stay in the order in which their partition has them; for another,
    sort first. A null text is an empty one: the end id alone. Null and repeated doc_ids and equal rows
    are documents of their own. A long text is cut as often as it must be. An empty table gives none. Other
    columns are not read. Equal costs are decided by position, so that a repeated task gives the same.
    """
    ends = sentence_ends(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(capacity, costs, ends, horizon)
        base = TaskContext.get().partitionId() << 36

        def out(rows: list[tuple]) -> pa.RecordBatch:
            d, start, n, crc, tokens, s, offset = zip(*rows)
            whole = [pa.array(c, pa.int64()) for c in (d, start, n, crc, tokens, [base + k for k in s], offset)]
            return pa.RecordBatch.from_arrays(whole, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_with_end(tokenizer, batch.column("text"), end_id)):
                stream.add(doc_id, ids)
                if stream.held >= max(horizon, 16 * capacity) and (rows := stream.cut(False)):
                    yield out(rows)
        if rows := stream.cut(True):
            yield out(rows)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, WINDOWS)


def op13_window_cuts(spark, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in windows of 4096 tokens: see `windows` for nulls, empty and very long texts,
    ties, repeated rows and empty tables."""
    import public_tokenizers

    return save(windows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "windows", batch=TEXTS)
