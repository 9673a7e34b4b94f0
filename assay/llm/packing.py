"""Best-fit packing with dominance reduction.

Documents become pieces of at most `capacity` tokens. How well pieces pack depends only on how
many there are of each length, so the work is done on the histogram of lengths: at most
`capacity` numbers, whatever the corpus. On it

1. the reduction of Martello and Toth fixes bins that provably dominate every alternative: a
   piece that nothing fits beside is alone; a pair that fills a bin exactly is together; the
   largest piece that fits beside another goes with it when no two others that fit would use
   more of the room;
2. what is left is packed by best fit in decreasing order, all pieces of a length and all bins
   of a residual at a time.

The result is a list of placement rules (length, ranks, bins), a few for each length. A piece's
rank among those of its length comes from salted windows, and a join with the rules places it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, give_back, held, hold, n_partitions, save, table
from .tokenizing import crc32, encode_with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RULES = "length long, from_rank long, to_rank long, first_bin long, per_bin long, first_offset long"
#: Rules that are broadcast: 6 numbers each, under 3 MB; beyond it Spark's own choice of join holds.
BROADCAST_RULES = 50_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Encode each text (null: empty), append `end_id`, cut what is longer than `capacity`.

    One row for each piece: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32. Null and repeated doc_ids are kept; an empty text is one piece of the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for d, ids in zip(batch.column("doc_id").to_pylist(), encode_with_end(tokenizer, batch.column("text"), end_id)):
                for k, i in enumerate(range(0, len(ids), capacity)):
                    part = ids[i : i + capacity]
                    rows.append((d, k, i, len(part), crc32(part)))
            d, k, i, n, c = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class _Plan:
    """Bins and rules made so far. `left` has the pieces of each length not placed yet."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in histogram.items() if c}
        self.lengths = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)
        self.bins, self.rules = 0, []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual: runs of bins
        self.residuals: list[int] = []

    def new(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def place(self, length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        self.rules.append((length, self.rank[length], self.rank[length] + count, first_bin, per_bin, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def keep_open(self, residual: int, first: int, count: int) -> None:
        if count and residual:
            if not self.open[residual]:
                insort(self.residuals, residual)
            self.open[residual].append((first, count))

    def take_open(self, residual: int) -> tuple[int, int]:
        run = self.open[residual].pop()
        if not self.open[residual]:
            self.residuals.pop(bisect_left(self.residuals, residual))
        return run


def _beats_pairs(lengths: list[int], left: dict[int, int], largest: int, room: int, own: int) -> bool:
    """Whether no set of two or more pieces that fits `room` uses more of it than `largest` does.
    `own` is the length of the piece in the bin: one of its length less is there to choose."""
    usable = [n for n in lengths if n <= room and left[n] - (n == own) > 0]
    smallest = [n for n in usable[:3] for _ in range(min(3, left[n] - (n == own)))][:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return True
    if len(smallest) == 3 and sum(smallest) <= room:
        return False  # sets of three fit: not shown
    i, j = 0, len(usable) - 1
    while i <= j:
        both = usable[i] + usable[j]
        if both > room:
            j -= 1
        elif both > largest and (i < j or left[usable[i]] - (usable[i] == own) > 1):
            return False
        else:
            i += 1
    return True


def _reduce(plan: _Plan) -> None:
    """Fix, from the largest piece down, the bins that dominate every other use of that piece."""
    for length in plan.lengths[::-1]:
        while plan.left.get(length):
            room, count = plan.capacity - length, plan.left[length]
            fit = bisect_left(plan.lengths, room + 1) - 1
            if fit >= 0 and plan.lengths[fit] == length and count == 1:
                fit -= 1
            if fit < 0:
                plan.place(length, count, plan.new(count), 1, 0)
                break
            best = plan.lengths[fit]
            if best > length or best != room and not _beats_pairs(plan.lengths, plan.left, best, room, length):
                break
            if best == length:
                pairs = count // 2
                plan.place(length, 2 * pairs, plan.new(pairs), 2, 0)
            else:
                pairs = min(count, plan.left[best])
                first = plan.new(pairs)
                plan.place(length, pairs, first, 1, 0)
                plan.place(best, pairs, first, 1, length)


def _best_fit(plan: _Plan) -> None:
    """Best fit in decreasing order over what is left."""
    for length in plan.lengths[::-1]:
        while plan.left.get(length):
            count, at = plan.left[length], bisect_left(plan.residuals, length)
            if at < len(plan.residuals):
                residual = plan.residuals[at]
                first, n = plan.take_open(residual)
            else:
                residual = plan.capacity
                n = -(-count // (residual // length))
                first = plan.new(n)
            each = residual // length
            whole = min(n, count // each)
            if whole:
                plan.place(length, whole * each, first, each, plan.capacity - residual)
                plan.keep_open(residual - each * length, first, whole)
            rest = plan.left.get(length, 0)
            if whole < n and rest and rest < each:
                plan.place(length, rest, first + whole, each, plan.capacity - residual)
                plan.keep_open(residual - rest * length, first + whole, 1)
                whole += 1
            plan.keep_open(residual, first + whole, n - whole)


def placement_rules(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Rules (length, from_rank, to_rank, first_bin, per_bin, first_offset) that place every piece:
    the one of rank r goes to bin first_bin + (r - from_rank) div per_bin, at first_offset plus
    length times the remainder. Bins are numbered from 0."""
    plan = _Plan(histogram, capacity)
    _reduce(plan)
    _best_fit(plan)
    return plan.rules


def pack(rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each row with a `length` of 1 to `capacity` a sequence_id and an offset, in as few
    sequences as dominance and best fit find; offsets are gapless from 0. Rows need doc_id and
    piece for a stable order; other columns are kept. An empty table gives an empty one.
    """
    spark, columns, needed = rows.sparkSession, rows.columns, ["doc_id", "piece", "length"]
    columns = [c for c in columns if c not in ("sequence_id", "offset")]
    rows = hold(rows.select(*columns), needed)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rules = placement_rules(counts, capacity)
    # The most common length is dealt out like the rest: no part of it exceeds half a mean partition.
    together = max(1, sum(counts.values()) // (2 * n_partitions(spark)))
    salts = max(1, -(-max(counts.values(), default=0) // together))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    if salts > 1:
        ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    else:
        ranked = ranked.withColumn("_rank", F.col("_row") - F.lit(1).cast("long"))
    placed = spark.createDataFrame(rules, RULES).withColumnRenamed("length", "_length")
    if len(rules) <= BROADCAST_RULES:
        placed = F.broadcast(placed)
    nth = F.col("_rank") - F.col("from_rank")
    return (
        ranked.join(placed, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.col("first_bin") + F.floor(nth / F.col("per_bin")))
        .withColumn("offset", F.col("first_offset") + nth % F.col("per_bin") * F.col("length"))
        .select(*held(columns, needed), "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places; see `pieces` and `pack`."""
    return pack(save(pieces(docs, tokenizer, capacity, end_id), "pieces", batch=TEXTS), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in sequences of 4096 tokens: see `pieces` and `pack_documents` for nulls,
    empty and very long texts, ties and repeated rows."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
