"""Removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in an earlier
document or earlier in its own. A full suffix array of a corpus is many times the corpus, so only
some suffixes are sorted: those at anchors. The anchor of a window of LENGTH bytes is the place in
it whose next LEAD bytes have the least hash, the first of equals. That depends on the window's
bytes alone, so equal windows have equal anchors at equal places; and one anchor serves about
thirty windows in a row.

1. Suffixes at anchors are range-partitioned by their leading bytes, with splitters from a sample
   of the texts, and each bucket is sorted. Splitters never part equal leading bytes, so a
   repetition does not cross a bucket's boundary. Of a suffix that a batch of documents has more
   than once only one goes to its bucket; the others are known already to repeat.
2. Only for anchors that repeat, the bytes of their windows are dealt again by the splitters,
   and the buckets sort them by their bytes with a multikey sort, eight at a time, each step only
   among windows that are equal so far. Of neighbours with equal bytes, all but the first are marked.
3. An anchor with more than HOT occurrences has its windows compared as rows by hash instead, of
   each batch of documents only the first of equal ones, so no bucket holds them all.

Whole copies of a text are found first. That texts or windows are equal is told by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, give_back, held, hold, n_partitions, release, save, table
from .hashing import between, mix, running, slices

#: Bytes of a string whose repetition counts, and of the string that makes an anchor.
LENGTH, LEAD = 100, 40
#: Sampled texts for the splitters, at most about.
SAMPLE = 20_000
#: Anchors that a task gathers before it writes them out; those of a bucket, about.
GATHERED, BUCKET = 1 << 18, 1 << 19
#: Shares of a bucket, by the anchor's hash, in which windows are sorted.
SHARES = 8
#: Occurrences of an anchor from which its windows are compared as rows.
HOT = 5_000
#: Such anchors that are broadcast, so that theirs is no hot key of a shuffle: 16 bytes each, under 2 MB.
BROADCAST_HOT = 100_000
#: Ids of texts (8 bytes), and runs (16 bytes), that are broadcast so that texts are not shuffled to meet them: under
#: 16 MB. Beyond it Spark shuffles.
BROADCAST_IDS = 1_000_000
#: Windows of a long text that are looked at together.
TOGETHER = 1 << 22
#: The order of a null doc_id: before all others.
FIRST = -(1 << 63)

_WIDE = LENGTH - LEAD + 1
_PLACE = np.uint64((1 << 24) - 1)


def _anchors(data: np.ndarray, sums: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that start where `ok`: anchors in order, the hashes of their LEAD bytes, and
    the first and last window of each."""
    if not ok.any():
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(len(data) - LEAD + 1)
    hashes = between(sums, at, at + LEAD)
    least = (hashes & ~_PLACE) | at.astype(np.uint64)
    width = 1
    while 2 * width <= _WIDE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _WIDE:
        least = np.minimum(least[: len(least) - (_WIDE - width)], least[_WIDE - width :])
    start = np.flatnonzero(ok)
    anchor = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], hashes[anchor[first]], start[first], start[last]


def anchors_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of LENGTH bytes or more: row, its bytes, anchors, their hashes, and the first and
    last window of each. A long text comes in several parts of its windows, with places in the whole."""
    for first, data, at in slices(texts):
        if len(at) == 2:
            for base in range(0, len(data) - LENGTH + 1, TOGETHER):
                part = data[base : base + TOGETHER + LENGTH - 1]
                anchor, hashes, start, last = _anchors(part, running(part), np.ones(len(part) - LENGTH + 1, bool))
                yield first, data, anchor + base, hashes, start + base, last + base
            continue
        ok = np.zeros(max(0, len(data) - LENGTH + 1), bool)
        for a, b in zip(at[:-1], at[1:]):
            ok[a : max(a, b - LENGTH + 1)] = True
        anchor, hashes, start, last = _anchors(data, running(data), ok)
        bounds = np.searchsorted(anchor, at)
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
            if i < j:
                yield first + k, data[at[k] : at[k + 1]], anchor[i:j] - at[k], hashes[i:j], start[i:j] - at[k], last[i:j] - at[k]


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number in their order."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | data[at + j].astype(np.uint64)
    return out


def _splitters(keyed: DataFrame, n_docs: int, buckets: int) -> np.ndarray:
    """Leading bytes, at one place in each text of a sample, that part them into even shares."""
    place = F.pmod(F.col("_h"), F.greatest(F.length("text") - 8, F.lit(1))).cast("int") + 1
    sample = keyed.where(F.pmod(F.xxhash64("_h"), F.lit(max(1, n_docs // SAMPLE))) == 0).select(F.encode(F.substring("text", place, F.lit(8)), "utf-8").alias("b"))
    leads = np.sort(np.array([int.from_bytes(r["b"][:8].ljust(8, b"\0"), "big") for r in sample.collect()], np.uint64))  # about SAMPLE rows
    return np.unique(leads[(np.arange(1, buckets) * len(leads)) // buckets]) if len(leads) else leads


def _packed(columns: dict[str, np.ndarray | None], deal: np.ndarray, **same: bool) -> pa.RecordBatch:
    """One row for each number in `deal`, with the bytes of its part of each column."""
    order = np.argsort(deal, kind="stable")
    found, first = np.unique(deal[order], return_index=True)
    parts = np.split(order, first[1:]) if len(deal) else []
    arrays = [pa.array(found, pa.int32())] + [pa.array([v] * len(parts), pa.bool_()) for v in same.values()] + [pa.array([b"" if x is None else x[i].tobytes() for i in parts], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *same, *columns])


def _column(group: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


def _repeating(keyed: DataFrame, cuts: np.ndarray, buckets: int) -> DataFrame:
    """Anchors that occur at more than one place of different texts: _h, bucket and lead (both name
    the anchor), pos. Rows may repeat."""
    held = keyed.sparkSession.sparkContext.broadcast(cuts)  # fewer than `buckets` numbers

    def packed(keys: list, parts: list) -> Iterator[pa.RecordBatch]:
        key = np.repeat(np.array(keys, np.int64), [len(x[0]) for x in parts])
        pos, lead, cut = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((lead, cut))
        key, pos, lead, cut = key[order], pos[order].astype("<u4"), lead[order].astype("<u4"), cut[order].astype("<i4")
        new = np.concatenate(([True], (lead[1:] != lead[:-1]) | (cut[1:] != cut[:-1])))
        many = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1
        yield _packed({"keys": key[new], "cuts": None, "leads": lead[new], "pos": pos[new]}, cut[new], known=False)
        yield _packed({"keys": key[many], "cuts": cut[many], "leads": lead[many], "pos": pos[many]}, (mix(key[many].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), known=True)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, seen, total = [], [], set(), 0
        for batch in batches:
            ids, copies = batch.column("_h").to_pylist(), set()
            for i, h in enumerate(ids):
                if h in seen:
                    copies.add(i)
                seen.add(h)
            for row, data, at, hashes, _, _ in anchors_of(batch.column("text")):
                if row not in copies:
                    keys.append(ids[row])
                    parts.append((at, hashes & np.uint64(0xFFFFFFFF), np.searchsorted(held.value, _leading(data, at), side="right")))
                    total += len(at)
            if total >= GATHERED:
                yield from packed(keys, parts)
                keys, parts, seen, total = [], [], set(), 0
        if keys:
            yield from packed(keys, parts)
        give_back()

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        known = np.array(group.column("known").to_pylist())
        own, rest = group.filter(pa.array(~known)), group.filter(pa.array(known))
        lead, pos, h = (_column(own, c, k) for c, k in (("leads", "<u4"), ("pos", "<u4"), ("keys", "<i8")))
        order = np.lexsort((pos, h, lead))
        lead, pos, h, cut = lead[order], pos[order], h[order], np.full(len(lead), key[0].as_py(), "<i4")
        same = lead[1:] == lead[:-1]
        other = same & ((pos[1:] != pos[:-1]) | (h[1:] != h[:-1]))  # copies of one text bring one place several times
        start = np.flatnonzero(np.concatenate(([True], ~same))) if len(lead) else np.zeros(0, np.int64)
        places = np.add.reduceat(np.concatenate(([0], other)), start) if len(lead) else start
        # A run's first entry holds no comparison of its own: what differs is counted from the second on.
        take = np.repeat(places > 0, np.diff(np.append(start, len(lead)))) if len(lead) else np.zeros(0, bool)
        columns = {"_h": h[take], "cut": cut[take], "lead": lead[take], "pos": pos[take]}
        more = {"_h": _column(rest, "keys", "<i8"), "cut": _column(rest, "cuts", "<i4"), "lead": _column(rest, "leads", "<u4"), "pos": _column(rest, "pos", "<u4")}
        return pa.table({c: pa.array(np.concatenate((columns[c], more[c])).astype(np.int32 if c == "cut" else np.int64)) for c in columns})

    rows = keyed.select("_h", "text").mapInArrow(gather, "bucket int, known boolean, keys binary, cuts binary, leads binary, pos binary")
    return rows.groupBy("bucket").applyInArrow(meet, "_h long, cut int, lead long, pos long")


def _windows(affected: DataFrame) -> DataFrame:
    """The windows of anchors that repeat, packed by the splitters' bucket and the anchor's hash: the
    document's order (_d, _h), the first window's place, how many windows, and their bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total = [], 0
        for batch in batches:
            ids, keys, wanted = (batch.column(c).to_pylist() for c in ("_d", "_h", "pos"))
            deals = batch.column("deal").to_pylist()
            for row, data, at, _, first, last in anchors_of(batch.column("text")):
                deal = dict(zip(wanted[row], deals[row]))
                for k in np.flatnonzero(np.isin(at, wanted[row])):
                    a, b = int(first[k]), int(last[k])
                    out.append((deal[int(at[k])], ids[row], keys[row], a, b - a + 1, data[a : b + LENGTH].tobytes()))
                    total += b - a + LENGTH
            if total >= 16 * GATHERED:
                yield flush(out)
                out, total = [], 0
        if out:
            yield flush(out)
        give_back()

    def flush(out: list[tuple]) -> pa.RecordBatch:
        out.sort(key=lambda r: r[0])
        deal = np.array([r[0] for r in out], np.int64)
        first = np.flatnonzero(np.concatenate(([True], deal[1:] != deal[:-1])))
        arrays = [pa.array(deal[first], pa.int32())]
        for c, kind in ((1, "<i8"), (2, "<i8"), (3, "<i8"), (4, "<i8")):
            arrays.append(pa.array([x.tobytes() for x in np.split(np.array([r[c] for r in out], kind), first[1:])], pa.binary()))
        ends = np.append(first[1:], len(out))
        arrays.append(pa.array([b"".join(r[5] for r in out[a:b]) for a, b in zip(first, ends)], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "ids", "keys", "starts", "counts", "bytes"])

    return affected.select("_d", "_h", "text", "pos", "deal").mapInArrow(gather, "bucket int, ids binary, keys binary, starts binary, counts binary, bytes binary")


def multikey_sorted(data: np.ndarray, begin: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places `begin` of the bytes, numbered by `order`) sorted by their first LENGTH bytes, and
    which of them differ from the one before. Multikey: all are sorted by one key of eight bytes, then
    only runs that are equal so far by the next key; a run whose suffixes are all equal, by 64-bit
    hash, is done. Equal suffixes keep their order."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    hashes = between(running(data), begin, begin + LENGTH)
    open_ = np.arange(len(order))  # places in the order whose runs are not told apart yet
    for depth in range(0, LENGTH, 8):
        if not len(open_):
            break
        run = np.cumsum(new[open_])  # every run is open from its first place on
        key = _leading(data, begin[order[open_]] + min(depth, LENGTH - 8))
        by = np.lexsort((key, run)) if depth else np.argsort(key, kind="stable")
        order[open_] = order[open_[by]]
        key = key[by]
        new[open_[1:]] |= key[1:] != key[:-1]
        run, h = np.cumsum(new[open_]) - 1, hashes[order[open_]]
        unlike = np.zeros(run[-1] + 1, bool)
        unlike[run[1:][(h[1:] != h[:-1]) & ~new[open_[1:]]]] = True
        open_ = open_[unlike[run]]
    return order, new


def _marked(key: tuple, group: pa.Table) -> pa.Table:
    """Of a bucket's windows, sorted, those equal to an earlier one: runs (_h, a, b) of their bytes."""
    ids, keys, starts, counts = (_column(group, c, "<i8") for c in ("ids", "keys", "starts", "counts"))
    data = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8)
    at = np.concatenate(([0], np.cumsum(counts + LENGTH - 1)))[:-1]
    before = np.concatenate(([0], np.cumsum(counts)))
    of = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(before[-1]) - before[of]
    begin = at[of] + step
    place = starts[of] + step
    # Windows come in the order of documents and places; the sort keeps it among equal ones.
    windows = np.lexsort((place, keys[of], ids[of]))
    order, new = multikey_sorted(data, begin, windows)
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    marked = np.zeros(len(order), bool)
    marked[order] = (place[order] != place[first]) | (keys[of[order]] != keys[of[first]])
    run = np.flatnonzero(marked)
    if not len(run):
        return pa.table({c: pa.array([], pa.int64()) for c in ("_h", "a", "b")})
    new = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1] + 1) | (of[run[1:]] != of[run[:-1]]))))
    end = np.append(new[1:], len(run)) - 1
    first, last = run[new], run[end]
    return pa.table({"_h": keys[of[first]], "a": starts[of[first]] + step[first], "b": starts[of[last]] + step[last] + LENGTH})


def _hot_windows(affected: DataFrame) -> DataFrame:
    """Of windows of anchors with very many occurrences, the first of each in a batch as a row: w (its
    hash), _d, _h, a; and runs (w null, _h, a, b) of those that repeat one of the same batch."""

    def flush(ids: list, keys: list, places: list, hashes: list) -> pa.RecordBatch:
        n = [len(x) for x in places]
        d, h = (np.repeat(np.array(x, np.int64), n) for x in (ids, keys))
        a, w = np.concatenate(places), np.concatenate(hashes)
        order = np.lexsort((a, h, d, w))
        new = np.concatenate(([True], w[order][1:] != w[order][:-1]))
        again = np.ones(len(w), bool)
        again[order[new]] = False
        run = np.flatnonzero(again)
        start = np.flatnonzero(np.concatenate(([True], (a[run][1:] != a[run][:-1] + 1) | (h[run][1:] != h[run][:-1])))) if len(run) else run
        end = np.append(start[1:], len(run))[: len(start)] - 1  # none, where no window repeats one of the batch
        first = order[new]
        columns = {"w": (w[first], None), "_d": (d[first], d[run[start]]), "_h": (h[first], h[run[start]]), "a": (a[first], a[run[start]]), "b": (None, a[run[end]] + LENGTH)}
        sizes = len(first), len(start)
        cells = [pa.concat_arrays([pa.nulls(k, pa.int64()) if x is None else pa.array(x, pa.int64()) for x, k in zip(c, sizes)]) for c in columns.values()]
        return pa.RecordBatch.from_arrays(cells, names=list(columns))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = ([], [], [], []), 0
        for batch in batches:
            ids, keys, wanted = (batch.column(c).to_pylist() for c in ("_d", "_h", "hot"))
            for row, data, at, _, first, last in anchors_of(batch.column("text")):
                take = np.isin(at, wanted[row])
                if take.any():
                    a = np.concatenate([np.arange(i, j + 1) for i, j in zip(first[take], last[take])])
                    for x, y in zip(held, (ids[row], keys[row], a, between(running(data), a, a + LENGTH).view(np.int64))):
                        x.append(y)
                    total += len(a)
                if total >= GATHERED:
                    yield flush(*held)
                    held, total = ([], [], [], []), 0
        if total:
            yield flush(*held)
        give_back()

    return affected.where(F.size("hot") > 0).select("_d", "_h", "text", "hot").mapInArrow(rows, "w long, _d long, _h long, a long, b long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the union of runs from each text."""
    for batch in batches:
        removed, spans, digests, left = [], [], [], []
        for data, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
            keep, at, n, k = [], 0, 0, 0
            for a, b in sorted((r["a"], r["b"]) for r in runs):
                if a > at or not k:
                    keep.append(data[at:a])
                    k += 1
                    n += b - a
                    at = b
                elif b > at:
                    n += b - at
                    at = b
            keep.append(data[at:])
            kept = b"".join(keep)
            removed.append(n)
            spans.append(k)
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode("utf-8", "ignore"))  # of a character that was cut in two nothing stays
        yield pa.RecordBatch.from_arrays([batch.column("_h"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], names=["_h", "n_removed", "n_spans", "kept_sha256", "kept"])
    give_back()


def _keyed(docs: DataFrame) -> DataFrame:
    """_d and _h, the order of a document and the name of its text; and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("text"))


def _met(df: DataFrame, n: int) -> DataFrame:
    """A table of `n` ids or runs, broadcast up to the bound."""
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def cut_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every document, texts that lose some bytes, the _h of those): doc_id, _d, _h, n_bytes, sha256, copy (an equal text
    stands earlier); and _h, n_removed, n_spans, kept_sha256, kept (the text left) for the first of each text.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    every = save(keyed.select("_d", "_h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")).groupBy("_d", "_h", "n_bytes", "sha256").agg(F.count(F.lit(1)).alias("_times")), "texts")
    firsts = save(every.groupBy("_h").agg(F.min("_d").alias("_d"), F.max("n_bytes").alias("n_bytes")), "first-texts")
    size = firsts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    buckets = max(n_partitions(spark), int(size[1]) // 30 // BUCKET)
    long_enough = keyed.where(F.octet_length("text") >= LENGTH)
    cuts = _splitters(long_enough, int(size[0]), buckets)
    found = save(_repeating(long_enough, cuts, buckets).distinct(), "anchors", batch=TEXTS)
    hot = found.groupBy("cut", "lead").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("cut", "lead", F.lit(True).alias("_hot"))
    hot = save(hot, "hot-anchors")
    if hot.count() <= BROADCAST_HOT:
        hot = F.broadcast(hot)
    places = (
        found.join(hot, ["cut", "lead"], "left")
        .groupBy("_h").agg(
            F.collect_list(F.when(F.col("_hot").isNull(), F.struct("pos", (F.col("cut") * SHARES + F.pmod(F.xxhash64("lead"), F.lit(SHARES)).cast("int")).alias("deal")))).alias("_p"),
            F.collect_list(F.when(F.col("_hot").isNotNull(), F.col("pos"))).alias("hot"),
        )
        .select("_h", F.col("_p.pos").alias("pos"), F.col("_p.deal").alias("deal"), "hot").join(firsts, "_h")
        .select(F.col("_h").alias("_key"), F.col("_d").alias("_first"), "pos", "deal", "hot")
    )
    same = (F.col("_d") == F.col("_first")) & (F.col("_h") == F.col("_key"))
    affected = long_enough.join(places, same).select("_d", "_h", "text", "pos", "deal", "hot")
    if not every.where(F.col("_times") > 1).isEmpty():  # equal rows: each text once
        affected = affected.dropDuplicates(["_d", "_h"])
    affected = save(affected, "affected")
    runs = _windows(affected).groupBy("bucket").applyInArrow(_marked, "_h long, a long, b long")
    rows = save(_hot_windows(affected), "hot-windows", batch=TEXTS)
    once = rows.where(F.col("w").isNotNull())
    least = once.groupBy("w").agg(F.min(F.struct("_d", "_h", "a")).alias("_m"))
    hot_runs = once.join(least, "w").where(F.struct("_d", "_h", "a") != F.col("_m")).select("_h", "a", (F.col("a") + LENGTH).alias("b"))
    hot_runs = hot_runs.unionByName(rows.where(F.col("w").isNull()).select("_h", "a", "b"))
    all_runs = save(runs.unionByName(hot_runs).groupBy("_h").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "runs", batch=TEXTS)
    size = all_runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    release(found, rows)
    cut = affected.select("_h", "text").join(_met(all_runs, size[1]), "_h").select("_h", "text", "runs").mapInArrow(_cut, "_h long, n_removed long, n_spans long, kept_sha256 string, kept string")
    copies = every.join(firsts.select("_h", F.col("_d").alias("_first")), "_h").withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    marked = copies.select(F.when(F.col("_d") != FIRST, F.col("_d")).alias("doc_id"), "_d", "_h", "n_bytes", "sha256", ((F.col("_d") != F.col("_first")) | (F.col("_nth") > 1)).alias("copy"))
    return marked, cut, _met(all_runs.select("_h"), size[0])


def removed_bytes(docs: DataFrame) -> DataFrame:
    """Every row's doc_id with n_bytes, n_removed, n_spans (maximal removed runs), and kept_sha256 of
    the bytes left.

    Null and empty texts have 0 bytes and lose none; so do texts under LENGTH bytes. A null doc_id
    stands before all others; texts that share a doc_id are ordered by their hash, and of equal
    rows one is first. Other columns are ignored. An empty table gives no rows.
    """
    marked, cut, _ = cut_texts(docs)
    whole = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    return marked.join(cut.drop("kept"), "_h", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the bytes that repeat cut from `text`. Copies of a text of LENGTH bytes
    or more go, all but the first; so do rows with no word left, also if they had none before.

    Other columns are kept as they are. See `removed_bytes` for nulls, ties and repeated rows.
    """
    marked, cut, losing = cut_texts(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = hold(docs, ["doc_id", "text"]).withColumn("_h", F.xxhash64(text)).withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)))
    copies = marked.where(F.col("copy") & (F.col("n_bytes") >= LENGTH)).select("_d", "_h")
    later = save(copies.join(marked.where(~F.col("copy")).select("_d", "_h"), ["_d", "_h"], "left_anti").distinct(), "later-copies")
    rows = rows.join(_met(later, later.count()), ["_d", "_h"], "left_anti")
    if not copies.join(marked.where(~F.col("copy")), ["_d", "_h"], "left_semi").isEmpty():  # equal rows
        rows = rows.dropDuplicates(["_d", "_h"])
    # Whole texts stay where they are; of the others only what is left of them meets their rows.
    whole = rows.join(losing, "_h", "left_anti")
    shorter = rows.drop("text").join(cut.select("_h", F.col("kept").alias("text")), "_h")
    rows = whole.unionByName(shorter)
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*held(docs.columns, ["doc_id", "text"]))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Removed bytes of all `documents`: see `removed_bytes` for nulls, empty and very long texts, ties and
    repeated rows."""
    return removed_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
