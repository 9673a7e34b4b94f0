"""Jaccard join of word 5-gram sets with trees of count vectors.

A set is a point: the tokens (hashed 5-grams) are dealt into groups, and its coordinates are the
counts of its tokens in each. What two sets share is at most the sum of the lesser coordinates,
so a pair, or a pair of leaves with bounding boxes, for which that sum is too small is dropped
unverified; the rest is verified token by token.

One tree over all points can't be searched well when texts are unrelated: the boxes of even a few
leaves cover most coordinates' ranges. So the top of the tree is cut by single groups: groups are
finely dealt and ordered by how full they are in the whole corpus, and a set stands below each of
the rarest groups that hold its prefix, 1/5 of its tokens. By the bound of summed minima, two sets
with a similarity of 0.8 always meet below one. Below a group

1. sets are first compared with a leader only (the least set below the group in a batch, or the
   least of those), and linked sets become components: near copies, however many, cost a star;
2. groups whose sets are still in several components are searched: the points are cut into leaves
   by size and by where they lie, bounding boxes, coarse points and full points are compared by
   summed minima, and of each component only the pair of greatest bound with a lesser one is
   verified; components that prove linked become one;
3. what is then still in several components is searched again, and every pair of different
   components that survives the bounds is verified.

No pair is lost, no list is capped, and nothing grows with the square of a group of near copies.
Equality of tokens is that of 64-bit hashes, of sets that of 64-bit sums of mixed hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, few, give_back, n_partitions, release, save, table
from .components import components
from .hashing import mix, word_hashes

GRAM = 5
#: Coordinates of a point, and of the coarser points that leaves hold (sums of neighbouring ones).
COORDINATES, COARSE = 256, 32
#: Groups whose loads order the tokens (a table of 8 MB), and how many of them travel together.
LOADS, TOGETHER = 1 << 20, 1 << 13
#: Prefix tokens that a task gathers before it writes them out, and those of a bucket, about.
GATHERED, BUCKET = 1 << 19, 1 << 19
#: Rounds in which each component is compared with its most promising lesser one only, and pairs that
#: a task gathers before it thins them out.
ROUNDS, THINNED = 1, 1 << 18
#: Sets of a leaf, about.
LEAF = 256
#: Leaves of a tree and size that are paired with others in one task, about, and pairs that go to a
#: Python worker together: a pair of leaves is about 140 KB.
SIDE, PAIRS = 16, 64
#: Rows that a task goes through, about: of sets or pairs with their points, and of names alone.
POINTED, NAMED = 10_000, 100_000
#: Documents whose ids are broadcast to fetch their texts: 8 MB. For more, Spark shuffles.
BROADCAST_IDS = 500_000

_ODD = mix(np.arange(1, GRAM + 2, dtype=np.uint64)) | np.uint64(1)


def gram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct 5-gram hashes, ascending; of a text of 1 to 4 words the hash of
    all of them; none of a text without words."""
    for _, hashes, at in word_hashes(texts):
        n = max(0, len(hashes) - GRAM + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(GRAM):
            grams += hashes[j : j + n] * _ODD[j]
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= GRAM:
                yield np.unique(grams[a : b - GRAM + 1])
            elif b > a:
                yield mix((hashes[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _ODD[GRAM])
            else:
                yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """The name of a set, a signed 64-bit number."""
    return int(mix(mix(grams ^ _ODD[0]).sum(keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def loads_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def point(grams: np.ndarray) -> np.ndarray:
    """Counts of tokens by group."""
    return np.bincount((grams & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES)


def _cell(p: np.ndarray) -> bytes:
    """A point in one byte for each coordinate where they fit, else in four."""
    return p.astype("u1" if p.max() < 256 else "<u4").tobytes()


def _points(column: pa.Array, width: int = COORDINATES) -> np.ndarray:
    cells = column.to_pylist()
    if all(len(c) == width for c in cells):
        return np.frombuffer(b"".join(cells), "u1").reshape(-1, width).astype(np.int32)
    return np.array([np.frombuffer(c, "u1" if len(c) == width else "<u4") for c in cells], np.int64)


def named_sets(docs: DataFrame) -> DataFrame:
    """doc_id, set_id (null for an empty set), n_shingles, point, and two sums of coordinates by which
    leaves are cut (of the first half, of every other one); and after the documents of each
    task rows with `part` and `loads`: how many tokens of its sets are in each group of that part."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(LOADS, np.int64)

        def rows(ids: pa.Array, names: list, sizes: list, points: list, sums: list, parts: list, last: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), pa.array(sums, pa.list_(pa.int32())), pa.array(parts, pa.int32()), pa.array(last, pa.binary())],
                names=["doc_id", "set_id", "n_shingles", "point", "sums", "part", "loads"],
            )

        for batch in batches:
            names, sizes, points, sums = [], [], [], []
            for grams in gram_sets(batch.column("text")):
                np.add.at(loads, loads_of(grams), 1)
                names.append(set_id(grams) if len(grams) else None)
                p = point(grams)
                points.append(_cell(p) if len(grams) else None)
                sums.append([int(p[: COORDINATES // 2].sum()), int(p[::2].sum())])
                sizes.append(len(grams))
            none = [None] * len(names)
            yield rows(batch.column("doc_id"), names, sizes, points, sums, none, none)
        part = np.flatnonzero(loads.reshape(-1, TOGETHER).any(1))
        none = [None] * len(part)
        yield rows(pa.array(none, pa.int64()), none, none, none, none, part.tolist(), [x.astype("<u4").tobytes() for x in loads.reshape(-1, TOGETHER)[part]])
        give_back()

    return docs.mapInArrow(name, "doc_id long, set_id long, n_shingles long, point binary, sums array<int>, part int, loads binary")


def _summed_loads(named: DataFrame) -> np.ndarray:
    """The loads of all groups, LOADS numbers: each part is added up by one task."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in group.column("loads").to_pylist())
        return pa.table({"part": [key[0].as_py()], "loads": pa.array([total.astype("<i8").tobytes()], pa.binary())}).cast(pa.schema([("part", pa.int32()), ("loads", pa.binary())]))

    loads = np.zeros(LOADS, np.int64)
    summed = named.where(F.col("loads").isNotNull()).select("part", "loads").groupBy("part").applyInArrow(add, "part int, loads binary")
    for r in summed.collect():
        loads[r["part"] * TOGETHER : (r["part"] + 1) * TOGETHER] = np.frombuffer(r["loads"], "<i8")
    return loads


def _prefix_rows(docs: DataFrame, loads: np.ndarray, buckets: int) -> DataFrame:
    """(token, leader, member) packed by bucket: for each token of a prefix, in each batch of sets,
    its least set as its own leader, dealt by token; and its other sets with that leader."""
    held = docs.sparkSession.sparkContext.broadcast(loads)  # LOADS numbers

    def packed(tokens: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate(tokens)
        # A token's bucket and 32 more bits of it name its tree; a rare mix-up of two costs a comparison.
        bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
        low = token.astype("<u4")
        member = np.repeat(np.array(names, np.int64), [len(t) for t in tokens])
        order = np.lexsort((member, low, bucket))
        bucket, low, member = bucket[order], low[order], member[order]
        first = np.concatenate(([True], (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])))
        leader = member[np.flatnonzero(first)[np.cumsum(first) - 1]]
        for own, deal in ((first, bucket[first]), (~first, (mix(member[~first].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))):
            at = np.argsort(deal, kind="stable")
            cuts = np.searchsorted(deal[at], np.arange(buckets + 1))
            full = [(b, at[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            led = (bucket[own].astype("<i4"), leader[own]) if own is not first else (None, None)  # a set that is its own leader needs neither
            cells = [pa.array([b"" if x is None else x[i].tobytes() for _, i in full], pa.binary()) for x in (low[own], member[own], *led)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in full], pa.int32()), *cells], names=["bucket", "tokens", "members", "buckets", "leaders"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, names, seen, total = [], [], set(), 0
        for batch in batches:
            for grams in gram_sets(batch.column("text")):
                if not len(grams) or (name := set_id(grams)) in seen:
                    continue
                order = np.argsort(held.value[loads_of(grams)], kind="stable")
                tokens.append(grams[order[: len(grams) - -(-4 * len(grams) // 5) + 1]])
                names.append(name)
                seen.add(name)
                total += len(tokens[-1])
                if total >= GATHERED:
                    yield from packed(tokens, names)
                    tokens, names, seen, total = [], [], set(), 0
        if tokens:
            yield from packed(tokens, names)
        give_back()

    return docs.select("text").mapInArrow(prefixes, "bucket int, tokens binary, members binary, buckets binary, leaders binary")


def _meetings(key: tuple, group: pa.Table) -> pa.Table:
    """Of a bucket: the sets that have a leader already as they are, and the leaders of tokens that
    several batches have, with the least as their leader. A bucket holds a token once for each batch."""
    own = group.filter(pc.equal(pc.binary_length(group.column("leaders")), 0))
    rest = group.filter(pc.greater(pc.binary_length(group.column("leaders")), 0))
    column = lambda g, c, k: np.frombuffer(b"".join(g.column(c).to_pylist()), k)
    t, m = column(own, "tokens", "<u4"), column(own, "members", "<i8")
    order = np.lexsort((m, t))
    t, m = t[order], m[order]
    first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
    least = m[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(t) else m
    met = least != m
    token = np.concatenate((t[met].astype(np.int64) + (key[0].as_py() << 32), column(rest, "tokens", "<u4").astype(np.int64) + (column(rest, "buckets", "<i4").astype(np.int64) << 32)))
    return pa.table({"token": token, "leader": np.concatenate((least[met], column(rest, "leaders", "<i8"))), "member": np.concatenate((m[met], column(rest, "members", "<i8")))})


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether a similarity of 0.8 is reached: 100 * shared >= 80 * (n + m - shared)."""
    return 9 * shared >= 4 * (n + m)


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their points those whose summed minima reach what a similarity of 0.8 needs."""
    for batch in batches:
        if batch.num_rows:
            n, m = np.asarray(batch.column("n")), np.asarray(batch.column("m"))
            ok = 9 * np.minimum(_points(batch.column("p")), _points(batch.column("q"))).sum(1) >= 4 * (n + m)
            yield batch.select(["a", "b", "n", "m"]).filter(pa.array(ok))


def _near(pairs: DataFrame, points: DataFrame, rows: int) -> DataFrame:
    """Of pairs (a, b) of set names, about `rows`, those that may be similar by size and points: a, b, n, m."""
    points = points.select("set_id", "n", "point")
    joined = pairs.join(points.toDF("a", "n", "p"), "a").join(points.toDF("b", "m", "q"), "b")
    joined = joined.where(_enough(F.least("n", "m"), F.col("n"), F.col("m"))).select("a", "b", "n", "m", "p", "q")
    return few(joined, rows, POINTED).mapInArrow(_may_be_similar, "a long, b long, n long, m long")


def _verified(docs: DataFrame, names: DataFrame, near: DataFrame) -> DataFrame:
    """Of pairs those with a similarity of 0.8 or more, by all their tokens: a, b."""
    rows = near.count()
    wanted = few(near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), 2 * rows, NAMED)
    least = few(names.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("_id")), 2 * rows, NAMED)
    ids = save(few(least.select("_id").distinct(), 2 * rows, NAMED), "ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                sets = list(gram_sets(batch.column("text").slice(i, 500)))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(g) for g in sets], pa.int64()), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))], names=["set_id", "grams"])
        give_back()

    # One document of each set; where several rows share its id, a set may come twice, and so a link.
    found = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(full, "set_id long, grams array<long>")
    grams = save(found.join(wanted, "set_id", "left_semi"), "grams", batch=TEXTS)
    size = lambda c: F.size(c).cast("long")
    linked = near.join(grams.toDF("a", "_g"), "a").join(grams.toDF("b", "_h"), "b").where(_enough(size(F.array_intersect("_g", "_h")), size("_g"), size("_h")))
    links = save(few(linked.select("a", "b").distinct(), rows, NAMED), "links")
    release(ids, grams)
    return links


def _best(part: np.ndarray, other: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Of pairs the one of greatest bound for each component that is the greater of its pair."""
    greater = np.maximum(part, other)
    order = np.lexsort((bound, greater))
    return order[np.append(greater[order][1:] != greater[order][:-1], True)] if len(order) else order


def _survivors(x: tuple, y: tuple, once: bool) -> tuple[np.ndarray, ...]:
    """Of the pairs of two leaves (of one, each pair once) those of different components that may be
    similar: their places on both sides, and the bound of what they share by what they need."""
    (part, n, p, coarse), (other, m, q, coarse_q) = x[1:], y[1:]
    if 9 * np.minimum(coarse.max(0), coarse_q.max(0)).sum() < 4 * (int(n.min()) + int(m.min())):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # the boxes' corners share too little for any pair
    need = 4 * (n[:, None] + m)
    ok = (9 * np.minimum(n[:, None], m) >= need) & (part[:, None] != other)
    i, j = np.nonzero(np.triu(ok, 1) if once else ok)
    near = np.concatenate([9 * np.minimum(coarse[i[k : k + 4096]], coarse_q[j[k : k + 4096]]).sum(1) >= need[i[k : k + 4096], j[k : k + 4096]] for k in range(0, len(i), 4096)] or [np.zeros(0, bool)])
    i, j = i[near], j[near]
    shared = np.concatenate([np.minimum(p[i[k : k + 1024]], q[j[k : k + 1024]]).sum(1) for k in range(0, len(i), 1024)] or [np.zeros(0, np.int64)])
    bound = 9 * shared / np.maximum(need[i, j], 1)
    return i[bound >= 1], j[bound >= 1], bound[bound >= 1]


def _leaf(column: pa.Array, i: int) -> tuple[np.ndarray, ...]:
    cells = column[i].values
    points = _points(cells.field("point"))
    return (*(np.asarray(cells.field(c)) for c in ("set_id", "component", "n")), points, points.reshape(len(points), COARSE, -1).sum(2))


def _searched(every: bool):
    """A function of leaves, or pairs of leaves: pairs (a, b) of sets that survive, all or only the
    best of each component, with their components and bound."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = [], 0

        def columns() -> list[np.ndarray]:
            a, b, part, other, bound = (np.concatenate(c) for c in zip(*found))
            keep = slice(None) if every else _best(part, other, bound)
            return [c[keep] for c in (a, b, part, other, bound)]

        def batch_of(cells: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["a", "b", "part", "other", "bound"])

        for batch in batches:
            for k in range(batch.num_rows):
                one = not batch.column("others")[k].is_valid
                x = _leaf(batch.column("sets"), k)
                y = x if one else _leaf(batch.column("others"), k)
                i, j, bound = _survivors(x, y, one)
                found.append((x[0][i], y[0][j], x[1][i], y[1][j], bound))
                total += len(i)
                if total >= THINNED:
                    cells = columns()
                    if every:
                        yield batch_of(cells)
                    found, total = ([] if every else [tuple(cells)]), 0
        if found:
            yield batch_of(columns())
        give_back()

    return search


def _open_trees(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """Trees whose sets are not all in one component: token, set_id, component, _k (sets of the tree)."""
    held = save(postings.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").select("token", "set_id", F.coalesce("component", "set_id").alias("component")), "trees")
    several = held.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_k")).where("_a <> _b")
    trees = save(few(held.join(several.select("token", "_k"), "token"), held.count(), NAMED), "open-trees")
    release(held)
    return trees


def _across(trees: DataFrame, points: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of sets that meet in an open tree, differ in component, and may be similar: all of
    them, or for each component that of the greatest bound.

    A passage makes a tree for each of its tokens, most with the same sets: of trees of one leaf
    with equal sets one is searched.
    """
    of_set = trees.select("set_id", "component").distinct()
    sets = F.collect_list(F.struct("set_id", "component", "n", "point"))
    rows = points.count()
    placed = save(few(points.join(of_set, "set_id").select("set_id", "component", "n", "point", "sums"), rows, POINTED), "placed")
    one_leaf = trees.where(F.col("_k") <= LEAF).groupBy("token").agg(F.array_sort(F.collect_list("set_id")).alias("members")).select("members").distinct()
    one_leaf = one_leaf.select(F.xxhash64("members", F.size("members")).alias("tree"), F.explode("members").alias("set_id"))
    small = one_leaf.join(placed, "set_id").groupBy("tree").agg(sets.alias("sets")).select("sets", F.lit(None).cast("array<struct<set_id:bigint,component:bigint,n:bigint,point:binary>>").alias("others"))
    kind = "a long, b long, part long, other long, bound double"
    # A join that is dealt anew for a skewed tree has far more tasks than the search is worth.
    spread = lambda pairs: pairs.coalesce(max(n_partitions(pairs.sparkSession), 4 * pairs.sparkSession.sparkContext.defaultParallelism))
    pairs, large, leaves = spread(small).mapInArrow(_searched(every), kind), trees.where(F.col("_k") > LEAF), []
    if not large.isEmpty():
        leaves = [_leaves(few(large.select("token", "set_id").join(placed, "set_id"), large.count(), POINTED), sets)]
        pairs = pairs.unionByName(spread(_leaf_pairs(leaves[0])).mapInArrow(_searched(every), kind))
    found = save(pairs, "found", batch=PAIRS)
    best = found
    if not every:
        best = found.groupBy(F.greatest("part", "other").alias("part")).agg(F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("_p")).select("_p.a", "_p.b")
    near = save(few(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), found.count(), NAMED), "near-links")
    release(placed, found, *leaves)
    return near


def _leaves(held: DataFrame, sets: Column) -> DataFrame:
    """Trees of several leaves (token and the sets with their points), cut into leaves by size, then by
    two sums of coordinates at quantiles of the tree, then, where points tie, by hash."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    held = save(held.withColumn("band", band), "held")
    cuts = F.array(*(F.lit(k / 8) for k in range(1, 8)))
    size = held.groupBy("token", "band").agg(F.count(F.lit(1)).alias("_w"), *(F.percentile_approx(F.col("sums")[h], cuts, 200).alias(f"_c{h}") for h in (0, 1)))
    tiles = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.sqrt(F.col("_w") / LEAF)))).cast("int")
    # Of the eighths of a tree's points every eighth, second or fourth is a cut, by how many leaves it fills.
    step = F.when(tiles > 4, 1).when(tiles > 2, 2).when(tiles > 1, 4).otherwise(8)
    tile = lambda h: F.size(F.filter(F.col(f"_c{h}"), lambda c, i: ((i + 1) % F.col("_step") == 0) & (c < F.col("sums")[h])))
    cells = save(held.join(size, ["token", "band"]).withColumn("_step", step).select("token", "band", "set_id", "component", "n", "point", (tile(0) * 8 + tile(1)).alias("cell")), "cells")
    share = cells.groupBy("token", "band", "cell").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("_w"))
    leaves = save(
        cells.join(share, ["token", "band", "cell"]).withColumn("leaf", F.struct("cell", F.pmod(F.xxhash64("set_id"), F.col("_w")).alias("part")))
        .groupBy("token", "band", "leaf").agg(sets.alias("sets"), F.min("component").alias("low"), F.max("component").alias("high")),
        "leaves",
    )
    release(held, cells)
    return leaves


def _leaf_pairs(leaves: DataFrame) -> DataFrame:
    """Pairs of leaves of one tree whose sizes and components allow a pair: sets, others (null: itself).
    Leaves of a large tree are dealt into shares of SIDE, each of which meets all others."""
    shares = save(few(leaves.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("_shares")), leaves.count(), NAMED), "shares")
    mine = leaves.join(shares, ["token", "band"]).withColumn("_share", F.pmod(F.xxhash64("leaf"), F.col("_shares")).cast("int"))
    others = leaves.select(F.col("token").alias("_token"), F.col("band").alias("_band"), F.col("leaf").alias("_leaf"), F.col("sets").alias("others"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("_meets"))
    others = others.join(shares.toDF("_token", "_meets", "_of"), ["_token", "_meets"]).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    # Similar sets are in one band or in neighbouring ones; of leaves of one band each pair once.
    once = (F.col("_band") > F.col("band")) | (F.col("leaf") < F.col("_leaf"))
    differ = (F.col("low") != F.col("_high")) | (F.col("high") != F.col("_low"))
    meet = (F.col("token") == F.col("_token")) & (F.col("band") == F.col("_meets")) & (F.col("_share") == F.col("_to")) & once & differ
    own = leaves.where("low <> high").select("sets", F.lit(None).cast(leaves.schema["sets"].dataType).alias("others"))
    return mine.join(others, meet).select("sets", "others").unionByName(own)


def link_classes(docs: DataFrame) -> DataFrame:
    """Every row's doc_id with n_shingles (size of its set) and component_id (the least doc_id that
    links reach, its own too).

    Two rows link if their sets' Jaccard similarity is 0.8 or more. A null, empty or blank text has
    an empty set, no links, and its own doc_id as component; so rows with a null doc_id and
    words are reached by others but name no class unless all of it is null. Repeated rows are
    equal sets, so linked. Very long texts are read whole. An empty table gives none. Other columns,
    whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    named = save(named_sets(docs), "sets", batch=TEXTS)
    loads = _summed_loads(named)
    names = named.where(F.col("part").isNull()).select("doc_id", "set_id", "n_shingles")
    buckets = max(n_partitions(spark), int(loads.sum()) // 5 // BUCKET)
    met = save(_prefix_rows(docs, loads, buckets).groupBy("bucket").applyInArrow(_meetings, "token long, leader long, member long"), "meetings", batch=TEXTS)
    postings = save(few(met.select("token", F.explode(F.array("leader", "member")).alias("set_id")).distinct(), 2 * met.count(), NAMED), "postings")
    points = named.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.first("point").alias("point"), F.first("sums").alias("sums"))
    rows = names.count()
    points = save(few(points.join(postings.select("set_id").distinct(), "set_id", "left_semi"), rows, POINTED), "points")
    # Of a set's leaders first the one it shares most trees with; the others count if components differ.
    star = met.groupBy("leader", "member").agg(F.count(F.lit(1)).alias("k")).groupBy("member").agg(F.max_by("leader", F.struct("k", "leader")).alias("a")).select("a", F.col("member").alias("b"))
    near = save(_near(star, points, rows), "near-stars")
    release(met)
    links = _verified(docs, names, near)
    parts = components(links)
    trees = _open_trees(postings, parts)
    release(postings, near)
    for every in [False] * ROUNDS + [True]:
        near = _across(trees, points, every)
        more = _verified(docs, names, near)
        release(near)
        if more.isEmpty():
            if every:
                break
            continue
        before = trees
        parts = components(parts.toDF("a", "b").unionByName(more))
        if not every:
            trees = _open_trees(trees.select("token", "set_id"), parts)
            release(before)
    release(trees, points)
    of_set = save(parts.withColumnRenamed("node", "set_id"), "classes")
    rows = names.join(of_set, "set_id", "left").withColumn("_class", F.coalesce("component", "set_id"))
    least = rows.where(F.col("_class").isNotNull()).groupBy("_class").agg(F.min("doc_id").alias("_least"))
    return rows.join(least, "_class", "left").select("doc_id", "n_shingles", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of all `documents` linked at a Jaccard similarity of 0.8 of their word 5-grams: see
    `link_classes` for nulls, empty and very long texts, ties and repeated rows."""
    return link_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
