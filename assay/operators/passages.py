"""Passages of words that several corpora have: texts are packed in batches, and hashes of passages travel as blobs.

A row of Spark's for each passage costs far more than the passage. So texts are read into batches of
many words, a batch's hashes are worked out at once, and what goes to one bucket of hashes is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, save

#: Bytes of words that a batch has (one record's texts stay together), bytes of words for each bucket of hashes, buckets
#: at least, rounds in which hashes are held together, texts and batches or blobs that go to a Python worker together.
_BATCH, _BUCKET, _LEAST, _ROUNDS, _TEXTS, _ROWS = 1_500_000, 8_000_000, 32, 2, 500, 32
#: Bytes beyond which a word is digested, and what keeps so many lower bytes of eight.
_LONG, _LOWER = 64, np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: All bytes but a-z and 0-9 are spaces.
_MARKS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
#: What ends a text in a batch; no byte of UTF-8.
_END = b"\xff"


def _plain(text: bytes, marked: bool) -> bytes:
    """The words of a text with one space between."""
    return b" ".join(text.translate(_MARKS).split()) if marked else text


def _has(plain: bytes, n: int) -> bool:
    return plain.count(b" ") >= n - 1 and plain != b""


def _cuts(words: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, words' starts and ends, each word's text, and the words at which a passage of `n` begins."""
    raw = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == _END[0]))
    starts = np.append(0, ends + 1)[: len(ends)]
    last = raw[ends] == _END[0]
    text = np.cumsum(last) - last
    return raw, starts, ends, text, np.flatnonzero(text[: max(len(text) - n + 1, 0)] == text[n - 1 :])


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, eight bytes at a time; the few very long words have parts of a digest."""
    eight = np.ndarray((len(raw) + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    size = ends - starts
    a, b = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at, left = 0, np.flatnonzero((size > 0) & (size <= _LONG))
    while len(left):
        some = eight[starts[left] + at] & _LOWER[np.minimum(size[left] - at, 8)]
        a[left] = _mixed(a[left] * np.uint64(0xA0761D6478BD642F) ^ some)
        b[left] = _mixed((b[left] ^ some) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(0x8EBC6AF09C88C6E3))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > _LONG):
        a[i], b[i] = np.frombuffer(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
    return a, b


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each passage, from those of its words."""
    factors = np.random.Generator(np.random.PCG64(20260714)).integers(0, 2**63, (n, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for k, values in enumerate(_words(raw, starts, ends)):
        h = np.zeros(max(len(ends) - n + 1, 0), np.uint64)
        for i in range(n):
            h += values[i : i + len(h)] * factors[i, k]
        out.append(_mixed(h[begins]))
    return out[0], out[1]


def _planes(values: np.ndarray) -> bytes:
    """Steps of rising numbers, their lower bytes first, so most bytes are nought."""
    return np.ascontiguousarray(np.diff(values, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _risen(cells: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cells, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().cumsum()


def _batches(rows: Iterator[pa.RecordBatch], n: int, marked: bool) -> Iterator[pa.RecordBatch]:
    """Texts, in order of corpus and record, as batches of one corpus. A batch is named by its first record's number,
    and records' numbers rise with corpus and record_id."""
    batch, corpus, ids, whole, record, texts, size = TaskContext.get().partitionId() << 33, None, [], [], [], [], 0

    def row() -> pa.RecordBatch:
        cells = [[batch], [corpus], [ids], [whole], [record], [b"".join(texts)], [size]]
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("record_id", pa.string()), ("content", pa.binary()), ("signature", pa.binary())])), pa.list_(pa.int32()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["batch", "corpus", "ids", "whole", "record", "words", "size"])

    for some in rows:
        for c, id_, content, text in zip(*(some.column(k).to_pylist() for k in ("corpus", "record_id", "_content", "_text"))):
            if ids and (c != corpus or (id_ != ids[-1] and size > _BATCH)):
                yield row()
                batch, ids, whole, record, texts, size = batch + len(ids), [], [], [], [], 0
            if not ids or id_ != ids[-1]:
                ids.append(id_)
            corpus, plain = c, _plain(text, marked)
            whole.append({"record_id": id_, "content": content, "signature": hashlib.sha256(plain).digest()})
            if _has(plain, n):
                record.append(len(ids) - 1)
                texts += [plain, _END]
                size += len(plain) + 1
    if ids:
        yield row()


def packed(texts: DataFrame, n: int, words: Column | None = None) -> DataFrame:
    """`texts` (corpus, record_id, text) in batches, written once: their records, the SHA-256 of each text and of its
    words alone, and the words of texts with `n` or more. Words are those of a-z and 0-9 of the lower-case
    text, or the arrays `words` of words without spaces."""
    marked = words is None
    text = F.lower("text") if marked else F.array_join(words, " ")
    rows = texts.where("text is not null").select("corpus", F.col("record_id").cast("string").alias("record_id"), "text")
    order = ["corpus", "record_id"]
    read = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.unhex(F.sha2("text", 256)).alias("_content"), text.cast("binary").alias("_text"))
    return save(
        read.mapInArrow(
            lambda b: _batches(b, n, marked), "batch long, corpus string, ids array<string>, whole array<struct<record_id: string, content: binary, signature: binary>>, record array<int>, words binary, size long"
        ), "packed", compression="zstd", batch=_TEXTS, wide=True,
    )


def _buckets(size: int | None) -> int:
    return max(_LEAST, (size or 0) // _BUCKET)


def _dealt(rows: Iterator[pa.RecordBatch], n: int, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """The hashes of batches' passages, each once for a record: a row for each batch and bucket of this round."""
    for some in rows:
        for batch, corpus, record, words in zip(*(some.column(k) for k in ("batch", "corpus", "record", "words"))):
            raw, starts, ends, text, begins = _cuts(words.as_buffer(), n)
            h, g = _hashes(raw, starts, ends, begins, n)
            bucket = (g >> np.uint64(20)) % np.uint64(buckets)
            mine = np.flatnonzero(bucket % np.uint64(_ROUNDS) == turn)
            h, g, bucket, at = h[mine], g[mine].astype(np.uint16), bucket[mine], begins[mine]
            of = record.values.to_numpy()[text[at]]
            order = np.argsort(h, kind="stable")
            again = np.zeros(len(h), bool)
            a, b = order[1:], order[:-1]
            again[a] = (h[a] == h[b]) & (g[a] == g[b]) & (of[a] == of[b])
            kept = np.flatnonzero(~again)
            kept = kept[np.argsort(bucket[kept].astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")]
            h, g, bucket, at, of = h[kept], g[kept], bucket[kept], at[kept], of[kept]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
            cells = [h[i:j].tobytes() + g[i:j].tobytes() + _planes(at[i:j]) + _planes(of[i:j]) for i, j in zip(first, np.append(first[1:], len(bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array([batch.as_py()] * len(first), pa.int64()), pa.array([corpus.as_py()] * len(first), pa.string()), pa.array(cells, pa.binary())], names=["bucket", "batch", "corpus", "cells"])


def _runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours, and where each key begins there."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if (same & (g[order[1:]] != g[order[:-1]])).any():
        order = np.lexsort((g, h))
        same = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
    return order, np.flatnonzero(np.append(True, ~same))[: len(order)]


def _ranked(corpora: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Corpora in order of their bytes, as Spark and SQL have it, and each row's place among them."""
    names = sorted(set(corpora.to_pylist()), key=lambda c: c.encode())
    places = {c: i for i, c in enumerate(names)}
    return names, np.array([places[c] for c in corpora.to_pylist()], np.int64)


def _joined(rows: pa.Table) -> tuple[list[bytes], np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """One bucket's blobs and their sizes, the corpora, each hash's corpus, an order in which equal keys are
    neighbours, and where each key begins there."""
    cells, (names, corpus) = rows.column("cells").to_pylist(), _ranked(rows.column("corpus"))
    sizes = np.array([len(c) // 18 for c in cells], np.int64)
    h = np.concatenate([np.frombuffer(c, "<u8", k) for c, k in zip(cells, sizes)])
    g = np.concatenate([np.frombuffer(c, "<u2", k, 8 * k) for c, k in zip(cells, sizes)])
    return cells, sizes, names, np.repeat(corpus, sizes), *_runs(h, g)


def _owned(rows: pa.Table) -> pa.Table:
    """Of one bucket's passages those that several corpora have: for each batch of later corpora the words at which
    they begin, and the number of the owner, which is the last record of the first corpus."""
    cells, sizes, _, corpus, order, first = _joined(rows)
    own = np.minimum.reduceat(corpus[order], first)
    several = own != np.maximum.reduceat(corpus[order], first)
    counts = np.diff(np.append(first, len(order)))
    own, order, counts = own[several], order[np.repeat(several, counts)], counts[several]
    if not len(order):
        return pa.table({"batch": pa.array([], pa.int64()), "pos": pa.array([], pa.list_(pa.int32())), "owner": pa.array([], pa.list_(pa.int64()))})
    batch = rows.column("batch").to_numpy()
    number = np.concatenate([b + _risen(c, k, 14 * k) for b, c, k in zip(batch, cells, sizes)]).astype(np.int64)[order]
    mine = corpus[order] == np.repeat(own, counts)
    owner = np.repeat(np.maximum.reduceat(np.where(mine, number, -1), np.cumsum(counts) - counts), counts)
    later, owner = order[~mine], owner[~mine]
    back = np.argsort(later)
    later, owner = later[back], owner[back]
    pos = np.concatenate([_risen(c, k, 10 * k) for c, k in zip(cells, sizes)])[later].astype(np.int32)
    found = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[later], minlength=len(sizes))
    some = np.flatnonzero(found)
    offsets = pa.array(np.append(0, np.cumsum(found[some])).astype(np.int32))
    return pa.table({"batch": batch[some], "pos": pa.ListArray.from_arrays(offsets, pa.array(pos)), "owner": pa.ListArray.from_arrays(offsets, pa.array(owner))})


def _pairs(rows: pa.Table) -> pa.Table:
    """For each two corpora the keys of one bucket that both have."""
    _, _, names, corpus, order, first = _joined(rows)
    key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    both = np.unique(key * len(names) + corpus[order])
    key, corpus, n = both // len(names), both % len(names), np.zeros((len(names), len(names)), np.int64)
    for step in range(1, len(names)):
        same = np.flatnonzero(key[step:] == key[:-step])
        np.add.at(n, (corpus[same], corpus[same + step]), 1)
    left, right = np.nonzero(n)
    return pa.table({"left_corpus": pa.array([names[i] for i in left], pa.string()), "right_corpus": pa.array([names[i] for i in right], pa.string()), "n_keys": n[left, right]})


def _audited(rows: pa.Table, corpus: str) -> pa.Table:
    """Of one bucket's keys that a corpus has: those others have too, those several of its records have, and all."""
    _, _, names, of, order, first = _joined(rows)
    mine = np.add.reduceat((np.array(names) == corpus)[of[order]].astype(np.int64), first)
    every = np.diff(np.append(first, len(order)))
    return pa.table({"n_excluded": [int(((mine > 0) & (every > mine)).sum())], "n_repeated": [int((mine > 1).sum())], "n_keys": [int((mine > 0).sum())]})


def _excluded(rows: pa.Table, corpus: str) -> pa.Table:
    """The numbers of a corpus's records that have a key of one bucket which others have too."""
    cells, sizes, names, of, order, first = _joined(rows)
    mine, every = (np.array(names) == corpus)[of], np.diff(np.append(first, len(order)))
    own = np.add.reduceat(mine[order].astype(np.int64), first)
    hit = order[np.repeat((own > 0) & (every > own), every)]
    number = np.concatenate([b + _risen(c, k, 14 * k) for b, c, k in zip(rows.column("batch").to_numpy(), cells, sizes)]).astype(np.int64)
    return pa.table({"_no": np.unique(number[hit[mine[hit]]])})


def _digests(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each passage that was hit, from the words."""
    names = ["key", "owner_corpus", "owner_id", "corpus", "record_id"]
    for some in rows:
        for corpus, ids, record, words, pos, owner, owners in zip(*(some.column(c) for c in ("corpus", "ids", "record", "words", "pos", "owner", "_owners"))):
            _, starts, ends, text, _ = _cuts(words.as_buffer(), n)
            pos, owner = pos.values.to_numpy(), owner.values.to_numpy()
            view, sha = memoryview(words.as_buffer()), hashlib.sha256
            keys = [sha(view[i:j]).hexdigest() for i, j in zip(starts[pos].tolist(), ends[pos + n - 1].tolist())]
            numbers = owners.values.field("_no").to_numpy()
            order = np.argsort(numbers)
            of = pa.array(order[np.searchsorted(numbers[order], owner)])
            mine = pa.array(record.values.to_numpy()[text[pos]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), owners.values.field("_corpus").take(of), owners.values.field("_id").take(of), pa.array([corpus.as_py()], pa.string()).take(pa.array(np.zeros(len(pos), np.int32))), ids.values.take(mine)], names=names)


def _held(packs: DataFrame, n: int, found: Callable[[pa.Table], pa.Table], kind: str) -> list[DataFrame]:
    """Saved tables of what `found` makes of each bucket of hashes of all passages of `n` words.

    Hashes of 80 bits, and those of the bucket's number, are held together in buckets, half of them
    at a time, which bounds disk: the words are hashed again each time, which is cheap. Two different
    passages of m are the same with a chance of under m * m / 2^86. A bucket grows with none but the
    records that share a passage; buckets are as many as the words ask for.
    """
    buckets = _buckets(packs.agg(F.sum("size")).first()[0])
    dealt = lambda turn: packs.select("batch", "corpus", "record", "words").mapInArrow(lambda b: _dealt(b, n, buckets, turn), "bucket int, batch long, corpus string, cells binary")
    return [save(dealt(turn).groupBy("bucket").applyInArrow(found, kind), "found", batch=_ROWS) for turn in range(_ROUNDS)]


def _numbers(packs: DataFrame) -> DataFrame:
    """_no, _corpus, _id: the records of packed texts by number."""
    return packs.select(F.col("batch").alias("_b"), F.col("corpus").alias("_corpus"), F.posexplode("ids").alias("_i", "_id")).select((F.col("_b") + F.col("_i")).alias("_no"), "_corpus", "_id")


def collisions(packs: DataFrame, n: int) -> DataFrame:
    """Of packed texts, the passages of `n` words that several corpora have: key (SHA-256), owner_corpus, owner_id, corpus,
    record_id, once for each record of a later corpus."""
    found = _held(packs, n, _owned, "batch long, pos array<int>, owner array<long>")
    of_batch = reduce(DataFrame.unionByName, found).groupBy("batch").agg(F.collect_list(F.struct("pos", "owner")).alias("_hits"))
    hits = save(of_batch.select("batch", F.flatten("_hits.pos").alias("pos"), F.flatten("_hits.owner").alias("owner")), "hits", wide=True)
    release(*found)
    owners = hits.select("batch", F.explode(F.array_distinct("owner")).alias("_no")).join(_numbers(packs), "_no").groupBy("batch").agg(F.collect_list(F.struct("_no", "_corpus", "_id")).alias("_owners"))
    read = packs.select("batch", "corpus", "ids", "record", "words").join(hits, "batch").join(owners, "batch")
    return read.mapInArrow(lambda b: _digests(b, n), "key string, owner_corpus string, owner_id string, corpus string, record_id string")


def shared_counts(packs: DataFrame, n: int) -> DataFrame:
    """For each pair of corpora: left_corpus, right_corpus, n_keys, the distinct passages of `n` words that both have."""
    found = _held(packs, n, _pairs, "left_corpus string, right_corpus string, n_keys long")
    return reduce(DataFrame.unionByName, found).groupBy("left_corpus", "right_corpus").agg(F.sum("n_keys").alias("n_keys"))


def audit(packs: DataFrame, n: int, corpus: str) -> DataFrame:
    """n_excluded, n_repeated, n_keys: of the distinct passages of a corpus those that others have too, those that several
    of its records have, and all; no row where it has none."""
    found = _held(packs, n, lambda rows: _audited(rows, corpus), "n_excluded long, n_repeated long, n_keys long")
    return reduce(DataFrame.unionByName, found).agg(*(F.sum(c).alias(c) for c in ("n_excluded", "n_repeated", "n_keys"))).where("n_keys > 0")


def excluded(packs: DataFrame, n: int, corpus: str) -> DataFrame:
    """record_id of a corpus's records with a passage that other corpora have too."""
    found = reduce(DataFrame.unionByName, _held(packs, n, lambda rows: _excluded(rows, corpus), "_no long"))
    return found.distinct().join(_numbers(packs), "_no").select(F.col("_id").alias("record_id"))
