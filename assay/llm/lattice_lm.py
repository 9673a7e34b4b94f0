"""Language-model scores by subword lattice likelihood.

A text is a sequence of words and an end. A word is drawn piece by piece from an existing
subword vocabulary until a piece that ends words comes; its probability is the sum over all ways
to cut it into pieces, a forward recursion in log space over its bytes. The vocabulary is given,
but none at hand has probabilities (BPE files hold merge ranks only), so these are learnt from the
training words: each is cut once by the vocabulary's own tokenizer and its pieces are counted with
the word's frequency; then ITERATIONS times every piece gets the expected count over all cuts of
all words, by forward and backward recursion. One is added to every piece's count.

Beside it stands a base score from add-one word frequencies.

Words are counted over all documents by a shuffle, and each distinct word's lattice is run once,
not once for each occurrence. The most frequent words' values (at most BROADCAST_WORDS of them,
24 bytes each) are broadcast; a document's other words meet theirs in a join, so nothing that is
broadcast or collected grows with the corpus. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table
from .hashing import between, running, word_hashes
from .tokenizing import WordEncoder

#: Words whose values are broadcast, at most: 6 MB.
BROADCAST_WORDS = 1 << 18
#: Distinct words whose lattices a task holds together.
WORDS = 20_000
#: Documents with this remainder of their id's CRC-32 are held out.
FOLDS, HELD_OUT = 7, 2
#: Rounds of expectation, and bytes of words whose lattices are held together in one.
ITERATIONS, TOGETHER = 1, 1 << 17
_END = "</w>"


def held_out() -> Column:
    """Whether a row is held out: crc32 of doc_id as text, mod 7, is 2; a null doc_id is empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _bytes_of() -> dict[str, int]:
    """Of byte-level vocabularies: the byte that each character of a piece stands for. Printable
    characters stand for themselves, the other bytes for those from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """The vocabulary as byte strings: which pieces go on and which end a word, found by hash."""

    def __init__(self, path: str):
        byte = _bytes_of()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)  # not kept
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.size = tokenizer.get_vocab_size(with_added_tokens=True)
        surfaces: dict[bytes, list[int]] = {}
        for piece, i in vocabulary.items():
            ends = piece.endswith(_END)
            text = piece[: -len(_END)] if ends else piece
            if text and all(c in byte for c in text):
                surfaces.setdefault(bytes(byte[c] for c in text), [-1, -1])[ends] = i
        self.known = sum((a >= 0) + (b >= 0) for a, b in surfaces.values())
        self.longest = max(map(len, surfaces))
        self.ids = np.array(list(surfaces.values()), np.int64)
        self.valid = np.zeros(self.size, bool)
        self.valid[self.ids[self.ids >= 0]] = True
        #: For each id the piece of the same bytes that goes on, or -1; then its bytes' pieces.
        self.inner = np.full(self.size, -1, np.int64)
        single = {s[0]: i for s, (i, _) in surfaces.items() if len(s) == 1}
        self.spelt: dict[int, list[int]] = {}
        for s, (a, b) in surfaces.items():
            for i in (a, b):
                if i >= 0:
                    self.inner[i] = a
                    if a < 0:
                        self.spelt[i] = [single[c] for c in s]
        text = np.frombuffer(b"".join(surfaces), np.uint8)
        ends = np.cumsum([len(s) for s in surfaces])
        self.hashes = between(running(text), np.concatenate(([0], ends[:-1])), ends)
        # Tables of slots by different bits of the hash; what collides in one goes to the next.
        self.tables, left, shift = [], np.arange(len(self.hashes)), 44
        while len(left):
            slots = np.full(1 << 20, -1, np.int32)
            slot = self._slot(self.hashes[left], shift)
            slots[slot] = left
            self.tables.append((shift, slots))
            left, shift = left[slots[slot] != left], shift - 11

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for shift, slots in self.tables:
            at = slots[self._slot(hashes, shift)]
            hit = (at >= 0) & (self.hashes[at] == hashes)
            out[hit] = at[hit]
        return out

    def count(self, ids: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is drawn if words with `ids` (from at[k] to at[k + 1]) come so often:
        the last piece of a word ends it, the others go on. Special tokens are none of the pieces."""
        own = self.valid[ids]
        ids, at = ids[own], np.concatenate(([0], np.cumsum(own)))[at]
        n = np.diff(at)
        weight = np.repeat(times, n).astype(np.float64)
        last = np.zeros(len(ids), bool)
        last[at[1:][n > 0] - 1] = True
        ids = ids.astype(np.int64)
        inner = self.inner[ids]
        counts = np.bincount(ids[last], weight[last], self.size) + np.bincount(inner[~last & (inner >= 0)], weight[~last & (inner >= 0)], self.size)
        for i, w in zip(ids[~last & (inner < 0)], weight[~last & (inner < 0)]):
            for b in self.spelt.get(int(i), ()):
                counts[b] += w
        return np.where(self.valid, counts, 0)

    def log_probabilities(self, counts: np.ndarray) -> np.ndarray:
        """For each surface the log-probability of the piece that goes on, and that ends a word."""
        logs = np.append(np.log((counts + 1) / (counts.sum() + self.known)), -np.inf)
        return logs[self.ids]  # -1 takes the last

    def log_likelihood(self, data: np.ndarray, at: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """For each word (bytes from at[k] to at[k + 1]) the log of its probability, over all cuts."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        start, size = at[:-1][order], size[order]
        sums, longest = running(data), int(size[0]) if len(size) else 0
        ring = min(self.longest, longest) + 1  # as many last columns as a piece can reach
        alpha = np.full((ring, len(size)), -np.inf)
        alpha[0] = 0.0
        out = np.zeros(len(size))
        for i in range(1, longest + 1):
            active = int(np.searchsorted(-size, -i, side="right"))  # words of i bytes or more come first
            here = np.full(active, -np.inf)
            ends = size[:active] == i
            for n, hit, _, step in self._arriving(sums, start[:active], ends, i, logs):
                here[hit] = np.logaddexp(here[hit], alpha[(i - n) % ring, hit] + step)
            alpha[i % ring, :active] = here
            out[:active][ends] = here[ends]
        result = np.empty(len(size))
        result[order] = out
        return result

    def _arriving(self, sums: np.ndarray, start: np.ndarray, ends: np.ndarray, i: int, logs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The pieces that can end at byte i of words, by their length: which words, which surfaces, and
        their log-probabilities."""
        for n in range(1, min(i, self.longest) + 1):
            begin = start + (i - n)
            piece = self.find(between(sums, begin, begin + n))
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                yield n, hit, piece[hit], logs[piece[hit], ends[hit].astype(np.int64)]

    def expected(self, data: np.ndarray, at: np.ndarray, times: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The expected count of each piece over all cuts of words that come so often."""
        counts = np.zeros((len(self.hashes), 2))
        sums, size = running(data), np.diff(at)
        order = np.argsort(-size, kind="stable")
        first = 0
        while first < len(order):  # longest words first, so that a matrix of all their places stays small
            some = order[first : first + max(1, TOGETHER // int(max(1, size[order[first]])))]
            first += len(some)
            self._expect(sums, at[:-1][some], size[some], times[some].astype(np.float64), logs, counts)
        out = np.zeros(self.size)
        for side in (0, 1):
            has = self.ids[:, side] >= 0
            np.add.at(out, self.ids[has, side], counts[has, side])
        return out

    def _expect(self, sums: np.ndarray, start: np.ndarray, size: np.ndarray, times: np.ndarray, logs: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts what words (longest first) give. Going on to byte i, all its lattice's edges are
        held; going back, each edge's share is what leads to it times what follows."""
        longest = int(size[0])
        alpha = np.full((longest + 1, len(size)), -np.inf)
        alpha[0] = 0.0
        edges = []
        for i in range(1, longest + 1):
            active = int(np.searchsorted(-size, -i, side="right"))
            ends = size[:active] == i
            found = list(self._arriving(sums, start[:active], ends, i, logs))
            edges.append((found, ends))
            for n, hit, _, step in found:
                alpha[i, hit] = np.logaddexp(alpha[i, hit], alpha[i - n, hit] + step)
        total = alpha[size, np.arange(len(size))]
        known = np.isfinite(total)
        beta = np.full((longest + 1, len(size)), -np.inf)
        beta[size, np.arange(len(size))] = 0.0
        for i in range(longest, 0, -1):
            found, ends = edges[i - 1]
            for n, hit, piece, step in found:
                after = beta[i, hit] + step
                beta[i - n, hit] = np.logaddexp(beta[i - n, hit], after)
                ok = known[hit]
                share = np.exp(alpha[i - n, hit[ok]] + after[ok] - total[hit[ok]]) * times[hit[ok]]
                np.add.at(counts, (piece[ok], ends[hit[ok]].astype(np.int64)), share)


_PIECES: dict[str, Pieces] = {}


_CUTTERS: dict[str, WordEncoder] = {}


def cutter(path: str) -> WordEncoder:
    """One tokenizer for each Python worker and file; no word comes twice, so none is remembered."""
    if path not in _CUTTERS:
        _CUTTERS[path] = WordEncoder(path, remember=False)
    return _CUTTERS[path]


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, n (all occurrences) and c (those in training documents), summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for train in (True, False):
                some = pc.filter(batch.column("text"), batch.column("train") if train else pc.invert(batch.column("train")))
                found = pc.ascii_split_whitespace(pc.ascii_lower(some)).flatten().value_counts()
                word, n = found.field("values"), found.field("counts")
                keep = pc.greater(pc.binary_length(word), 0)
                word, n = pc.filter(word, keep), pc.filter(n, keep)
                yield pa.RecordBatch.from_arrays([word.cast(pa.binary()), n.cast(pa.int64()), n.cast(pa.int64()) if train else pa.array(np.zeros(len(n), np.int64))], names=["word", "n", "c"])

    return docs.select("text", "train").mapInArrow(count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of words."""
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if len(words) and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def _summed(words: DataFrame, path: str, of) -> np.ndarray:
    """The training counts of all pieces, as many numbers as the vocabulary has: the sum of what `of`
    gives for each batch of words (`word`, `c`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pieces(path).size)
        for batch in batches:
            for i in range(0, batch.num_rows, WORDS):
                total += of(batch.slice(i, WORDS))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    out = np.zeros(pieces(path).size)
    for r in words.where("c > 0").select("word", "c").mapInArrow(count, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _piece_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often each piece is drawn in training: first by one cut of each word, then by expectation."""

    def once(batch: pa.RecordBatch) -> np.ndarray:
        ids, at = cutter(path).encode(batch.column("word").cast(pa.string()))
        return pieces(path).count(ids, at, np.asarray(batch.column("c")))

    counts = _summed(words, path, once)
    for _ in range(ITERATIONS):
        held = words.sparkSession.sparkContext.broadcast(counts)

        def expected(batch: pa.RecordBatch, held=held) -> np.ndarray:
            data, at = _flat(batch.column("word"))
            return pieces(path).expected(data, at, np.asarray(batch.column("c")), pieces(path).log_probabilities(held.value))

        counts = _summed(words, path, expected)
    return counts


def _valued(words: DataFrame, path: str, counts: np.ndarray) -> DataFrame:
    """For each word its hash h, n, c, and lp: log10 of its lattice probability."""
    held = words.sparkSession.sparkContext.broadcast(counts)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        logs = p.log_probabilities(held.value)
        for batch in (b.slice(i, WORDS) for b in batches for i in range(0, b.num_rows, WORDS)):
            data, at = _flat(batch.column("word"))
            h = between(running(data), at[:-1], at[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("n"), batch.column("c"), pa.array(p.log_likelihood(data, at, logs) / math.log(10))], names=["h", "n", "c", "lp"])

    return words.mapInArrow(value, "h long, n long, c long, lp double")


def _frequent(words: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least n for which at most BROADCAST_WORDS words are as frequent, and the hashes (ascending),
    c and lp of those."""
    by_n = words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("above", F.sum("k").over(Window.orderBy(F.desc("n"))))
    least = by_n.where(F.col("above") <= BROADCAST_WORDS).agg(F.min("n")).first()[0]
    if least is None:
        return 1 << 62, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    rows = words.where(F.col("n") >= least).select("h", "c", "lp").orderBy("h").toArrow()
    return least, tuple(np.asarray(rows.column(k)) for k in ("h", "c", "lp"))


def _parts(docs: DataFrame, values: tuple) -> DataFrame:
    """For each row: uid, n_words, and of its frequent words how many are known, the sum of
    log10(c + 1) and of lp; the others as hashes with their counts."""
    held = docs.sparkSession.sparkContext.broadcast(values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, lp = held.value
        base = np.log10(c + 1.0)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, hashes, at in word_hashes(batch.column("text")):
                hashes, n = hashes.view(np.int64), len(at) - 1
                place = np.minimum(np.searchsorted(h, hashes), max(0, len(h) - 1))
                found = h[place] == hashes if len(h) else np.zeros(len(hashes), bool)
                place = place[found]
                upto = np.concatenate(([0], np.cumsum(found)))[at]
                known, base_sum, lattice = (np.diff(np.concatenate(([0], np.cumsum(x[place])))[upto]) for x in (c > 0, base, lp))
                # The other words of each text, each once with its number.
                of, rare = np.repeat(np.arange(n), np.diff(at))[~found], hashes[~found]
                order = np.lexsort((rare, of))
                of, rare = of[order], rare[order]
                new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (rare[1:] != rare[:-1])))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare)))
                offsets = pa.array(np.searchsorted(of[new], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (rare[new], times)]
                rows = batch.slice(first, n)
                cells = [pa.array(np.arange(uid, uid + n)), pa.array(np.diff(at), pa.int64()), pa.array(known, pa.int64()), pa.array(base_sum), pa.array(lattice)]
                uid += n
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("train"), *cells, *lists], names=["doc_id", "train", "uid", "n_words", "known", "base", "lattice", "rare", "times"])

    return docs.select("doc_id", "text", "train").mapInArrow(part, "doc_id long, train boolean, uid long, n_words long, known long, base double, lattice double, rare array<long>, times array<long>")


def score(docs: DataFrame, path: str) -> DataFrame:
    """Every row's doc_id with held_out, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score and score (log10 probabilities).

    A null or empty text is an end alone. Rows are never merged: repeated and null doc_ids stay
    apart. Without training documents base and model rest on the added ones alone; an empty table
    gives no rows. A very long text is scored whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~held_out()).alias("train"))
    counted = save(_word_counts(docs), "words")
    words = save(_valued(counted, path, _piece_counts(counted, path)), "values")
    least, values = _frequent(words)
    parts = save(_parts(docs, values), "parts")
    ends = parts.agg(F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()[0]
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = total[0] + ends, total[1] + (ends > 0)
    each, end = math.log10(n + v + 1), (ends + 1) / (n + 2)
    rare = parts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("_r")).select("uid", F.col("_r.rare").alias("h"), F.col("_r.times").alias("_k"))
    summed = (
        rare.join(words.where(F.col("n") < least).select("h", "c", "lp"), "h")
        .groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("_k")).otherwise(0)).alias("_known"), F.sum(F.col("_k") * F.log10(F.col("c") + 1.0)).alias("_base"), F.sum(F.col("_k") * F.col("lp")).alias("_lattice"))
    )
    n_tokens = F.col("n_words") + 1
    of = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.join(summed, "uid", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), n_tokens.alias("n_tokens"), (of("known", "_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (of("base", "_base") + math.log10(ends + 1) - n_tokens * each).alias("base_score"),
        (of("lattice", "_lattice") + F.col("n_words") * math.log10(1 - end) + math.log10(end)).alias("score"),
    )


def op8_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learnt from those not held out: see `score` for nulls, empty and
    very long texts, ties and repeated rows."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
