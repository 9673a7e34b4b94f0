"""Encoding whole texts with a word-level BPE of the tokenizers library, a distinct word at a time.

The tokenizer splits a text at white space before it merges, and no step of it looks across
white space, so the ids of a text are the ids of its white-space separated words in order.
Words repeat, so each batch is dictionary-encoded with Arrow and only words a worker has not
met lately (known by their 64-bit hashes) go through the library. The split here is at ASCII white space only, a subset of
what the tokenizer splits at: a word with other spaces inside is passed on whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import between, running

#: Words a worker remembers in each of two generations; a bound of its memory, not of its results.
CACHE_WORDS = 250_000
#: Bytes of text that are encoded together; a longer text is encoded alone.
SLICE_BYTES = 1 << 22

_ENCODERS: dict[str, "WordEncoder"] = {}


#: Letters that no step before the merges changes, and marks that it always parts from them.
_PLAIN = "[a-zà-öø-ÿ]"
_MARK = "[.,;:!?]"


def _gather(store: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `store` from each place on, one after the other."""
    ends = np.cumsum(size)
    return store[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class _Known:
    """Ids of words by the words' 64-bit hashes, ascending: flat arrays, no object for each word."""

    def __init__(self):
        self.hashes, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place, -1)

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        at = np.concatenate((self.at, len(self.ids) + np.cumsum(size) - size))
        hashes, size = np.concatenate((self.hashes, hashes)), np.concatenate((self.size, size))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.size, self.ids = hashes[order], at[order], size[order], np.concatenate((self.ids, ids))


class WordEncoder:
    """Encodes Arrow arrays of texts to flat uint32 ids with offsets."""

    def __init__(self, path: str, remember: bool = True):
        """`remember`: keep the ids of words for later batches; of no use where no word comes twice."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's own threads would only wait for work
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words of plain letters normalising and splitting do nothing: only merges are left.
        self.steps = {False: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), True: (normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))}
        self.young, self.old = _Known(), _Known()
        self.most = CACHE_WORDS if remember else 0

    def part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts: flat, and the place and number of each part's. Parts that are in
        neither generation go through the library; all are in the young one then."""
        if len(self.young.hashes) > self.most:
            self.old, self.young = self.young if self.most else _Known(), _Known()
        cells = parts.cast(pa.large_binary())
        at = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1] if len(cells) else np.zeros(1, np.int64)
        data = np.frombuffer(cells.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        hashes = between(running(data), at[:-1] - at[0], at[1:] - at[0])
        lacking = np.flatnonzero(self.young.find(hashes) < 0)
        before = self.old.find(hashes[lacking])
        kept = before[before >= 0]
        self.young.add(hashes[lacking[before >= 0]], self.old.size[kept], _gather(self.old.ids, self.old.at[kept], self.old.size[kept]))
        new = lacking[before < 0]
        plain = np.asarray(pc.match_substring_regex(parts.take(pa.array(new)), f"^{_PLAIN}+$"), bool)
        for merges_only, chosen in ((True, new[plain]), (False, new[~plain])):
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps[merges_only]
            for i in range(0, len(chosen), 8192):
                found = [e.ids for e in self.tokenizer.encode_batch_fast(parts.take(pa.array(chosen[i : i + 8192])).to_pylist(), add_special_tokens=False)]
                size = np.fromiter(map(len, found), np.int64, len(found))
                self.young.add(hashes[chosen[i : i + 8192]], size, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))
        place = self.young.find(hashes)
        return self.young.ids, self.young.at[place], self.young.size[place]

    def slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`encode` of runs of whole texts of about SLICE_BYTES, in order; bounds memory."""
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield self.encode(texts.slice(first, last - first))
            first = last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32, flat) and offsets (int64, one more than texts); a null text has none.

        A word's ASCII letters are lower-cased and marks parted from the letters before them, as
        the tokenizer does, so that fewer distinct parts are left; not in a word that may hold
        one of the special tokens.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = np.diff(np.asarray(split.offsets, np.int64))
        coded = split.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices, np.int64), coded.dictionary
        spaced = pc.replace_substring_regex(pc.ascii_lower(words), f"({_PLAIN})({_MARK})", r"\1 \2")
        parts = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(words, "<|"), words, spaced))
        per_word = np.diff(np.asarray(parts.offsets, np.int64))
        coded = parts.flatten().dictionary_encode()
        store, at, size = self.part_ids(coded.dictionary)
        indices = np.asarray(coded.indices, np.int64)
        part_size = size[indices]
        store = _gather(store, at[indices], part_size)  # the ids of each distinct word, one after the other
        bounds = np.concatenate(([0], np.cumsum(part_size)))[np.concatenate(([0], np.cumsum(per_word)))]
        count = np.diff(bounds)[codes]
        ends = np.concatenate(([0], np.cumsum(count)))
        return _gather(store, bounds[:-1][codes], count), ends[np.concatenate(([0], np.cumsum(per_text)))]


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_with_end(path: str, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """For each text its ids (little-endian uint32) and then `end_id`."""
    end = np.array([end_id], "<u4")
    for ids, at in encoder(path).slices(texts):
        for a, b in zip(at[:-1], at[1:]):
            yield np.concatenate((ids[a:b], end))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
