"""Hashes of the words of many texts at once, with numpy over their UTF-8 bytes.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case. A word's hash is a polynomial in its bytes,
read off running sums over a slice of the batch, and mixed. Slices hold about a quarter megabyte of
whole texts, which bounds memory beside one long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, np.uint64)  # one fixed number for each byte
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared ... as 64-bit numbers, n of them at least."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE_BYTES + 1), base)
        held[0] = 1
        _POWERS[int(base)] = held = np.cumprod(held, dtype=np.uint64)
        if n > 4 * SLICE_BYTES:
            del _POWERS[int(base)]  # a very long text's table isn't kept
    return held


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets of the rows in them) of runs of whole texts; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, side="right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def running(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of the numbers of bytes i to j, each times the base to its place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the bytes from start to end, wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: lower-case bytes, starts and ends of its words, and offsets of the rows in those."""
    lower = _LOWER[data]
    space = _SPACE[data]
    bounds = at[(at > 0) & (at < len(data))]
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    after = np.concatenate((space[1:], [True])) if len(data) else space
    if len(bounds):
        before[bounds] = True
        after[bounds - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return lower, start, end, np.searchsorted(start, at)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of the rows in them) of runs of whole texts."""
    for first, data, at in slices(texts):
        lower, start, end, rows = words(data, at)
        yield first, between(running(lower), start, end), rows
