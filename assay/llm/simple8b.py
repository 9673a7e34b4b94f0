"""Simple-8b: ids packed into 64-bit words, as many of one width as fit 60 bits, a selector above.

A selector of 1 to 14 says how many ids the word has and how wide they are; 0 says that the
word's 60 bits are the place of one larger id in a list of escapes. Ids are coded in chunks of
CHUNK, and `offsets` has the words before each chunk, so that chunks code and decode side by
side: every step below is a numpy operation over all chunks or all words of a selector.
"""

from __future__ import annotations

import numpy as np

#: Ids of a word, and their bits, for selectors 1 to 14.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
CHUNK = 1024

_LIMITS = np.left_shift(np.uint64(1), WIDTHS.astype(np.uint64))
_TAKES = np.concatenate((COUNTS, [1]))


def _fitting(need: np.ndarray) -> np.ndarray:
    """For each place the selector index (14: escape) that packs most ids from there on."""
    choice = np.full(need.shape, len(COUNTS), np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        run, n = need <= s, 1
        while n < COUNTS[s] and run.any():
            step = min(n, COUNTS[s] - n)
            shifted = np.ones_like(run)
            shifted[:, :-step] = run[:, step:]
            run = run & shifted
            n += step
        choice[run] = s
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64), offsets (words before each chunk, int32) and escapes (uint64)."""
    ids = np.asarray(ids, np.uint64)
    chunks = -(-len(ids) // CHUNK)
    if not chunks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    wide = CHUNK + int(COUNTS[0])
    values = np.zeros((chunks, wide), np.uint64)
    flat = np.zeros(chunks * CHUNK, np.uint64)
    flat[: len(ids)] = ids
    values[:, :CHUNK] = flat.reshape(chunks, CHUNK)
    size = np.full(chunks, CHUNK)
    size[-1] = len(ids) - (chunks - 1) * CHUNK
    choice = _fitting(np.searchsorted(_LIMITS, values, side="right").astype(np.int8))
    row, at, steps = np.arange(chunks), np.zeros(chunks, np.int64), []
    while len(row):
        s = choice[row, at]
        steps.append((row, at, s))
        at = at + _TAKES[s]
        more = at < size[row]
        row, at = row[more], at[more]
    rows, places, chosen = (np.concatenate(x) for x in zip(*steps))
    order = np.lexsort((places, rows))
    rows, places, chosen = rows[order], places[order], chosen[order]
    words = np.zeros(len(rows), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s == len(COUNTS):
            escapes = values[rows[here], places[here]]
            words[here] = np.arange(len(here), dtype=np.uint64)
        else:
            packed = np.full(len(here), np.uint64(s + 1) << np.uint64(60))
            for j in range(COUNTS[s]):
                packed |= values[rows[here], places[here] + j] << np.uint64(j * WIDTHS[s])
            words[here] = packed
    if not (chosen == len(COUNTS)).any():
        escapes = np.zeros(0, np.uint64)
    return words, np.searchsorted(rows, np.arange(chunks)).astype(np.int32), escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids (uint64) again."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64) - 1
    count = np.where(selector < 0, 1, COUNTS[selector])
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    size = np.full(len(offsets), CHUNK)
    size[-1] = n_ids - (len(offsets) - 1) * CHUNK
    before = np.concatenate(([0], np.cumsum(count)))
    count[ends - 1] -= before[ends] - before[offsets.astype(np.int64)] - size  # the last word of a chunk may have room left
    start = np.concatenate(([0], np.cumsum(count)))[:-1]
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s < 0:
            out[start[here]] = escapes[words[here].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            held = here[count[here] > j]
            out[start[held] + j] = (words[held] >> np.uint64(j * WIDTHS[s])) & mask
    return out
