"""Vectorised words and five-word shingles of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chronofold.llm.common import mix64

WIDTH = 5
#: Bytes of text worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate((out, out * np.uint64(step)))
            step = step * step & 0xFFFFFFFFFFFFFFFF
    return out[:n]


_LETTERS = mix64(np.arange(256, dtype=np.uint64), 77)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z as a-z
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and each row's offset; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about CHUNK_BYTES."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, in order, and the number of words of each row.

    Words are maximal runs of bytes other than space and U+0009 to U+000D, A-Z as a-z.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    d = data[begin:end]
    n = len(d)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACES[d]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_rows = offsets[:-1] - begin
    at = starts_of_rows[starts_of_rows < n]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[1:] - begin - 1
    ends_at = ends_at[ends_at >= 0]
    last[ends_at] = inside[ends_at]
    ends = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTERS[d] * _powers(n, _BASE), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts]
        h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    counts = np.diff(np.searchsorted(starts, offsets - begin))
    return h, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in row order, with repeats, and how many each row has.

    A row of fewer than WIDTH words has its whole sequence as one shingle; a row without words has none.
    """
    n_rows = len(counts)
    per_row = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), per_row
    first_word = np.concatenate(([0], np.cumsum(counts)[:-1]))
    padded = np.concatenate((words, np.zeros(WIDTH, np.uint64)))
    total = int(per_row.sum())
    row = np.repeat(np.arange(n_rows), per_row)
    at = first_word[row] + np.arange(total) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    size = np.minimum(counts[row], WIDTH)
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            step = out * np.uint64(0x2545F4914F6CDD1D) + padded[at + k]
            step ^= step >> np.uint64(29)
            out = np.where(size > k, step, out) if (size < WIDTH).any() else step
    return mix64(out), per_row


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, the rows' sorted distinct shingle hashes one after another, each row's count."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        words, counts = word_hashes(data, offsets[lo : hi + 1])
        hashes, per_row = shingle_hashes(words, counts)
        ends = np.cumsum(per_row)
        sets = [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), per_row.tolist())]
        yield lo, (np.concatenate(sets) if sets else hashes), np.array([len(s) for s in sets], np.int64)
