"""Words, sentences and byte n-grams of whole Arrow batches, found with numpy on the UTF-8 bytes.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, with A-Z read as a-z.  In
UTF-8 that rule needs no decoding: every byte of a non-ASCII character is 0x80 or above.  Words are
hashed to 64 bits by a polynomial over one random number per byte, normalised by the word's position,
so a word has one hash wherever it stands.  Texts are read in segments cut between words, so the
working memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]

_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, made once per process (again for a longer word)."""
    if not _powers or len(_powers[0]) < size:
        _powers.clear()
        for factor in (_BASE, _INVERSE):
            steps = np.full(max(size, SEGMENT), factor, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:size], _powers[1][:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if column.null_count:
        # A null row may still span bytes in the buffer; such rows are taken out.
        gone = column.is_null().to_numpy(zero_copy_only=False)
        lengths = np.diff(bounds)
        if lengths[gone].any():
            keep = np.repeat(~gone, lengths)
            flat, lengths = flat[keep], np.where(gone, 0, lengths)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
    return flat, bounds


@dataclass
class Words:
    """The words of some texts in order: hash, row, byte span in the flat buffer, hashes of leading bytes."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    stems: list[np.ndarray]


def _segments(flat: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about SEGMENT bytes that end between words; longer ones only for a longer word."""
    at, total = 0, len(flat)
    while at < total:
        end = stop = min(at + SEGMENT, total)
        while end < total:
            loose = np.flatnonzero(~IS_WORD[flat[stop - SEGMENT : stop]])
            if len(loose):
                end = stop - SEGMENT + int(loose[-1]) + 1
                break
            end = stop = min(stop + SEGMENT, total)
        yield at, end
        at = end


def words_of(flat: np.ndarray, bounds: np.ndarray, stems: tuple[int, ...] = ()) -> Words:
    """All words of all rows; ``stems``: also hash so many leading bytes of each word."""
    inner = np.unique(bounds[1:-1])
    found: list[tuple[np.ndarray, ...]] = []
    for at, end in _segments(flat):
        piece = flat[at:end]
        is_word = IS_WORD[piece]
        fresh = is_word.copy()
        fresh[1:] &= ~is_word[:-1]
        last = is_word.copy()
        last[:-1] &= ~is_word[1:]
        lo, hi = np.searchsorted(inner, [at, end])
        cuts = inner[lo:hi] - at
        cuts = cuts[cuts > 0]
        fresh[cuts] = is_word[cuts]
        last[cuts - 1] = is_word[cuts - 1]
        starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        power, inverse = _power_tables(len(piece))
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[piece] * power, out=sums[1:])
        tops = [ends, *(np.minimum(starts + size, ends) for size in stems)]
        found.append((starts + at, ends + at, *(mix((sums[top] - sums[starts]) * inverse[starts]) for top in tops)))
    if not found:
        empty, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(none, empty, empty, empty, [none for _ in stems])
    starts, ends, hashes, *leading = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, np.searchsorted(bounds, starts, side="right") - 1, starts, ends, leading)


def batches(frames: Iterator[pa.RecordBatch], limit: int = 2 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows whose texts hold about ``limit`` bytes (at least one row each)."""
    for batch in frames:
        if not batch.num_rows:
            continue
        column = batch.column("text").cast(pa.large_string())
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])
        by_size, by_row = np.cumsum(lengths) // limit, np.arange(batch.num_rows) // rows
        cuts = [0, *(np.flatnonzero(np.diff(by_size) | np.diff(by_row)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
