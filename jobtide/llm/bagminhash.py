"""BagMinHash signatures of word-shingle multisets.

A shingle of weight w owns the weight levels [0, w).  The levels are discretised to the doubling intervals
[0, 1), [1, 2), [2, 4), [4, 8) ..., and each (shingle, interval) has a Poisson process whose rate is the
interval's width.  A point falls on one level of its interval, found by halving the interval bit by bit, and
belongs to every multiset whose weight lies above that level; it also falls on one of the signature's places.
A place holds the earliest point among all that belong.  The earliest point of two multisets is the same with
a probability of exactly their weighted Jaccard similarity, sum of minima over sum of maxima.

Points come in order of time, so a process is left as soon as it is later than everything in its text's
signature; long texts need hardly more than the first point of each process.
"""

from __future__ import annotations

import numpy as np

from .words import mix, words_of

SHINGLE = 5
PLACES = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


def shingles(flat: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each row's different shingles, by row and hash.

    A text of fewer than ``size`` words, but not none, is one shingle.
    """
    words = words_of(flat, bounds)
    n = len(bounds) - 1
    first = np.searchsorted(words.rows, np.arange(n + 1))
    count = np.diff(first)
    place = np.arange(len(words.rows)) - first[words.rows]
    starts = place <= np.maximum(count[words.rows] - size, 0)
    at = np.flatnonzero(starts)
    value = np.zeros(len(at), np.uint64)
    for ahead in range(size):
        inside = np.minimum(at + ahead, len(words.rows) - 1)
        part = np.where(place[at] + ahead < count[words.rows[at]], words.hashes[inside], np.uint64(ahead))
        value = mix(value * _STEP + part)
    rows = words.rows[at]
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    edges = np.append(np.flatnonzero(fresh), len(value))
    return rows[fresh], value[fresh], np.diff(edges)


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """The earliest time at each place, for ``n`` texts; infinite throughout for a text without shingles.

    ``places`` is a power of two.
    """
    earliest = np.full((n, places), np.inf)
    flat = earliest.reshape(-1)
    # One process for each (shingle, interval) that reaches below the weight.
    row, state, width, weight, parts = rows, mix(hashes ^ _SALT), np.ones(len(rows), np.int64), counts, []
    base = np.zeros(len(rows), np.int64)
    parts.append((row, state, base, width, weight))
    lowest = 1
    while len(row := rows[chosen := counts > lowest]):
        state = mix(hashes[chosen] ^ np.uint64(int(_SALT) * (2 * lowest + 1) % 2**64))
        parts.append((row, state, np.full(len(row), lowest), np.full(len(row), lowest), counts[chosen]))
        lowest *= 2
    row, state, base, width, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(row))
    while len(row):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
        fall = mix(draw ^ _SALT)
        place = (fall & np.uint64(places - 1)).astype(np.int64)
        # Widths are powers of two: each bit of the remainder takes one half of what is left of the interval.
        level = base + ((fall >> np.uint64(20)).astype(np.int64) & (width - 1))
        hit = level < weight
        np.minimum.at(flat, row[hit] * places + place[hit], time[hit])
        open_ = time < earliest.max(axis=1)[row]
        row, state, base, width, weight, time = row[open_], state[open_], base[open_], width[open_], weight[open_], time[open_]
    return earliest


def compact(earliest: np.ndarray) -> np.ndarray:
    """16 bits of each place; equal places stay equal, different ones meet by chance once in 65,536."""
    return (mix(earliest.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as sorted hashes and counts."""
    total = int(a[1].sum() + b[1].sum())
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][left], b[1][right]).sum())
    return shared / (total - shared) if total else 0.0
