"""Quality by nearest-neighbour voting in a latent-semantic space of style features.

A text is described by the trigrams of its character classes (runs of letters count once), the lengths of
its words and how often words repeat; none of these depends on vocabulary or language.  Counts are
square-rooted, weighted by inverse document frequency and projected on the leading singular directions of
the labelled sample.  Every document is compared with every labelled vector by exact cosine products, in
blocks; its nearest neighbours vote, weighted by similarity.

Vectors and directions are rounded to whole numbers of 1 / GRID.  Products and their sums are then exact in
floating point, so a score depends on its text and the model alone and not on the rows beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .arrow import with_computed
from .learning import fold, labelled_texts
from .words import batches, mix, text_bytes, words_of
from .workspace import ship

SHAPE_BUCKETS = 512
LENGTHS = 16
REPEATS = 4
WIDTH = SHAPE_BUCKETS + LENGTHS + REPEATS

#: Byte classes: letters of a case share one, digits one, every other ASCII character has its own.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_other = np.flatnonzero(_CLASS == 0)
_CLASS[_other] = np.arange(4, 4 + len(_other))
_CLASSES = 4 + len(_other)
_SEGMENT = 1 << 20


def _spans(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of whole short rows together, and of long rows piece by piece from their own start."""
    at = int(bounds[0])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - at > _SEGMENT:
            if lo > at:
                yield at, lo
            at = lo
            while hi - at > _SEGMENT:
                yield at, at + _SEGMENT
                at += _SEGMENT
            if lo < at < hi:
                yield at, hi
                at = hi
    if bounds[-1] > at:
        yield at, int(bounds[-1])


def _shapes(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of hashed class trigrams by row; a row's counts do not depend on the rows around it."""
    n = len(bounds) - 1
    counts = np.zeros(n * SHAPE_BUCKETS)
    for at, end in _spans(bounds):
        piece = _CLASS[flat[at:end]]
        rows = np.searchsorted(bounds, np.arange(at, end), side="right") - 1
        turn = np.ones(len(piece), bool)
        turn[1:] = (piece[1:] != piece[:-1]) | (piece[1:] > 3) | (rows[1:] != rows[:-1])
        kinds, rows = piece[turn], rows[turn]
        grams = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:]
        inside = rows[:-2] == rows[2:]
        slot = (mix(grams[inside].astype(np.uint64)) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
        counts += np.bincount(rows[:-2][inside] * SHAPE_BUCKETS + slot, minlength=n * SHAPE_BUCKETS)
    return counts.reshape(n, SHAPE_BUCKETS)


def features(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Square roots of the feature counts, a row for each text."""
    n = len(bounds) - 1
    words = words_of(flat, bounds)
    lengths = np.minimum(words.ends - words.starts, LENGTHS - 1)
    by_length = np.bincount(words.rows * LENGTHS + lengths, minlength=n * LENGTHS).reshape(n, LENGTHS)
    repeats = np.zeros((n, REPEATS))
    for gap in range(1, REPEATS):
        same = (words.hashes[gap:] == words.hashes[:-gap]) & (words.rows[gap:] == words.rows[:-gap])
        repeats[:, gap - 1] = np.bincount(words.rows[gap:][same], minlength=n)
    order = np.lexsort((words.hashes, words.rows))
    hashes, rows = words.hashes[order], words.rows[order]
    again = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    repeats[:, REPEATS - 1] = np.bincount(rows[1:][again], minlength=n)
    return np.sqrt(np.hstack([_shapes(flat, bounds), by_length, repeats]))


#: Numbers of at most 1 in steps of 2^-20: WIDTH products of two of them add up exactly in 53 bits.
GRID = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in whole numbers of 1 / GRID."""
    x = np.ascontiguousarray(x, float)
    return np.rint(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) * GRID)


@dataclass
class NeighbourModel:
    """Labelled latent vectors and what is needed to place other texts among them."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def place(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _unit(_unit(features(flat, bounds) * self.weights) @ self.directions)

    def score(self, flat: np.ndarray, bounds: np.ndarray, block: int = 512) -> np.ndarray:
        n, known = len(bounds) - 1, len(self.labels)
        if not known:
            return np.ones(n)
        prior, out, placed = self.labels.mean(), np.empty(n), self.place(flat, bounds)
        k = min(self.neighbours, known)
        # Similarity first, then the earlier label row, as one number.
        later = np.arange(known)[::-1]
        for at in range(0, n, block):
            products = placed[at : at + block] @ self.vectors.T
            keys = products.astype(np.int64) * known + later
            near = np.argpartition(keys, known - k, axis=1)[:, known - k :]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(keys, near, 1), axis=1), 1)
            votes = np.maximum(np.take_along_axis(products, near, 1) / GRID**2, 0) ** self.sharpness
            out[at : at + block] = ((votes * self.labels[near]).sum(1) + 0.5 * prior) / (votes.sum(1) + 0.5)
        return np.clip(np.round(out, 6), 0, 1)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, worked out by the executors: WIDTH numbers come back for each text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            counts = features(*text_bytes(batch.column("text")))
            columns = [*(batch.column(c) for c in ("hi", "lo", "_label")), pa.array([x.tobytes() for x in counts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "_label", "counts"])

    ship(docs.sparkSession)
    found = labelled_texts(docs, labels, "quality", 4, 2, rows).mapInArrow(run, "hi long, lo long, _label int, counts binary")
    table = found.toArrow().sort_by([("hi", "ascending"), ("lo", "ascending")])
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), float).reshape(-1, WIDTH)
    return counts, table.column("_label").to_numpy().astype(float)


def fit(
    docs: DataFrame, labels: DataFrame, *, rows: int = 4096, dimensions: int = 48, neighbours: int = 15, sharpness: float = 8.0
) -> NeighbourModel:
    """Learn from at most ``rows`` labelled texts (labels.quality), each read whole.

    Rows whose crc32(doc_id) modulo 4 is 2 are never learned from.  The broadcast model holds
    rows x dimensions numbers, about 1.6 MB with the defaults.  Without labelled rows every score is 1.
    """
    counts, known = _sample(docs, labels, rows)
    if not len(known):
        return NeighbourModel(np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros((0, 1)), known, neighbours, sharpness)
    weights = np.maximum(np.log(1 / ((counts > 0).mean(0) + 1e-3)) + 0.2, 0.2)
    weighted = _unit(counts * weights)
    _, directions = np.linalg.eigh((weighted / GRID).T @ (weighted / GRID))
    directions = np.rint(directions[:, ::-1][:, :dimensions] * GRID)
    return NeighbourModel(weights, directions, _unit(weighted @ directions), known, neighbours, sharpness)


def score_quality(docs: DataFrame, model: NeighbourModel, keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``keep`` (all columns of ``docs`` by default) with score (0 to 1, higher is better) and predicted.

    A null or empty text has no features and is scored by the vote of the vectors nearest to nothing,
    which is the prior of the labels.  Neighbours are ordered by similarity; of equally similar ones the one whose
    text has the smaller key comes first.  Repeated rows are scored alike; columns named score or predicted
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = shared.value.score(*text_bytes(batch.column("text")))
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return with_computed(docs, compute, fields, keep or docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return fold(F.col(doc_id), 4) == 2
