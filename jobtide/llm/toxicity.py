"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

Each sentence has a probability from the words and word stems in it; noisy-or combines them to the
document's probability, 1 - prod(1 - p).  Only document labels are known, so the sentence weights are
trained through that product.  The sentence probabilities then say which sentences offend.

A sentence without any word that speaks for toxicity has no probability, and one whose evidence is weak has
none either; so a text does not become toxic by its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .arrow import with_computed
from .learning import fold, labelled_texts
from .words import batches, mix, text_bytes, words_of
from .workspace import Workspace

#: A sentence ends at one of these characters.
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
STEMS = (4, 5, 6)
BUCKETS = 1 << 20

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])


@dataclass
class Sentences:
    """Sentences with words, their rows and byte spans, and (sentence, feature) pairs without repeats."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    features: np.ndarray


def sentences(flat: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> Sentences:
    """Cut texts into sentences; features are hash buckets of words and of their stems (only ``wanted`` ones)."""
    words = words_of(flat, bounds, STEMS)
    stops = np.flatnonzero(_STOP[flat])
    cut = np.searchsorted(stops, words.starts)
    fresh = np.ones(len(cut), bool)
    fresh[1:] = (cut[1:] != cut[:-1]) | (words.rows[1:] != words.rows[:-1])
    sid = np.cumsum(fresh) - 1
    last = np.flatnonzero(np.append(fresh[1:], True)) if len(fresh) else np.zeros(0, np.int64)
    pairs = []
    for salt, hashes in enumerate([words.hashes, *words.stems]):
        bucket = (mix(hashes + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64)
        chosen = slice(None) if wanted is None else wanted[bucket]
        pairs.append(sid[chosen] * BUCKETS + bucket[chosen])
    pairs = np.unique(np.concatenate(pairs))
    return Sentences(words.rows[fresh], words.starts[fresh], words.ends[last], pairs // BUCKETS, pairs % BUCKETS)


@dataclass
class SentenceModel:
    """Weights of the features that matter, by bucket; ``bias`` is added where a sentence has any of them."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(BUCKETS)
        table[self.buckets] = self.weights
        return table


#: A sentence of a lower probability has none.
LEAST_EVIDENCE = 0.2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _counted(sample: DataFrame) -> DataFrame:
    """bucket, seen, seen_toxic: in how many texts, and how many toxic ones, each feature stands; bucket -1 counts the texts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches(frames):
            label = batch.column("_label").to_numpy().astype(np.int64)
            part = sentences(*text_bytes(batch.column("text")))
            pairs = np.unique(part.rows[part.of] * BUCKETS + part.features)
            seen[:BUCKETS] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            toxic[:BUCKETS] += np.bincount(pairs[label[pairs // BUCKETS] == 1] % BUCKETS, minlength=BUCKETS)
            seen[BUCKETS] += len(label)
            toxic[BUCKETS] += label.sum()
        some = np.flatnonzero(seen)
        columns = [pa.array(np.where(some == BUCKETS, -1, some)), pa.array(seen[some]), pa.array(toxic[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "seen", "seen_toxic"])

    found = sample.select("text", "_label").mapInArrow(run, "bucket long, seen long, seen_toxic long")
    return found.groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("seen_toxic").alias("seen_toxic"))


def _evidence(sample: DataFrame, wanted: np.ndarray) -> pa.Table:
    """hi, lo, _label and, for each different set of wanted features that a sentence of the text has, the set's
    places in ``wanted`` and how many sentences have it.  A text without any has one row with a null set."""
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        mask, place = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
        mask[wanted], place[wanted] = True, np.arange(len(wanted))
        for batch in batches(frames):
            part = sentences(*text_bytes(batch.column("text")), mask)
            sets: Counter[tuple[int, tuple[int, ...]]] = Counter()
            cuts = np.flatnonzero(np.diff(part.of)) + 1
            for of, features in zip(part.of[np.append(0, cuts)].tolist() if len(part.of) else [], np.split(place[part.features], cuts), strict=False):
                sets[int(part.rows[of]), tuple(features.tolist())] += 1
            rows = [(row, list(features), n) for (row, features), n in sets.items()]
            rows += [(row, None, 0) for row in set(range(batch.num_rows)) - {row for row, _, _ in rows}]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(c).take(at) for c in ("hi", "lo", "_label")]
            columns += [pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "_label", "features", "n"])

    kinds = "hi long, lo long, _label int, features array<long>, n long"
    return sample.mapInArrow(run, kinds).orderBy("hi", "lo", "features").toArrow()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows: int = 16_384,
    least_documents: int = 5,
    least_z: float = 5.0,
    steps: int = 300,
) -> SentenceModel:
    """Learn from at most ``rows`` labelled texts (labels.toxic), each read whole.

    Rows whose crc32(doc_id) modulo 5 is 0 are never learned from.  A feature counts if it stands in
    ``least_documents`` texts and its texts are toxic more often than chance by ``least_z`` standard
    deviations.  Executors read the texts and count; the driver gets a count for each feature that counts, and of
    every text the different sets of such features in its sentences.  Without labelled rows, or with no such
    feature, every document scores 0.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    sample = work.settle(labelled_texts(docs, labels, "toxic", 5, 0, rows), "sample")
    counts = work.settle(_counted(sample), "counts")
    whole = counts.where("bucket = -1").first()
    none = SentenceModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    if whole is None or whole["seen_toxic"] in (0, whole["seen"]):
        work.drop()
        return none
    rate = whole["seen_toxic"] / whole["seen"]
    z = (F.col("seen_toxic") - F.col("seen") * rate) / F.sqrt(F.col("seen") * (rate * (1 - rate)) + 1e-9)
    kept = counts.where((F.col("bucket") >= 0) & (F.col("seen") >= least_documents) & (z >= least_z))
    wanted = np.sort(kept.select("bucket").toArrow().column("bucket").to_numpy())
    table = _evidence(sample, wanted)
    work.drop()
    if not len(wanted):
        return none
    texts = np.stack([table.column(c).to_numpy() for c in ("hi", "lo")], 1)
    fresh = np.append(True, (texts[1:] != texts[:-1]).any(1))
    owner, toxic = np.cumsum(fresh) - 1, table.column("_label").to_numpy()[fresh].astype(float)
    some = table.column("n").to_numpy() > 0
    features = table.column("features").filter(pa.array(some)).to_pylist()
    of = np.repeat(np.arange(len(features)), [len(x) for x in features])
    which = np.array([x for row in features for x in row], np.int64)
    weights, bias = _train(toxic, owner[some], table.column("n").to_numpy()[some], of, which, len(wanted), steps)
    return SentenceModel(wanted, weights, bias)


def _train(toxic: np.ndarray, owner: np.ndarray, times: np.ndarray, of: np.ndarray, which: np.ndarray, width: int, steps: int):
    """Adam on the negative log-likelihood of the document labels under noisy-or.

    owner, times: each sentence's document, and how often it stands there; of, which: (sentence, feature) pairs.
    """
    n, count = len(toxic), len(owner)
    at = np.zeros(width + 1)
    at[-1] = -6.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = _sigmoid(at[-1] + np.bincount(of, weights=at[:-1][which], minlength=count))
        clean = np.bincount(owner, weights=times * np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        whole = np.clip(1 - np.exp(clean), 1e-6, 1 - 1e-6)
        slope = times * np.where(toxic == 1, -(1 - whole) / whole, 1.0)[owner] * p / n
        gradient = np.append(np.bincount(which, weights=slope[of], minlength=width), slope.sum())
        gradient[:-1] += 1e-5 * at[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        at -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return at[:-1], float(at[-1])


def score_toxicity(docs: DataFrame, model: SentenceModel, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` (all columns by default) with score, predicted and offending.

    score is the noisy-or over the sentences; predicted is 1 from ``threshold``; offending lists the
    sentences whose own probability reaches the threshold, as code point spans (end exclusive), or
    the strongest one where several weaker ones make a document toxic: it is never empty where
    predicted is 1.  A sentence below LEAST_EVIDENCE has no probability, so a text of any length without a
    suspicious sentence scores 0, as does an empty or null one.  Repeated rows are scored
    alike; columns of the three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        flat, bounds = text_bytes(batch.column("text"))
        table = model.dense()
        part = sentences(flat, bounds, table != 0)
        known = np.bincount(part.of, minlength=len(part.rows)) > 0
        p = np.where(known, _sigmoid(model.bias + np.bincount(part.of, weights=table[part.features], minlength=len(part.rows))), 0)
        p[p < LEAST_EVIDENCE] = 0
        clean = np.bincount(part.rows, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=batch.num_rows)
        scores = np.round(1 - np.exp(clean), 6)
        most = np.zeros(batch.num_rows)
        np.maximum.at(most, part.rows, p)
        bar = np.where(scores >= threshold, np.minimum(threshold, most), threshold)
        bad = np.flatnonzero((p > 0) & (p >= bar[part.rows]))
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i in bad.tolist():
            row, lo, hi = int(part.rows[i]), int(part.starts[i]), int(part.ends[i])
            ahead = int(((flat[bounds[row] : lo] & 0xC0) != 0x80).sum())
            size = int(((flat[lo:hi] & 0xC0) != 0x80).sum())
            spans[row].append({"start": ahead, "end": ahead + size, "score": round(float(p[i]), 6)})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)]

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("offending", ArrayType(SPAN))]
    return with_computed(docs, compute, fields, keep or docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return fold(F.col(doc_id), 5) == 0
