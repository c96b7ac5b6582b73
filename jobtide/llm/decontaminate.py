"""Benchmark decontamination: an FM-index for each shard of documents, searched for benchmark phrases.

A shard is a few MB of whole documents.  Its index covers the runs of words that all occur in benchmark
phrases and are long enough to hold one; no occurrence can lie outside them.  Phrases are found by backward
search, located by sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .arrow import with_computed
from .fmindex import FMIndex
from .keys import text_keys
from .words import batches, text_bytes, words_of
from .workspace import Workspace, ship

WINDOW = 13
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("hit_words", ArrayType(SPAN)),
    StructField("spans", ArrayType(SPAN)),
    StructField("contaminated", BooleanType()),
]


@dataclass
class Phrases:
    """Different phrases of a block, as arrays: the vocabulary of word hashes, for each length the phrases as rows of
    symbols (1 is the first word of the vocabulary), and whose they are, phrase after phrase."""

    vocabulary: np.ndarray
    by_length: list[np.ndarray]
    bounds: list[np.ndarray]  # of each length: where each phrase's owners begin
    owners: list[np.ndarray]
    items: np.ndarray


def phrase_pairs(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, item), each once: a phrase is the hashes of ``window`` words in a row as bytes, or of a shorter item's words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            words = words_of(*text_bytes(batch.column("text")))
            first = np.searchsorted(words.rows, np.arange(batch.num_rows + 1))
            for row, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                size, item = min(window, hi - lo), batch.column("item")[row]
                for at in range(lo, hi - size + 1 if size else lo, 8_192):
                    part = words.hashes[at : min(at + 8_191 + size, hi)]
                    windows = np.lib.stride_tricks.sliding_window_view(part, size)
                    phrases = pa.array([w.tobytes() for w in windows], pa.binary())
                    yield pa.RecordBatch.from_arrays([phrases, pa.array([item.as_py()] * len(phrases), pa.string())], names=["phrase", "item"])

    ship(benchmark.sparkSession)
    items = benchmark.select("text", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    return items.mapInArrow(run, "phrase binary, item string").distinct()


def phrases_of(pairs: pa.Table) -> Phrases:
    """The arrays of a block of pairs."""
    table = pairs.append_column("size", pc.binary_length(pairs.column("phrase"))).sort_by([("size", "ascending"), ("phrase", "ascending"), ("item", "ascending")])
    names = table.column("item").combine_chunks().dictionary_encode()
    sizes, codes = table.column("size").to_numpy() // 8, names.indices.to_numpy()
    flat = np.frombuffer(b"".join(table.column("phrase").to_pylist()), np.uint64)
    vocabulary, symbols = np.unique(flat, return_inverse=True)
    by_length, bounds, owners, at = [], [], [], 0
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        rows = symbols[at : at + size * len(mine)].reshape(-1, size) + 1
        at += size * len(mine)
        fresh = np.append(True, (rows[1:] != rows[:-1]).any(1))  # equal phrases stand together
        by_length.append(rows[fresh].astype(np.int32))
        bounds.append(np.append(np.flatnonzero(fresh), len(rows)))
        owners.append(codes[mine].astype(np.int32))
    return Phrases(vocabulary, by_length, bounds, owners, np.array(names.dictionary.to_pylist(), object))


def occurrences(words, rows: int, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Which words lie in an occurrence of a phrase, and the items that occur in each row."""
    hit, items = np.zeros(len(words.hashes) + 1, np.int64), [set() for _ in range(rows)]
    if not len(words.hashes) or not phrases.by_length:
        return hit[:-1] > 0, items
    slot = np.minimum(np.searchsorted(phrases.vocabulary, words.hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[slot] == words.hashes
    turn = np.ones(len(known), bool)
    turn[1:] = (known[1:] != known[:-1]) | (words.rows[1:] != words.rows[:-1])
    run = np.cumsum(turn) - 1
    size = np.bincount(run)
    chosen = np.flatnonzero(known & (size[run] >= phrases.by_length[0].shape[1]))
    if not len(chosen):
        return hit[:-1] > 0, items
    # The runs one after another, each followed by a separator.
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = run[chosen[1:]] != run[chosen[:-1]]
    place = np.arange(len(chosen)) + np.cumsum(fresh) - 1
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = slot[chosen] + 1
    word_at = np.zeros(len(text), np.int64)
    word_at[place] = chosen
    index = FMIndex(text, len(phrases.vocabulary))
    there = np.zeros(len(phrases.vocabulary) + 1, bool)
    there[text] = True
    for table, bounds, owners in zip(phrases.by_length, phrases.bounds, phrases.owners, strict=True):
        # A phrase with a word that the shard does not have cannot occur in it.
        possible = np.flatnonzero(there[table].all(1))
        low, high = index.search(table[possible].astype(np.int64))
        found = np.repeat(np.arange(len(possible)), high - low)
        inside = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        at = word_at[index.locate(low[found] + inside)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + table.shape[1], -1)
        for met in np.unique(words.rows[at] * len(table) + possible[found]).tolist():
            row, number = divmod(met, len(table))
            items[row].update(phrases.items[owners[bounds[number] : bounds[number + 1]]].tolist())
    return np.cumsum(hit[:-1]) > 0, items


def _spans(hit: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each run of hit words within a row."""
    edge = np.ones(len(hit), bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(hit))
    kept = hit[starts] if len(starts) else np.zeros(0, bool)
    return starts[kept], ends[kept]


#: Found by the blocks before: of each text its key, hit words and items.
_BEFORE = StructType([StructField("hi", LongType()), StructField("lo", LongType()), FIELDS[2], FIELDS[3]])


def _hits(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """hi, lo, items and hit_words of the texts that share a phrase with this block, each text once."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            words = words_of(*text_bytes(batch.column("text")))
            base = np.searchsorted(words.rows, np.arange(batch.num_rows + 1))
            hit, items = occurrences(words, batch.num_rows, shared.value)
            met = [row for row in range(batch.num_rows) if items[row]]
            spans: dict[int, list[dict]] = {row: [] for row in met}
            for lo, hi in zip(*(x.tolist() for x in _spans(hit, words.rows)), strict=True):
                row = int(words.rows[lo])
                spans[row].append({"start": lo - int(base[row]), "end": hi - int(base[row])})
            at = pa.array(met, pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(c).take(at) for c in ("hi", "lo")]
            columns += [pa.array([sorted(items[row]) for row in met], pa.list_(pa.string())), pa.array([spans[row] for row in met], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=_BEFORE.names)

    return docs.select("text", *text_keys()).mapInArrow(run, _BEFORE).dropDuplicates(["hi", "lo"])


def _search(docs: DataFrame, phrases: Phrases, keep: list[str], again: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        flat, bounds = text_bytes(batch.column("text"))
        n = batch.num_rows
        words = words_of(flat, bounds)
        base = np.searchsorted(words.rows, np.arange(n + 1))
        hit, items = occurrences(words, n, shared.value)
        if again:  # what the other blocks have found
            before = zip(batch.column("_hit_words").to_pylist(), batch.column("_items").to_pylist(), strict=True)
            for row, (spans, names) in enumerate(before):
                items[row] |= set(names or ())
                for span in spans or ():
                    hit[base[row] + span["start"] : base[row] + span["end"]] = True
        n_words = np.diff(base)
        n_hit = np.bincount(words.rows[hit], minlength=n)
        hit_words: list[list[dict]] = [[] for _ in range(n)]
        spans: list[list[dict]] = [[] for _ in range(n)]
        for lo, hi in zip(*(x.tolist() for x in _spans(hit, words.rows)), strict=True):
            row = int(words.rows[lo])
            begin, end = int(words.starts[lo]), int(words.ends[hi - 1])
            ahead = int(((flat[bounds[row] : begin] & 0xC0) != 0x80).sum())
            hit_words[row].append({"start": lo - int(base[row]), "end": hi - int(base[row])})
            spans[row].append({"start": ahead, "end": ahead + int(((flat[begin:end] & 0xC0) != 0x80).sum())})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [
            pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(hit_words, kind), pa.array(spans, kind),
            pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
        ]

    return with_computed(docs, compute, FIELDS, keep, ("_items", "_hit_words") if again else ())


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, *, window: int = WINDOW, pairs_at_once: int = 100_000
) -> DataFrame:
    """``keep`` (all columns by default) with what each document shares with the benchmark.

    n_words, n_hit (words inside any occurrence of a benchmark phrase), items (ids of the items that occur,
    sorted), hit_words and spans (merged removal spans in words and in code points, end exclusive) and
    contaminated (n_hit > 0 and 20 n_hit >= n_words).

    The benchmark is read once, into pairs of a phrase and an item.  Pairs go to the executors in blocks of about
    ``pairs_at_once``, some 120 bytes a pair; one block is one pass over the documents.  All blocks but the
    last are settled one by one, as one narrow row for each text with a hit, so no task ever holds two blocks;
    the last pass joins what they found by the text's 128-bit key.

    A null or empty text has no words and no hits, and so has everything when the benchmark is empty.  Items without
    words are never found; items of one id count once, an item without id is called "".  Repeated documents are
    judged alike.  Columns of the names above are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in {f.name for f in FIELDS}]
    work = Workspace(docs.sparkSession, "contamination")
    pairs = work.settle(phrase_pairs(benchmark, window), "pairs")
    blocks = max(1, -(-pairs.count() // pairs_at_once))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)))

    def block(number: int) -> Phrases:
        return phrases_of(pairs.where(F.col("block") == number).select("phrase", "item").toArrow())

    if blocks == 1:
        return _search(docs, block(0), keep, False)
    found = [work.settle(_hits(docs, block(number)), f"hits-{number}") for number in range(blocks - 1)]
    merged = reduce(DataFrame.unionByName, found).groupBy("hi", "lo")
    merged = merged.agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("hit_words")).alias("_hit_words"))
    merged = work.settle(merged.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "_items", "_hit_words"), "merged")
    keyed = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])], *text_keys("_own_hi", "_own_lo"))
    joined = keyed.join(merged, (F.col("_own_hi") == F.col("_hi")) & (F.col("_own_lo") == F.col("_lo")), "left")
    return _search(joined, block(blocks - 1), keep, True)
