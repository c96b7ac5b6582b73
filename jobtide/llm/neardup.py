"""Near-duplicate classes by BagMinHash signatures, bands and exact multiset overlap.

Exact copies are one text from the start.  Texts that agree on a whole band of their signatures share a
bucket.  First each bucket's members are verified against its most connected member, which joins nearly
all there is to join.  Then, wherever a bucket still holds different classes, all its pairs across
classes are compared exactly, in blocks of bounded size; those comparisons emit only the links that join
classes, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bagminhash import PLACES, compact, shingles, signatures, similarity
from .components import components
from .words import batches, mix, text_bytes
from .keys import text_keys
from .spread import look_up
from .workspace import Workspace

BAND = 4
BANDS = PLACES // BAND


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the text's 128-bit key (hi, lo), whether it has words, and its compact signature."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            n = batch.num_rows
            rows, hashes, counts = shingles(*text_bytes(batch.column("text")))
            places = compact(signatures(rows, hashes, counts, n))
            columns = [batch.column(c) for c in ("doc_id", "hi", "lo")]
            columns += [pa.array(np.bincount(rows, minlength=n) > 0), pa.array([x.tobytes() for x in places], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hi", "lo", "worded", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *text_keys()).mapInArrow(run, f"doc_id {kind}, hi long, lo long, worded boolean, places binary")


#: A row's text and id.  Joining and de-duplicating by the same columns takes one shuffle of the texts.
_KEY = ["hi", "lo", "doc", "no_doc"]


def _doc_key() -> list[Column]:
    """doc_id as columns without nulls."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("doc_id").isNull().alias("no_doc")]


def _bands(texts: DataFrame) -> DataFrame:
    """id, bucket for each band of each text: four places of 16 bits make a bucket's number."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in frames:
            places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint64).reshape(-1, BANDS)
            ids = np.repeat(batch.column("id").to_numpy(), BANDS)
            buckets = mix(places ^ salts).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(buckets)], names=["id", "bucket"])

    return texts.where("worded").select("id", "places").mapInArrow(run, "id long, bucket long")


def _multisets(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    flat, bounds = text_bytes(pa.array(texts, pa.large_string()))
    rows, hashes, counts = shingles(flat, bounds)
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [(hashes[lo:hi], counts[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                batch = frame.slice(at, 256)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                known = dict(zip(a + b, batch.column("a_text").to_pylist() + batch.column("b_text").to_pylist(), strict=True))
                sets = dict(zip(known, _multisets(list(known.values())), strict=True))
                good = [i for i in range(len(a)) if similarity(sets[a[i]], sets[b[i]]) >= threshold]
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(end), F.col("text").alias(f"{end}_text")), end)
    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def _forest(ids: np.ndarray, classes: np.ndarray, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that join classes not joined by earlier ones."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    kept = []
    for i, j in links:
        a, b = root(int(classes[i])), root(int(classes[j]))
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append((int(ids[i]), int(ids[j])))
    return kept


def _across(table: pa.Table, threshold: float, agreement: float) -> pa.Table:
    """Links between the classes of two blocks: candidate pairs compared exactly."""
    table = table.sort_by("id")
    ids, classes = table.column("id").to_numpy(), table.column("class").to_numpy()
    block, pair = table.column("block").to_numpy(), (table.column("low")[0].as_py(), table.column("high")[0].as_py())
    places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint16).reshape(-1, PLACES)
    bands = places.view(np.uint64)
    sets = _multisets(table.column("text").to_pylist())
    vocabulary, local = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    sizes = np.array([len(h) for h, _ in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.concatenate([c for _, c in sets])
    totals = np.array([c.sum() for _, c in sets])
    own, links = np.zeros(len(vocabulary), np.int64), []
    left = np.flatnonzero(block == pair[0])
    right = np.flatnonzero(block == pair[1])
    for i in left.tolist():
        others = right[right > i] if pair[0] == pair[1] else right
        others = others[classes[others] != classes[i]]
        others = others[(bands[others] == bands[i]).any(axis=1)]
        others = others[(places[others] == places[i]).mean(axis=1) >= agreement]
        if not len(others):
            continue
        mine = local[starts[i] : starts[i + 1]]
        own[mine] = counts[starts[i] : starts[i + 1]]
        at = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in others.tolist()])
        shared = np.add.reduceat(np.minimum(own[local[at]], counts[at]), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        own[mine] = 0
        same = shared / (totals[i] + totals[others] - shared)
        links += [(i, j) for j in others[same >= threshold].tolist()]
    kept = _forest(ids, classes, links)
    return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})


def near_duplicates(
    docs: DataFrame, *, threshold: float = 0.8, agreement: float = 0.6, block: int = 64
) -> tuple[Workspace, DataFrame]:
    """doc_id, hi, lo (the text's key) and class (a number) for every row; the workspace still holds the tables.

    Two texts are linked if the weighted Jaccard similarity of their multisets of five-word shingles is at
    least ``threshold``; classes are the connected components of the links.  A text of fewer words is one
    shingle.  A text without words, a null one included (it counts as empty), is only like its exact copies.
    Repeated rows are copies.  Candidates are pairs that share one of 32 bands of 4 places (at a similarity
    of 0.8 a pair is missed with a probability of 5e-8) and, in blocks, agree on ``agreement`` of the 128 places
    (5 standard deviations below 0.8).  There is no cap on buckets, candidates or links.
    """
    work = Workspace(docs.sparkSession, "neardup")
    sketches = work.settle(_sketches(docs), "sketches")
    texts = work.settle(
        sketches.groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("doc_id"), F.first("worded").alias("worded"), F.first("places").alias("places"))
        .withColumn("id", F.monotonically_increasing_id()),
        "texts",
    )
    bands = _bands(texts)
    sizes = work.settle(bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    counts, total = sizes.withColumnRenamed("members", "n"), BANDS * texts.where("worded").count()
    of_bucket = lambda rows, values: look_up(rows, values, counts, "bucket", total, F.col("id"))
    members = work.settle(of_bucket(bands, sizes).where("members is not null"), "members")
    # The member that meets most others is compared with everyone else in its bucket.
    degrees = members.groupBy("id").agg(F.sum("members").alias("degree"))
    centre = (
        members.select("id", "bucket").join(degrees, "id")
        .groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("best"))
        .select("bucket", (-F.col("best.id")).alias("centre"))
    )
    a, b = F.least("id", "centre"), F.greatest("id", "centre")
    centre = work.settle(centre, "centre")
    star = of_bucket(members, centre).where("id <> centre").select(a.alias("a"), b.alias("b")).distinct()
    # Whole texts of the members: of each text, the row with the smallest doc_id.
    wanted = members.select("id").distinct().join(texts.select("id", *_KEY[:2], *_doc_key()), "id")
    bodies = docs.select("text", *text_keys(), *_doc_key()).join(wanted, _KEY).dropDuplicates(_KEY)
    bodies = work.settle(bodies.select("id", "text"), "bodies")
    links = work.settle(_verify(star, bodies, threshold), "links")
    joined = components(work, links, "star")
    # Buckets that still hold different classes; of two members the star has compared both.
    labelled = members.join(joined, members["id"] == joined["node"], "left").select(
        "bucket", "id", "members", F.coalesce("root", "id").alias("class")
    )
    mixed = (
        labelled.where("members > 2").groupBy("bucket")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("id").alias("first")).where("low <> high")
    )
    rest = work.settle(labelled.join(mixed.select("bucket", "first"), "bucket").select("bucket", "id", "class", "first"), "rest")
    if not rest.isEmpty():
        # Texts that may meet in a bucket are one region; its texts are dealt into blocks, and blocks meet in pairs.
        regions = components(work, rest.select(F.col("first").alias("a"), F.col("id").alias("b")), "region")
        inside = rest.select("id", "class").distinct().join(regions.withColumnRenamed("node", "id"), "id")
        counts = inside.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = work.settle(
            inside.join(counts, "root")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .join(texts.select("id", "places"), "id")
            .join(bodies, "id"),
            "dealt",
        )
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "block", "id", "class", "places", "text",
        )
        more = met.groupBy("root", "low", "high").applyInArrow(lambda t: _across(t, threshold, agreement), "a long, b long")
        links = links.unionByName(work.settle(more, "more"))
        joined = components(work, links, "all")
    labels = texts.select("hi", "lo", "id").join(joined, texts["id"] == joined["node"], "left")
    labels = labels.select("hi", "lo", F.coalesce("root", "id").alias("class"))
    return work, sketches.select("doc_id", "hi", "lo").join(labels, ["hi", "lo"])


def duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size for every row.

    See ``near_duplicates``.  A class whose rows all lack an id has a null class_id.
    """
    work, classes = near_duplicates(docs, **options)
    classes = work.settle(classes, "classes")
    first = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return work.finish(classes.join(first, "class").select("doc_id", "class_id", "class_size"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest doc_id of each class, with all its columns; one of several equal rows."""
    work, classes = near_duplicates(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hi", "lo")).alias("first")
    chosen = work.settle(classes.groupBy("class").agg(first).select("first.doc_id", "first.hi", "first.lo"), "chosen")
    work.keep_only("chosen")
    names = {f"in_{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in names.items()], *text_keys(), *_doc_key())
    kept = rows.join(chosen.select(*_KEY[:2], *_doc_key()), _KEY, "left_semi").dropDuplicates(_KEY)
    return kept.select(*[F.col(name).alias(c) for name, c in names.items()])
