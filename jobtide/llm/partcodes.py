"""Codes for vectors: each of 16 parts becomes the number of the nearest entry of that part's codebook.

Vectors are dealt into blocks; each block has one metric tree per part (see ``anchors``), built once and used
in every round.  A round sends the codebooks to the blocks and gets back a count and a sum for each entry,
one row for each task and entry, so what is shuffled does not grow with the vectors.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import assign, build
from .spread import look_up
from .workspace import Workspace

SCALE = 256
#: Components below this keep squared distances of up to 128 components, and sums of 2^34 vectors, in 64 bits.
LARGEST = 1 << 27
WIDEST = 128


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (floor(SCALE * x)) of the vectors without null or non-finite components."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(F.col("embedding").isNotNull()).where(whole).select("vec_id", "label", scaled.alias("v"))


def _width(kept: DataFrame, parts: int) -> int:
    """Components per part, once the vectors are known to be of one usable shape."""
    size = F.size("v")
    seen = kept.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if seen["most"] is None:
        return 0
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors of different lengths: {seen['least']} to {seen['most']}")
    if seen["most"] % parts or seen["most"] // parts > WIDEST:
        raise ValueError(f"vectors of {seen['most']} components cannot be cut into {parts} parts of at most {WIDEST}")
    if seen["largest"] is not None and seen["largest"] >= LARGEST:
        raise ValueError(f"a component is {seen['largest']} when scaled; it must be below {LARGEST}")
    return seen["most"] // parts


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def _blocks(kept: DataFrame, parts: int, width: int, block: int) -> DataFrame:
    """One row per block: its ids and labels, its points and its trees."""
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                points = _matrix(part.column("v"), parts * width)
                trees = [pickle.dumps(build(points[:, p * width : (p + 1) * width])) for p in range(parts)]
                bounds = pa.array([0, len(points)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(bounds, part.column("vec_id")), pa.ListArray.from_arrays(bounds, part.column("label")),
                        pa.array([points.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary())),
                    ],
                    names=["vec_ids", "labels", "points", "trees"],
                )

    schema = f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, points binary, trees array<binary>"
    return kept.mapInArrow(run, schema)


def _read(batch: pa.RecordBatch, row: int, parts: int, width: int) -> Iterator[tuple[int, object, np.ndarray]]:
    """Each part's number, tree and points of a block."""
    points = np.frombuffer(batch.column("points")[row].as_py(), np.int32).astype(np.int64).reshape(-1, parts * width)
    for p, tree in enumerate(batch.column("trees")[row].as_py()):
        yield p, pickle.loads(tree), points[:, p * width : (p + 1) * width]


def _refit(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its points' mean, or as it was if it has none."""
    parts, entries, width = codebooks.shape
    shared = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in frames:
            for row in range(batch.num_rows):
                for p, tree, points in _read(batch, row, parts, width):
                    found = assign(tree, points, books[p])
                    counts[p] += found.counts
                    sums[p] += found.sums
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    found = blocks.select("points", "trees").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    whole = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "total"))
    whole = whole.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # One row for each component of the codebooks.
    fresh = codebooks.copy()
    for r in whole.collect():
        fresh[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return fresh


def _encode(blocks: DataFrame, kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts, _, width = codebooks.shape
    shared = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row in range(batch.num_rows):
                codes, error = [], 0
                for p, tree, points in _read(batch, row, parts, width):
                    chosen = assign(tree, points, shared.value[p]).entries
                    codes.append(chosen.astype(np.uint8))
                    error = error + ((points - shared.value[p][chosen]) ** 2).sum(1)
                texts = [x.tobytes().hex() for x in np.stack(codes, 1)]
                ids, labels = batch.column("vec_ids").slice(row, 1).flatten(), batch.column("labels").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return blocks.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, block: int = 2048
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error and label_error of every vector; the codebooks by part, entry and place).

    A codebook starts as that part of the ``entries`` (at most 256) vectors with the smallest vec_ids, of fewer if
    there are fewer.  Each round assigns every part to the nearest entry, ties to the lower one, and moves each
    entry to the floor of its points' mean; an entry without points stays.  code gives two hex digits per
    part; error is the squared distance to the entries, summed over the parts; label_error is the sum of
    error over all vectors with the same label, null being a label of its own.

    Vectors that are null or hold null or non-finite components are left out.  The others must have one length,
    which ``parts`` divides, and scaled components below LARGEST, else ValueError says so before any work.  A
    missing vec_id comes after all others; equal ids go by their components.  Repeated rows are vectors of their
    own.  Only vec_id, embedding and label are read.  An empty table gives no rows and no codebooks.

    Broadcast are the codebooks only: ``entries`` vectors.  A block is about 12 bytes for each component.
    """
    work = Workspace(vectors.sparkSession, "partcodes")
    kept = kept_vectors(vectors)
    width = _width(kept, parts)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not start:
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return work.finish(none.withColumn("label_error", F.col("error")).limit(0)), None
    codebooks = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    blocks = work.settle(_blocks(kept, parts, width, block), "blocks")
    for _ in range(rounds):
        codebooks = _refit(blocks, codebooks)
    coded = work.settle(_encode(blocks, kept, codebooks).withColumn("_key", F.to_json(F.struct("label"))), "coded")
    work.drop("blocks")
    labels = work.settle(coded.groupBy("_key").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    result = look_up(coded, labels.drop("n"), labels, "_key", coded.count(), F.xxhash64("vec_id", "code"))
    return work.finish(result.drop("_key")), codebooks


def codebooks_digest(codebooks: np.ndarray | None) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place, joined by commas."""
    numbers = [] if codebooks is None else codebooks.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same by comparing every part with every entry of its codebook."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT id, p.part, any_value(s) AS s, min({{'d': list_sum(list_transform(range(1, len(s) + 1), lambda i: (s[i] - c[i]) * (s[i] - c[i]))), 'entry': entry}}) AS near
  FROM p JOIN c{i} ON p.part = c{i}.part GROUP BY id, p.part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT part, entry, pos, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n
  FROM (SELECT part, near.entry AS entry, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS x FROM a{i}) GROUP BY part, entry, pos), n{i} AS (
  SELECT part, entry, list(CAST((total - ((total % n) + n) % n) / n AS BIGINT) ORDER BY pos) AS c FROM m{i} GROUP BY part, entry), c{i + 1} AS (
  SELECT c{i}.part, c{i}.entry, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} ON c{i}.part = n{i}.part AND c{i}.entry = n{i}.entry)""")
    last = ", ".join(steps)
    return f"""WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), w AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS id FROM v), p AS (
  SELECT id, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS s
  FROM (SELECT id, e, unnest(range(0, {parts})) AS part FROM w)), c0 AS (
  SELECT part, id - 1 AS entry, s AS c FROM p WHERE id <= {entries}), {last}, r AS (
  SELECT id, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{rounds} GROUP BY id), b AS (
  SELECT sha256(string_agg(x, ',' ORDER BY part, entry, pos)) AS books
  FROM (SELECT part, entry, unnest(range(1, len(c) + 1)) AS pos, CAST(unnest(c) AS VARCHAR) AS x FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256
FROM w JOIN r USING (id), b"""
