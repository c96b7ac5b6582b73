"""Exact top-k by inner product over norm buckets.

Vectors are turned to integers and grouped by length.  A query's k best among the longest vectors give a
score it must reach.  Against a bucket that score is a cosine threshold: if the bucket's longest vector
cannot reach it the bucket is skipped; if the threshold is low the bucket is cut off where its vectors get too
short; if it is high, vectors are ruled out by the range that single coordinates of a vector so close
in direction must lie in.  What is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .workspace import Workspace

SCALE = 256
_ROOM = 1e-9  # relative slack of the pruning bounds, far above rounding


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(SCALE * x) as doubles, which hold these whole numbers exactly, in bytes) and norm; rows without
    id or with bad components are left out."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            good, parts = [], []
            for row, value in enumerate(batch.column(1)):
                found = value.as_py() if value.is_valid else None
                if found is not None and not any(x is None for x in found):
                    found = np.array(found, np.float64)
                    if np.isfinite(found).all():
                        good.append(row)
                        parts.append(np.floor(found * SCALE))
            norms = [float(np.sqrt((x**2).sum())) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(good, pa.int64())),
                    pa.array([x.tobytes() for x in parts], pa.binary()),
                    pa.array(norms, pa.float64()),
                ],
                names=["vec_id", "v", "norm"],
            )

    source = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    return source.mapInArrow(run, "vec_id long, v binary, norm double")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact products of whole numbers, none of which is larger than ``largest``: in floating point or 64 bits while
    every partial sum fits, else in Python's integers."""
    if largest < 2.0**52:
        return (a @ b.T).astype(np.int64)
    if largest < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object).dot(whole(b).astype(object).T)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: score falls, then id rises."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (query[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


LOWEST = -(2**63)


def _long(scores: np.ndarray, query: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers.  One that is too large is among the best, whatever the other blocks hold, and is
    named; one that is too low becomes the lowest number, and matters only if it stays among the best."""
    if scores.dtype == object:
        for score, q, v in zip(scores.tolist(), query.tolist(), ids.tolist(), strict=True):
            if score >= 2**63:
                raise OverflowError(f"the product of vec_id {q} and vec_id {v} does not fit in 64 bits: {score}")
        scores = np.array([max(x, LOWEST) for x in scores.tolist()], np.int64)
    return scores


def _survivors(q: np.ndarray, q_norm: float, least: float, v: np.ndarray, norms: np.ndarray, local: float, focus: int) -> np.ndarray:
    """Rows of a bucket (norms falling) that may reach the product ``least`` with q."""
    if q_norm == 0 or least <= 0:
        return np.arange(len(v))  # any product may do
    # Length: |v| >= least / |q|.
    cut = int(np.searchsorted(-norms, -least / q_norm * (1 - _ROOM), side="right"))
    threshold = least / (q_norm * norms[0])
    if threshold < local or threshold > 1:
        return np.arange(cut)
    # Coordinates: a unit vector at a cosine of at least t to q has coordinate f within
    # t q_f -+ sqrt((1 - t^2)(1 - q_f^2)), widened at the ends where the bound turns.
    rows, unit = np.arange(cut), q / q_norm
    for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
        size = abs(unit[f])
        spread = np.sqrt(max(0.0, 1 - threshold**2) * max(0.0, 1 - size**2))
        low = threshold * size - spread
        high = 1.0 if size >= threshold else threshold * size + spread
        along = np.sign(unit[f]) * v[rows, f] / np.maximum(norms[rows], 1e-300)
        rows = rows[(along >= low - 1e-9) & (along <= high + 1e-9)]
    return rows


def top_products(
    vectors: DataFrame,
    *,
    query_every: int = 50,
    k: int = 5,
    seeds: int = 1024,
    block: int = 2048,
    query_block: int = 512,
    local_threshold: float = 0.3,
    focus: int = 4,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer products, ties to the smaller id.

    Queries are the vectors whose id ``query_every`` divides.  All other vectors are candidates; a query
    does not meet vectors of its own id, and a repeated row (same id, same vector) counts once.  Vectors that
    are null or hold null or non-finite components, and rows without id, take no part; all others must
    have one length, else ValueError says so before any product.  An empty table gives no rows.  Products are
    exact however large; a score among the ``k`` best that does not fit in 64 bits raises an error with its ids.

    The only broadcasts are ``seeds`` vectors and the bucket table (at most 8 buckets for each doubling of the
    length, so about 16,000 rows for any doubles).  Work goes by (block of queries, block of a bucket).
    """
    work = Workspace(vectors.sparkSession, "topk")
    spark = vectors.sparkSession
    own = work.settle(
        integer_vectors(vectors).dropDuplicates(["vec_id", "v"])
        .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 8)).otherwise(-100_000).cast("int")),
        "vectors",
    )
    shape = own.agg(F.min(F.octet_length("v") / 8).alias("least"), F.max(F.octet_length("v") / 8).alias("most")).first()
    if shape["least"] != shape["most"]:
        work.drop()
        raise ValueError(f"vectors of different lengths: {shape['least']:.0f} to {shape['most']:.0f} components")
    is_query = F.col("vec_id") % query_every == 0
    # One row for each bucket; its vectors are dealt into blocks.
    buckets = own.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("norm").alias("longest"))
    buckets = work.settle(buckets.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")), "buckets")
    known = buckets.select("bucket", "longest").toArrow()
    reach = spark.sparkContext.broadcast((known.column("bucket").to_numpy(), known.column("longest").to_numpy()))
    # Seeds: the longest vectors. Each query's k-th best product with them must be reached.
    longest = own.orderBy(F.desc("norm"), "vec_id", "v").limit(seeds).select("vec_id", "v", "norm").toArrow()
    lead = _matrix(longest.column("v")) if len(longest) else None
    seed = spark.sparkContext.broadcast(
        (longest.column("vec_id").to_numpy(), lead, max(longest.column("norm").to_pylist(), default=0.0))
    )

    def thresholds(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The product each query must reach, and the buckets that can reach it."""
        (ids, matrix, largest), (numbers, lengths) = seed.value, reach.value
        for batch in frames:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, norms = _matrix(part.column("v")), part.column("norm").to_numpy()
                scores = _products(q, matrix, largest * norms.max()).astype(float)
                scores[part.column("vec_id").to_numpy()[:, None] == ids[None, :]] = -np.inf
                least = np.full(len(q), -np.inf)
                if scores.shape[1] >= k:
                    least = np.partition(scores, -k, axis=1)[:, -k]
                    least -= np.abs(least) * 1e-12  # a large product was rounded above
                useful = [numbers[(least[i] <= 0) | (norms[i] * lengths * (1 + _ROOM) >= least[i])] for i in range(len(q))]
                columns = [*part.columns, pa.array(least), pa.array(useful, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "norm", "least", "buckets"])

    kinds = "vec_id long, v binary, norm double, least double, buckets array<int>"
    queries = own.where(is_query).select("vec_id", "v", "norm").mapInArrow(thresholds, kinds)
    q_blocks = max(1, -(-own.where(is_query).count() // query_block))
    asked = (
        queries.withColumn("bucket", F.explode("buckets"))
        .join(F.broadcast(buckets.select("bucket", "blocks")), "bucket")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
        .select("q_block", "bucket", "part", "vec_id", "v", "norm", "least")
    )
    asked = work.settle(asked, "asked")
    wanted = asked.select("q_block", "bucket", "part").distinct()
    offered = (
        own.join(F.broadcast(buckets.select("bucket", "blocks")), "bucket")
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
        .join(wanted, ["bucket", "part"])
        .select(*[F.col(c).alias(c) for c in ("q_block", "bucket", "part", "vec_id", "v", "norm")])
    )

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({name: pa.array([], pa.int64()) for name in ("query_id", "vec_id", "score")})
        right = right.sort_by([("norm", "descending"), ("vec_id", "ascending")])
        q_ids, q, q_norms = left.column("vec_id").to_numpy(), _matrix(left.column("v")), left.column("norm").to_numpy()
        least = left.column("least").to_numpy()
        ids, v, norms = right.column("vec_id").to_numpy(), _matrix(right.column("v")), right.column("norm").to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            rows = _survivors(q[i], q_norms[i], least[i], v, norms, local_threshold, focus)
            rows = rows[ids[rows] != q_ids[i]]
            scores = _products(q[i : i + 1], v[rows], q_norms[i] * norms[0])[0]
            rows, scores = rows[scores >= least[i]], scores[scores >= least[i]]
            if len(rows) > 4 * k:  # far fewer are needed; equal scores stay together
                bar = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, -k)[-k]
                rows, scores = rows[scores >= bar], scores[scores >= bar]
            found.append((np.full(len(rows), i), ids[rows], scores))
        query, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
        best = _best(query, vec, score, k)
        query, vec = q_ids[query[best]], vec[best]
        return pa.table({"query_id": pa.array(query), "vec_id": pa.array(vec), "score": pa.array(_long(score[best], query, vec))})

    keys = ["q_block", "bucket", "part"]
    met = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(verify, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    named = F.concat(F.lit("the product of vec_id "), "query_id", F.lit(" and vec_id "), "vec_id", F.lit(" does not fit in 64 bits"))
    score = F.when(F.col("score") == LOWEST, F.raise_error(named).cast("long")).otherwise(F.col("score"))
    return work.finish(best.select("query_id", "rank", "vec_id", score.alias("score")))
