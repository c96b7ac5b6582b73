import math

import numpy as np
import pytest

from . import helpers as H
from jobtide.llm import queries, topk

KIND = "vec_id long, embedding array<float>"


def brute(rows, every=50, k=5):
    own = {}
    for vec_id, x in rows:
        if vec_id is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own[vec_id, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    out = []
    for q, a in own:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for v, b in own if v != q)[:k]
        out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_equals_brute_force(spark, scale):
    random = np.random.default_rng(5)
    rows = [(i, (random.normal(size=12) * scale * random.gamma(2)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # a hot vector, ties
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 10), (2100, [math.nan] * 12), (2150, [math.inf] * 12), (None, [1.0] * 12), (2200, [0.0] * 12)]
    rows += [rows[0], rows[50]]  # repeated rows
    df = spark.createDataFrame(rows, KIND)
    got = H.rows_of(topk.top_products(df, block=64, query_block=4, seeds=100), "query_id", "rank", "vec_id", "score")
    assert got == brute(rows)
    assert H.rows_of(topk.top_products(df, block=64, seeds=3, local_threshold=0.0), "query_id", "rank", "vec_id", "score") == got


def test_extreme_values_and_few_rows(spark):
    rows = [(0, [3e6, -2e6]), (1, [1e6, 1e6]), (50, [0.001, -0.001])]
    df = spark.createDataFrame(rows, KIND)
    assert H.rows_of(topk.top_products(df), "query_id", "rank", "vec_id", "score") == brute(rows)
    assert topk.top_products(spark.createDataFrame([], KIND)).collect() == []
    assert topk.top_products(spark.createDataFrame([(50, [1.0])], KIND)).collect() == []


@pytest.mark.parametrize("size", [2e3, 3e7, 4e12, 1e17])
def test_large_components_are_exact_or_refused(spark, size):
    random = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=3) * size / 256]) for i in range(60)]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [-1.0, 0.0, 0.5])]  # short ones among the long ones
    df = spark.createDataFrame(rows, KIND)
    wanted = brute(rows)
    if max(abs(r[3]) for r in wanted) < 2**63:
        assert H.rows_of(topk.top_products(df, block=16, seeds=8), "query_id", "rank", "vec_id", "score") == wanted
    else:
        with pytest.raises(Exception, match="does not fit in 64 bits"):
            topk.top_products(df, block=16, seeds=8)
    assert size < 1e12 or max(abs(r[3]) for r in wanted) > 2**63


def test_a_product_that_is_too_low_matters_only_among_the_best(spark):
    rows = [(0, [1e8, 0.0]), (1, [-1e12, 0.0]), *((i, [0.0, float(i)]) for i in range(2, 7))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r[2] for r in H.rows_of(topk.top_products(df), "query_id", "rank", "vec_id", "score")]
    assert got == [2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="vec_id 0 and vec_id 1 does not fit"):
        topk.top_products(df.where("vec_id < 6"))


def test_vectors_of_different_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="different lengths: 1 to 2"):
        topk.top_products(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [None, 2.0, 3.0])], KIND))


def test_same_rows_as_sql(spark, tmp_path):
    """Also with rows that are there twice, and with two vectors under one id."""
    vectors = spark.read.parquet(f"{H.SF}/embeddings.parquet").select("vec_id", "embedding")
    again = vectors.where("vec_id < 60").unionByName(vectors.where("vec_id = 3").selectExpr("50L as vec_id", "embedding"))
    vectors.unionByName(again).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = H.against_sql(spark, queries.op7_norm_bucket_top5(spark, str(tmp_path)), queries.OP7_SQL, embeddings=vectors)
    assert got == want


def test_pruning_bounds_never_lose_a_row():
    random = np.random.default_rng(9)
    for _ in range(300):
        v = random.integers(-300, 300, (80, 6))
        v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
        norms, q = np.linalg.norm(v, axis=1), random.integers(-300, 300, 6)
        scores = v @ q
        least = float(np.sort(scores)[-random.integers(1, 30)])
        rows = topk._survivors(q, float(np.linalg.norm(q)), least, v, norms, 0.1, 4)
        assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
