import pytest
from pyspark.sql import functions as F

from . import helpers as H
from jobtide.llm import neardup, spread


@pytest.mark.parametrize("kind", ["string", "long"])
def test_look_up_equals_a_join_and_spreads_hot_keys(spark, kind, monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 200)
    rows = [(i, 7 if i % 3 == 0 else None if i % 50 == 1 else i % 90, "x") for i in range(6000)]
    values = {k: (f"v{k}", k * 2 if k % 2 else None) for k in range(0, 90) if k % 10}
    left = spark.createDataFrame(rows, "id long, k long, other string").withColumn("k", F.col("k").cast(kind))
    right = spark.createDataFrame([(k, *v) for k, v in values.items()], "k long, a string, b long").withColumn("k", F.col("k").cast(kind))
    counts = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    found = spread.look_up(left, right, counts, "k", len(rows), F.col("id"))
    assert found.columns == ["id", "k", "other", "a", "b"]
    got = sorted(tuple(r) for r in found.select("id", "a", "b").collect())
    assert got == sorted((i, *values.get(k, (None, None))) for i, k, _ in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = spread.look_up(left, right, counts, "k", len(rows), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 1500, "a third of the rows have one key"


def test_hot_buckets_give_the_same_classes(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(80))
    texts = [f"{base} tail{i} {i}" for i in range(60)] + [f"{base[:-30]} other{i}" for i in range(20)] + ["alone a b c d e f"]
    docs = H.documents(spark, texts)
    plain = sorted(map(tuple, neardup.duplicate_classes(docs).select("doc_id", "class_id", "class_size").collect()))
    monkeypatch.setattr(spread, "HOT_ROWS", 3)
    assert sorted(map(tuple, neardup.duplicate_classes(docs).select("doc_id", "class_id", "class_size").collect())) == plain
    want = H.duplicate_classes(list(enumerate(texts)))
    assert [(i, want[i]) for i in range(len(texts))] == [(i, c) for i, c, _ in plain]
