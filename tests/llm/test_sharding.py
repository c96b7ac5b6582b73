import zlib

import pytest

from . import helpers as H
from jobtide.llm import sharding


def check(rows, texts_by_id, shards, tolerance):
    total = 0
    sizes, slots = {}, {}
    for r in rows:
        text = texts_by_id[r.doc_id]
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        total += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r.size for r in rows), default=0)
    bounds = 0
    for shard in range(shards - 1):
        bounds += sizes.get(shard, 0)
        assert abs(bounds - total * (shard + 1) / shards) <= max(tolerance * total / shards, largest)


def test_near_equal_bytes_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_by_bytes(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    check(rows, texts, 16, 0.0005)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_hot_copies_odd_and_repeated_rows(spark, shards):
    texts = ["hot text " * 20] * 700 + ["", None, "é" * 50_000] + [f"text {i} " * (i % 30) for i in range(1300)]
    ids = list(range(len(texts)))
    ids[:50] = [0] * 50  # repeated rows
    docs = H.documents(spark, texts, ids=ids, schema=H.DOC + ", key string, size int", extra=("k", 1))
    rows = sharding.shard_by_bytes(docs, shards=shards).collect()
    assert len(rows) == len(texts)
    check(rows, dict(zip(ids, texts, strict=True)), shards, 0.0005)


def test_equals_brute_force_in_any_files(spark, tmp_path):
    """Rows in key order, cut where the bytes before a cut are nearest to an equal share; slots are places in a shard."""
    texts = ["hot " * 9] * 900 + ["", None, "é" * 70_000] + [f"t{i} " * (i % 50) for i in range(2500)]
    ids = [None if i == 7 else i // 3 for i in range(len(texts))]  # rows alike in id and text among them
    docs = H.documents(spark, texts, ids=ids)
    tolerance, shards = 0.0005, 8
    rows = sorted((r.key, -1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in sharding.keyed_rows(docs).collect())
    assert len(rows) == len(texts) and len({r[0] for r in rows}) == len(rows)
    got = [tuple(r) for r in sharding.shard_by_bytes(docs, shards=shards, tolerance=tolerance).collect()]
    total, before = sum(r[3] for r in rows), [0]
    for r in rows:
        before.append(before[-1] + r[3])
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(shards)]
    cuts, at = [0], 0
    for shard in range(1, shards):
        at += sizes[shard - 1]
        wanted = total * shard / shards
        best = min(abs(b - wanted) for b in before)
        assert abs(at - wanted) <= best + tolerance * total / shards
        cuts.append(before.index(at))
    cuts.append(len(rows))
    want = [(r[1], r[3], r[2], s, i) for s in range(shards) for i, r in enumerate(rows[cuts[s] : cuts[s + 1]])]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    docs.repartition(7).write.parquet(f"{tmp_path}/other")
    again = sharding.shard_by_bytes(spark.read.parquet(f"{tmp_path}/other").repartition(3), shards=shards, tolerance=tolerance)
    assert sorted(map(str, again.collect())) == sorted(map(str, sharding.shard_by_bytes(docs, shards=shards, tolerance=tolerance).collect()))


def test_more_ranges_give_the_same_slots(spark):
    docs = H.documents(spark, [f"text {i} " * (i % 9) for i in range(6000)])
    few, many = (sorted(map(str, sharding.shard_by_bytes(docs, shards=4, cells=c, tolerance=0.001).collect())) for c in (8, 2000))
    assert few == many


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_AT_ONCE", 7)
    docs = H.documents(spark, ["same"] * 100 + ["one"], ids=[1] * 100 + [2])
    assert sharding.keyed_rows(docs).select("key").distinct().count() == 101
    rows = sharding.shard_by_bytes(docs, shards=4).collect()
    assert sorted(sum(r.shard == s for r in rows) for s in range(4)) == [25, 25, 25, 26]


def test_equal_texts_are_neighbours_and_order_is_by_key(spark):
    docs = H.documents(spark, [f"t{i % 40}" for i in range(400)])
    rows = sorted(sharding.shard_by_bytes(docs, shards=4).collect(), key=lambda r: (r.shard, r.slot))
    crcs = [r.text_crc32 for r in rows]
    assert sum(a != b for a, b in zip(crcs, crcs[1:], strict=False)) == 39


def test_small_tables(spark):
    assert sharding.shard_by_bytes(H.documents(spark, [])).collect() == []
    rows = sharding.shard_by_bytes(H.documents(spark, ["a", "bb"], ids=[None, 5])).collect()
    assert len(rows) == 2 and all(r.slot in (0, 1) for r in rows)
