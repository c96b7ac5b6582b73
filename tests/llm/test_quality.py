import zlib

import numpy as np
import pytest

from . import helpers as H
from jobtide.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_folds(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    scored = quality.score_quality(docs, model, ["doc_id"]).withColumn("held_out", quality.held_out()).join(labels, "doc_id").toPandas()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]).all()
    held = scored[scored.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((held.predicted == 1) == (held.score >= 0.7)).all()


def test_learning_never_sees_the_held_out_fold(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_votes_equal_brute_force(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, rows=200)
    # Twins of labelled vectors with the other label: every text near them meets ties.
    model.vectors, model.labels = np.vstack([model.vectors, model.vectors[::-1]]), np.append(model.labels, 1 - model.labels[::-1])
    some = docs.orderBy("doc_id").limit(40)
    got = {r.doc_id: r.score for r in quality.score_quality(some, model, ["doc_id"]).collect()}
    vectors = [[int(x) for x in v] for v in model.vectors]
    for row in some.collect():
        own = [int(x) for x in model.place(np.frombuffer(row.text.encode(), np.uint8), np.array([0, len(row.text.encode())]))[0]]
        products = [sum(a * b for a, b in zip(own, v)) for v in vectors]
        near = sorted(range(len(vectors)), key=lambda i: (-products[i], i))[: model.neighbours]
        votes = [max(products[i] / quality.GRID**2, 0) ** model.sharpness for i in near]
        want = (sum(v * model.labels[i] for v, i in zip(votes, near)) + 0.5 * model.labels.mean()) / (sum(votes) + 0.5)
        assert got[row.doc_id] == pytest.approx(want, abs=1e-6)


def test_a_score_is_its_rows_own(spark, tables):
    """The same in any company, in any batch."""
    docs, labels = tables
    model = quality.fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(300).collect()]
    flat, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    together = model.score(flat, bounds)
    alone = [model.score(flat[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds, bounds[1:])]
    assert together.tolist() == alone == model.score(flat, bounds, block=7).tolist()


def test_long_texts_are_learned_from_whole(spark):
    long = [" ".join(f"w{(i * j) % 97}" for j in range(6000)) + "." for i in range(1, 9)]
    docs = H.documents(spark, long)
    counts, known = quality._sample(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int"), 100)
    kept = [i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(known) == len(kept) and sorted(counts[:, quality.SHAPE_BUCKETS : quality.SHAPE_BUCKETS + quality.LENGTHS].__pow__(2).sum(1).round()) == [6000] * len(kept)


def test_odd_rows_and_clashing_columns(spark, tables):
    model = quality.fit(*tables)
    texts = ["", None, "word " * 300_000, "same", "same"]
    docs = H.documents(spark, texts, schema=H.DOC + ", score string, extra int", extra=("x", 7))
    rows = quality.score_quality(docs, model).orderBy("doc_id").collect()
    assert [r.text for r in rows] == texts and {r.extra for r in rows} == {7}
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[3].score == rows[4].score


def test_no_labels_and_no_documents(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in quality.score_quality(docs.limit(5), model, ["doc_id"]).collect()} == {(1.0, 1)}
    empty = H.documents(spark, [])
    assert quality.score_quality(empty, quality.fit(empty, labels)).collect() == []


def test_score_does_not_depend_on_neighbouring_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(quality, "_SEGMENT", 64)
    texts = ["Abc def! 12 " * 30, "x", "", "Zz || " * 50]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    together = quality._shapes(flat, bounds)
    for i, text in enumerate(texts):
        alone = quality._shapes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert np.array_equal(together[i], alone[0])
