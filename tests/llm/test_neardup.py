import numpy as np
import pytest

from . import helpers as H
from jobtide.llm import bagminhash, components, neardup
from jobtide.llm.workspace import Workspace


def test_signatures_are_unbiased():
    random = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        size = int(random.integers(1, 60))
        hashes = random.integers(1, 2**63, size, dtype=np.uint64)
        a = random.integers(0, 12, size)
        b = np.where(random.random(size) < 0.6, a, random.integers(0, 12, size))
        rows = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        places = bagminhash.compact(
            bagminhash.signatures(rows, np.concatenate([hashes[a > 0], hashes[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        )
        if a.any() and b.any():
            errors.append((places[0] == places[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5 + 1e-3


def test_similarity_of_multisets():
    a, b = "a b c d e a b c d e x y", "a b c d e a b c d e z"
    (x, y) = neardup._multisets([a, b])
    assert bagminhash.similarity(x, y) == pytest.approx(H.overlap(H.multiset(a), H.multiset(b)))


def near_copies(random, base, count, edits):
    out = []
    for _ in range(count):
        own = list(base)
        for at in random.choice(len(own), int(random.integers(0, edits + 1)), replace=False):
            own[at] = f"new{random.integers(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def fixture(spark):
    random = np.random.default_rng(2)
    word = lambda n: [f"v{random.integers(400)}" for _ in range(n)]
    texts = [" ".join(word(int(random.integers(1, 60)))) for _ in range(120)]
    for size, edits in ((60, 6), (150, 9), (300, 12), (25, 1)):
        texts += near_copies(random, word(size), 60, edits)
    texts += [texts[0]] * 30 + ["", None, "", "***", "***", "one", "One!", "one two", "the the the the the the the the " * 9, "the the the the the the the the " * 10]
    ids = [int(i) for i in random.permutation(len(texts))]
    ids[5] = None
    return texts, ids


def test_classes_equal_brute_force(spark, fixture):
    texts, ids = fixture
    docs = H.documents(spark, texts, ids=ids, schema=H.DOC + ", id int, hi int, first int, in_0 int", extra=(1, 2, 3, 4)).repartition(5)
    want_of = H.duplicate_classes(list(zip(ids, texts, strict=True)))
    members = {}
    for position, top in want_of.items():
        members.setdefault(top, []).append(ids[position])
    want = sorted(
        ((i, min((x for x in group if x is not None), default=None), len(group)) for group in members.values() for i in group),
        key=str,
    )
    for block in (8, 64):
        got = sorted((tuple(r) for r in neardup.duplicate_classes(docs, block=block).select("doc_id", "class_id", "class_size").collect()), key=str)
        assert got == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[1] for w in want}, key=str)


def test_blocks_find_links_that_the_centre_misses():
    """Of a-b-c only neighbours are similar enough; all three share buckets."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:180] + ["x"]), " ".join(["y"] + words[10:])]
    sets = neardup._multisets(texts)
    from jobtide.llm.words import text_bytes

    rows, hashes, counts = bagminhash.shingles(*text_bytes(pa.array(texts)))
    places = bagminhash.compact(bagminhash.signatures(rows, hashes, counts, 3))
    table = pa.table({
        "id": [1, 2, 3], "class": [1, 2, 3], "block": [0, 0, 1], "low": [0] * 3, "high": [1] * 3,
        "places": pa.array([p.tobytes() for p in places], pa.binary()), "text": texts,
    })
    links = neardup._across(table, 0.8, 0.0).to_pylist()
    assert [(x["a"], x["b"]) for x in links] == [(a, 3) for a in (1, 2) if bagminhash.similarity(sets[a - 1], sets[2]) >= 0.8]


def test_components(spark):
    random = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(100)]
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        if a != b:
            top[b] = a
    work = Workspace(spark, "test")
    got = {r.node: r.root for r in components.components(work, spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if x not in {y for e in edges for y in e}}
    assert components.components(work, spark.createDataFrame([], "a long, b long"), "none").collect() == []
    work.drop()


def test_empty_table(spark):
    empty = H.documents(spark, [])
    assert neardup.duplicate_classes(empty).collect() == [] and neardup.keep_one(empty).collect() == []
