import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from . import helpers as H
from jobtide.llm import decontaminate as D, fmindex, queries


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 4))
def test_index_finds_all_occurrences(runs, size):
    text = np.array([x for run in runs for x in [*run, 0]], np.int64)
    index = fmindex.FMIndex(text, 4, every=3)
    phrases = {tuple(text[i : i + size]) for i in range(len(text) - size + 1)} | {tuple([5] * 0 + [4] * size)}
    phrases = np.array(sorted(p for p in phrases if 0 not in p), np.int64).reshape(-1, size)
    low, high = index.search(phrases)
    for phrase, lo, hi in zip(phrases.tolist(), low.tolist(), high.tolist(), strict=True):
        want = [i for i in range(len(text) - size + 1) if text[i : i + size].tolist() == phrase]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def brute(text, items, window=13):
    own, hit, found = H.words(text), set(), set()
    for item, passage in items:
        theirs = H.words(passage)
        size = min(window, len(theirs))
        for i in range(len(theirs) - size + 1 if size else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == theirs[i : i + size]:
                    hit |= set(range(at, at + size))
                    found.add(item or "")
    return own, hit, sorted(found)


PASSAGE = " ".join(f"p{i}" for i in range(20))
ITEMS = [("b", PASSAGE), ("a", PASSAGE.upper().replace(" ", ", ")), ("c", "short phrase"), ("d", "..."), ("e", None), (None, "zeta eta theta"), ("b", "other entry of this id")]
TEXTS = [
    f"é before. {PASSAGE}! after", " ".join(PASSAGE.split()[3:16]), " ".join(PASSAGE.split()[3:15]), "a short; Phrase here", "", None, "...",
    f"{PASSAGE} {PASSAGE}", "w " * 400 + "short phrase", "p0 " * 50, "ZETA-eta 中 theta zeta eta theta", "x" * 70_000 + " short phrase", f"{PASSAGE} {PASSAGE}",
]


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs = H.documents(spark, TEXTS, schema=H.DOC + ", items string, n_hit int", extra=("i", 1))
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    for pairs in (100_000, 6, 1):
        rows = {r.doc_id: r for r in D.find_contamination(docs, bench, pairs_at_once=pairs).collect()}
        for i, text in enumerate(TEXTS):
            own, hit, found = brute(text, ITEMS)
            r = rows[i]
            assert (r.n_words, r.n_hit, r.items) == (len(own), len(hit), found), i
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(own))
            assert r.text == text
            covered = {w for s in r.hit_words for w in range(s.start, s.end)}
            assert covered == hit
            assert [w for s in r.spans for w in H.words(text[s.start : s.end])] == [own[w] for w in sorted(hit)]


def test_same_rows_as_sql(spark):
    docs, bench = H.documents(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id string, text string")
    path = __import__("tempfile").mkdtemp()
    docs.write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    df = queries.op9_benchmark_windows(spark, path)
    got, want = H.against_sql(spark, df, queries.OP9_SQL, documents=docs, benchmark=bench)
    assert got == want
    empty = hashlib.sha256(b"").hexdigest()
    assert df.where("n_items = 0").select("items_sha256").distinct().first()[0] == empty


def test_memory_does_not_grow_with_the_blocks(spark):
    """A benchmark of many blocks: what is broadcast, and what a stage holds, is one block."""
    import pickle

    random = np.random.default_rng(3)
    items = [(f"i{i}", " ".join(f"w{x}" for x in random.integers(0, 5000, 60))) for i in range(420)]
    items.append(("one long item", " ".join(f"v{x}" for x in random.integers(0, 9000, 3000))))
    bench = spark.createDataFrame(items, "item_id string, text string")
    pairs = D.phrase_pairs(bench).toArrow()
    assert len(pairs) == 420 * 48 + 2988
    whole, sent = len(pickle.dumps(D.phrases_of(pairs))), []
    original = spark.sparkContext.broadcast
    spark.sparkContext.broadcast = lambda value: (sent.append(len(pickle.dumps(value))), original(value))[1]
    try:
        docs = H.documents(spark, [items[7][1] + " tail", "nothing here", items[-1][1][500:2000], items[7][1] + " and " + items[300][1]])
        df = D.find_contamination(docs, bench, pairs_at_once=len(pairs) // 40 + 1)
    finally:
        del spark.sparkContext.broadcast
    assert len(sent) == 40 and max(sent) < whole / 12
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {r.doc_id: r for r in df.collect()}
    whole = {r.doc_id: r for r in D.find_contamination(docs, bench).collect()}
    assert rows == whole and rows[3].items == ["i300", "i7"] and rows[2].items == ["one long item"] and not rows[1].items


def test_empty_tables(spark):
    docs, bench = H.documents(spark, TEXTS), spark.createDataFrame([], "item_id string, text string")
    assert {(r.n_hit, r.contaminated) for r in D.find_contamination(docs, bench).collect()} == {(0, False)}
    assert D.find_contamination(H.documents(spark, []), spark.createDataFrame(ITEMS, "item_id string, text string")).collect() == []
