import collections
import math
import re
import zlib

import numpy as np
import pytest

from . import helpers as H
from jobtide.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of neutral sentences, of which the toxic ones hold one bad word."""
    random = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        parts = [" ".join(random.choice(vocabulary, 8)) for _ in range(4)]
        toxic = int(i % 4 == 0)
        if toxic:
            parts[i % 3] += " " + ["vileword", "vilewords", "grim"][i % 3]
        texts.append(". ".join(parts) + ".")
        labels.append((i, 1, toxic))
    return H.documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_words_are_found_and_located(spark, planted):
    docs, labels = planted
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).withColumn("held_out", toxicity.held_out()).join(labels.drop("quality"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == r.toxic == int(r.score >= 0.5), r
        assert len(r.offending) == r.toxic
        for span in r.offending:
            assert any(w in r.text[span.start : span.end] for w in ("vileword", "grim")) and "." not in r.text[span.start : span.end]


def cut(text):
    """(start, end, features) of each sentence with words, by regular expressions: words and their leading bytes by name."""
    out = []
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        found = list(H.WORD.finditer(m[0]))
        if found:
            names = set()
            for w in found:
                raw = H.lower(w[0]).encode()
                names |= {("word", raw), *((f"stem {n}", raw[:n]) for n in toxicity.STEMS)}
            out.append((m.start() + found[0].start(), m.start() + found[-1].end(), names))
    return out


def trained(docs, labels):
    """Weights by name and bias: the same learning written out, with one probability after another."""
    known = [(docs[i], t) for i, _, t in labels if i in docs and zlib.crc32(str(i).encode()) % 5]
    parts, toxic = [cut(t) for t, _ in known], [t for _, t in known]
    rate = sum(toxic) / len(toxic)
    seen, bad = collections.Counter(), collections.Counter()
    for own, t in zip(parts, toxic):
        for name in set().union(*(f for _, _, f in own)) if own else ():
            seen[name] += 1
            bad[name] += t
    wanted = [f for f, n in seen.items() if n >= 5 and (bad[f] - n * rate) / math.sqrt(n * rate * (1 - rate)) >= 5]
    w, bias, state = dict.fromkeys(wanted, 0.0), -6.0, {}
    for step in range(1, 301):
        slopes = dict.fromkeys([*wanted, None], 0.0)
        for own, t in zip(parts, toxic):
            some = [f & w.keys() for _, _, f in own if f & w.keys()]
            p = [1 / (1 + math.exp(-(bias + sum(w[x] for x in f)))) for f in some]
            whole = min(max(1 - math.prod(1 - x for x in p), 1e-6), 1 - 1e-6)
            for f, x in zip(some, p):
                slope = (-(1 - whole) / whole if t else 1.0) * x / len(parts)
                for name in [*f, None]:
                    slopes[name] += slope
        for name, g in slopes.items():
            g += 1e-5 * w[name] if name else 0
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = m, v
            move = 0.1 * (m / (1 - 0.9**step)) / (math.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if name:
                w[name] -= move
            else:
                bias -= move
    return w, bias


def test_equals_the_learning_written_out(spark, planted):
    docs, labels = planted
    texts = {r.doc_id: r.text for r in docs.collect()}
    w, bias = trained(texts, [tuple(r) for r in labels.collect()])
    model = toxicity.fit(docs, labels)
    assert len(model.weights) == len(w) and model.bias == pytest.approx(bias, abs=1e-6)
    assert np.sort(model.weights) == pytest.approx(sorted(w.values()), abs=1e-6)
    odd = ["vileword. grim. plain", "", None, "w1 w2? grim vilewords! w3", "é vileword"]
    frame = H.documents(spark, [*texts.values(), *odd])
    for row in toxicity.score_toxicity(frame, model).collect():
        clean, spans, most = 1.0, [], None
        for start, end, names in cut(row.text):
            some = names & w.keys()
            p = 1 / (1 + math.exp(-(bias + sum(w[x] for x in some)))) if some else 0
            if p >= toxicity.LEAST_EVIDENCE:
                clean *= 1 - p
                spans += [(start, end)] if p >= 0.5 else []
                most = max(most or (0,), (p, start, end))
        assert row.score == pytest.approx(1 - clean, abs=2e-6)
        if row.predicted and not spans:
            spans = [most[1:]]
        assert [(x.start, x.end) for x in row.offending] == spans


def test_length_alone_is_not_toxic(spark, tables):
    docs, labels = tables
    models = [toxicity.fit(docs, labels)]
    plain = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").limit(40).collect()]
    clean = ". ".join(plain)
    texts = ["One plain clean sentence. " * 200_000, clean, clean * 20]
    for model in models:
        rows = toxicity.score_toxicity(H.documents(spark, texts), model).collect()
        assert all(r.score < 0.5 and r.predicted == 0 and r.offending == [] for r in rows[:1])
        assert all(r.predicted == 0 or r.offending for r in rows)
        assert rows[1].score < 0.5 and rows[2].score < 0.5


def test_several_weak_sentences_name_the_strongest(spark):
    model = toxicity.SentenceModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    part = toxicity.sentences(np.frombuffer(b"weak", np.uint8), np.array([0, 4]))
    model.buckets, model.weights, model.bias = np.unique(part.features), np.full(len(np.unique(part.features)), 1e-9), -0.6
    rows = toxicity.score_toxicity(H.documents(spark, ["weak. other. weak. weak", "weak"]), model).orderBy("doc_id").collect()
    assert rows[0].predicted == 1 and len(rows[0].offending) == 3 and rows[1].predicted == 0 and rows[1].offending == []


def test_held_out_rows_are_not_learned_from(spark, planted):
    docs, labels = planted
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights)


def test_held_out_ranking_on_the_tables(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_toxicity(docs, model, ["doc_id"]).withColumn("held_out", toxicity.held_out()).join(labels, "doc_id").toPandas()
    held = scored[scored.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    assert not held[(held.predicted == 1) & (held.toxic == 0)].shape[0] > 2


def test_odd_rows_and_clashing_columns(spark, planted):
    model = toxicity.fit(*planted)
    texts = ["", None, "grim", "...", "word. " * 200_000, "é. ü vileword! ok"]
    docs = H.documents(spark, texts, schema=H.DOC + ", predicted string, offending int", extra=("x", 7))
    rows = toxicity.score_toxicity(docs, model).orderBy("doc_id").collect()
    assert [r.text for r in rows] == texts
    assert [r.score for r in rows][:2] == [0, 0] and rows[3].score == 0
    span = rows[5].offending[0]
    assert texts[5][span.start : span.end] == "ü vileword"


def test_without_labels_or_documents(spark, planted):
    docs, labels = planted
    for known in (labels.limit(0), labels.selectExpr("doc_id", "quality", "0 as toxic")):
        assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.fit(docs, known), ["doc_id"]).collect()} == {0}
    empty = H.documents(spark, [])
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels)).collect() == []
