import os
import subprocess
import sys

import corpus_pipeline as C
import numpy as np
import pytest
import __spark_entry__ as entry

from pyspark.sql import functions as F

from . import helpers as H
from jobtide.llm import lines, packing, quality, queries

LABELS = "/root/testdata/sf0.01"
#: Names that operators use for their own columns, and odd ones.
CLASHING = ["score", "Predicted", "n_lines", "n_dropped", "n_words", "n_hit", "items", "hit_words", "spans", "contaminated", "hi", "lo", "gone", "a.b", "tick`s", "with space", "_items", "in_0"]


def test_registered():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES) and [n for n, _ in C.STAGES] == ["quality", "line dedup", "near-duplicates", "decontamination", "packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted cases, and the real labelled documents to learn from."""
    path = str(tmp_path_factory.mktemp("tables"))
    real = spark.read.parquet(f"{LABELS}/documents.parquet")
    bench = spark.read.parquet(f"{LABELS}/benchmark.parquet")
    random = np.random.default_rng(8)
    model = quality.fit(real, spark.read.parquet(f"{LABELS}/labels.parquet"))
    good = quality.score_quality(real, model).where("lang = 'en' and predicted = 1 and n_chars between 1500 and 2500").orderBy("doc_id").limit(6).collect()
    base = [w for r in good for w in r.text.split(" ")]
    near = " ".join(base[:130])
    variant = near + " changed here"
    passage = bench.orderBy("item_id").first().text
    extra = [near, near, variant, f"{passage} {' '.join(base[300:330])}", "", None, "", " ".join(base[600:720])]
    rows = [(10_000 + i, t, "en", "planted", None if t is None else len(t)) for i, t in enumerate(extra)]
    rows += [(20_000 + i, f"Shared footer 12{i} of the site\n" + " ".join(random.permutation(base)[:80]), "en", "planted", 0) for i in range(10)]
    docs = real.unionByName(spark.createDataFrame(rows, real.schema)).withColumn("extra", F.lit(1))
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{LABELS}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_every_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for number, (_, stage) in enumerate(C.STAGES):
        stage(spark, frames[-1], folder).write.parquet(f"{tmp_path}/{number}")
        frames.append(spark.read.parquet(f"{tmp_path}/{number}"))
        if number < 4:
            assert frames[-1].columns == docs.columns
            for place, name in enumerate(docs.columns):
                if name in CLASHING:
                    assert all(r[place] == f"{name} of {r[0]}" for r in frames[-1].collect()), (number, name)
    start, good, cleaned, single, clean, packed = ([tuple(r) for r in f.collect()] for f in frames)
    key = lambda r: str(r)
    # Quality: exactly the documents whose nearest labelled vectors, one product after the other, vote 0.7.
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    vectors, near = model.vectors.astype(np.int64), model.neighbours

    def vote(text):
        raw = (text or "").encode()
        own = model.place(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].astype(np.int64)
        products = (vectors * own).sum(1).tolist()
        first = sorted(range(len(products)), key=lambda i: (-products[i], i))[:near]
        votes = [max(products[i] / quality.GRID**2, 0) ** model.sharpness for i in first]
        return (sum(v * model.labels[i] for v, i in zip(votes, first)) + 0.5 * model.labels.mean()) / (sum(votes) + 0.5)

    assert sorted(good, key=key) == sorted((r for r in start if round(vote(r[1]), 6) >= 0.7), key=key)
    # Lines: the SQL form of the operator over what quality kept.
    got, want = H.against_sql(spark, frames[2].select("doc_id", "text"), f"SELECT doc_id, text FROM ({lines.lines_sql()})", documents=frames[1])
    assert got == want
    assert all(r[4] == len(r[1]) for r in cleaned if r[1] is not None and (r[0], r[1]) not in {(x[0], x[1]) for x in start})
    # Near-duplicates: one document of each brute-force class.
    classes = H.duplicate_classes([(r[0], r[1]) for r in cleaned])
    first = {}
    for position, top in classes.items():
        first[top] = min(first.get(top, cleaned[position][0]), cleaned[position][0])
    assert sorted(r[0] for r in single) == sorted(first.values())
    assert {10_000} == {r[0] for r in single} & {10_000, 10_001, 10_002}
    # Decontamination: the contract's rule.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for _, t in items for w in [H.words(t)] for i in range(len(w) - 12)}

    def contaminated(text):
        own, hit = H.words(text), set()
        for i in range(len(own) - 12):
            if tuple(own[i : i + 13]) in windows:
                hit |= set(range(i, i + 13))
        return bool(hit) and 20 * len(hit) >= len(own)

    assert sorted(clean, key=key) == sorted((r for r in single if not contaminated(r[1])), key=key)
    assert 10_003 not in {r[0] for r in clean} and 10_007 in {r[0] for r in clean}
    # Packing: every id of every document once, in sequences of at most 1024.
    tokeniser = packing.Tokeniser.get("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    lengths, used = {}, {}
    for doc_id, _, _, length, _, sequence, offset in packed:
        lengths[doc_id] = lengths.get(doc_id, 0) + length
        used.setdefault(sequence, []).append((offset, length))
    assert lengths == {r[0]: len(tokeniser.ids(r[1] or "")) + 1 for r in clean}
    for spans in used.values():
        ends = [a + b for a, b in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_run_and_empty_table(spark, folder, tmp_path):
    assert C.run(spark, folder).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_workers_find_the_package_from_any_folder(tmp_path):
    """The driver is started elsewhere and finds the package by its own path only."""
    code = f"""
import sys
sys.path.insert(0, {str(H.ROOT)!r})
import __spark_entry__ as entry
from jobtide.session import local_session
spark = local_session(2)
for name in ("op3_quality_votes", "op9_benchmark_windows", "op12_part_codes"):
    print(name, entry.queries()[name](spark, {H.SF!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == ["op3_quality_votes", "op9_benchmark_windows", "op12_part_codes"], done.stderr[-3000:]


def test_what_calls_leave_is_deleted_at_the_end(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(H.ROOT)!r})
import __spark_entry__ as entry
from jobtide.session import local_session
spark = local_session(2, **{{"spark.checkpoint.dir": {str(tmp_path / "shared")!r}}})
for name in ("op4_template_lines", "op8_bagminhash_classes", "op11_capture_transactions", "new_since_previous", "rebuilt_history"):
    print(name, entry.queries()[name](spark, {H.SF!r}).count())
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("\n") == 5, done.stderr[-3000:]
    assert not [p for p in (tmp_path / "shared").rglob("*.parquet")]
