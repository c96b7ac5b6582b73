import collections
import itertools
import re

import pytest

from . import helpers as H
from jobtide.llm import interaction, queries

LABELS = "doc_id long, quality int, toxic int"


def masks(rows):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    for doc_id, text, lang in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > smallest[t],
        }
        yield doc_id, lang or "", {k for k, v in fails.items() if v}


def brute(rows, labels):
    out, credit = {}, collections.Counter()
    marked = list(masks(rows))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, fails) for i, p, fails in marked if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                failing = sum(letter in f for _, f in own)
                left = [(i, f) for i, f in left if letter not in f]
                credit[part, letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
    return sorted((*k, *v, credit[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, part string, mask int")
    return H.rows_of(interaction.audit(docs, spark.createDataFrame(labels, LABELS)), *interaction._NAMES)


def test_equals_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(230))
    texts = ["", None, "short text", long, long + " #", "SHOUT " * 300, "a b " * 150 + "é" * 50, "x\x0by\x0cz\r\n" * 80, long.upper(), "w " * 1000, "\x1fctrl " + long, "word " * 200_000]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(itertools.product(texts, ["en", "fr", None, ""]))]
    rows += [(1000 + i, long, ["en", "de"][i % 2]) for i in range(300)]  # a hot text
    rows += [(3, texts[3], "fr"), (None, long, "en"), (None, "", None), (rows[4][0], "", "en")]  # repeated, without id
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1300, 2)] + [(2, 1, None), (None, 1, 1), (4, None, 0)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_fields_do_not_run_over():
    most = 2**63 - 1
    total = sum(interaction.packed(m) * most for m in range(2)) + interaction.packed(31)
    counts = interaction.unpacked(total)
    for order, steps in zip(interaction.ORDERS, counts, strict=True):
        assert steps[order.index("A")] == most + (order[0] == "A")
        assert sum(steps) == most + 1


def test_without_rows_or_labels(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    rows = audited(spark, [(1, "a b", "en")], [])
    assert len(rows) == 600 and {r[7:9] for r in rows} == {(0, 0)}


@pytest.mark.parametrize("sf", [H.SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, sf):
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")}
    got, want = H.against_sql(spark, queries.op13_filter_interactions(spark, sf), interaction.audit_sql(), **tables)
    assert got == want and got
