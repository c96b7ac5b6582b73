"""Small fixtures and brute-force versions."""

import collections
import re
from pathlib import Path

import duckdb
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(lower(text or ""))


def documents(spark, texts, ids=None, schema=DOC, extra=()):
    """Rows of the documents table; ``texts`` may hold None."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, schema)


def multiset(text, size=5):
    own = words(text)
    if not own:
        return collections.Counter()
    return collections.Counter(tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1)))


def overlap(a, b):
    shared = sum(min(n, b[k]) for k, n in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def duplicate_classes(rows, threshold=0.8):
    """{position: smallest position of its class} by comparing all pairs of different texts."""
    texts = [t or "" for _, t in rows]
    sets = [multiset(t) for t in texts]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or (sets[i] and sets[j] and overlap(sets[i], sets[j]) >= threshold):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(rows))}


def against_sql(spark, df, sql, **tables):
    """Sorted rows of both sides; ``tables`` are DataFrames."""
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=key)
    return got, want


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


__all__ = [n for n in dir() if not n.startswith("_")] + ["Row"]
