"""Every registered query against its SQL counterpart on the smallest tables."""

import datetime
from decimal import Decimal

import duckdb
import pytest

from jobtide import catalog

SIZES = {size: f"/root/testdata/{size}" for size in ("sf0.001", "sf0.01")}
# What goes through a store or a stream is compared on the larger tables too: more dates, more cases.
STORED = [name for name, fn in catalog.QUERIES.items() if fn.__module__.endswith(".storage")] + [
    "append_refusals", "append_replaces_date", "incremental_equals_rebuild", "streamed_history", "health_report", "halving_guard", "crosswalk_gaps",
    "late_snapshot", "gap_fill", "robust_spread", "mad_outlier", "exact_median", "as_of_join", "identity_occurrence", "observed_checks",
]
CASES = [(name, "sf0.001") for name in catalog.QUERIES] + [(name, "sf0.01") for name in dict.fromkeys(STORED)]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


@pytest.fixture(scope="module")
def duck():
    connections = {}
    for size, folder in SIZES.items():
        connections[size] = duckdb.connect()
        for t in TABLES:
            connections[size].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connections


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize(("name", "size"), CASES)
def test_query_matches_sql(spark, duck, name, size):
    df = catalog.QUERIES[name](spark, SIZES[size])
    columns = sorted(df.columns)
    got = ordered(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalog.ORACLE:
        assert got
        return
    result = duck[size].execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = ordered(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert got == wanted
    assert got or size == "sf0.001", "a query that finds nothing proves nothing"
