import datetime as dt

import pytest
from .conftest import values

from jobtide import catalog
from jobtide.operators import quality
from jobtide.plans import health
from jobtide.schemas import REQUIRED_COLUMNS, struct

D = dt.date


def test_missing_columns_one_row_each(spark):
    got = quality.missing_columns(spark, "f", ["a", "z"], ["a", "b", "c"])
    assert values(got) == [("f", "b"), ("f", "c")]
    assert quality.missing_columns(spark, "f", ["a", "extra"], ["a"]).count() == 0
    assert len(REQUIRED_COLUMNS["district_context"]) == 25 and len(REQUIRED_COLUMNS["institution_context"]) == 22


def test_padding_reports_and_types(spark):
    df = spark.createDataFrame([("x",)], "a string")
    padded, report = quality.pad_columns(df, struct(a="s", b="x"), "f")
    assert padded.schema["b"].dataType.typeName() == "double" and padded.first() == ("x", None)
    assert values(report) == [("f", "b")]


def test_same_columns_or_error():
    quality.require_same_columns(struct(a="s", b="x"), struct(b="x", a="s"), "t")
    for other in (struct(a="s"), struct(a="s", b="x", c="s"), struct(a="s", b="s")):
        with pytest.raises(quality.QualityError, match="column mismatch"):
            quality.require_same_columns(struct(a="s", b="x"), other, "t")


def test_totals_against_parts(spark):
    parts = spark.createDataFrame([("c", "A", 2), ("c", "B", 3)], "cat string, e string, sum long")
    good = spark.createDataFrame([("c", 5)], "cat string, sum long")
    quality.require_totals_match(good, parts, ["cat"])
    with pytest.raises(quality.QualityError):
        quality.require_totals_match(spark.createDataFrame([("c", 999)], "cat string, sum long"), parts, ["cat"])
    lonely = spark.createDataFrame([("c", 5), ("d", 1)], "cat string, sum long")
    assert values(quality.total_mismatches(lonely, parts, ["cat"])) == [("d", 1, None)]
    assert values(quality.total_mismatches(good.filter("false"), parts, ["cat"])) == [("c", None, 5)]


def test_baseline_skips_old_dates_and_adds_no_zeros(spark):
    rows = [("a", D(2026, 8, 1))] * 9 + [("a", D(2026, 8, 6))] * 4 + [("a", D(2026, 8, 13))] * 6 + [("b", D(2026, 8, 13))]
    df = spark.createDataFrame(rows, "source string, Archive_Date date")
    got = quality.historical_counts(df, "source", valid_from=health.BASELINE_VALID_FROM)
    assert values(got, "name", "n_weeks", "mean_count") == [("a", 2, 5.0), ("b", 1, 1.0)]


def test_drift_flags(spark):
    baseline = spark.createDataFrame([("dead", 3, 10.0), ("low", 2, 20.0), ("fine", 2, 10.0), ("young", 1, 10.0)], "name string, n_weeks long, mean_count double")
    current = spark.createDataFrame([("low", 4), ("fine", 3)], "name string, count long")
    assert [(r["name"], r["count"]) for r in quality.drift_flags(current, baseline).collect()] == [("low", 4), ("dead", 0)]


def test_source_drift_and_page_signals(spark):
    rows = [("a", D(2026, 8, d)) for d in (6, 13) for _ in range(10)] + [("b", D(2026, 8, 20))]
    flagged = health.source_drift(spark.createDataFrame(rows, "source string, Archive_Date date"), "source")
    urls = spark.createDataFrame([("a", "u")], "name string, url string")
    pages = spark.createDataFrame([("u", "Apply now View details Job title")], "url string, text string")
    assert values(health.corroborated(flagged, urls, pages), "name", "count", "signal") == [("a", 0, "likely_broken")]
    report = health.health_report(drift=flagged)
    assert report.first().check == "drift" and '"name":"a"' in report.first().detail


def test_totals_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    write = lambda df, name: df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    # Added as doubles in this order, the prices of 2000 come to 613933.4999999999.
    prices = [(1, 2000, 331826.61), (1, 2000, 239681.31), (1, 2000, 42425.58), (1, 1999, 100000.0)]
    prices += [(c, y, 1000.0) for c in (2, 3, 4) for y in (1999, 2000)]
    write(spark.createDataFrame([(c, dt.datetime(y, 6, 1), p) for c, y, p in prices], "o_custkey long, o_orderdate timestamp, o_totalprice double"), "orders")
    write(spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "user_id long, ts timestamp").selectExpr("*", "1L event_id", "'view' event_type", "1D value", "'{\"k\": 1}' props"), "events")
    write(spark.createDataFrame([(1, "u", "")], "page_id long, url string, html string"), "pages")
    write(spark.createDataFrame([(2, 5.0)], "c_custkey long, c_acctbal double"), "customer")
    report = catalog.QUERIES["health_report"](spark, str(tmp_path))
    assert values(report.filter("check = 'plausibility'"), "entity", "detail") == [("1", "100000.00 to 613934.00")]


def test_the_whole_report(spark):
    rows = [("a", D(2026, 8, d)) for d in (6, 13) for _ in range(10)] + [("b", D(2026, 8, 20))]
    snapshots = spark.createDataFrame(rows, "source string, Archive_Date date")
    urls = spark.createDataFrame([("a", "u")], "name string, url string")
    pages = spark.createDataFrame([("u", "Apply now View details Job title")], "url string, text string")
    df = spark.createDataFrame([("x", 1.0, None), ("y", None, 7.0), ("z", 99.0, 8.0), ("z", 99.0, 9.0)], "e string, v double, w double")
    prior = spark.createDataFrame([(n, 100.0) for n in "abcdef"], "name string, value double")
    now = spark.createDataFrame([(n, 100.0 + i) for i, n in enumerate("abcde")] + [("f", 200.0)], "name string, value double")
    report = health.source_health(
        health.source_checks(snapshots, "source", urls, pages), health.value_checks(df, "e", ["e", "v", "w"], {"v": (0.0, 10.0), "w": (0.0, 8.5)}, min_ok=4), health.salary_checks(now, prior)
    )
    assert values(report) == sorted([
        ("bounds", "v", "z", 99.0, "0.0 to 10.0"), ("bounds", "w", "z", 9.0, "0.0 to 8.5"), ("coverage", "v", None, 3.0, "at least 4"), ("coverage", "w", None, 3.0, "at least 4"),
        ("drift", "source", "a", 0.0, "mean 10.00"), ("page", "source", "a", 0.0, "likely_broken"), ("plausibility", "value", "f", 1.0, "100.00 to 200.00"),
    ], key=lambda t: [(v is None, str(v)) for v in t])
    assert health.value_checks(df.limit(0), "e", ["e"], {"v": (0.0, 1.0)}).count() == 0


def test_coverage_and_bounds(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 99.0)], "e string, v double")
    assert values(quality.coverage_gaps(df, ["v", "e"], 3)) == [("v", 3, 2)]
    assert quality.coverage_gaps(df, ["v"], 3, min_ok=2).count() == 0
    assert values(quality.out_of_bounds(df, "e", "v", 0.0, 10.0, "pay"), "entity", "value") == [("c", 99.0)]


def _pairs(spark, prior, current):
    make = lambda d: spark.createDataFrame(list(d.items()), "name string, value double")
    return values(quality.change_outliers(make(current), make(prior)), "name")


def test_only_the_true_outlier(spark):
    prior = {n: 100.0 for n in "abcdef"}
    current = {"a": 101.0, "b": 102.0, "c": 103.0, "d": 104.0, "e": 102.5, "f": 200.0}
    assert _pairs(spark, prior, current) == [("f",)]


def test_zero_spread_and_too_few(spark):
    prior = {n: 100.0 for n in "abcd"}
    assert _pairs(spark, prior, {"a": 100.0, "b": 100.0, "c": 100.0, "d": 140.0}) == [("d",)]
    assert _pairs(spark, {"a": 100.0, "b": 100.0}, {"a": 500.0, "b": 100.0}) == []
    assert _pairs(spark, prior, {n: 150.0 for n in "abcd"}) == [("a",), ("b",), ("c",), ("d",)]


def test_halving_and_encoding_and_crosswalk(spark):
    before = spark.createDataFrame([("k12", 10), ("he", 10)], "side string, n long")
    after = spark.createDataFrame([("k12", 5)], "side string, n long")
    assert values(quality.halved(before, after, "side")) == [("he", 10, 0)]
    with pytest.raises(quality.QualityError, match="half"):
        quality.require_not_halved(before, after, "side")
    titles = spark.createDataFrame([("ok",), ("bad �",)], "title string")
    assert quality.encoding_faults(titles, "title").count() == 1
    walk = spark.createDataFrame([("a",), ("x",)], "entity string")
    known = spark.createDataFrame([("a",), ("b",)], "entity string")
    assert values(quality.crosswalk_gaps(walk, known)) == [("b", "not mapped"), ("x", "not registered")]
