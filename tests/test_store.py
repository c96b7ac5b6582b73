import datetime as dt
import re

import pytest
from .conftest import values
from pyspark.sql import functions as F

from jobtide import catalog
from jobtide.catalog import storage
from jobtide.operators import checks, newness, quality, trends
from jobtide.operators.asof import base_dates
from jobtide.operators.quality import QualityError
from jobtide.plans import higher_ed, k12, weekly
from jobtide.schemas import RAW_PAYLOAD, RUN_LOG, empty
from jobtide.sinks import changes, store
from jobtide.sources import files, shape, vintages
from jobtide.schemas import struct
from jobtide.streaming.snapshots import follow_snapshots

D = dt.date


def week(spark, day, *rows):
    return spark.createDataFrame([(d, day, n) for d, n in rows], "District string, Archive_Date date, n double")


def test_append_by_date(spark, tmp_path):
    path = str(tmp_path / "h")
    first = week(spark, D(2026, 8, 6), ("a", 1.0))
    assert store.append_by_date(first, path).count() == 1
    assert store.append_by_date(week(spark, D(2026, 8, 13), ("a", 2.0)), path).count() == 2
    again = store.append_by_date(week(spark, D(2026, 8, 13), ("a", 5.0), ("b", 6.0)), path)
    assert values(again, "District", "n") == [("a", 1.0), ("a", 5.0), ("b", 6.0)]
    assert store.append_by_date(first.filter("false"), path).count() == 3
    assert store.append_by_date(first.filter("false"), str(tmp_path / "none")).count() == 0
    with pytest.raises(QualityError, match="exactly one"):
        store.append_by_date(first.unionByName(week(spark, D(2026, 8, 20), ("a", 1.0))), path)
    for other in (first.withColumn("extra", F.lit(1)), first.withColumn("n", F.col("n").cast("string"))):
        with pytest.raises(QualityError, match="column mismatch"):
            store.append_by_date(other, path)
    assert store.read_history(spark, path).count() == 3
    assert values(store.replaced(first, week(spark, D(2026, 8, 6), ("z", 9.0))), "District") == [("z",)]


def salaries(spark, *rows):
    return spark.createDataFrame(
        [(d, y, 10.0, 1.0, 2.0, 3.0) for d, y in rows],
        "District string, Salary_Year string, Teacher_Count double, Teacher_Salary_10th_Pctile double, "
        "Teacher_Avg_Salary double, Teacher_Salary_90th_Pctile double",
    )


def test_year_archive(spark, tmp_path):
    path = str(tmp_path / "s")
    partial = salaries(spark, ("a", "2023-24"), ("a", "2023-24"))
    assert store.archive_year_snapshot(partial, path) is True
    assert store.archive_year_snapshot(partial, path) is False
    assert store.archive_year_snapshot(salaries(spark, ("a", "2023-24"), ("b", "2023-24")), path) is True
    assert store.archive_year_snapshot(salaries(spark, ("a", "2024-25")), path) is True
    assert store.archive_year_snapshot(salaries(spark, ("a", "2025-26"), ("b", "2026-27")), path) is False
    kept = store.read_history(spark, path)
    assert values(kept, "District", "Salary_Year") == [("a", "2023-24"), ("a", "2024-25"), ("b", "2023-24")]


def test_complete_rows_come_first(spark):
    snapshot = spark.createDataFrame([("a", "2024", None, 9.0), ("a", "2024", 5.0, 1.0), ("b", "2024", 2.0, 3.0), ("b", "2024", 1.0, 4.0)], "District string, Salary_Year string, x double, file double")
    assert values(store.missing_year_rows(snapshot.limit(0), snapshot)) == [("a", "2024", 5.0, 1.0), ("b", "2024", 1.0, 4.0)]
    assert values(store.missing_year_rows(snapshot.limit(0), snapshot, order="file"), "District", "file") == [("a", 1.0), ("b", 3.0)]


def test_overwriting_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    store.overwrite_table(spark.read.parquet(path).filter("id > 0"), path)
    assert values(store.read_history(spark, path)) == [(1,), (2,)]


def test_run_log_and_audit(spark, tmp_path):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    rows = spark.createDataFrame([("a",), ("a",)], "source string")
    failures = spark.createDataFrame([("c", "timed out")], "source string, error_message string")
    audit = shape.ingest_audit(expected, rows, failures)
    assert values(audit) == [("a", "ok", 2, None), ("b", "empty", 0, None), ("c", "error", 0, "timed out")]
    for _ in range(2):
        store.append_log(audit, str(tmp_path / "log"), dt.datetime(2026, 8, 6, 1, 2, 3))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_csv_round_trip_and_export(spark, tmp_path):
    schema = struct(a="s", n="x", d="d")
    df = spark.createDataFrame([('say "hi", twice', 1.5, D(2026, 8, 6)), (None, None, None)], schema)
    store.export_csv(df, str(tmp_path / "out"))
    assert values(files.read_table_csv(spark, str(tmp_path / "out"), schema)) == values(df)


def test_snapshot_files_with_different_columns(spark, tmp_path):
    tmp_path = tmp_path / "the archive"
    tmp_path.mkdir()
    (tmp_path / "combined_1.csv").write_text('"X","title","Archive_Date"\n1,"Math, HS","8/6/2026"\n')
    (tmp_path / "combined_2.csv").write_text('"title","Archive_Date","url"\n"Art","2026-08-13",NA\n')
    got = files.read_snapshot_csvs(spark, str(tmp_path))
    assert values(got, "title", "Archive_Date", "url") == [("Art", D(2026, 8, 13), None), ("Math, HS", D(2026, 8, 6), None)]
    assert "X" not in got.columns
    with pytest.raises(FileNotFoundError):
        files.read_snapshot_csvs(spark, str(tmp_path), "*.nope")


def test_only_the_first_lines_are_read_for_the_headers(spark, tmp_path):
    for i in range(12):
        names = "title,Archive_Date" if i % 3 else "Archive_Date,title,X"
        row = "t,2026-08-06" if i % 3 else "2026-08-06,t,1"
        (tmp_path / f"f{i}.csv").write_text("\n".join([names, *[row] * (40_000 if i == 5 else i)]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    found = files._headers(spark, str(tmp_path), "*.csv")
    assert {h: len(f) for h, f in found.items()} == {"title,Archive_Date": 8, "Archive_Date,title,X": 4}
    got = files.read_snapshot_csvs(spark, str(tmp_path))
    assert got.columns == ["title", "Archive_Date"] or set(got.columns) == {"title", "Archive_Date"}
    assert got.filter("title = 't' and Archive_Date = date'2026-08-06'").count() == got.count() == 40_000 + sum(range(12)) - 5
    schema = struct(title="s", Archive_Date="s")
    large = files.read_table_csv(spark, str(tmp_path / "f5.csv"), schema, line_breaks=False)
    assert large.count() == 40_000


def test_raw_bytes_survive_the_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'title,n\n"Math \x96 HS",1\n')
    lines = files.read_raw_lines(spark, str(tmp_path / "a.csv"))
    assert values(files.parse_csv_lines(lines, struct(title="s", n="n"))) == [("Math – HS", 1)]


def test_ledger_title_line(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Expenditures,,\nFundCode,DistrictName,SumOfAmount\n01,A,5\n1,B,7\n")
    ledger = files.read_ledger(spark, str(tmp_path / "l.csv"), struct(FundCode="s", DistrictName="s", SumOfAmount="s"))
    assert values(ledger) == [("01", "A", "5"), ("1", "B", "7")]


def test_vintages(spark):
    df = spark.createDataFrame([(2021,), (2023,), (2030,)], "year int")
    assert values(vintages.latest_vintage(df, 2026, 5)) == [(2023,)]
    assert vintages.latest_vintage(df, 2019, 5).count() == 0
    with pytest.raises(LookupError):
        vintages.latest_vintage(df, 2019, 5, required=True)


def test_empty_and_column_helpers(spark):
    assert empty(spark, RAW_PAYLOAD).columns == RAW_PAYLOAD.names
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert shape.drop_and_lead(df, ["b", "nope"], ["c"]).columns == ["c", "a"]


# -- repair, rebuild, stream -------------------------------------------------


def test_archive_repair_touches_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [("CafÃ©", "x", D(2026, 8, 6)), ("Plain", "y", D(2026, 8, 6)), ("Fine é", "z", D(2026, 8, 13))]
    store.write_snapshot(spark.createDataFrame(rows, "title string, url string, Archive_Date date"), path)
    untouched = sorted((tmp_path / "raw" / "Archive_Date=2026-08-13").iterdir())
    report = store.repair_archive(spark, path)
    assert values(report, "original", "repaired") == [("CafÃ©", "Café")]
    assert values(spark.read.parquet(path), "title")[0] == ("CafÃ©",)
    store.repair_archive(spark, path, apply=True)
    assert values(spark.read.parquet(path), "title") == [("Café",), ("Fine é",), ("Plain",)]
    assert sorted((tmp_path / "raw" / "Archive_Date=2026-08-13").iterdir()) == untouched
    assert store.repair_archive(spark, path).count() == 0


def k12_weeks(spark):
    def rows(day, n):
        titles = ["Math Teacher", "Art Teacher", "Cook", "Math Teacher", "SPED Teacher"]
        return [
            (titles[i % 5], f"School {i % 2}", D(2026, 8, 1), f"https://x.example/jobs/{i}" if i % 2 else None, f"D{i % 3}", "S", None, day, i)
            for i in range(n)
        ]

    schema = (
        "title string, location string, date_posted date, url string, District string, Posting_Source string, "
        "position string, Archive_Date date, seq long"
    )
    return [spark.createDataFrame(rows(day, n), schema) for day, n in ((D(2026, 8, 6), 12), (D(2026, 8, 7), 9), (D(2026, 8, 18), 20))]


TABLES = ("teacher_history", "district_totals", "category_counts")


def _paths(tmp_path, name):
    return {t: str(tmp_path / name / t) for t in TABLES}


def test_appends_equal_rebuild_equal_stream(spark, tmp_path):
    weeks = k12_weeks(spark)
    raw, appended = str(tmp_path / "raw"), _paths(tmp_path, "appended")
    for df in (weeks[0], weeks[1], weeks[1], weeks[2]):
        store.write_snapshot(df, raw)
        tables = k12.history_tables(df)
        for t, path in appended.items():
            store.append_by_date(tables[t], path)
    rebuilt = _paths(tmp_path, "rebuilt")
    store.rebuild(spark, raw, k12.history_tables, rebuilt)
    streamed = _paths(tmp_path, "streamed")
    schema = spark.read.parquet(raw).schema
    for state in ("one", "two"):  # a fresh checkpoint replays everything
        follow_snapshots(
            spark, raw, schema, k12.history_tables, streamed, str(tmp_path / state), files_per_batch=1, once=True
        ).awaitTermination()
    for t in TABLES:
        frames = [store.read_history(spark, p[t]) for p in (appended, rebuilt, streamed)]
        wanted = values(frames[0], *sorted(frames[0].columns))
        assert wanted and all(values(f, *sorted(f.columns)) == wanted for f in frames[1:]), t
    counts = store.read_history(spark, appended["category_counts"])
    assert counts.filter("District = 'Total'").agg(F.sum("sum")).first() == counts.filter("District <> 'Total'").agg(F.sum("sum")).first()


def test_a_rebuild_and_a_late_date_leave_nothing_behind(spark, tmp_path):
    weeks = k12_weeks(spark)
    raw, targets = str(tmp_path / "raw"), _paths(tmp_path, "t")
    for df in weeks:
        store.write_snapshot(df, raw)
    store.rebuild(spark, raw, k12.history_tables, targets)
    # The first date comes again and has no teacher left.
    late = weeks[0].filter("title = 'Cook'")
    store.write_snapshot(late, raw)
    follow_snapshots(spark, raw, spark.read.parquet(raw).schema, k12.history_tables, targets, str(tmp_path / "state"), once=True).awaitTermination()
    teachers = store.read_history(spark, targets["teacher_history"])
    assert values(teachers.select("Archive_Date").distinct()) == [(D(2026, 8, 7),), (D(2026, 8, 18),)]
    assert store.read_history(spark, targets["category_counts"]).filter("Archive_Date = '2026-08-06'").count() == 0
    # An archive without the other dates.
    only = str(tmp_path / "only")
    store.write_snapshot(weeks[2], only)
    store.rebuild(spark, only, k12.history_tables, targets)
    for path in targets.values():
        assert values(store.read_history(spark, path).select("Archive_Date").distinct()) == [(D(2026, 8, 18),)]


def test_each_title_is_classified_once(spark):
    weeks = k12_weeks(spark)
    both = weeks[0].unionByName(weeks[2]).withColumn("title", F.expr("case when seq = 4 then null when seq = 6 then 'Aide' else title end"))
    tables = k12.history_tables(both)
    # The tables read labels that were worked out before, title by title.
    for name in ("postings", "teacher_history"):
        assert "RLIKE" not in tables[name]._jdf.queryExecution().optimizedPlan().toString().upper(), name
    by_row = k12.current_postings(k12.identify(both))
    assert values(tables["postings"]) == values(by_row) and by_row.filter("title is null").count() == 2
    assert values(tables["teacher_history"]) == values(k12.teacher_rows(by_row)) and tables["teacher_history"].columns == k12.teacher_rows(by_row).columns
    assert values(tables["district_totals"]) == values(k12.district_totals(by_row))
    classes = values(k12.title_classes(by_row.select("title")))
    assert [c[0] for c in classes] == ["Aide", "Art Teacher", "Cook", "Math Teacher", "SPED Teacher", None]
    assert classes[2] == ("Cook", "Food Services", None, "Other") and classes[3] == ("Math Teacher", "Teacher", "Mathematics Education", "Math")


def test_totals_of_postings_without_a_district(spark):
    week = k12_weeks(spark)[0].withColumn("District", F.expr("case seq % 3 when 0 then null when 1 then 'Total' else 'D' end"))
    tables = k12.history_tables(week)
    counts = tables["category_counts"].filter("Broad_Category = 'Math'")
    parts, totals = values(counts, "District", "sum"), 5
    assert sum(n for _, n in parts) == 2 * totals and (None, 2) in parts
    now = k12.category_counts_now(tables["category_counts"].filter("District is null or District <> 'Total' or sum > 3"))
    assert now.filter("District is null").count() > 0


def test_weekly_job(spark, tmp_path):
    first, _, last = k12_weeks(spark)
    raw, targets, log = str(tmp_path / "raw"), _paths(tmp_path, "t"), str(tmp_path / "log")
    expected = spark.createDataFrame([("D0",), ("D9",)], "source string")
    job = lambda df: weekly.run_week(df, k12.history_tables, raw, targets, "district_totals", "District", expected, log, dt.datetime(2026, 8, 6))
    job(first)
    with pytest.raises(QualityError, match="half"):
        job(last.limit(2))
    assert values(spark.read.parquet(raw).select("Archive_Date").distinct()) == [(D(2026, 8, 6),)]
    for bad in (first.unionByName(last), first.limit(0), spark.createDataFrame([], first.schema), first.withColumn("Archive_Date", F.expr("if(seq = 3, null, Archive_Date)"))):
        with pytest.raises(ValueError, match="one snapshot date"):
            job(bad)
    job(last)
    job(last)
    assert spark.read.parquet(raw).count() == 32
    assert spark.read.parquet(log).groupBy("source", "status").count().filter("count = 3").count() == 2
    rebuilt = _paths(tmp_path, "again")
    store.rebuild(spark, raw, k12.history_tables, rebuilt)
    for t in TABLES:
        a, b = store.read_history(spark, targets[t]), store.read_history(spark, rebuilt[t])
        assert values(a, *sorted(a.columns)) == values(b, *sorted(b.columns))


def test_a_weekly_job_reads_its_own_date_only(spark, monkeypatch):
    filters = []
    monkeypatch.setattr(weekly, "run_week", lambda week, derive, raw, targets, *_: (
        filters.append(re.findall(r"PartitionFilters: \[(.*?)\]", week._jdf.queryExecution().toString())), store.write_snapshot(derive(week)["institution_totals"], targets["institution_totals"]))
    )
    catalog.QUERIES["weekly_job"](spark, "/root/testdata/sf0.001")
    assert len(filters) == 31 and all(found and all("Archive_Date" in f for f in found) for found in filters)


def _landed_events(spark, folder, *days):
    """Events of days from 2024-01-01 on as (day, number, user)."""
    rows = [(100 * day + i, dt.datetime(2024, 1, 1 + day, 12), user, "view", 1.0, '{"k": 3}') for day, n, user in days for i in range(n)]
    columns = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, columns).write.parquet(str(folder / "events.parquet"))


def test_a_halved_date_goes_through_the_whole_weekly_job(spark, tmp_path, monkeypatch):
    _landed_events(spark, tmp_path, (0, 10, 25), (1, 4, 25))
    monkeypatch.setattr(storage, "scratch", lambda spark, name: str(tmp_path / name))
    totals = catalog.QUERIES["weekly_job"](spark, str(tmp_path))
    assert values(totals) == [(D(2024, 1, 1), "College 0", 10), (D(2024, 1, 2), "College 0", 4)]
    # Every delivery is in the log, and that a loss was accepted.
    log = spark.read.parquet(str(tmp_path / "log"))
    assert values(log, "source", "status", "n_rows") == [("College 0", "ok", 10)] + 2 * [("College 0", "ok", 4)] + 2 * [("Institution", "halved", 4)]


@pytest.mark.parametrize("n", [4, 10])
def test_a_date_that_fails_a_check_does_not_look_like_a_result(spark, tmp_path, monkeypatch, n):
    # An institution is missing, with and without a loss of postings.
    _landed_events(spark, tmp_path, (0, 10, 25), (1, n - 1, 25), (1, 1, None))
    monkeypatch.setattr(storage, "scratch", lambda spark, name: str(tmp_path / name))
    with pytest.raises(QualityError, match="coverage"):
        catalog.QUERIES["weekly_job"](spark, str(tmp_path))
    held = lambda name: values(store.read_history(spark, str(tmp_path / name)).select("Archive_Date").distinct())
    assert held("raw") == held("institution_totals") == [(D(2024, 1, 1),)]


def test_failed_fetches_and_accepted_losses_are_logged(spark, tmp_path):
    raw, log, targets = str(tmp_path / "raw"), str(tmp_path / "log"), {"institution_totals": str(tmp_path / "totals")}
    expected = spark.createDataFrame([("C0",), ("C1",), ("C2",)], "source string")
    failed = spark.createDataFrame([("C1", "timed out")], "source string, error_message string")

    def job(day, n, title="Math Professor", log=log, **extra):
        rows = spark.createDataFrame([(title, None, None, "u", "C0", day)] * n, "Title string, Location string, Posted_Date string, Link string, Institution string, Archive_Date date")
        weekly.run_week(rows, higher_ed.history_tables, raw, targets, "institution_totals", "Institution", expected, log, dt.datetime(2026, 8, 6), [checks.encoding("Title")], **extra)

    # A source whose fetch failed is not told as one without postings.
    job(D(2026, 8, 6), 10, failures=failed)
    assert values(spark.read.parquet(log), *RUN_LOG.names[1:]) == [("C0", "ok", 10, None), ("C1", "error", 0, "timed out"), ("C2", "empty", 0, None)]
    with pytest.raises(ValueError, match="failures are logged"):
        job(D(2026, 8, 13), 10, log=None, failures=failed)
    # Only the loss is accepted, and only a loss is logged as one.
    with pytest.raises(quality.HalvedError):
        job(D(2026, 8, 13), 4)
    with pytest.raises(QualityError, match="encoding"):
        job(D(2026, 8, 13), 4, "bad \ufffd", loss_accepted=True)
    assert store.stored_dates(spark, raw) == [D(2026, 8, 6)]
    job(D(2026, 8, 13), 4, loss_accepted=True)
    job(D(2026, 8, 20), 4, loss_accepted=True)
    assert store.stored_dates(spark, raw) == [D(2026, 8, 6), D(2026, 8, 13), D(2026, 8, 20)]
    halved = spark.read.parquet(log).filter("status = 'halved'")
    assert values(halved, *RUN_LOG.names[1:]) == [("Institution", "halved", 4, "accepted: more than half of 10 postings are gone")]


def test_an_accepted_loss_covers_its_own_side_only(spark):
    before = spark.createDataFrame([("k12", 10), ("he", 10), (None, 10)], "side string, n long")
    after = spark.createDataFrame([("k12", 4)], "side string, n long")
    with pytest.raises(quality.HalvedError, match="he") as refused:
        quality.require_not_halved(before, after, "side", ["k12"])
    assert "k12" not in str(refused.value) and "None" in str(refused.value)
    assert [tuple(r) for r in quality.require_not_halved(before.filter("side = 'k12'"), after, "side", ["k12"])] == [("k12", 10, 4)]


def test_higher_ed_tables(spark):
    rows = [("Adjunct, Math", "x"), ("Math Professor", "x"), ("Math Professor", "y"), ("Chef", "x")]
    board = spark.createDataFrame([(t, None, None, "u", i) for t, i in rows], "Title string, Location string, Posted_Date date, Link string, Institution string")
    raw = higher_ed.raw_snapshot(board, D(2026, 8, 6))
    tables = higher_ed.history_tables(raw)
    assert values(tables["institution_totals"], "Institution", "n") == [("x", 3), ("y", 1)]
    checked = higher_ed.checked_category_counts(tables["faculty_history"])
    assert ("Math", "Total", "Instructor/Teacher/Faculty", 2) in values(checked, "Category", "Institution", "Job_Type", "sum")
    now = higher_ed.category_counts_now(checked)
    assert ("Math", "Adjunct/Part-Time Faculty", 1, "Total") in values(now, "Category", "Job_Type", "Sum", "Institution")


def test_weekly_build_end_to_end(spark):
    rows = spark.createDataFrame([(" Math\r\nTeacher ", "HS", "8/1/2026", "https://a.example/jobs/1", "D1", 1), ("Cook", "HS", "Aug 2, 2026", None, "D1", 2)], "Title string, Location string, Posted_Date string, Link string, District string, seq long")
    feed = spark.createDataFrame([("MATH teacher", "Town", "2026-08-01", "https://apps.opi.mt.gov/mtjobsforteachers/x", 1), ("Nurse", "Town", None, "https://apps.opi.mt.gov/mtjobsforteachers/x", 2)], "Title string, Location string, Posted_Date string, Link string, seq long")
    registry = spark.createDataFrame([("D1", "Town")], "District string, City string")
    raw = k12.raw_snapshot([shape.k12_posting(rows, "SchoolSpring")], shape.k12_posting(feed, "Statewide", district="Location"), registry, D(2026, 8, 6))
    current = k12.current_postings(raw)
    assert values(current, "title", "position", "District") == [("Cook", "Food Services", "D1"), ("Math Teacher", "Teacher", "D1"), ("Nurse", "Other", "Town")]
    checked = k12.checked_category_counts(k12.teacher_rows(current))
    assert values(checked, "Broad_Category", "District", "sum") == [("Math", "D1", 1), ("Math", "Total", 1)]
    assert values(k12.category_counts_now(checked)) == [("Math", 1, "D1"), ("Math", 1, "Total")]


# -- versions ----------------------------------------------------------------


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path, other = str(tmp_path / "t"), str(tmp_path / "u")
    first = week(spark, D(2026, 8, 6), ("a", 1.0))
    store.replace_dates(first, path)  # a table without versions
    for n in (2.0, 3.0, 4.0):
        store.replace_table(week(spark, D(2026, 8, 13), ("b", n)), path)
        assert values(store.read_history(spark, path), "District", "n") == [("b", n)]
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert names == ["_current", "_versions"] and len(list((tmp_path / "t" / "_versions").iterdir())) == 2
    before = values(store.read_history(spark, path))
    # The pointer cannot be written.
    with monkeypatch.context() as broken:
        broken.setattr(store, "_point", lambda *a: (_ for _ in ()).throw(OSError("no")))
        with pytest.raises(OSError, match="no"):
            store.replace_table(first, path)
    # The second table of a rebuild cannot be written: the first one is not replaced either.
    bad = first.withColumn("n", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        store.replace_tables({path: first, other: bad}, "Archive_Date")
    assert values(store.read_history(spark, path)) == before and not store.table_exists(spark, other)
    # A killed process leaves a version without a pointer.
    first.write.partitionBy("Archive_Date").parquet(f"{path}/_versions/orphan")
    assert values(store.read_history(spark, path)) == before
    store.replace_dates(first.limit(0), path, [D(2026, 8, 6)])  # nothing to write, nothing to clear
    assert values(store.read_history(spark, path)) == before
    # Dates are replaced inside the version in use.
    store.replace_dates(week(spark, D(2026, 8, 20), ("c", 1.0)), path, [D(2026, 8, 13), D(2026, 8, 20)])
    assert values(store.read_history(spark, path), "District") == [("c",)] and store.stored_dates(spark, path) == [D(2026, 8, 20)]


def test_dates_are_cleared_only_after_the_write(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_dates(week(spark, D(2026, 8, 6), ("a", 1.0)), path)
    bad = week(spark, D(2026, 8, 13), ("b", 1.0)).withColumn("n", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        store.replace_dates(bad, path, [D(2026, 8, 6), D(2026, 8, 13)])
    assert values(store.read_history(spark, path), "District") == [("a",)]


def test_repair_by_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "the raw zone")
    schema = "title string, n int, Archive_Date date"
    for part in range(3):  # three files per date, one of them clean
        rows = [("Café" if part != 1 else "Fine", part * 10 + i, D(2026, 8, 6 + i % 2)) for i in range(4)]
        corrupt = F.translate(F.decode(F.encode("title", "utf-8"), "iso-8859-1"), "", "")
        spark.createDataFrame(rows, schema).withColumn("title", corrupt).coalesce(1).write.mode("append").partitionBy("Archive_Date").parquet(path)
    files = {str(f): f.read_bytes() for f in sorted((tmp_path / "the raw zone").rglob("part-*.parquet"))}
    report = store.repair_archive(spark, path)
    assert len(files) == 6 and report.select("file").distinct().count() == 4 and report.count() == 8
    # One file cannot be put in place: it stays as it was.
    rename = store._put_in_place
    with monkeypatch.context() as broken:
        broken.setattr(store, "_put_in_place", lambda spark, folder, file: rename(spark, folder + "-gone", file))
        with pytest.raises(OSError, match="expected one file"):
            store.repair_archive(spark, path, apply=True)
    assert {str(f): f.read_bytes() for f in sorted((tmp_path / "the raw zone").rglob("part-*.parquet")) if "/_repair-" not in str(f)} == files
    done = store.repair_archive(spark, path, apply=True)
    assert done.count() == 8
    after = {str(f): f.read_bytes() for f in sorted((tmp_path / "the raw zone").rglob("part-*.parquet")) if "/_repair-" not in str(f)}
    assert set(after) == set(files) and sum(after[f] != files[f] for f in files) == 4
    read = spark.read.parquet(path)
    assert values(read, "title", "n") == sorted((("Café" if n // 10 != 1 else "Fine", n) for n in range(24) if n % 10 < 4), key=lambda t: [(False, str(v)) for v in t])
    assert store.repair_archive(spark, path).count() == 0


def test_tables_that_are_not_there_and_rows_without_a_date(spark, tmp_path):
    schema = week(spark, None).schema
    assert store.read_history(spark, str(tmp_path / "none"), schema).collect() == []
    path = str(tmp_path / "t")
    store.replace_dates(week(spark, D(2026, 8, 6), ("a", 1.0)).unionByName(week(spark, None, ("b", 2.0))), path)
    assert store.stored_dates(spark, path) == [D(2026, 8, 6)] and store.read_history(spark, path).count() == 2


# -- changes -----------------------------------------------------------------


def test_affected_dates_equal_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(500):
        days = [D(2026, 1, 1) + dt.timedelta(x) for x in rng.sample(range(40), 12)]
        now, changed, back = set(days[:9]), set(rng.sample(days, 2)), rng.randrange(1, 9)
        before = (now - changed) | {d for d in changed if rng.random() < 0.5}
        bases = {d: b for d, b in base_dates(now, back)}
        old = {d: b for d, b in base_dates(before, back)}
        must = changed | {d for d, b in bases.items() if b in changed or old.get(d, b) != b}
        assert must <= set(changes.affected(now, changed, back)) <= must | now


def test_a_late_date_changes_the_dates_that_rest_on_it(spark, tmp_path):
    def snapshot(day, *ids):
        return spark.createDataFrame([(i, day) for i in ids], "Posting_ID string, Archive_Date date")

    raw, state = str(tmp_path / "raw"), str(tmp_path / "state")
    path = lambda n: str(tmp_path / n)
    kept = [
        changes.Change(path("h"), path("new"), newness.new_by_date),
        changes.Change(path("t"), path("delta"), trends.deltas_by_date, back=5),
    ]
    derive = lambda rows: {"h": rows, "t": rows.groupBy("Archive_Date").agg(F.count(F.lit(1)).alias("n"))}
    targets = {"h": path("h"), "t": path("t")}

    def follow():
        follow_snapshots(spark, raw, snapshot(None).schema, derive, targets, state, once=True, changes=kept).awaitTermination()
        for i, change in enumerate(kept):
            again = changes.Change(change.source, path(f"again{i}"), change.derive, change.back)
            changes.rebuild(spark, again)
            columns = sorted(store.read_history(spark, change.path).columns)
            assert values(store.read_history(spark, change.path), *columns) == values(store.read_history(spark, again.path), *columns)
        return values(store.read_history(spark, path("new")), "Archive_Date", "Posting_ID")

    days = [D(2026, 8, d) for d in (1, 8, 15, 22)]
    store.write_snapshot(snapshot(days[0], "a", "b").unionByName(snapshot(days[2], "a", "c")).unionByName(snapshot(days[3], "a", "c", "d")), raw)
    assert follow() == [(days[2], "c"), (days[3], "d")]
    # A date arrives late: the following date rests on it now.
    store.write_snapshot(snapshot(days[1], "b", "c"), raw)
    assert follow() == [(days[1], "c"), (days[2], "a"), (days[3], "d")]
    assert values(store.read_history(spark, path("delta")), "Archive_Date", "delta") == [(days[0], None), (days[1], 0), (days[2], 0), (days[3], 1)]
    # A date is replaced.
    store.write_snapshot(snapshot(days[2], "c", "d", "e"), raw)
    assert follow() == [(days[1], "c"), (days[2], "d"), (days[2], "e"), (days[3], "a")]


def test_a_table_without_rows_can_be_read(spark, tmp_path):
    path, other = str(tmp_path / "t"), str(tmp_path / "u")
    rows = week(spark, D(2026, 8, 6), ("a", 1.0))
    store.replace_dates(rows, path)
    store.replace_dates(rows.limit(0), path, [D(2026, 8, 6)])  # its only date is emptied
    store.replace_table(rows.limit(0), other)
    for emptied in (path, other):
        held = store.read_history(spark, emptied)
        assert held.count() == 0 and held.dtypes == [(n, t) for n, t in rows.dtypes if n != "Archive_Date"] + [("Archive_Date", "date")]
        store.append_by_date(rows, emptied)
        assert values(store.read_history(spark, emptied), "District", "n") == [("a", 1.0)]


def test_late_postings_none_of_which_is_new(spark, tmp_path):
    days = spark.range(4).select(
        F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(int(id))").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    days.write.parquet(str(tmp_path / "events.parquet"))
    assert catalog.QUERIES["late_new_postings"](spark, str(tmp_path)).collect() == []


# -- checks while writing ----------------------------------------------------


def test_observed_checks_equal_the_operators(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "ok", True), ("b", None, "bad \ufffd", False), (None, 99.0, "ok", False)], "e string, v double, t string, is_total boolean")
    asked = [checks.coverage(["e", "v", "t"]), checks.coverage(["v"], expected=5, min_ok=2), checks.bounds("v", 0.0, 10.0), checks.encoding("t"), checks.totals("is_total", "v")]
    watched, seen = checks.observed(df, asked)
    watched.write.parquet(str(tmp_path / "x"))
    found = {(f.check, f.name): f.actual for f in checks.failures(asked, seen.get)}
    gaps = {("coverage", r.name): r.actual for r in quality.coverage_gaps(df, ["e", "v", "t"], 3).collect()}
    assert found == gaps | {
        ("bounds", "v"): quality.out_of_bounds(df, "e", "v", 0.0, 10.0, "v").count(), ("encoding", "t"): quality.encoding_faults(df, "t").count(), ("totals", "v"): 1.0,
    }
    assert checks.failures([checks.bounds("v", 0, 100)], {"v_outside": 0}) == []


def test_sides_are_taken_or_refused_together(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    def side(name, day, n, title="Math Professor"):
        rows = spark.createDataFrame([(title, None, None, f"u{i}", f"C{i % 2}", day) for i in range(n)], "Title string, Location string, Posted_Date string, Link string, Institution string, Archive_Date date")
        targets = {t: str(tmp_path / name / t) for t in ("institution_totals", "faculty_history", "category_counts")}
        return weekly.Side(name, rows.mapInPandas(look, rows.schema), higher_ed.history_tables, str(tmp_path / name / "raw"), targets, "institution_totals", "Institution", checks=[checks.encoding("Title"), checks.coverage(["Title", "Link"])])

    weekly.run_sides([side("x", D(2026, 8, 6), 10), side("y", D(2026, 8, 6), 4)])
    assert seen.value == 14, "each side's rows are read once"
    held = lambda n: values(spark.read.parquet(str(tmp_path / n / "raw")).groupBy("Archive_Date").count())
    assert held("x") == [(D(2026, 8, 6), 10)] and held("y") == [(D(2026, 8, 6), 4)]
    for bad, why in ((side("y", D(2026, 8, 13), 1), "half"), (side("y", D(2026, 8, 13), 5, "bad \ufffd"), "encoding"), (side("y", D(2026, 8, 13), 5, None), "coverage")):
        with pytest.raises(QualityError, match=why):
            weekly.run_sides([side("x", D(2026, 8, 13), 9), bad])
        assert held("x") == [(D(2026, 8, 6), 10)] and held("y") == [(D(2026, 8, 6), 4)]
