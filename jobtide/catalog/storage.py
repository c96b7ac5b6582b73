"""Queries that write derived data to shared storage and read it back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import ADJUNCT_JOB_TYPE, FACULTY_JOB_TYPE, he_job_type
from ..functions.text import C1_CONTROLS, CP1252_CHARS
from ..operators.checks import coverage, encoding
from ..operators.counts import row_counts
from ..operators.newness import new_by_date
from ..operators.quality import HalvedError
from ..operators.trends import deltas_by_date
from ..plans import higher_ed, k12, weekly
from ..schemas import SALARY_HISTORY, struct
from ..session import settled
from ..sinks import store
from ..sinks.changes import Change
from ..sources import files, shape
from ..streaming.snapshots import follow_snapshots
from .base import HE_EXPECTED, HE_SQL, events, he_rows, k12_rows, query, scratch, sql_list, table
from .plans import _HE_SQL, _TEACHERS_SQL


@query(
    "csv_export_and_scan",
    """SELECT c_custkey, '"' || c_name || '", ' || c_mktsegment AS label, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer""",
)
def csv_export_and_scan(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, commas and missing values survive the round trip."""
    path = scratch(spark, "csv")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('", '), "c_mktsegment").alias("label"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
    )
    store.export_csv(rows, path)
    return files.read_table_csv(spark, path, struct(c_custkey="n", label="s", balance="x"))


@query(
    "snapshot_csv_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS Archive_Date,
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status FROM orders""",
)
def snapshot_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of snapshot files, different in columns and date layout."""
    path, orders = scratch(spark, "snapshots"), table(spark, d, "orders")
    old = orders.filter("o_orderstatus = 'F'").select(
        F.lit("1").alias("X"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "M/d/yyyy").alias("Archive_Date"),
        F.col("o_orderpriority").alias("priority"),
    )
    new = orders.filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Archive_Date"),
    )
    store.export_csv(old, f"{path}/old")
    store.export_csv(new, f"{path}/new")
    return files.read_snapshot_csvs(spark, f"{path}/*").select("id", "Archive_Date", "priority", "status")


@query(
    "raw_byte_lines",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\r\n]+', ' ', 'g'))) AS line FROM documents""",
)
def raw_byte_lines(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines in a legacy single-byte encoding (where it has all characters): bytes are kept, repaired,
    then parsed, with the quotes, commas and backslashes of the texts in place."""
    path = scratch(spark, "bytes")
    flat = F.trim(F.regexp_replace("text", r"[\r\n]+", " "))
    line = F.concat(F.col("doc_id"), F.lit(',"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    single = F.col("text").rlike("^[\\x{00}-\\x{7f}\\x{a0}-\\x{ff}]*$")
    landed = F.when(single, F.encode(line, "iso-8859-1")).otherwise(F.encode(line, "utf-8"))
    table(spark, d, "documents").select(landed.cast("string").alias("value")).write.text(path)
    parsed = files.parse_csv_lines(files.read_raw_lines(spark, path), struct(doc_id="n", title="s"))
    return parsed.select("doc_id", F.md5(F.coalesce("title", F.lit(""))).alias("line"))


@query(
    "ledger_scan",
    """SELECT '0' || (c_custkey % 3) AS FundCode, c_name AS DistrictName, CAST(c_nationkey AS VARCHAR) AS SumOfAmount FROM customer""",
)
def ledger_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sheets with a title line above the header; codes stay text."""
    path = scratch(spark, "ledger")
    names = ["FundCode", "DistrictName", "SumOfAmount"]
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("0"), F.col("c_custkey") % 3).alias("Expenditures"), F.col("c_name").alias("Page"),
        F.col("c_nationkey").cast("string").alias("One"),
    )

    def below_a_header(batches):
        yield pd.DataFrame([names], columns=["Expenditures", "Page", "One"])
        yield from batches

    # Each written file opens with the title (the writer's header) and then the real header.
    store.export_csv(rows.mapInPandas(below_a_header, rows.schema), path)
    return files.read_ledger(spark, path, struct(**dict.fromkeys(names, "s")))


@query(
    "year_archive",
    """SELECT DISTINCT 'C' || o_custkey AS District, CAST(year(o_orderdate) AS VARCHAR) AS Salary_Year FROM orders""",
)
def year_archive(spark: SparkSession, d: str) -> DataFrame:
    """Year after year archived, each in part first, then whole, then once more; all years at once are refused."""
    path = scratch(spark, "salaries")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("District"), F.year("o_orderdate").cast("string").alias("Salary_Year"),
        *[F.lit(1.0).alias(c) for c in SALARY_HISTORY.names[2:]], "o_orderstatus",
    )
    years = [r[0] for r in rows.select("Salary_Year").distinct().orderBy("Salary_Year").collect()]
    for year in years:
        own = rows.filter(F.col("Salary_Year") == year)
        for snapshot in (own.filter("o_orderstatus = 'F'"), own, own):
            store.archive_year_snapshot(snapshot.drop("o_orderstatus"), path)
    store.archive_year_snapshot(rows.drop("o_orderstatus"), path)
    return store.read_history(spark, path).select("District", "Salary_Year")


def _landed_titles(spark: SparkSession, d: str, path: str) -> None:
    """Titles in a date-partitioned archive of three files per date.  Where the corruption can be proven the
    title is archived corrupted; the others go in as they are."""
    corrupted = F.translate(F.decode(F.encode("text", "utf-8"), "iso-8859-1"), C1_CONTROLS, CP1252_CHARS)
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 7).cast("int"))
    lost = F.hex(F.encode("text", "utf-8")).rlike("^(..)*(81|8D|8F|90|9D)")
    title = F.when(lost | (F.col("doc_id") % 3 == 1), F.col("text")).otherwise(corrupted)
    rows = table(spark, d, "documents").select("doc_id", title.alias("title"), day.alias("Archive_Date"))
    for part in range(3):
        rows.filter(F.col("doc_id") % 3 == part).repartition("Archive_Date").write.mode("append").partitionBy("Archive_Date").parquet(path)


@query("archive_repair", "SELECT doc_id, md5(text) AS title FROM documents")
def archive_repair(spark: SparkSession, d: str) -> DataFrame:
    """Titles in an archive, repaired in place, file by file; files without changes are not rewritten."""
    path = scratch(spark, "archive")
    _landed_titles(spark, d, path)
    store.repair_archive(spark, path, apply=True)
    return spark.read.parquet(path).select("doc_id", F.md5("title").alias("title"))


@query(
    "archive_repair_report",
    r"""WITH t AS (SELECT doc_id, text, doc_id % 7 AS day, doc_id % 3 AS part FROM documents
  WHERE doc_id % 3 <> 1 AND regexp_matches(text, '[^\x00-\x7F]') AND NOT regexp_matches(hex(encode(text)), '^(..)*(81|8D|8F|90|9D)'))
SELECT DATE '2024-01-01' + CAST(day AS INTEGER) AS Archive_Date, doc_id % 3 AS part, count(*) AS titles, md5(string_agg(md5(text), ',' ORDER BY md5(text))) AS repaired
FROM t GROUP BY ALL""",
)
def archive_repair_report(spark: SparkSession, d: str) -> DataFrame:
    """What the repair would change, by date and file: every file with a change, how many titles, and their repaired texts."""
    path = scratch(spark, "archive")
    _landed_titles(spark, d, path)
    report = store.repair_archive(spark, path)
    # A file holds one third of the ids; which one is read off the file itself.
    part = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), (F.col("doc_id") % 3).alias("part")).distinct()
    repaired = F.md5(F.array_join(F.sort_array(F.collect_list(F.md5("repaired"))), ","))
    by_file = report.groupBy("Archive_Date", "file").agg(F.count(F.lit(1)).alias("titles"), repaired.alias("repaired"))
    return by_file.join(part, "file").drop("file")


@query(
    "rebuilt_history",
    f"""WITH {_TEACHERS_SQL} SELECT Broad_Category, Archive_Date, District, sum FROM allsum""",
)
def rebuilt_history(spark: SparkSession, d: str) -> DataFrame:
    """Every K-12 table derived again from the archived raw snapshots, over tables of dates that are gone."""
    raw, targets = scratch(spark, "raw"), {n: scratch(spark, n) for n in ("category_counts", "teacher_history", "district_totals")}
    rows = k12_rows(spark, d).withColumn("position", F.lit(None).cast("string"))
    older = rows.withColumn("Archive_Date", F.add_months("Archive_Date", -12))
    store.write_snapshot(older, raw)
    store.rebuild(spark, raw, k12.history_tables, targets)
    raw = scratch(spark, "raw")
    store.write_snapshot(rows, raw)
    store.rebuild(spark, raw, k12.history_tables, targets)
    return store.read_history(spark, targets["category_counts"]).select("Broad_Category", "Archive_Date", "District", "sum")


@query(
    "rebuilt_he_history",
    f"""WITH {_HE_SQL} SELECT 'counts' AS kind, Category AS label, Archive_Date, Institution, CAST(sum AS BIGINT) AS n, Job_Type FROM hesum
UNION ALL SELECT 'totals', NULL, Archive_Date, Institution, count(*), NULL FROM he GROUP BY ALL""",
)
def rebuilt_he_history(spark: SparkSession, d: str) -> DataFrame:
    """The higher-ed tables derived again from their archive."""
    raw, targets = scratch(spark, "raw"), {n: scratch(spark, n) for n in ("category_counts", "faculty_history", "institution_totals")}
    store.write_snapshot(he_rows(spark, d), raw)
    store.rebuild(spark, raw, higher_ed.history_tables, targets)
    counted = store.read_history(spark, targets["category_counts"]).select(
        F.lit("counts").alias("kind"), F.col("Category").alias("label"), "Archive_Date", "Institution", F.col("sum").alias("n"), "Job_Type"
    )
    totals = store.read_history(spark, targets["institution_totals"]).select(
        F.lit("totals").alias("kind"), F.lit(None).cast("string").alias("label"), "Archive_Date", "Institution", "n", F.lit(None).cast("string").alias("Job_Type")
    )
    return counted.unionByName(totals)


@query(
    "weekly_job",
    f"""WITH {HE_SQL} SELECT Archive_Date, Institution, count(*) AS n FROM he GROUP BY ALL""",
)
def weekly_job(spark: SparkSession, d: str) -> DataFrame:
    """All dates of the data, one weekly job each, the last delivered twice: checks, archive, append, log.

    A date of less than half the postings is refused, then taken by a job that accepts the loss and logs it; a date
    that fails any other check ends the query.
    """
    raw, log = scratch(spark, "raw"), scratch(spark, "log")
    targets = {n: scratch(spark, n) for n in ("category_counts", "faculty_history", "institution_totals")}
    # Landed by date, so that a week's job reads its own date and not all of them.
    landed = scratch(spark, "landed")
    store.write_snapshot(he_rows(spark, d), landed)
    rows = store.read_history(spark, landed)
    expected = rows.select(F.col("Institution").alias("source")).distinct()
    checks = [coverage(["Title", "Institution", "Link"]), encoding("Title")]
    days = [r[0] for r in rows.select("Archive_Date").distinct().orderBy("Archive_Date").collect()]
    for day in [*days, days[-1]]:
        week = rows.filter(F.col("Archive_Date") == F.lit(day))
        job = partial(weekly.run_week, week, higher_ed.history_tables, raw, targets, "institution_totals", "Institution", expected, log, dt.datetime(2024, 2, 1), checks)
        try:
            job()
        except HalvedError:
            job(loss_accepted=True)
    return store.read_history(spark, targets["institution_totals"]).select("Archive_Date", "Institution", "n")


_FACULTY_TITLES = [title for title, (job_type, *_) in HE_EXPECTED.items() if job_type in (FACULTY_JOB_TYPE, ADJUNCT_JOB_TYPE)]


@query(
    "late_snapshot",
    f"""WITH {HE_SQL}, edge AS (SELECT min(Archive_Date) AS day FROM he), kept AS (
  SELECT he.* FROM he, edge WHERE Archive_Date <> day OR NOT list_contains({sql_list(_FACULTY_TITLES)}, Title))
SELECT 'totals' AS kind, Archive_Date, Institution, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT 'faculty', Archive_Date, NULL, count(*) FROM kept WHERE list_contains({sql_list(_FACULTY_TITLES)}, Title) GROUP BY ALL""",
)
def late_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The stream meets the oldest date again, now without its faculty posts: the date is replaced, and
    where a table has no rows for it any more, cleared."""
    raw, state = scratch(spark, "raw"), scratch(spark, "state")
    targets = {n: scratch(spark, n) for n in ("institution_totals", "faculty_history")}
    rows = settled(he_rows(spark, d))
    store.write_snapshot(rows, raw)
    schema = spark.read.parquet(raw).schema

    def follow() -> None:
        follow_snapshots(spark, raw, schema, higher_ed.history_tables, targets, state, once=True).awaitTermination()

    follow()
    first = rows.agg(F.min("Archive_Date")).first()[0]
    late = rows.filter((F.col("Archive_Date") == F.lit(first)) & ~he_job_type("Title").isin(FACULTY_JOB_TYPE, ADJUNCT_JOB_TYPE))
    store.write_snapshot(late, raw)
    follow()
    totals = store.read_history(spark, targets["institution_totals"]).select(F.lit("totals").alias("kind"), "Archive_Date", "Institution", "n")
    faculty = row_counts(store.read_history(spark, targets["faculty_history"]), ["Archive_Date"])
    return totals.unionByName(faculty.select(F.lit("faculty").alias("kind"), "Archive_Date", F.lit(None).cast("string").alias("Institution"), "n"))


# The third date is late, and arrives twice: with two of three rows, then with all.
_LATE = 2
_DATED_SQL = """days AS (SELECT DISTINCT Archive_Date AS day FROM he),
pairs AS (SELECT a.day, (SELECT max(b.day) FROM days b WHERE b.day <= a.day - {back}) AS base FROM days a)"""


def _followed(spark: SparkSession, d: str, change: Callable[[dict[str, str]], Change]) -> DataFrame:
    """A change table kept by the stream: all dates but one, then that one in part, then whole."""
    raw, state = scratch(spark, "raw"), scratch(spark, "state")
    targets = {n: scratch(spark, n) for n in ("postings", "institution_totals")}
    kept = change(targets)
    rows = settled(he_rows(spark, d).withColumn("_part", F.xxhash64("Link") % 3))
    late = F.col("Archive_Date") == F.lit(rows.select("Archive_Date").distinct().orderBy("Archive_Date").collect()[_LATE][0])
    schema = None

    def derive(snapshots: DataFrame) -> dict[str, DataFrame]:
        return {"postings": snapshots, "institution_totals": higher_ed.institution_totals(snapshots)}

    for arriving in (rows.filter(~late), rows.filter(late & (F.col("_part") != 0)), rows.filter(late)):
        store.write_snapshot(arriving.drop("_part"), raw)
        schema = schema or spark.read.parquet(raw).schema
        follow_snapshots(spark, raw, schema, derive, targets, state, once=True, changes=[kept]).awaitTermination()
    return store.read_history(spark, kept.path)


@query(
    "late_new_postings",
    f"""WITH {HE_SQL}, {_DATED_SQL.format(back=1)}
SELECT Archive_Date, Institution, count(*) AS n FROM he JOIN pairs ON Archive_Date = day
WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM he b WHERE b.Archive_Date = base AND b.Title IS NOT DISTINCT FROM he.Title
  AND b.Location IS NOT DISTINCT FROM he.Location AND b.Institution IS NOT DISTINCT FROM he.Institution)
GROUP BY ALL""",
)
def late_new_postings(spark: SparkSession, d: str) -> DataFrame:
    """New postings of every date, kept while a date arrives late: the date after it is derived again."""
    found = _followed(
        spark, d,
        lambda targets: Change(targets["postings"], scratch(spark, "new"), partial(new_by_date, keys=("Title", "Location", "Institution"))),
    )
    return row_counts(found, ["Archive_Date", "Institution"])


@query(
    "late_deltas",
    f"""WITH {HE_SQL}, {_DATED_SQL.format(back=5)}, t AS (SELECT Archive_Date, count(*) AS n FROM he GROUP BY 1)
SELECT a.Archive_Date, a.n AS latest_n, base AS prior_date, b.n AS prior_n, a.n - b.n AS delta
FROM t a JOIN pairs ON a.Archive_Date = day LEFT JOIN t b ON b.Archive_Date = base""",
)
def late_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The total of every date against the newest one five days earlier, kept while a date arrives late."""
    return _followed(spark, d, lambda targets: Change(targets["institution_totals"], scratch(spark, "deltas"), deltas_by_date, back=5))


@query(
    "overwritten_table",
    f"WITH {HE_SQL} SELECT Institution, count(*) AS n FROM he WHERE Location IS NOT NULL GROUP BY 1",
)
def overwritten_table(spark: SparkSession, d: str) -> DataFrame:
    """A current table refreshed from itself."""
    path = scratch(spark, "current")
    store.overwrite_table(he_rows(spark, d), path)
    store.overwrite_table(store.read_history(spark, path).filter("Location IS NOT NULL"), path)
    return row_counts(store.read_history(spark, path), ["Institution"])


@query(
    "run_log",
    """WITH n AS (SELECT user_id % 7 AS s, count(*) AS c FROM events WHERE user_id % 7 <> 3 GROUP BY 1),
e AS (SELECT DISTINCT 'source ' || (user_id % 7) AS source, user_id % 7 AS s FROM events)
SELECT source, CASE WHEN c IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(c, 0) AS n_rows, 2::BIGINT AS runs
FROM e LEFT JOIN n USING (s)""",
)
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Two runs in one append-only log."""
    path = scratch(spark, "log")
    rows = events(spark, d).select(F.concat(F.lit("source "), F.col("user_id") % 7).alias("source"))
    audit = shape.ingest_audit(rows, rows.filter("source <> 'source 3'"))
    for hour in (1, 2):
        store.append_log(audit, path, dt.datetime(2024, 1, 1, hour))
    return spark.read.parquet(path).groupBy("source", "status", "n_rows").agg(F.count(F.lit(1)).alias("runs"))
