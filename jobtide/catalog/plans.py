"""Queries over the composed analytics: the weekly builds, context tables, views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules
from ..functions.signals import visible_text
from ..operators import quality
from ..operators.asof import at_latest
from ..plans import context, health, higher_ed, k12, views
from ..schemas import DISTRICT_CONTEXT, ENTITY_MAP, INSTITUTION_CONTEXT, conform
from ..session import settled
from ..sinks import store
from ..sources.shape import k12_posting
from ..streaming.snapshots import follow_snapshots
from .base import (
    EVENTS_SQL,
    HE_EXPECTED,
    HE_SQL,
    IDENTITY_SQL,
    K12_EXPECTED,
    K12_TITLES,
    events,
    he_rows,
    k12_rows,
    pick,
    query,
    signal_sql,
    scratch,
    sql_expected,
    sql_list,
    sql_map,
    table,
    whole_total,
)

# -- the K-12 build ----------------------------------------------------------

_POSITION_SQL = sql_expected("title", K12_EXPECTED, 0)
_TEACHERS_SQL = f"""{IDENTITY_SQL}, titles AS (SELECT DISTINCT title, {_POSITION_SQL} AS position FROM kept),
subjects AS (SELECT title, position, {sql_expected("title", K12_EXPECTED, 1)} AS Category FROM titles),
classes AS (SELECT *, {sql_expected("title", K12_EXPECTED, 2)} AS Broad_Category FROM subjects),
teachers AS (SELECT * FROM kept JOIN classes USING (title) WHERE position = 'Teacher'),
parts AS (SELECT Broad_Category, Archive_Date, District, count(DISTINCT Posting_ID) AS sum FROM teachers GROUP BY ALL),
allsum AS (SELECT Broad_Category, Archive_Date, coalesce(District, 'Total') AS District, CAST(sum(sum) AS BIGINT) AS sum
    FROM parts GROUP BY GROUPING SETS ((Broad_Category, Archive_Date, District), (Broad_Category, Archive_Date)))"""


def _teachers(spark: SparkSession, d: str) -> DataFrame:
    return k12.teacher_rows(k12.current_postings(k12.identify(k12_rows(spark, d))))


@query(
    "open_teacher_postings",
    f"WITH {_TEACHERS_SQL} SELECT Broad_Category, Archive_Date, District, sum FROM allsum",
)
def open_teacher_postings(spark: SparkSession, d: str) -> DataFrame:
    """Open teacher postings by category, snapshot and district, with Total rows."""
    return k12.category_counts(_teachers(spark, d))


@query(
    "teacher_history",
    f"""WITH {_TEACHERS_SQL}
SELECT title, Archive_Date, position, location, url, District, Posting_Source, Posting_Identity_Method, Posting_ID, Category, Broad_Category
FROM teachers""",
)
def teacher_history(spark: SparkSession, d: str) -> DataFrame:
    return k12.history_tables(k12_rows(spark, d))["teacher_history"]


@query(
    "district_totals",
    f"""WITH {IDENTITY_SQL}
SELECT District, Archive_Date, count(DISTINCT Posting_ID) AS n FROM kept GROUP BY ALL""",
)
def district_totals(spark: SparkSession, d: str) -> DataFrame:
    return k12.history_tables(k12_rows(spark, d))["district_totals"]


@query(
    "category_counts_now",
    f"""WITH {_TEACHERS_SQL}
SELECT Broad_Category, sum AS Sum, District FROM allsum WHERE Archive_Date = (SELECT max(Archive_Date) FROM allsum)""",
)
def category_counts_now(spark: SparkSession, d: str) -> DataFrame:
    return k12.category_counts_now(k12.category_counts(_teachers(spark, d)))


@query(
    "combine_sources",
    f"""WITH {EVENTS_SQL}, rows AS (
  SELECT {sql_list(K12_TITLES)}[k % {len(K12_TITLES)} + 1] AS title, day - k % 7 AS day, 'Town ' || (user_id % 17) AS place,
         'District ' || (user_id % 40) AS District, event_type, event_id FROM ev),
registry AS (SELECT DISTINCT 'District ' || (user_id % 40) AS District, 'Town ' || (user_id % 40 % 17) AS city FROM ev),
known AS (SELECT DISTINCT city, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS tkey, day
  FROM rows JOIN registry USING (District) WHERE event_type <> 'click')
SELECT title, day AS date_posted, place AS location, District, event_id FROM rows WHERE event_type <> 'click'
UNION ALL SELECT title, day, place, place, event_id FROM rows WHERE event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM known WHERE known.city = rows.place AND known.tkey = regexp_replace(lower(rows.title), '[^a-z0-9]+', ' ', 'g')
    AND known.day = rows.day)""",
)
def combine_sources(spark: SparkSession, d: str) -> DataFrame:
    """Four direct platforms and the statewide feed; dates in two layouts; feed
    rows that a direct board of the same town shows are dropped."""
    rows = k12_rows(spark, d).join(events(spark, d).select(F.col("event_id").alias("seq"), "event_type"), "seq")
    board = rows.select(
        "event_type", "seq", F.col("title").alias("Title"), F.col("location").alias("Location"),
        F.date_format("date_posted", "MM/dd/yyyy").alias("Posted_Date"), F.col("url").alias("Link"), "District",
    )
    feed = board.filter("event_type = 'click'").withColumn("Posted_Date", F.date_format(F.to_date("Posted_Date", "MM/dd/yyyy"), "MMM d, yyyy"))
    registry = events(spark, d).select((F.col("user_id") % 40).alias("n")).distinct().select(
        F.concat(F.lit("District "), F.col("n")).alias("District"), F.concat(F.lit("Town "), F.col("n") % 17).alias("City")
    )
    platforms = {"view": "SchoolSpring", "purchase": "TedK12", "signup": "AppliTrack", "error": "Apptegy"}
    combined = k12.combine_sources(
        [k12_posting(board.filter(F.col("event_type") == kind), platform) for kind, platform in platforms.items()],
        k12_posting(feed, "Statewide", district="Location"),
        registry,
    )
    return combined.select("title", "date_posted", "location", "District", F.col("seq.page").alias("event_id"))


@query(
    "snapshot_to_current",
    f"""WITH {EVENTS_SQL}, rows AS (
  SELECT {sql_list(K12_TITLES)}[k % {len(K12_TITLES)} + 1] AS title, day - k % 7 AS day, 'Town ' || (user_id % 17) AS place,
         'District ' || (user_id % 40) AS District, event_type, event_id FROM ev),
registry AS (SELECT DISTINCT 'District ' || (user_id % 40) AS District, 'Town ' || (user_id % 40 % 17) AS city FROM ev),
known AS (SELECT DISTINCT city, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS tkey, day
  FROM rows JOIN registry USING (District) WHERE event_type <> 'click'),
united AS (SELECT title, day, place, District, 'direct' AS kind, event_id FROM rows WHERE event_type <> 'click'
UNION ALL SELECT title, day, place, place, 'feed', event_id FROM rows WHERE event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM known WHERE known.city = rows.place AND known.tkey = regexp_replace(lower(rows.title), '[^a-z0-9]+', ' ', 'g')
    AND known.day = rows.day))
SELECT title, {_POSITION_SQL} AS position, day AS date_posted, place AS location,
       regexp_replace(District, '^District 1$', 'First District') AS District, DATE '2024-02-01' AS Archive_Date, count(*) AS n, count(*) AS ids
FROM united GROUP BY ALL""",
)
def snapshot_to_current(spark: SparkSession, d: str) -> DataFrame:
    """The raw snapshot of boards and feed, names canonicalised and titles classified: what a week shows."""
    rows = events(spark, d).select(
        "event_type", F.col("event_id").alias("seq"), pick(K12_TITLES, F.col("k")).alias("Title"),
        F.concat(F.lit("Town "), F.col("user_id") % 17).alias("Location"),
        F.date_format(F.date_sub("day", F.col("k") % 7), "M/d/yyyy").alias("Posted_Date"),
        F.concat(F.lit("https://board.example/jobs/"), F.col("event_id")).alias("Link"),
        F.concat(F.lit("District "), F.col("user_id") % 40).alias("District"),
    )
    feed = rows.filter("event_type = 'click'").withColumn("Link", F.lit("https://apps.opi.mt.gov/mtjobsforteachers/list"))
    registry = events(spark, d).select((F.col("user_id") % 40).alias("n")).distinct().select(
        F.concat(F.lit("District "), F.col("n")).alias("District"), F.concat(F.lit("Town "), F.col("n") % 17).alias("City")
    )
    raw = k12.raw_snapshot(
        [k12_posting(rows.filter("event_type <> 'click'"), "SchoolSpring")],
        k12_posting(feed, "Statewide", district="Location"), registry, dt.date(2024, 2, 1),
    )
    aliases = spark.createDataFrame([("District 1", "First District")], "alias string, canonical string")
    current = k12.current_postings(raw, aliases)
    keys = ["title", "position", "date_posted", "location", "District", "Archive_Date"]
    return current.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Posting_ID").alias("ids"))


@query(
    "counts_without_district",
    f"""WITH {_TEACHERS_SQL}, renamed AS (SELECT CASE WHEN District IN ('District 3', 'District 4') THEN NULL
    WHEN District = 'District 5' THEN 'Total' ELSE District END AS District, Broad_Category, Archive_Date, Posting_ID FROM teachers),
by_district AS (SELECT Broad_Category, Archive_Date, District, count(DISTINCT Posting_ID) AS sum FROM renamed GROUP BY ALL)
SELECT * FROM by_district UNION ALL SELECT Broad_Category, Archive_Date, 'Total', CAST(sum(sum) AS BIGINT) FROM by_district GROUP BY ALL""",
)
def counts_without_district(spark: SparkSession, d: str) -> DataFrame:
    """Checked counts where some postings have no district and one district is called "Total"."""
    name = F.col("District")
    teachers = _teachers(spark, d).withColumn(
        "District", F.when(name == "District 5", F.lit("Total")).when(~name.isin("District 3", "District 4"), name)
    )
    return k12.checked_category_counts(teachers)


# -- the higher-ed build -----------------------------------------------------

_HE_SQL = f"""{HE_SQL}, titles AS (SELECT DISTINCT Title, {sql_expected("Title", HE_EXPECTED, 0)} AS Job_Type,
    {sql_expected("Title", HE_EXPECTED, 1)} AS Category, {sql_expected("Title", HE_EXPECTED, 2)} AS Appointment FROM he),
faculty AS (SELECT he.*, Job_Type, Category FROM he JOIN titles USING (Title)
    WHERE Job_Type IN ('Instructor/Teacher/Faculty', 'Adjunct/Part-Time Faculty')),
hesum AS (SELECT Category, Archive_Date, CASE WHEN grouping(Institution) = 1 THEN 'Total' ELSE Institution END AS Institution,
    Job_Type, count(*) AS sum FROM faculty
    GROUP BY GROUPING SETS ((Category, Archive_Date, Job_Type, Institution), (Category, Archive_Date, Job_Type)))"""


@query("faculty_history", f"WITH {_HE_SQL} SELECT * FROM faculty")
def faculty_history(spark: SparkSession, d: str) -> DataFrame:
    return higher_ed.faculty_rows(he_rows(spark, d))


@query("he_category_counts", f"WITH {_HE_SQL} SELECT * FROM hesum")
def he_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return higher_ed.history_tables(he_rows(spark, d))["category_counts"]


@query(
    "he_category_counts_now",
    f"""WITH {_HE_SQL} SELECT Category, Job_Type, sum AS Sum, Institution FROM hesum
WHERE Archive_Date = (SELECT max(Archive_Date) FROM hesum)""",
)
def he_category_counts_now(spark: SparkSession, d: str) -> DataFrame:
    return higher_ed.category_counts_now(higher_ed.category_counts(higher_ed.faculty_rows(he_rows(spark, d))))


@query(
    "institution_totals",
    f"WITH {HE_SQL} SELECT Institution, Archive_Date, count(*) AS n FROM he GROUP BY ALL",
)
def institution_totals(spark: SparkSession, d: str) -> DataFrame:
    return higher_ed.institution_totals(he_rows(spark, d))


# -- written history ---------------------------------------------------------


_INSTITUTION_TOTALS = f"WITH {HE_SQL} SELECT Institution, Archive_Date, count(*) AS n FROM he GROUP BY ALL"


@query("incremental_equals_rebuild", _INSTITUTION_TOTALS)
def incremental_equals_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A rebuilt history, then the last two dates appended, one of them delivered twice:
    the table is what a rebuild of everything gives."""
    path = scratch(spark, "totals")
    rows = he_rows(spark, d)
    days = [r[0] for r in rows.select("Archive_Date").distinct().orderBy("Archive_Date").collect()]
    store.replace_dates(higher_ed.institution_totals(rows.filter(F.col("Archive_Date").isin(days[:-2]))), path)
    for day in (*days[-2:], days[-1]):
        week = rows.filter(F.col("Archive_Date") == F.lit(day))
        store.append_by_date(higher_ed.institution_totals(week), path)
    return store.read_history(spark, path).select("Institution", "Archive_Date", "n")


@query("streamed_history", _INSTITUTION_TOTALS)
def streamed_history(spark: SparkSession, d: str) -> DataFrame:
    """The same table kept by a file stream over landed snapshots."""
    raw, path, checkpoint = scratch(spark, "raw"), scratch(spark, "streamed"), scratch(spark, "stream-state")
    store.write_snapshot(he_rows(spark, d), raw)
    schema = spark.read.parquet(raw).schema
    stream = follow_snapshots(
        spark, raw, schema, lambda rows: {"totals": higher_ed.institution_totals(rows)}, {"totals": path}, checkpoint, once=True
    )
    stream.awaitTermination()
    return store.read_history(spark, path).select("Institution", "Archive_Date", "n")


# -- cubes and series --------------------------------------------------------

_K12_CUBE_SQL = f"""{_TEACHERS_SQL}, labelled AS (
  SELECT {sql_map("Broad_Category", rules.K12_SHORT_LABELS, "Broad_Category")} AS Broad_Category, Archive_Date, District, sum
  FROM allsum WHERE Broad_Category <> 'Other'),
cube AS (SELECT b.Broad_Category, a.Archive_Date, c.District, coalesce(l.sum, 0) AS sum
  FROM (SELECT DISTINCT Broad_Category FROM labelled) b CROSS JOIN (SELECT DISTINCT Archive_Date FROM labelled) a
  CROSS JOIN (SELECT DISTINCT District FROM labelled) c LEFT JOIN labelled l USING (Broad_Category, Archive_Date, District))"""


def _k12_cube(spark: SparkSession, d: str, collapse: bool = False) -> DataFrame:
    return views.k12_cube(k12.category_counts(_teachers(spark, d)), collapse)


@query("k12_cube", f"WITH {_K12_CUBE_SQL} SELECT * FROM cube")
def k12_cube(spark: SparkSession, d: str) -> DataFrame:
    return _k12_cube(spark, d)


@query(
    "k12_trend_series",
    f"""WITH {_K12_CUBE_SQL}
SELECT {sql_map("Broad_Category", rules.K12_COLLAPSED, "Broad_Category")} AS Broad_Category, Archive_Date, CAST(sum(sum) AS BIGINT) AS sum
FROM cube WHERE District <> 'Total' AND Archive_Date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL""",
)
def k12_trend_series(spark: SparkSession, d: str) -> DataFrame:
    """All districts together, coarse categories: total rows are left out, not added."""
    return views.trend_series(
        _k12_cube(spark, d, collapse=True), "District", "Broad_Category", start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 25)
    )


@query(
    "he_trend_series",
    f"""WITH {_HE_SQL}, kept AS (SELECT * FROM hesum WHERE Category <> 'Uncategorized'),
cube AS (SELECT a.Category, b.Archive_Date, c.Institution, e.Job_Type, coalesce(kept.sum, 0) AS sum
  FROM (SELECT DISTINCT Category FROM kept) a CROSS JOIN (SELECT DISTINCT Archive_Date FROM kept) b
  CROSS JOIN (SELECT DISTINCT Institution FROM kept) c CROSS JOIN (SELECT DISTINCT Job_Type FROM kept) e
  LEFT JOIN kept USING (Category, Archive_Date, Institution, Job_Type))
SELECT Category, Archive_Date, CAST(sum(sum) AS BIGINT) AS sum FROM cube
WHERE Institution = 'College 7' AND Job_Type = 'Instructor/Teacher/Faculty' GROUP BY ALL""",
)
def he_trend_series(spark: SparkSession, d: str) -> DataFrame:
    """One institution and appointment, days without postings as 0."""
    cube = views.he_cube(higher_ed.category_counts(higher_ed.faculty_rows(he_rows(spark, d))))
    return views.trend_series(cube, "Institution", "Category", "College 7", Job_Type=rules.FACULTY_JOB_TYPE)


@query(
    "k12_current_trends",
    f"""WITH {_K12_CUBE_SQL}, h AS (SELECT Broad_Category AS Category, Archive_Date, sum AS n FROM cube WHERE District = 'Total'),
m AS (SELECT max(Archive_Date) AS latest, max(Archive_Date) FILTER (WHERE Archive_Date <= (SELECT max(Archive_Date) FROM h) - 28) AS month FROM h)
SELECT Category, any_value(n) FILTER (WHERE Archive_Date = latest) AS current,
       any_value(n) FILTER (WHERE Archive_Date = latest) - any_value(n) FILTER (WHERE Archive_Date = month) AS vs_month_ago,
       CAST(NULL AS BIGINT) AS vs_quarter_ago, CAST(NULL AS BIGINT) AS vs_year_ago,
       array_to_string(list(n ORDER BY Archive_Date) FILTER (WHERE Archive_Date > latest - 12), ',') AS series
FROM h, m GROUP BY Category""",
)
def k12_current_trends(spark: SparkSession, d: str) -> DataFrame:
    trends = views.current_trends_view(_k12_cube(spark, d), "District", "Broad_Category")
    return trends.withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


# -- job lists ---------------------------------------------------------------

AS_OF = dt.date(2024, 7, 10)


@query(
    "k12_job_list",
    f"""WITH {IDENTITY_SQL}, once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY Posting_ID ORDER BY title, url, District, location, date_posted) = 1)
SELECT District, title AS "Title", {_POSITION_SQL} AS "Position", location AS "Location",
       CASE WHEN date_posted < DATE '2024-07-10' - 180 THEN 'Listed since ' ELSE '' END || date_posted AS "Posted / listed",
       url AS "Link", Posting_Source AS "Source", Posting_Identity_Method AS "Identity method", Posting_ID
FROM once""",
)
def k12_job_list(spark: SparkSession, d: str) -> DataFrame:
    postings = k12.current_postings(k12.identify(k12_rows(spark, d)))
    return views.k12_job_list(postings, AS_OF)


@query(
    "he_job_list",
    f"""WITH {_HE_SQL}
SELECT Institution, he.Title, Location,
       CASE WHEN CAST(Posted_Date AS DATE) < DATE '2024-07-10' - 180 THEN 'Listed since ' ELSE '' END || Posted_Date AS "Posted / listed",
       Link, Appointment
FROM he JOIN titles USING (Title) WHERE Appointment = 'Adjunct/part-time faculty'""",
)
def he_job_list(spark: SparkSession, d: str) -> DataFrame:
    return views.he_job_list(he_rows(spark, d), AS_OF, appointment=rules.ADJUNCT_APPOINTMENT)


@query(
    "he_new_by_appointment",
    f"""WITH {_HE_SQL}, two AS (SELECT max(Archive_Date) AS latest,
    max(Archive_Date) FILTER (WHERE Archive_Date < (SELECT max(Archive_Date) FROM faculty)) AS previous FROM faculty),
old AS (SELECT DISTINCT Title, Location, Institution FROM faculty, two WHERE Archive_Date = previous)
SELECT n.Title, n.Institution, n.Location, n.Category, n.Link, n.Posted_Date, n.Job_Type, n.Archive_Date,
       'Faculty/instructor (non-adjunct)' AS Appointment FROM faculty n, two WHERE Archive_Date = latest
  AND Job_Type = 'Instructor/Teacher/Faculty' AND NOT EXISTS (SELECT 1 FROM old WHERE old.Title = n.Title
    AND old.Location IS NOT DISTINCT FROM n.Location AND old.Institution = n.Institution)""",
)
def he_new_by_appointment(spark: SparkSession, d: str) -> DataFrame:
    faculty = higher_ed.with_appointment(higher_ed.faculty_rows(he_rows(spark, d)))
    return views.he_new(faculty, rules.FACULTY_APPOINTMENT)


@query(
    "faculty_totals",
    f"""WITH {_HE_SQL}
SELECT count(*) FILTER (WHERE Appointment = 'Faculty/instructor (non-adjunct)') AS faculty_instructor,
       count(*) FILTER (WHERE Appointment = 'Adjunct/part-time faculty') AS adjunct_part_time FROM he JOIN titles USING (Title)""",
)
def faculty_totals(spark: SparkSession, d: str) -> DataFrame:
    return views.faculty_totals(he_rows(spark, d))


# -- headline figures --------------------------------------------------------


@query(
    "side_kpis",
    f"""WITH {HE_SQL}, t AS (SELECT Archive_Date AS day, count(*) AS n FROM he GROUP BY 1),
m AS (SELECT max(day) AS latest, max(day) FILTER (WHERE day <= (SELECT max(day) FROM t) - 5) AS prior FROM t)
SELECT (SELECT count(*) FROM he, m WHERE Archive_Date = latest) AS open_postings, latest AS latest_date, prior AS prior_date,
       a.n - b.n AS delta, (SELECT array_to_string(list(n ORDER BY day), ',') FROM t WHERE day > (SELECT max(day) FROM t) - 12) AS series
FROM m JOIN t a ON a.day = latest JOIN t b ON b.day = prior""",
)
def side_kpis(spark: SparkSession, d: str) -> DataFrame:
    rows = he_rows(spark, d)
    kpis = views.side_kpis(higher_ed.institution_totals(rows), at_latest(rows))
    return kpis.withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


@query(
    "top_hiring",
    f"""WITH {HE_SQL}, t AS (SELECT Institution, Archive_Date AS day, count(*) AS n FROM he GROUP BY ALL),
top AS (SELECT Institution, count(*) AS open_postings FROM he GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
s AS (SELECT Institution, array_to_string(list(n ORDER BY day), ',') AS series FROM (
  SELECT *, row_number() OVER (PARTITION BY Institution ORDER BY day DESC) AS r FROM t) WHERE r <= 12 GROUP BY Institution)
SELECT Institution, open_postings, series FROM top JOIN s USING (Institution)""",
)
def top_hiring(spark: SparkSession, d: str) -> DataFrame:
    rows = he_rows(spark, d)
    top = views.top_hiring(rows, higher_ed.institution_totals(rows), "Institution")
    return top.withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


# -- entity map and summaries ------------------------------------------------


def _county(n: Column) -> list[Column]:
    return [
        (n % 7 * 500.0 + 41000).alias("Median_Household_Income"), (n % 7 * 10.0 + 700).alias("Median_Gross_Rent"),
        (n % 7 / 100).alias("Mining_Employment_Share"), (n % 7 / 100 - 0.03).alias("Population_Change_Pct"),
        F.lit(2023).alias("ACS_Year"),
    ]


_COUNTY_SQL = """n % 7 * 500.0::DOUBLE + 41000 AS Median_Household_Income, n % 7 * 10.0::DOUBLE + 700 AS Median_Gross_Rent,
    (n % 7) / 100::DOUBLE AS Mining_Employment_Share, (n % 7) / 100::DOUBLE - 0.03::DOUBLE AS Population_Change_Pct, 2023 AS ACS_Year"""


def _dollars_sql(x: str, suffix: str = "") -> str:
    return f"'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) || '{suffix}'"


def _percent_sql(x: str, signed: bool = False) -> str:
    sign = f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || " if signed else ""
    return f"{sign}printf('%.1f%%', round_even({x} * 1000, 0) / 10 + 0.0)"


_COUNTY_SUMMARY = f"""{_dollars_sql("Median_Household_Income")} AS "County Median Income", {_dollars_sql("Median_Gross_Rent", "/mo")} AS "County Median Rent",
       {_percent_sql("Mining_Employment_Share")} AS "County Mining/Energy Jobs", {_percent_sql("Population_Change_Pct", True)} AS "County Population Trend (5yr)\""""


def _district_registry(spark: SparkSession, d: str) -> DataFrame:
    """Context of each district seen in the events, from its number."""
    n = F.col("n")
    return (
        events(spark, d)
        .select((F.col("user_id") % 40).alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("District "), n).alias("District"),
            F.concat(F.lit("County "), n % 7).alias("County"),
            F.concat(F.lit("https://d.example/"), n).alias("Job_Link"),
            (n * 3).cast("double").alias("Teachers_Total_FTE"),
            (n * 100).cast("double").alias("Enrollment"),
            F.when(n % 3 != 0, n * 1000.0 + 40000).alias("Teacher_Avg_Salary"),
            F.lit("2023-24").alias("Salary_Year"),
            (n * 100.0 + 30000).alias("Teacher_Salary_10th_Pctile"),
            (n * 2000.0 + 50000).alias("Teacher_Salary_90th_Pctile"),
            (n * 125000.0 + 1).alias("Total_General_Fund_Expenditure"),
            F.lit("2024").alias("Finance_FY"),
            (n / 100).alias("Child_Poverty_Rate"),
            *_county(n),
        )
    )


def _institution_registry(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return (
        events(spark, d)
        .select((F.col("user_id") % 25).alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("College "), n).alias("Name"),
            F.concat(F.lit("County "), n % 7).alias("County"),
            F.concat(F.lit("https://c.example/"), n).alias("Link"),
            (n * 2).cast("double").alias("Faculty_Count"),
            (n * 50).cast("double").alias("Enrollment"),
            (n * 0.001 - 0.01).alias("Enrollment_Change_Pct"),
            F.lit("2024").alias("Salary_Year"),
            (n * 1000.0 + 60000).alias("Faculty_Avg_Salary"),
            (n * 900.0 + 59000).alias("Faculty_Avg_Salary_Y1Ago"),
            F.when(n % 2 == 0, n * 800.0 + 58000).alias("Faculty_Avg_Salary_Y2Ago"),
            (n * 1500.0 + 80000).alias("Faculty_Avg_Salary_Professor"),
            (n / 50).alias("Pell_Recipient_Share"),
            F.lit("2022").alias("Pell_Year"),
            *_county(n),
        )
    )


def _districts(spark: SparkSession, d: str) -> DataFrame:
    postings = settled(k12.current_postings(k12.identify(k12_rows(spark, d))))
    return views.district_map(_district_registry(spark, d), at_latest(postings), k12.teacher_rows(postings))


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    postings = he_rows(spark, d)
    faculty = settled(higher_ed.faculty_rows(postings))
    return views.institution_map(_institution_registry(spark, d), at_latest(postings), faculty)


# Both sides in one statement: events are defined once, the title tables under two names.
_HE_WITHOUT_EVENTS = (
    _HE_SQL.removeprefix(EVENTS_SQL + ", ").replace("titles AS", "he_titles AS").replace("JOIN titles", "JOIN he_titles")
)
_MAP_SQL = f"""{_TEACHERS_SQL}, {_HE_WITHOUT_EVENTS},
kd AS (SELECT max(Archive_Date) AS latest, max(Archive_Date) FILTER (WHERE Archive_Date < (SELECT max(Archive_Date) FROM teachers)) AS previous FROM teachers),
hd AS (SELECT max(Archive_Date) AS latest, max(Archive_Date) FILTER (WHERE Archive_Date < (SELECT max(Archive_Date) FROM faculty)) AS previous FROM faculty),
dreg AS (SELECT DISTINCT user_id % 40 AS n FROM ev), ireg AS (SELECT DISTINCT user_id % 25 AS n FROM ev),
know AS (SELECT * FROM kept WHERE Archive_Date = (SELECT max(Archive_Date) FROM kept)),
hnow AS (SELECT * FROM he WHERE Archive_Date = (SELECT max(Archive_Date) FROM he)),
dc AS (SELECT District AS e, count(*) AS c FROM know GROUP BY 1),
dt AS (SELECT District AS e, string_agg(title, '; ' ORDER BY title) AS s FROM (
  SELECT District, title FROM know QUALIFY row_number() OVER (PARTITION BY District ORDER BY title) <= 3) GROUP BY 1),
dn AS (SELECT District AS e, count(*) AS c FROM teachers, kd WHERE Archive_Date = latest AND Posting_ID NOT IN (
  SELECT Posting_ID FROM teachers, kd WHERE Archive_Date = previous) GROUP BY 1),
dv AS (SELECT District AS e, count(DISTINCT Posting_ID) AS c FROM teachers, kd WHERE Archive_Date = latest GROUP BY 1),
ic AS (SELECT Institution AS e, count(*) AS c FROM hnow GROUP BY 1),
it AS (SELECT Institution AS e, string_agg(Title, '; ' ORDER BY Title) AS s FROM (
  SELECT Institution, Title FROM hnow QUALIFY row_number() OVER (PARTITION BY Institution ORDER BY Title) <= 3) GROUP BY 1),
nw AS (SELECT n.Institution AS e, count(*) AS c FROM faculty n, hd WHERE Archive_Date = latest AND NOT EXISTS (
  SELECT 1 FROM faculty o, hd h2 WHERE o.Archive_Date = h2.previous AND o.Title = n.Title
    AND o.Location IS NOT DISTINCT FROM n.Location AND o.Institution = n.Institution) GROUP BY 1),
iv AS (SELECT Institution AS e, count(*) AS c FROM faculty, hd WHERE Archive_Date = latest AND Job_Type = 'Instructor/Teacher/Faculty' GROUP BY 1),
m AS (SELECT 'District ' || n AS Name, 'K-12 District' AS Type, 'County ' || (n % 7) AS County, 'https://d.example/' || n AS Link,
    coalesce(dc.c, 0) AS CurrentCount, coalesce(dn.c, 0) AS WeeklyNew, coalesce(dt.s, '') AS SampleTitles,
    coalesce(dv.c, 0) AS Vacancy_Numerator, CAST(n * 3 AS DOUBLE) AS Vacancy_Denominator, CAST(n * 100 AS DOUBLE) AS Enrollment,
    CASE WHEN n % 3 <> 0 THEN CAST(n * 1000 + 40000 AS DOUBLE) END AS salary, CAST(NULL AS DOUBLE) AS change, n
  FROM dreg LEFT JOIN dc ON dc.e = 'District ' || n LEFT JOIN dt ON dt.e = 'District ' || n LEFT JOIN dn ON dn.e = 'District ' || n
    LEFT JOIN dv ON dv.e = 'District ' || n
  UNION ALL SELECT 'College ' || n, 'Higher Ed Institution', 'County ' || (n % 7), 'https://c.example/' || n,
    coalesce(ic.c, 0), coalesce(nw.c, 0), coalesce(it.s, ''), coalesce(iv.c, 0), CAST(n * 2 AS DOUBLE), CAST(n * 50 AS DOUBLE),
    CAST(n * 1000 + 60000 AS DOUBLE), n * 0.001 - 0.01, n
  FROM ireg LEFT JOIN ic ON ic.e = 'College ' || n LEFT JOIN it ON it.e = 'College ' || n LEFT JOIN nw ON nw.e = 'College ' || n
    LEFT JOIN iv ON iv.e = 'College ' || n),
rated AS (SELECT *, {_COUNTY_SQL}, CASE WHEN Vacancy_Denominator >= 10 THEN Vacancy_Numerator / Vacancy_Denominator END AS Vacancy_Rate,
    CASE WHEN Vacancy_Denominator > 0 THEN Enrollment / Vacancy_Denominator END AS Students_Per_Teacher FROM m)"""


def _map_columns_sql() -> str:
    """Every column of the map; what neither registry has is null."""
    k12 = lambda x: f"CASE WHEN Type = 'K-12 District' THEN {x} END"
    he = lambda x: f"CASE WHEN Type <> 'K-12 District' THEN {x} END"
    own = {
        "Teacher_Avg_Salary": k12("salary"), "Teacher_Salary_10th_Pctile": k12("n * 100.0::DOUBLE + 30000"),
        "Teacher_Salary_90th_Pctile": k12("n * 2000.0::DOUBLE + 50000"), "Salary_Year": "CASE WHEN Type = 'K-12 District' THEN '2023-24' ELSE '2024' END",
        "Total_General_Fund_Expenditure": k12("n * 125000.0::DOUBLE + 1"), "Finance_FY": k12("'2024'"), "Child_Poverty_Rate": k12("n / 100::DOUBLE"),
        "Faculty_Avg_Salary": he("salary"), "Faculty_Avg_Salary_Y1Ago": he("n * 900.0::DOUBLE + 59000"),
        "Faculty_Avg_Salary_Y2Ago": he("CASE WHEN n % 2 = 0 THEN n * 800.0::DOUBLE + 58000 END"),
        "Faculty_Avg_Salary_Professor": he("n * 1500.0::DOUBLE + 80000"), "Faculty_Count": he("n * 2.0::DOUBLE"),
        "Pell_Recipient_Share": he("n / 50::DOUBLE"), "Pell_Year": he("'2022'"), "Enrollment_Change_Pct": "round(CAST(change AS DOUBLE), 9)",
        "Vacancy_Rate": "round(Vacancy_Rate, 9)", "Students_Per_Teacher": "round(Students_Per_Teacher, 9)", "Population_Change_Pct": "round(Population_Change_Pct, 9)",
    }
    given = {
        "Name", "Type", "County", "Link", "CurrentCount", "WeeklyNew", "SampleTitles", "Vacancy_Numerator", "Vacancy_Denominator", "Enrollment",
        "Median_Household_Income", "Median_Gross_Rent", "Mining_Employment_Share", "ACS_Year",
    }
    kinds = {"double": "DOUBLE", "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER"}
    return ", ".join(
        f"{own[f.name]} AS {f.name}" if f.name in own else f.name if f.name in given else f"CAST(NULL AS {kinds[f.dataType.simpleString()]}) AS {f.name}"
        for f in ENTITY_MAP.fields
    )


_ROUNDED = ("Vacancy_Rate", "Students_Per_Teacher", "Marker_Radius", "Population_Change_Pct", "Enrollment_Change_Pct")


@query(
    "entity_map",
    f"""WITH {_MAP_SQL}
SELECT {_map_columns_sql()}, round(least(24.0, 6.0 + 1.2 * sqrt(CurrentCount)), 9) AS Marker_Radius FROM rated""",
)
def entity_map(spark: SparkSession, d: str) -> DataFrame:
    """Districts and institutions with counts, sample titles, new postings, vacancy rates and context."""
    entities = views.entity_map(_districts(spark, d), _institutions(spark, d))
    return entities.withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query(
    "vacancy_leaders",
    f"""WITH {_MAP_SQL}
SELECT Name, Vacancy_Numerator, Vacancy_Denominator, round(Vacancy_Rate, 9) AS Vacancy_Rate,
       printf('%.1f%%', round_even(Vacancy_Rate * 1000, 0) / 10) AS Rate_Text
FROM rated WHERE Type = 'K-12 District' AND Vacancy_Rate IS NOT NULL ORDER BY rated.Vacancy_Rate DESC, Name LIMIT 8""",
)
def vacancy_leaders(spark: SparkSession, d: str) -> DataFrame:
    leaders = views.vacancy_leaders(_districts(spark, d), views.K12_TYPE)
    return leaders.withColumn("Vacancy_Rate", F.round("Vacancy_Rate", 9))


@query(
    "vacancy_domain",
    f"""WITH {_MAP_SQL}
SELECT round(coalesce(min(Vacancy_Rate), 0), 9) AS low, round(coalesce(max(Vacancy_Rate), 1), 9) AS high
FROM rated WHERE Type = 'Higher Ed Institution'""",
)
def vacancy_domain(spark: SparkSession, d: str) -> DataFrame:
    domain = views.vacancy_domain(_institutions(spark, d))
    return domain.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    "district_summary",
    f"""WITH {_MAP_SQL}
SELECT Name AS "District", County, CurrentCount AS "Current Openings", WeeklyNew AS "New This Week",
       {_percent_sql("Vacancy_Rate")} AS "Teacher Vacancy Rate", Enrollment,
       printf('%.1f', round_even(Students_Per_Teacher * 10, 0) / 10) AS "Students per Teacher",
       {_dollars_sql("salary")} AS "Teacher Avg Salary (2023-24)",
       {_dollars_sql("(n * 100 + 30000)::DOUBLE")} || ' - ' || {_dollars_sql("(n * 2000 + 50000)::DOUBLE")} AS "Teacher Salary Range (10th-90th %ile)",
       {_dollars_sql("(n * 125000 + 1)::DOUBLE")} AS "General Fund Expenditure (FY2024)", {_COUNTY_SUMMARY},
       {_percent_sql("(n / 100::DOUBLE)")} AS "District Child Poverty Rate"
FROM rated WHERE Type = 'K-12 District'""",
)
def district_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.district_summary(settled(_districts(spark, d)))


@query(
    "institution_summary",
    f"""WITH {_MAP_SQL}, split AS (SELECT Institution, count(*) FILTER (WHERE Appointment = 'Faculty/instructor (non-adjunct)') AS f,
    count(*) FILTER (WHERE Appointment = 'Adjunct/part-time faculty') AS a FROM hnow JOIN he_titles USING (Title) GROUP BY 1)
SELECT Name AS "Institution", County, CurrentCount AS "Current Openings", coalesce(f, 0) AS "Faculty/instructor (non-adjunct)",
       coalesce(a, 0) AS "Adjunct/part-time faculty", WeeklyNew AS "New This Week",
       {_percent_sql("Vacancy_Rate")} AS "Faculty Vacancy Rate", {_dollars_sql("salary")} AS "Avg Faculty Salary (2024)",
       {_dollars_sql("(n * 900 + 59000)::DOUBLE")} AS "Avg Faculty Salary (2023)",
       CASE WHEN n % 2 = 0 THEN {_dollars_sql("(n * 800 + 58000)::DOUBLE")} END AS "Avg Faculty Salary (2022)",
       {_dollars_sql("(n * 1500 + 80000)::DOUBLE")} AS "Professor Avg Salary (2024)", n * 2.0::DOUBLE AS "Faculty Count", Enrollment,
       printf('%.1f', round_even(Students_Per_Teacher * 10, 0) / 10) AS "Students per Faculty",
       {_percent_sql("change", True)} AS "Enrollment Trend (5yr)",
       {_percent_sql("(n / 50::DOUBLE)")} || ' (2022)' AS "Pell Grant Recipient Share", {_COUNTY_SUMMARY}
FROM rated LEFT JOIN split ON Institution = Name WHERE Type = 'Higher Ed Institution'""",
)
def institution_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.institution_summary(settled(_institutions(spark, d)), at_latest(he_rows(spark, d)))


# -- context -----------------------------------------------------------------


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unitid"), F.col("c_name").alias("Name"))


def _enrollment_survey(spark: SparkSession, d: str) -> DataFrame:
    """Orders as enrolment records: one status reports -1, the other figure is a fallback."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("unitid"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "F", F.lit(-1.0)).otherwise(F.floor("o_totalprice").cast("double")).alias("est_fte"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(7.0)).otherwise(F.lit(-2.0)).alias("rep_fte"),
    )


_SURVEY_SQL = """survey AS (SELECT o_custkey AS unitid, year(o_orderdate) AS year,
    CASE WHEN o_orderstatus <> 'F' THEN floor(o_totalprice) WHEN o_orderkey % 2 = 0 THEN 7.0 END AS fte FROM orders),
totals AS (SELECT unitid, year, sum(fte) AS e FROM survey GROUP BY ALL)"""


@query(
    "enrollment",
    f"""WITH {_SURVEY_SQL}
SELECT c_name AS Name, e AS Enrollment, '2000' AS Enrollment_Year FROM customer LEFT JOIN totals ON unitid = c_custkey AND year = 2000""",
)
def enrollment(spark: SparkSession, d: str) -> DataFrame:
    return context.enrollment(_enrollment_survey(spark, d).filter("year = 2000"), _ids(spark, d), 2000)


@query(
    "enrollment_trend",
    f"""WITH {_SURVEY_SQL}
SELECT c_name AS Name, round(CASE WHEN b.e > 0 THEN (a.e - b.e) / b.e END, 6) AS Enrollment_Change_Pct
FROM customer LEFT JOIN totals a ON a.unitid = c_custkey AND a.year = 2000 LEFT JOIN totals b ON b.unitid = c_custkey AND b.year = 1995""",
)
def enrollment_trend(spark: SparkSession, d: str) -> DataFrame:
    change = context.enrollment_trend(_enrollment_survey(spark, d), _ids(spark, d), 2000)
    return change.withColumn("Enrollment_Change_Pct", F.round("Enrollment_Change_Pct", 6))


@query(
    "same_year_ratio",
    f"""WITH {_SURVEY_SQL}, g AS (SELECT c_custkey AS unitid, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS r FROM customer)
SELECT c_name AS Name, round(CASE WHEN e > 0 THEN r / e END, 9) AS Pell_Recipient_Share, '1999' AS Pell_Year
FROM customer JOIN g ON g.unitid = c_custkey LEFT JOIN totals ON totals.unitid = c_custkey AND year = 1999""",
)
def same_year_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Grants of the newest landed year (1999) over the enrolment of that year."""
    grants = table(spark, d, "customer").select(
        F.col("c_custkey").alias("unitid"),
        F.explode(F.array(F.struct(F.lit(4).alias("t"), F.lit(1999).alias("y")), F.struct(F.lit(1).alias("t"), F.lit(1998).alias("y")))).alias("g"),
        F.col("c_acctbal").alias("grant_recipients_unitid"),
    ).select("unitid", F.col("g.t").alias("grant_type"), F.col("g.y").alias("year"), "grant_recipients_unitid")
    share = context.same_year_pell_share(grants, _enrollment_survey(spark, d), _ids(spark, d), 2003)
    return share.withColumn("Pell_Recipient_Share", F.round("Pell_Recipient_Share", 9))


def _salary_survey(spark: SparkSession, d: str) -> DataFrame:
    """One record per customer, year and rank (99 = all, 1 = professor)."""
    yearly = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unitid"), F.year("o_orderdate").alias("year"))
    paid = yearly.agg(F.round(F.max("o_totalprice"), 2).alias("pay"), F.count(F.lit(1)).alias("n"))
    rank = F.explode(F.array(F.lit(99), F.lit(1)))
    return paid.select("unitid", "year", rank.alias("academic_rank"), "pay", "n").select(
        "unitid", "year", "academic_rank", F.lit(99).alias("contract_length"), F.lit(99).alias("sex"),
        F.when(F.col("academic_rank") == 99, F.col("pay")).when(F.col("unitid") % 3 != 0, F.col("pay") * 2).otherwise(F.lit(-1.0)).alias("average_salary"),
        F.when(F.col("n") > 1, F.col("n").cast("double")).otherwise(F.lit(-2.0)).alias("instruc_staff_count"),
    )


_SALARY_SQL = """pay AS (SELECT o_custkey AS unitid, year(o_orderdate) AS year, round(max(o_totalprice), 2) AS pay, count(*) AS n FROM orders GROUP BY ALL)"""


@query(
    "faculty_salaries",
    f"""WITH {_SALARY_SQL}
SELECT c_name AS Name, pay AS Faculty_Avg_Salary, CASE WHEN c_custkey % 3 <> 0 THEN pay * 2 END AS Faculty_Avg_Salary_Professor,
       CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END AS Faculty_Count, '2000' AS Salary_Year
FROM customer LEFT JOIN pay ON unitid = c_custkey AND year = 2000""",
)
def faculty_salaries(spark: SparkSession, d: str) -> DataFrame:
    return context.faculty_salaries(_salary_survey(spark, d).filter("year = 2000"), _ids(spark, d), 2000)


@query(
    "salary_trend",
    f"""WITH {_SALARY_SQL}
SELECT c_name AS Name, CAST(y AS INTEGER) AS Year, pay AS Faculty_Avg_Salary
FROM customer CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS y) LEFT JOIN pay ON unitid = c_custkey AND year = y""",
)
def salary_trend(spark: SparkSession, d: str) -> DataFrame:
    return context.salary_trend(_salary_survey(spark, d), _ids(spark, d), 2000)


@query(
    "teacher_staffing",
    """WITH x AS (SELECT r_name AS entity, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey),
s AS (SELECT s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS fte, CAST(s_suppkey AS DOUBLE) AS e FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT entity AS District, CASE WHEN count(s_nationkey) > 0 THEN round(coalesce(sum(fte), 0), 2) END AS Teachers_Total_FTE,
       CASE WHEN count(s_nationkey) > 0 THEN sum(e) END AS Enrollment, 2023 AS CCD_Year
FROM x LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY entity""",
)
def teacher_staffing(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as school agencies: only regular ones with schools count."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    crosswalk = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("entity"), F.col("n_nationkey").cast("string").alias("source_name")
    )
    key = F.col("s_suppkey")
    directory = table(spark, d, "supplier").select(
        F.concat(F.lit(" "), F.col("s_nationkey")).alias("lea_name"),
        F.when(key % 10 == 0, 4).otherwise(1).alias("agency_type"),
        F.when(key % 10 == 5, 0).otherwise(2).alias("number_of_schools"),
        F.col("s_acctbal").alias("teachers_total_fte"), key.cast("double").alias("enrollment"),
    )
    staffing = context.teacher_staffing(directory, crosswalk, 2023)
    return staffing.withColumn("Teachers_Total_FTE", F.round("Teachers_Total_FTE", 2))


@query(
    "child_poverty",
    """WITH x AS (SELECT r_name AS entity, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey),
g AS (SELECT c_nationkey AS n, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS rate FROM customer
  UNION ALL SELECT s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal / 100 END FROM supplier)
SELECT entity AS District, round(avg(rate), 6) AS Child_Poverty_Rate, 2023 AS SAIPE_Year FROM x LEFT JOIN g ON n = n_nationkey GROUP BY entity""",
)
def child_poverty(spark: SparkSession, d: str) -> DataFrame:
    """Two geographies united, percent text to share, plain mean per entity."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    crosswalk = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("entity"), F.col("n_nationkey").cast("string").alias("source_name")
    )

    def geography(name: str, key: str, rate: str) -> DataFrame:
        return table(spark, d, name).select(
            F.concat(F.col(key).cast("string"), F.lit(" ")).alias("SD_NAME"), F.col(rate).cast("string").alias(context.POVERTY_RATE)
        )

    both = [geography("customer", "c_nationkey", "c_acctbal"), geography("supplier", "s_nationkey", "s_acctbal")]
    return context.child_poverty(both, crosswalk, 2023).withColumn("Child_Poverty_Rate", F.round("Child_Poverty_Rate", 6))


@query(
    "county_context",
    """SELECT c_name AS County, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS Median_Household_Income, CAST(c_nationkey AS DOUBLE) AS Median_Gross_Rent,
       CAST(c_custkey + 100 AS DOUBLE) AS Population, 2022 AS ACS_Year,
       round(CASE WHEN c_nationkey > 0 THEN 1.0 / c_nationkey END, 9) AS Mining_Employment_Share,
       round(CASE WHEN c_mktsegment <> 'BUILDING' AND c_custkey > 0 THEN 100.0 / c_custkey END, 9) AS Population_Change_Pct
FROM customer""",
)
def county_context(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    name, key = F.concat("c_name", F.lit(", State")).alias("NAME"), F.col("c_custkey").cast("double")
    detail = customer.select(
        name, F.col("c_acctbal").alias(context.INCOME), F.col("c_nationkey").cast("double").alias(context.RENT),
        (key + 100).alias(context.POPULATION),
    )
    prior = customer.filter("c_mktsegment <> 'BUILDING'").select(
        name, F.lit(0.0).alias(context.INCOME), F.lit(0.0).alias(context.RENT), key.alias(context.POPULATION)
    )
    subject = customer.select(
        name, F.col("c_nationkey").cast("double").alias(context.WORKERS), F.lit(1.0).alias(context.MINING_WORKERS)
    )
    built = context.county_context(detail, prior, subject, 2022, "State")
    for c in ("Mining_Employment_Share", "Population_Change_Pct"):
        built = built.withColumn(c, F.round(c, 9))
    return built


@query(
    "institution_context",
    f"""WITH {_SURVEY_SQL}, {_SALARY_SQL}
SELECT c_name AS Name, 'County ' || c_nationkey AS County, p0.pay AS Faculty_Avg_Salary, p1.pay AS Faculty_Avg_Salary_Y1Ago,
       p2.pay AS Faculty_Avg_Salary_Y2Ago, e AS Enrollment, 'kept' AS Pell_Year
FROM customer LEFT JOIN pay p0 ON p0.unitid = c_custkey AND p0.year = 2000 LEFT JOIN pay p1 ON p1.unitid = c_custkey AND p1.year = 1999
  LEFT JOIN pay p2 ON p2.unitid = c_custkey AND p2.year = 1998 LEFT JOIN totals ON totals.unitid = c_custkey AND totals.year = 2000""",
)
def institution_context(spark: SparkSession, d: str) -> DataFrame:
    """Fresh salary, trend and enrolment; the grants did not land, so the last good year stays."""
    customer, ids = table(spark, d, "customer"), _ids(spark, d)
    registry = customer.select(
        F.col("c_name").alias("Institution"), F.concat(F.lit("County "), F.col("c_nationkey")).alias("County"),
        F.lit(0.0).alias("Longitude"), F.lit(0.0).alias("Latitude"), F.lit("https://x.example").alias("Job_Link"),
    )
    previous = ids.select("Name", F.lit(0.5).alias("Pell_Recipient_Share"), F.lit("kept").alias("Pell_Year"), F.lit(-1.0).alias("Enrollment"))
    salaries, enrolled = _salary_survey(spark, d), _enrollment_survey(spark, d)
    landed = context.InstitutionSources(
        salary=context.faculty_salaries(salaries.filter("year = 2000"), ids, 2000),
        salary_trend=context.salary_trend(salaries, ids, 2000),
        enrollment=context.enrollment(enrolled.filter("year = 2000"), ids, 2000),
        pell=context.pell_share(
            salaries.filter(F.lit(False)).select("unitid", F.lit(4).alias("grant_type"), F.lit(1.0).alias("grant_recipients_unitid")),
            context.enrollment(enrolled, ids, 0), ids, 3000,
        ),
    )
    built = context.institution_context(registry, previous, landed)
    return built.select(
        "Name", "County", "Faculty_Avg_Salary", "Faculty_Avg_Salary_Y1Ago", "Faculty_Avg_Salary_Y2Ago", "Enrollment", "Pell_Year"
    )


@query(
    "district_context",
    """WITH x AS (SELECT n_name, n_nationkey FROM nation)
SELECT n_name AS District, 'County ' || n_regionkey AS County, round(sum(CASE WHEN s_acctbal >= 0 THEN s_acctbal END), 2) AS Teachers_Total_FTE,
       any_value(CASE WHEN n_regionkey <> 2 THEN 0.25::DOUBLE END) AS Child_Poverty_Rate, 'FY0' AS Finance_FY
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_regionkey""",
)
def district_context(spark: SparkSession, d: str) -> DataFrame:
    """Staffing landed, poverty landed for some, finance did not land at all."""
    nation = table(spark, d, "nation")
    registry = nation.select(
        F.col("n_name").alias("District"), F.concat(F.lit("County "), F.col("n_regionkey")).alias("County"),
        F.lit(0.0).alias("Latitude"), F.lit(0.0).alias("Longitude"), F.lit("https://x.example").alias("Job_Link"),
    )
    previous = nation.select(
        F.col("n_name").alias("District"), F.lit("Old").alias("County"), F.lit(0.9).alias("Child_Poverty_Rate"),
        F.lit("FY0").alias("Finance_FY"), F.lit(1.0).alias("Total_General_Fund_Expenditure"),
    )
    crosswalk = nation.select(F.col("n_name").alias("entity"), F.col("n_nationkey").cast("string").alias("source_name"))
    directory = table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("lea_name"), F.lit(1).alias("agency_type"), F.lit(1).alias("number_of_schools"),
        F.col("s_acctbal").alias("teachers_total_fte"), F.lit(5.0).alias("enrollment"),
    )
    ledger = table(spark, d, "customer").filter(F.lit(False)).select(
        F.lit("01").alias("FundCode"), F.col("c_name").alias("DistrictName"), F.lit("FY1").alias("StateFY"), F.lit("1").alias("SumOfAmount")
    )
    landed = context.DistrictSources(
        staffing=context.teacher_staffing(directory, crosswalk, 2023),
        poverty=nation.filter("n_regionkey <> 2").select(
            F.col("n_name").alias("District"), F.lit(0.25).alias("Child_Poverty_Rate"), F.lit(2023).alias("SAIPE_Year")
        ),
        finance=context.general_fund_expenditure(ledger, crosswalk),
    )
    built = context.district_context(registry, previous, landed)
    return built.select("District", "County", F.round("Teachers_Total_FTE", 2).alias("Teachers_Total_FTE"), "Child_Poverty_Rate", "Finance_FY")


def _counties(spark: SparkSession, d: str) -> DataFrame:
    """County figures from the regions, through the census grids."""
    region, key = table(spark, d, "region"), F.col("r_regionkey").cast("double")
    name = F.concat(F.lit("County "), F.col("r_regionkey"), F.lit(", State")).alias("NAME")

    def grid(people: Column) -> DataFrame:
        return region.select(name, (key * 1000 + 40000).alias(context.INCOME), (key * 10 + 700).alias(context.RENT), people.alias(context.POPULATION))

    jobs = region.select(name, (key + 50).alias(context.WORKERS), key.alias(context.MINING_WORKERS))
    return context.county_context(grid(key * 10 + 1000), grid(F.lit(800.0)), jobs, 2022, "State")


_COUNTIES_SQL = """c AS (SELECT 'County ' || r_regionkey AS County, r_regionkey * 1000.0::DOUBLE + 40000 AS Median_Household_Income,
    r_regionkey * 10.0::DOUBLE + 700 AS Median_Gross_Rent, round(r_regionkey::DOUBLE / (r_regionkey + 50), 9) AS Mining_Employment_Share,
    round((r_regionkey * 10.0::DOUBLE + 1000 - 800) / 800, 9) AS Population_Change_Pct, 2022 AS ACS_Year FROM region)"""
_COUNTY_RATIOS = ("Mining_Employment_Share", "Population_Change_Pct")


@query(
    "district_context_landed",
    f"""WITH {_COUNTIES_SQL}, staff AS (SELECT s_nationkey AS k, round(sum(CASE WHEN s_acctbal >= 0 THEN s_acctbal END), 2) AS fte, count(*) * 5.0::DOUBLE AS e FROM supplier GROUP BY 1),
poor AS (SELECT c_nationkey AS k, round(avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END), 6) AS rate FROM customer GROUP BY 1),
spent AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT n_name AS District, c.County, 0.0::DOUBLE AS Latitude, 0.0::DOUBLE AS Longitude, 'https://x.example' AS Job_Link,
       n_nationkey * 10.0::DOUBLE AS Teacher_Count, 1.0::DOUBLE AS Teacher_Salary_10th_Pctile, 2.0::DOUBLE AS Teacher_Avg_Salary, 3.0::DOUBLE AS Teacher_Salary_90th_Pctile,
       '2023-24' AS Salary_Year, '{context.SALARY_TAG}' AS Salary_Source, coalesce(fte, CASE WHEN e > 0 THEN 0 END) AS Teachers_Total_FTE, e AS Enrollment, 2023 AS CCD_Year,
       '{context.STAFFING_TAG}' AS CCD_Source, Median_Household_Income, Median_Gross_Rent, Mining_Employment_Share, Population_Change_Pct, ACS_Year,
       rate AS Child_Poverty_Rate, 2022 AS SAIPE_Year, total AS Total_General_Fund_Expenditure, 'FY25' AS Finance_FY, '{context.FINANCE_TAG}' AS Finance_Source
FROM nation JOIN c ON c.County = 'County ' || n_regionkey LEFT JOIN staff ON staff.k = n_nationkey LEFT JOIN poor ON poor.k = n_nationkey LEFT JOIN spent ON spent.k = n_nationkey""",
)
def district_context_landed(spark: SparkSession, d: str) -> DataFrame:
    """All five groups landed, all columns: nothing of the previous table is left."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    registry = nation.select(
        F.col("n_name").alias("District"), F.concat(F.lit("County "), F.col("n_regionkey")).alias("County"),
        F.lit(0.0).alias("Latitude"), F.lit(0.0).alias("Longitude"), F.lit("https://x.example").alias("Job_Link"),
    )
    previous = nation.select(
        F.col("n_name").alias("District"), F.lit("FY0").alias("Finance_FY"), F.lit(-1.0).alias("Enrollment"), F.lit("1999").alias("Salary_Year")
    )
    crosswalk = nation.select(F.col("n_name").alias("entity"), F.col("n_nationkey").cast("string").alias("source_name"))
    directory = table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("lea_name"), F.lit(1).alias("agency_type"), F.lit(1).alias("number_of_schools"),
        F.col("s_acctbal").alias("teachers_total_fte"), F.lit(5.0).alias("enrollment"),
    )
    poverty = customer.select(F.col("c_nationkey").cast("string").alias("SD_NAME"), F.col("c_acctbal").cast("string").alias(context.POVERTY_RATE))
    ledger = customer.select(
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("01")).otherwise(F.lit("1")).alias("FundCode"),
        F.col("c_nationkey").cast("string").alias("DistrictName"), F.lit("FY25").alias("StateFY"), F.col("c_acctbal").cast("string").alias("SumOfAmount"),
    )
    landed = context.DistrictSources(
        salary=nation.select(
            F.col("n_name").alias("District"), (F.col("n_nationkey") * 10.0).alias("Teacher_Count"), F.lit(1.0).alias("Teacher_Salary_10th_Pctile"),
            F.lit(2.0).alias("Teacher_Avg_Salary"), F.lit(3.0).alias("Teacher_Salary_90th_Pctile"), F.lit("2023-24").alias("Salary_Year"),
        ),
        staffing=context.teacher_staffing(directory, crosswalk, 2023),
        county=_counties(spark, d),
        poverty=context.child_poverty([poverty], crosswalk, 2022),
        finance=context.general_fund_expenditure(ledger, crosswalk),
    )
    built = conform(context.district_context(registry, previous, landed), DISTRICT_CONTEXT)
    places = {"Teachers_Total_FTE": 2, "Child_Poverty_Rate": 6, "Total_General_Fund_Expenditure": 2} | dict.fromkeys(_COUNTY_RATIOS, 9)
    return built.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(
    "institution_context_landed",
    f"""WITH {_SURVEY_SQL}, {_SALARY_SQL}, {_COUNTIES_SQL}, g AS (SELECT c_custkey AS unitid, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS r FROM customer)
SELECT c_name AS Name, c.County, 0.0::DOUBLE AS Longitude, 0.0::DOUBLE AS Latitude, 'https://x.example' AS Link, p0.pay AS Faculty_Avg_Salary,
       CASE WHEN c_custkey % 3 <> 0 THEN p0.pay * 2 END AS Faculty_Avg_Salary_Professor, CASE WHEN p0.n > 1 THEN CAST(p0.n AS DOUBLE) END AS Faculty_Count,
       '2000' AS Salary_Year, '{context.HE_SALARY_TAG}' AS Salary_Source, p1.pay AS Faculty_Avg_Salary_Y1Ago, p2.pay AS Faculty_Avg_Salary_Y2Ago,
       t0.e AS Enrollment, '2000' AS Enrollment_Year, round(CASE WHEN t5.e > 0 THEN (t0.e - t5.e) / t5.e END, 6) AS Enrollment_Change_Pct,
       round(CASE WHEN t1.e > 0 THEN r / t1.e END, 9) AS Pell_Recipient_Share, '1999' AS Pell_Year,
       Median_Household_Income, Median_Gross_Rent, Mining_Employment_Share, Population_Change_Pct, ACS_Year
FROM customer JOIN c ON c.County = 'County ' || (c_nationkey % 5) JOIN g ON g.unitid = c_custkey
  LEFT JOIN pay p0 ON p0.unitid = c_custkey AND p0.year = 2000 LEFT JOIN pay p1 ON p1.unitid = c_custkey AND p1.year = 1999
  LEFT JOIN pay p2 ON p2.unitid = c_custkey AND p2.year = 1998 LEFT JOIN totals t0 ON t0.unitid = c_custkey AND t0.year = 2000
  LEFT JOIN totals t1 ON t1.unitid = c_custkey AND t1.year = 1999 LEFT JOIN totals t5 ON t5.unitid = c_custkey AND t5.year = 1995""",
)
def institution_context_landed(spark: SparkSession, d: str) -> DataFrame:
    """All six groups landed, all columns."""
    customer, ids = table(spark, d, "customer"), _ids(spark, d)
    registry = customer.select(
        F.col("c_name").alias("Institution"), F.concat(F.lit("County "), F.col("c_nationkey") % 5).alias("County"),
        F.lit(0.0).alias("Longitude"), F.lit(0.0).alias("Latitude"), F.lit("https://x.example").alias("Job_Link"),
    )
    previous = ids.select("Name", F.lit(0.5).alias("Pell_Recipient_Share"), F.lit("kept").alias("Pell_Year"), F.lit(-1.0).alias("Enrollment"))
    salaries, enrolled = _salary_survey(spark, d), _enrollment_survey(spark, d)
    grants = customer.select(
        F.col("c_custkey").alias("unitid"), F.lit(4).alias("grant_type"), F.lit(1999).alias("year"), F.col("c_acctbal").alias("grant_recipients_unitid")
    )
    landed = context.InstitutionSources(
        salary=context.faculty_salaries(salaries.filter("year = 2000"), ids, 2000),
        salary_trend=context.salary_trend(salaries, ids, 2000),
        enrollment=context.enrollment(enrolled.filter("year = 2000"), ids, 2000),
        enrollment_trend=context.enrollment_trend(enrolled, ids, 2000),
        pell=context.same_year_pell_share(grants, enrolled, ids, 2003),
        county=_counties(spark, d),
    )
    built = conform(context.institution_context(registry, previous, landed), INSTITUTION_CONTEXT)
    places = {"Enrollment_Change_Pct": 6, "Pell_Recipient_Share": 9} | dict.fromkeys(_COUNTY_RATIOS, 9)
    return built.withColumns({c: F.round(c, n) for c, n in places.items()})


# -- health ------------------------------------------------------------------


@query(
    "corroborated_drift",
    f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events), t AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT max(day) AS latest FROM t), b AS (SELECT user_id, count(*) AS w, avg(n) AS mean FROM t, m WHERE day < latest GROUP BY 1),
c AS (SELECT user_id, n FROM t, m WHERE day = latest),
f AS (SELECT user_id, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (user_id) WHERE w >= 2 AND coalesce(n, 0) <= mean * 0.2)
SELECT CAST(user_id AS VARCHAR) AS name, n AS count, url,
  {signal_sql('html')} AS signal
FROM f LEFT JOIN pages ON page_id = user_id""",
)
def corroborated_drift(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fell silent, with what their page says."""
    snapshots = events(spark, d).select(F.col("user_id").cast("string").alias("source"), F.col("day").alias("Archive_Date"))
    flagged = health.source_drift(snapshots, "source", valid_from=None)
    seen = table(spark, d, "pages")
    addresses = seen.select(F.col("page_id").cast("string").alias("name"), "url")
    texts = seen.select("url", visible_text("html").alias("text")).dropDuplicates(["url"])
    return health.corroborated(flagged, addresses, texts).select("name", "count", "url", "signal")


@query(
    "health_report",
    f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events), t AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT max(day) AS latest FROM t), b AS (SELECT user_id, count(*) AS w, avg(n) AS mean FROM t, m WHERE day < latest GROUP BY 1),
f AS (SELECT b.user_id, mean, coalesce(n, 0) AS n FROM b LEFT JOIN t ON t.user_id = b.user_id AND t.day = (SELECT latest FROM m)
  WHERE w >= 2 AND coalesce(n, 0) <= mean * 0.2), s AS (
  SELECT f.*, {signal_sql('html')} AS signal FROM f LEFT JOIN pages ON page_id = user_id), y AS (
  SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice)) AS t FROM orders GROUP BY 1, 2), p AS (
  SELECT a.o_custkey AS name, b.t AS prior, a.t AS current, (a.t - b.t) / b.t AS c
  FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.y = 2000 AND b.y = 1999 WHERE b.t <> 0), c AS (
  SELECT median(c) AS center FROM p), d AS (SELECT 1.4826 * median(abs(c - center)) AS spread FROM p, c), x AS (
  SELECT 'drift' AS "check", 'source' AS name, CAST(user_id AS VARCHAR) AS entity, CAST(n AS DOUBLE) AS actual,
         'mean ' || CAST(CAST(round(mean, 2) AS DECIMAL(38,2)) AS VARCHAR) AS detail FROM s
  UNION ALL SELECT 'page', 'source', CAST(user_id AS VARCHAR), n, signal FROM s
  UNION ALL SELECT 'bounds', 'Balance', 'Customer ' || c_custkey, c_acctbal, '0.0 to 9000.0' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000
  UNION ALL SELECT 'coverage', 'Phone', NULL, count(*) FILTER (c_custkey % 2 = 0), 'at least ' || count(*) FROM customer
  UNION ALL SELECT 'plausibility', 'value', CAST(name AS VARCHAR), c,
    CAST(CAST(prior AS DECIMAL(38,2)) AS VARCHAR) || ' to ' || CAST(CAST(current AS DECIMAL(38,2)) AS VARCHAR)
    FROM p, c, d WHERE (SELECT count(*) FROM p) >= 3 AND abs(c) > 0.25 AND (spread = 0 OR abs(c - center) > 3 * spread))
SELECT "check", name, entity, round(actual, 6) AS actual, detail FROM x""",
)
def health_report(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong in one table: silent sources and their pages, values out of bounds, columns
    with gaps, and changes too large to be true."""
    snapshots = events(spark, d).select(F.col("user_id").cast("string").alias("source"), F.col("day").alias("Archive_Date"))
    seen = table(spark, d, "pages")
    urls = seen.select(F.col("page_id").cast("string").alias("name"), "url")
    texts = seen.select("url", visible_text("html").alias("text")).dropDuplicates(["url"])
    customers = table(spark, d, "customer").select(
        F.concat(F.lit("Customer "), F.col("c_custkey")).alias("District"), F.col("c_acctbal").alias("Balance"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("x")).alias("Phone"),
    )
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name"), F.year("o_orderdate").alias("year"))
    spent = spent.agg(whole_total("o_totalprice").alias("value"))
    year = lambda y: spent.filter(F.col("year") == y).select("name", "value")
    report = health.source_health(
        health.source_checks(snapshots, "source", urls, texts, valid_from=None),
        health.value_checks(customers, "District", ["District", "Phone"], {"Balance": (0.0, 9000.0)}),
        health.salary_checks(year(2000), year(1999), mads=3.0),
    )
    return report.withColumn("actual", F.round("actual", 6))
