"""Shared inputs of the registered queries, in Spark and in SQL.

The driver tables stand in for landed data: every event is a posting seen on
``date(ts)`` (its snapshot date), by entity ``user_id``.  Titles are picked
from a list of phrases by the number in the event's properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import signals, urls
from ..session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage the session names, deleted when the session's process ends."""
    return shared_folder(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Title -> the position, subject and broad category it must get.
K12_EXPECTED = {
    "Math Teacher": ("Teacher", "Mathematics Education", "Math"),
    "Special Education Teacher": ("Teacher", "Special Education - General", "Special Education - General"),
    "Resource Room Teacher": ("Teacher", "Special Education - Resource/Life Skills", "Special Education - Resource/Life Skills"),
    "Paraprofessional": ("Paraprofessional", "Uncategorized", "Other"),
    "Route Bus Driver": ("Transportation", "Uncategorized", "Other"),
    "Elementary Teacher - Part-Time": ("Part-Time Teacher", "Elementary Education", "Elementary"),
    "Welding Instructor": ("Teacher", "Technical Education", "CTE - Trades, Ag & Technical"),
    "Substitute Teacher": ("Substitute", "Substitute Teaching", "Other"),
    "School Counselor": ("Support Services", "Uncategorized", "Other"),
    "Pre-K Teacher": ("Teacher", "Early Childhood Education", "Early Childhood"),
    "Head Volleyball Coach": ("Athletics", "Uncategorized", "Other"),
    "Music Teacher": ("Teacher", "Music Education", "Music"),
    "Library Media Specialist": ("Teacher", "Library Media", "Library Media"),
    "Custodian": ("Custodial/Maintenance", "Uncategorized", "Other"),
    "High School Principal": ("Administration", "Uncategorized", "Other"),
    "Food Service Cook": ("Food Services", "Uncategorized", "Other"),
    "English Teacher": ("Teacher", "English Language Arts Education", "English Language Arts Secondary"),
    "ESL Teacher": ("Teacher", "Language Education", "Language"),
    "Technology Education Teacher Assistant": ("Teacher", "Uncategorized", "Other"),
    "PE Teacher": ("Teacher", "Physical Education", "Physical Education"),
    "Art Teacher": ("Teacher", "Art Teacher", "Art"),
    "Biology Teacher": ("Teacher", "Science Education", "Science"),
    "Business Teacher": ("Teacher", "Business and Economics", "CTE - Business & Family Sciences"),
    "History Teacher": ("Teacher", "Social Studies Education", "Secondary Social Studies"),
    "STEM Teacher": ("Teacher", "STEM Teacher", "Science"),
    "Gifted Teacher": ("Teacher", "Gifted and Talented", "Gifted and Talented"),
    "Virtual Teacher": ("Teacher", "Virtual Education", "Other"),
    "Desk Clerk": ("Staff", "Uncategorized", "Other"),
    "English as a Second Language Teacher": ("Teacher", "Elementary Education", "Elementary"),
    "Language Arts Coordinator Teacher": ("Teacher", "Uncategorized", "Other"),
    "Daycare Lead": ("Child Care", "Uncategorized", "Other"),
    "Astronaut": ("Other", "Uncategorized", "Other"),
}
# Title -> the job type, category and appointment it must get.
HE_EXPECTED = {
    "Adjunct Instructor, Music": ("Adjunct/Part-Time Faculty", "The Arts", "Adjunct/part-time faculty"),
    "Custodian 1-Part-Time": ("Support Services", "Uncategorized", "Adjunct/part-time faculty"),
    "Part-Time Nursing Faculty": ("Adjunct/Part-Time Faculty", "CTE - Health Sciences", "Adjunct/part-time faculty"),
    "Assistant Professor of Biology": ("Instructor/Teacher/Faculty", "Science", "Faculty/instructor (non-adjunct)"),
    "Professor of Law": ("Instructor/Teacher/Faculty", "Legal", "Faculty/instructor (non-adjunct)"),
    "Librarian": ("Instructor/Teacher/Faculty", "Library", "Faculty/instructor (non-adjunct)"),
    "Student Worker - Gym": ("Student Positions", "Uncategorized", "Other / not faculty"),
    "Registered Nurse": ("Healthcare", "Uncategorized", "Other / not faculty"),
    "Pooled Position - Grounds": ("Temporary Position", "Uncategorized", "Other / not faculty"),
    "Administrative Associate III": ("Staff", "Uncategorized", "Other / not faculty"),
    "Academic Advisor II": ("Advising and Student Services", "Uncategorized", "Other / not faculty"),
    "Sous Chef": ("Culinary", "Uncategorized", "Other / not faculty"),
    "Admissions Coordinator": ("Professional", "Uncategorized", "Other / not faculty"),
    "Dean of Students": ("Administration", "Uncategorized", "Other / not faculty"),
    "Head Coach": ("Coaching or Athletics", "Uncategorized", "Other / not faculty"),
    "Accountant II": ("Accounting/Finance", "Uncategorized", "Other / not faculty"),
    "Research Scientist": ("Research & Science", "Uncategorized", "Other / not faculty"),
    "Network Specialist": ("Technical", "Uncategorized", "Other / not faculty"),
    "Plumber": ("Maintenance & Service", "Uncategorized", "Other / not faculty"),
    "Lifeguard": ("Support Services", "Uncategorized", "Other / not faculty"),
    "Director of Facilities": ("Maintenance & Service", "Uncategorized", "Other / not faculty"),
    "Astronomer": ("Other", "Uncategorized", "Other / not faculty"),
    "Lecturer in Computer Science": ("Instructor/Teacher/Faculty", "CTE - Business & Computing", "Faculty/instructor (non-adjunct)"),
    "Welding Instructor": ("Instructor/Teacher/Faculty", "CTE - Trades & Engineering", "Faculty/instructor (non-adjunct)"),
    "Instructor of Spanish": ("Instructor/Teacher/Faculty", "Language", "Faculty/instructor (non-adjunct)"),
    "Extension Educator": ("Instructor/Teacher/Faculty", "Extension/Outreach", "Faculty/instructor (non-adjunct)"),
    "Math Instructor": ("Instructor/Teacher/Faculty", "Math", "Faculty/instructor (non-adjunct)"),
    "Economics Professor": ("Instructor/Teacher/Faculty", "CTE - Business & Computing", "Faculty/instructor (non-adjunct)"),
    "Theatre Lecturer": ("Instructor/Teacher/Faculty", "The Arts", "Faculty/instructor (non-adjunct)"),
}
K12_TITLES, HE_TITLES = list(K12_EXPECTED), list(HE_EXPECTED)


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def whole_total(price: str) -> Column:
    """The sum rounded to whole units.  Added as decimals: sums of doubles depend on the order of the rows, which
    decides where a total ends in one half."""
    return F.round(F.sum(F.col(price).cast("decimal(28,10)"))).cast("double")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their day and the number in their properties."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("date").alias("day"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events)"""

STATEWIDE = "OPI Jobs for Teachers (statewide)"
SCHOOLSPRING = "SchoolSpring (direct district board)"


def k12_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as K-12 board rows over many snapshot dates."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        pick(K12_TITLES, F.col("k")).alias("title"),
        F.date_sub("day", F.col("k") % 7).alias("date_posted"),
        F.concat(F.lit("Town "), F.col("user_id") % 17).alias("location"),
        F.when(kind == "view", F.concat(F.lit("https://Board.example/jobs/"), F.col("event_id") % 500))
        .when(kind == "click", F.lit("https://apps.opi.mt.gov/mtjobsforteachers/list"))
        .when(kind == "purchase", F.concat(F.lit("https://board.example/careers?id="), F.col("user_id")))
        .when(kind == "signup", F.concat(F.lit("https://board.example/files/"), F.col("k"), F.lit(".PDF")))
        .alias("url"),
        F.concat(F.lit("District "), F.col("user_id") % 40).alias("District"),
        F.when(kind == "click", F.lit(STATEWIDE)).when(kind != "error", F.lit(SCHOOLSPRING)).alias("Posting_Source"),
        F.lit(None).cast("string").alias("position"),
        F.col("day").alias("Archive_Date"),
        F.col("event_id").alias("seq"),
    )


K12_SQL = f"""{EVENTS_SQL}, k12 AS (
  SELECT {sql_list(K12_TITLES)}[k % {len(K12_TITLES)} + 1] AS title,
         day - k % 7 AS date_posted,
         'Town ' || (user_id % 17) AS location,
         CASE event_type WHEN 'view' THEN 'https://Board.example/jobs/' || (event_id % 500)
              WHEN 'click' THEN 'https://apps.opi.mt.gov/mtjobsforteachers/list'
              WHEN 'purchase' THEN 'https://board.example/careers?id=' || user_id
              WHEN 'signup' THEN 'https://board.example/files/' || k || '.PDF' END AS url,
         'District ' || (user_id % 40) AS District,
         CASE WHEN event_type = 'click' THEN '{STATEWIDE}'
              WHEN event_type <> 'error' THEN '{SCHOOLSPRING}' END AS source,
         day AS Archive_Date, event_id AS seq
  FROM ev)"""

IDENTITY_SQL = f"""{K12_SQL}, tagged AS (
  SELECT *, coalesce(source, 'Direct district board') AS Posting_Source,
         coalesce(source = '{STATEWIDE}' OR regexp_matches(url, '(?i){urls.STATEWIDE_FEED}'), FALSE) AS statewide
  FROM k12), based AS (
  SELECT *, (NOT statewide AND coalesce(regexp_matches(url, '{urls.STABLE_POSTING_URL}'), FALSE)) AS stable,
         concat_ws(chr(31), CASE WHEN statewide THEN 'opi-fallback' ELSE 'source-fallback' END,
                   lower(Posting_Source), lower(District), lower(title), lower(location),
                   CAST(date_posted AS VARCHAR)) AS base
  FROM tagged), identified AS (
  SELECT *, CASE WHEN stable THEN 'url:' || lower(url)
                 ELSE 'fallback:' || base || '#' || row_number() OVER (PARTITION BY base, Archive_Date ORDER BY seq)
            END AS Posting_ID,
         CASE WHEN stable THEN 'Stable per-posting URL'
              WHEN statewide THEN 'OPI fallback: title + raw location + posted date (not a stable OPI ID)'
              ELSE 'Source fallback: title + location + posted date (no stable posting URL)' END AS Posting_Identity_Method
  FROM based), kept AS (
  SELECT * FROM identified QUALIFY row_number() OVER (PARTITION BY Posting_ID, Archive_Date ORDER BY seq) = 1)"""


def he_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as higher-ed postings; every fifth entity's rows lack a location."""
    return events(spark, sf_dir).select(
        pick(HE_TITLES, F.col("k")).alias("Title"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("Campus "), F.col("user_id") % 3)).alias("Location"),
        F.date_sub("day", F.col("k") % 5).cast("string").alias("Posted_Date"),
        F.concat(F.lit("College "), F.col("user_id") % 25).alias("Institution"),
        F.concat(F.lit("https://college.example/"), F.col("event_id")).alias("Link"),
        F.col("day").alias("Archive_Date"),
    )


HE_SQL = f"""{EVENTS_SQL}, he AS (
  SELECT {sql_list(HE_TITLES)}[k % {len(HE_TITLES)} + 1] AS Title,
         CASE WHEN user_id % 5 <> 0 THEN 'Campus ' || (user_id % 3) END AS Location,
         CAST(day - k % 5 AS VARCHAR) AS Posted_Date,
         'College ' || (user_id % 25) AS Institution,
         'https://college.example/' || event_id AS Link,
         day AS Archive_Date
  FROM ev)"""


def signal_sql(column: str) -> str:
    """What a page's text says about its board, from the same phrases as the operator."""
    return (
        f"CASE WHEN {column} IS NULL THEN 'inconclusive' "
        f"WHEN len(regexp_extract_all({column}, '(?i){signals.LIVE_BOARD}')) >= {signals.LIVE_BOARD_MIN_HITS} THEN 'likely_broken' "
        f"WHEN regexp_matches({column}, '(?i){signals.EMPTY_BOARD}') THEN 'looks_genuinely_empty' ELSE 'inconclusive' END"
    )


def sql_case(column: str, rules: list[tuple[str, ...]], default: str) -> str:
    """A rule set as a SQL CASE."""
    quote = lambda s: s.replace("'", "''")
    whens = " ".join(
        "WHEN " + " AND ".join(f"regexp_matches({column}, '(?i){quote(p)}')" for p in patterns) + f" THEN '{quote(label)}'"
        for label, *patterns in rules
    )
    return f"CASE {whens} ELSE '{quote(default)}' END"


def sql_map(column: str, labels: dict[str, str], default: str) -> str:
    """A lookup table as a SQL CASE; ``default`` is a SQL expression."""
    quote = lambda s: s.replace("'", "''")
    whens = " ".join(f"WHEN '{quote(k)}' THEN '{quote(v)}'" for k, v in labels.items())
    return f"CASE {column} {whens} ELSE {default} END"


def sql_expected(column: str, expected: dict[str, tuple[str, ...]], place: int) -> str:
    """The expected label of a fixed title, independent of the rules that are put to the test."""
    return sql_map(column, {title: labels[place] for title, labels in expected.items()}, "'unknown title'")
