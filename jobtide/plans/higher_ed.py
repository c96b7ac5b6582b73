"""The weekly higher-ed build.  This side has no posting identity: counts are
row counts and text is taken as it comes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import (
    ADJUNCT_JOB_TYPE,
    FACULTY_JOB_TYPE,
    HE_APPOINTMENT_OF_JOB_TYPE,
    HE_JOB_TYPE_DEFAULT,
    HE_JOB_TYPE_RULES,
    classify,
    he_category,
    recode,
    rules_for,
)
from ..operators.asof import DATE, at_latest
from ..operators.counts import (
    flagged_totals,
    named_totals,
    row_counts,
    row_counts_with_total,
    with_total_rows,
    without_total_rows,
)
from ..operators.joins import canonical_name
from ..operators.quality import require_totals_match
from ..schemas import FACULTY_HISTORY, HE_CATEGORY_COUNTS, HE_POSTINGS_CURRENT
from ..session import settled


def raw_snapshot(rows: DataFrame, snapshot_date: dt.date) -> DataFrame:
    """Board rows with an Institution, stamped; names as the boards spell them."""
    return rows.select(
        "Title", "Location", F.col("Posted_Date").cast("string").alias("Posted_Date"), "Institution", "Link",
        F.lit(snapshot_date).alias(DATE),
    ).select(*HE_POSTINGS_CURRENT.names)


def faculty_rows(postings: DataFrame) -> DataFrame:
    """Faculty and adjunct postings with their subject.  Only the rules that can
    tell these two job types are evaluated."""
    kept = (FACULTY_JOB_TYPE, ADJUNCT_JOB_TYPE)
    job_type = classify("Title", rules_for(HE_JOB_TYPE_RULES, kept), HE_JOB_TYPE_DEFAULT)
    return (
        postings.withColumn("Job_Type", job_type)
        .filter(F.col("Job_Type").isin(*kept))
        .withColumn("Category", he_category("Title"))
        .select(*FACULTY_HISTORY.names)
    )


def institution_totals(postings: DataFrame) -> DataFrame:
    return row_counts(postings, ["Institution", DATE])


CATEGORY_KEYS = ["Category", DATE, "Job_Type"]


def category_counts(faculty: DataFrame) -> DataFrame:
    counts = row_counts_with_total(faculty, CATEGORY_KEYS, "Institution")
    return counts.select(*HE_CATEGORY_COUNTS.names)


def checked_category_counts(faculty: DataFrame) -> DataFrame:
    """The same, refused when a total row is not the sum of its parts; rows are told apart by a flag."""
    counts = settled(flagged_totals(row_counts(faculty, [*CATEGORY_KEYS, "Institution"], "sum"), CATEGORY_KEYS, "Institution"))
    require_totals_match(counts.filter("is_total"), counts.filter("not is_total"), CATEGORY_KEYS)
    return named_totals(counts, CATEGORY_KEYS, "Institution").select(*HE_CATEGORY_COUNTS.names)


def category_counts_now(counts: DataFrame) -> DataFrame:
    parts = at_latest(without_total_rows(counts, "Institution"))
    return with_total_rows(parts, ["Category", "Job_Type"], "Institution").select(
        "Category", "Job_Type", F.col("sum").alias("Sum"), "Institution"
    )


def with_appointment(faculty: DataFrame) -> DataFrame:
    return faculty.withColumn("Appointment", recode("Job_Type", HE_APPOINTMENT_OF_JOB_TYPE))


def history_tables(snapshots: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """All history tables from raw snapshots of any number of dates; totals that do not add up raise here."""
    postings = canonical_name(snapshots, "Institution", aliases) if aliases is not None else snapshots
    faculty = settled(faculty_rows(postings))
    return {
        "postings": postings.select(*HE_POSTINGS_CURRENT.names),
        "faculty_history": faculty,
        "institution_totals": institution_totals(postings),
        "category_counts": checked_category_counts(faculty),
    }
