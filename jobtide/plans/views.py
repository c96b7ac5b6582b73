"""What the dashboard shows, as tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import posted_or_listed
from ..functions.numbers import (
    VACANCY_MIN_POSITIONS,
    dollars,
    guarded_ratio,
    marker_radius,
    one_decimal,
    percent,
)
from ..functions.rules import (
    ADJUNCT_APPOINTMENT,
    FACULTY_APPOINTMENT,
    FACULTY_JOB_TYPE,
    HE_COLLAPSED,
    K12_COLLAPSED,
    K12_SHORT_LABELS,
    he_appointment,
    recode,
)
from ..functions.text import squish
from ..operators.asof import DATE, mark_dates
from ..operators.counts import (
    TOTAL,
    count_where,
    distinct_counts,
    resum,
    row_counts,
    single_value,
    value_range,
    without_total_rows,
)
from ..operators.gapfill import gap_fill
from ..operators.identity import distinct_postings
from ..operators.newness import new_since_previous
from ..operators.ordering import top_per_key
from ..operators.trends import biggest_mover, current_trends, daily_totals, last_n_series, top_k, week_over_week
from ..schemas import ENTITY_MAP, conform

K12_TYPE, HE_TYPE = "K-12 District", "Higher Ed Institution"
ALL = "all"
# Which row speaks for an identity that occurs more than once.
ONCE_ORDER = ("title", "url", "District", "location", "date_posted")


# -- cubes -------------------------------------------------------------------


def k12_cube(counts: DataFrame, collapse: bool = False) -> DataFrame:
    """Category x date x district without "Other", short labels, gaps as 0."""
    labelled = (
        counts.withColumn("District", squish("District"))
        .withColumn("Broad_Category", recode("Broad_Category", K12_SHORT_LABELS))
        .filter(F.col("Broad_Category") != "Other")
    )
    cube = gap_fill(labelled, ["Broad_Category", DATE, "District"], {"sum": 0})
    if not collapse:
        return cube
    return resum(
        cube, ["Broad_Category", DATE, "District"], relabel={"Broad_Category": recode("Broad_Category", K12_COLLAPSED)}
    )


def he_cube(counts: DataFrame, collapse: bool = False) -> DataFrame:
    """Category x date x institution x job type without "Uncategorized", gaps as 0."""
    keys = ["Category", DATE, "Institution", "Job_Type"]
    cube = gap_fill(counts.filter(F.col("Category") != "Uncategorized"), keys, {"sum": 0})
    return resum(cube, keys, relabel={"Category": recode("Category", HE_COLLAPSED)}) if collapse else cube


def trend_series(
    cube: DataFrame,
    entity_column: str,
    category_column: str,
    entity: str = TOTAL,
    categories: Sequence[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    **equals: str,
) -> DataFrame:
    """Category x date series of one entity, or of all of them together.

    "Total" means the sum of the parts: the stored total rows are taken out
    first.  Further keyword filters accept "all" for no restriction.
    """
    df = without_total_rows(cube, entity_column)
    if entity != TOTAL:
        df = df.filter(F.col(entity_column) == entity)
    if categories is not None:
        df = df.filter(F.col(category_column).isin(*categories))
    if start is not None:
        df = df.filter(F.col(DATE) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(DATE) <= F.lit(end))
    for column, value in equals.items():
        if value != ALL:
            df = df.filter(F.col(column) == value)
    return resum(df, [category_column, DATE]).orderBy(category_column, DATE)


def current_trends_view(
    cube: DataFrame, entity_column: str, category_column: str, entity: str = TOTAL, **equals: str
) -> DataFrame:
    """Current count per category with its changes and recent series, for one entity."""
    df = cube.filter(F.col(entity_column) == entity)
    for column, value in equals.items():
        if value != ALL:
            df = df.filter(F.col(column) == value)
    return current_trends(df.select(F.col(category_column).alias("Category"), DATE, F.col("sum").alias("n")))


# -- job lists ---------------------------------------------------------------


def k12_job_list(postings: DataFrame, as_of: dt.date | Column, district: str | None = None) -> DataFrame:
    """Open K-12 postings, each identity once, dates marked when stale."""
    jobs = distinct_postings(postings, ["Posting_ID"], order=ONCE_ORDER)
    if district is not None:
        jobs = jobs.filter(squish("District") == district)
    return jobs.select(
        squish("District").alias("District"),
        F.col("title").alias("Title"),
        F.col("position").alias("Position"),
        F.col("location").alias("Location"),
        posted_or_listed("date_posted", as_of).alias("Posted / listed"),
        F.col("url").alias("Link"),
        F.col("Posting_Source").alias("Source"),
        F.col("Posting_Identity_Method").alias("Identity method"),
        "Posting_ID",
    )


def he_job_list(
    postings: DataFrame, as_of: dt.date | Column, institution: str | None = None, appointment: str = ALL
) -> DataFrame:
    """Open higher-ed postings with their appointment type."""
    jobs = postings.withColumn("Appointment", he_appointment("Title"))
    if institution is not None:
        jobs = jobs.filter(F.col("Institution") == institution)
    if appointment != ALL:
        jobs = jobs.filter(F.col("Appointment") == appointment)
    return jobs.select(
        "Institution", "Title", "Location",
        posted_or_listed("Posted_Date", as_of).alias("Posted / listed"), "Link", "Appointment",
    )


def he_new(faculty_history: DataFrame, appointment: str = ALL) -> DataFrame:
    """New faculty postings by title, location and institution, for want of an identity."""
    new = new_since_previous(faculty_history, ["Title", "Location", "Institution"])
    if appointment != ALL:
        new = new.filter(F.col("Appointment") == appointment)
    return new


def faculty_totals(postings: DataFrame) -> DataFrame:
    """One row: non-adjunct and adjunct openings by title."""
    appointment = he_appointment("Title")
    return count_where(
        postings,
        faculty_instructor=appointment == FACULTY_APPOINTMENT,
        adjunct_part_time=appointment == ADJUNCT_APPOINTMENT,
    )


# -- entity map --------------------------------------------------------------


def sample_titles(postings: DataFrame, entity: str, title: str, k: int = 3) -> DataFrame:
    """The first k titles per entity in alphabetical order, joined by "; "."""
    first = top_per_key(postings.select(entity, title), [entity], [F.col(title).asc_nulls_last()], k)
    # A missing title sorts last and is written NA.
    texts = F.sort_array(F.collect_list(F.struct(F.col(title).isNull().alias("absent"), F.col(title).alias("title"))))
    shown = F.transform(texts, lambda t: F.coalesce(t["title"], F.lit("NA")))
    return first.groupBy(entity).agg(F.array_join(shown, "; ").alias("SampleTitles"))


def _with_activity(
    context: DataFrame, name: str, current: DataFrame, new: DataFrame, openings: DataFrame, entity: str, title: str
) -> DataFrame:
    """Registry rows with counts of current, new and vacancy-relevant postings."""
    counts = [
        row_counts(current, [entity], "CurrentCount"),
        sample_titles(current, entity, title),
        row_counts(new, [entity], "WeeklyNew"),
        openings,
    ]
    out = context
    for table in counts:
        out = out.join(table.withColumnRenamed(entity, name), name, "left")
    return out.fillna(0, ["CurrentCount", "WeeklyNew", "Vacancy_Numerator"]).fillna("", ["SampleTitles"])


def _with_ratios(df: DataFrame, positions: str) -> DataFrame:
    return (
        df.withColumn("Vacancy_Denominator", F.col(positions).cast("double"))
        .withColumn("Vacancy_Rate", guarded_ratio("Vacancy_Numerator", positions, at_least=VACANCY_MIN_POSITIONS))
        .withColumn("Students_Per_Teacher", guarded_ratio("Enrollment", positions))
    )


def district_map(context: DataFrame, current: DataFrame, teacher_history: DataFrame) -> DataFrame:
    """Districts; the vacancy numerator is distinct teacher postings at the latest date.

    The history's dates are looked up once; only its two newest dates are then read.
    """
    marks = mark_dates(teacher_history)
    latest = teacher_history.filter(F.col(DATE) == marks["latest"])
    openings = distinct_counts(latest, ["District"], out="Vacancy_Numerator")
    once = distinct_postings(current, ["Posting_ID"], order=ONCE_ORDER)
    jobs = once.withColumn("District", squish("District"))
    new = new_since_previous(teacher_history, ["Posting_ID"], marks=marks)
    filled = _with_activity(
        context.withColumnRenamed("District", "Name"), "Name", jobs, new, openings, "District", "title"
    ).withColumnRenamed("Job_Link", "Link")
    return conform(_with_ratios(filled, "Teachers_Total_FTE").withColumn("Type", F.lit(K12_TYPE)), ENTITY_MAP)


def institution_map(context: DataFrame, current: DataFrame, faculty_history: DataFrame) -> DataFrame:
    """Institutions; only full-time faculty postings count, like the denominator."""
    marks = mark_dates(faculty_history)
    latest = faculty_history.filter(F.col(DATE) == marks["latest"])
    openings = row_counts(latest.filter(F.col("Job_Type") == FACULTY_JOB_TYPE), ["Institution"], "Vacancy_Numerator")
    new = new_since_previous(faculty_history, ["Title", "Location", "Institution"], marks=marks)
    filled = _with_activity(context, "Name", current, new, openings, "Institution", "Title")
    return conform(_with_ratios(filled, "Faculty_Count").withColumn("Type", F.lit(HE_TYPE)), ENTITY_MAP)


def entity_map(districts: DataFrame, institutions: DataFrame) -> DataFrame:
    """Both kinds in one table, with the marker size of each."""
    return districts.unionByName(institutions).withColumn("Marker_Radius", marker_radius("CurrentCount"))


def vacancy_domain(entities: DataFrame) -> DataFrame:
    return value_range(entities, "Vacancy_Rate")


# -- headline figures --------------------------------------------------------


def side_kpis(weekly_totals: DataFrame, current: DataFrame) -> DataFrame:
    """One row: open postings, week-over-week delta, series of the last snapshots."""
    daily = daily_totals(weekly_totals).withColumn("_all", F.lit(1))
    series = last_n_series(daily, ["_all"])
    return week_over_week(weekly_totals).select(
        current.agg(F.count(F.lit(1))).scalar().alias("open_postings"),
        "latest_date", "prior_date", "delta",
        series.select("series").scalar().alias("series"),
    )


def mover(weekly_totals: DataFrame, name: str) -> DataFrame:
    return biggest_mover(weekly_totals, name)


def top_hiring(current: DataFrame, weekly_totals: DataFrame, entity: str, k: int = 5) -> DataFrame:
    """The k entities with most open postings and the recent series of each."""
    top = top_k(row_counts(current, [entity], "open_postings"), "open_postings", k, entity)
    series = last_n_series(weekly_totals.join(top.select(entity), entity, "left_semi"), [entity])
    return top.join(series, entity, "left").orderBy(F.desc("open_postings"), entity)


def vacancy_leaders(entities: DataFrame, kind: str, k: int = 8) -> DataFrame:
    """The k highest vacancy rates of one kind of entity."""
    ranked = top_k(entities.filter(F.col("Type") == kind), "Vacancy_Rate", k, "Name")
    return ranked.select(
        "Name", "Vacancy_Numerator", "Vacancy_Denominator", "Vacancy_Rate", percent("Vacancy_Rate").alias("Rate_Text")
    )


# -- summary tables ----------------------------------------------------------


def _label(df: DataFrame, column: str, default: str) -> str:
    """The one year that goes into column names (one small row is fetched)."""
    return single_value(df, column, default).first()["value"]


def district_summary(entities: DataFrame) -> DataFrame:
    """One formatted row per district, most openings first."""
    rows = entities.filter(F.col("Type") == K12_TYPE)
    year = _label(rows, "Salary_Year", "current year")
    fiscal = _label(rows, "Finance_FY", "current fiscal year")
    band = F.concat(dollars("Teacher_Salary_10th_Pctile"), F.lit(" - "), dollars("Teacher_Salary_90th_Pctile"))
    return rows.orderBy(F.desc("CurrentCount"), "Name").select(
        F.col("Name").alias("District"),
        "County",
        F.col("CurrentCount").alias("Current Openings"),
        F.col("WeeklyNew").alias("New This Week"),
        percent("Vacancy_Rate").alias("Teacher Vacancy Rate"),
        "Enrollment",
        one_decimal("Students_Per_Teacher").alias("Students per Teacher"),
        dollars("Teacher_Avg_Salary").alias(f"Teacher Avg Salary ({year})"),
        band.alias("Teacher Salary Range (10th-90th %ile)"),
        dollars("Total_General_Fund_Expenditure").alias(f"General Fund Expenditure (FY{fiscal})"),
        *_county_columns(),
        percent("Child_Poverty_Rate").alias("District Child Poverty Rate"),
    )


def institution_summary(entities: DataFrame, current: DataFrame) -> DataFrame:
    """One formatted row per institution, openings split by appointment."""
    rows = entities.filter(F.col("Type") == HE_TYPE)
    year = _label(rows, "Salary_Year", "current")
    y1, y2 = (str(int(year) - 1), str(int(year) - 2)) if year.isdigit() else ("1 year ago", "2 years ago")
    appointment = he_appointment("Title")
    split = current.groupBy(F.col("Institution").alias("Name")).agg(
        F.count_if(appointment == FACULTY_APPOINTMENT).alias(FACULTY_APPOINTMENT),
        F.count_if(appointment == ADJUNCT_APPOINTMENT).alias(ADJUNCT_APPOINTMENT),
    )
    pell = F.concat(percent("Pell_Recipient_Share"), F.lit(" ("), F.col("Pell_Year"), F.lit(")"))
    return (
        rows.join(split, "Name", "left")
        .fillna(0, [FACULTY_APPOINTMENT, ADJUNCT_APPOINTMENT])
        .orderBy(F.desc("CurrentCount"), "Name")
        .select(
            F.col("Name").alias("Institution"),
            "County",
            F.col("CurrentCount").alias("Current Openings"),
            FACULTY_APPOINTMENT,
            ADJUNCT_APPOINTMENT,
            F.col("WeeklyNew").alias("New This Week"),
            percent("Vacancy_Rate").alias("Faculty Vacancy Rate"),
            dollars("Faculty_Avg_Salary").alias(f"Avg Faculty Salary ({year})"),
            dollars("Faculty_Avg_Salary_Y1Ago").alias(f"Avg Faculty Salary ({y1})"),
            dollars("Faculty_Avg_Salary_Y2Ago").alias(f"Avg Faculty Salary ({y2})"),
            dollars("Faculty_Avg_Salary_Professor").alias(f"Professor Avg Salary ({year})"),
            F.col("Faculty_Count").alias("Faculty Count"),
            "Enrollment",
            one_decimal("Students_Per_Teacher").alias("Students per Faculty"),
            percent("Enrollment_Change_Pct", signed=True).alias("Enrollment Trend (5yr)"),
            pell.alias("Pell Grant Recipient Share"),
            *_county_columns(),
        )
    )


def _county_columns() -> list[Column]:
    return [
        dollars("Median_Household_Income").alias("County Median Income"),
        dollars("Median_Gross_Rent", suffix="/mo").alias("County Median Rent"),
        percent("Mining_Employment_Share").alias("County Mining/Energy Jobs"),
        percent("Population_Change_Pct", signed=True).alias("County Population Trend (5yr)"),
    ]
