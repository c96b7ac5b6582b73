import datetime as dt

import pytest
from .conftest import values
from pyspark.sql import functions as F

from jobtide.functions.rules import ADJUNCT_APPOINTMENT, FACULTY_APPOINTMENT
from jobtide.operators.joins import crosswalk_table
from jobtide.plans import context, higher_ed, views
from jobtide.schemas import DISTRICT_CONTEXT, ENTITY_MAP, INSTITUTION_CONTEXT, TEACHER_HISTORY, conform

D = dt.date
OLD, NEW = D(2026, 8, 11), D(2026, 8, 18)


# -- context -----------------------------------------------------------------


def test_staffing_sums_names_and_drops_sentinels(spark):
    rows = [("A Elem", 1, 1, 10.0, 100.0), ("A HS ", 1, 2, 5.0, -2.0), ("B", 1, 0, 9.0, 9.0), ("C", 4, 1, 9.0, 9.0), ("E", 1, 1, -1.0, None)]
    directory = spark.createDataFrame(rows, "lea_name string, agency_type int, number_of_schools int, teachers_total_fte double, enrollment double")
    walk = crosswalk_table(spark, {"A": ["A Elem", "A HS"], "B": ["B"], "C": ["C"], "E": ["E"]})
    got = context.teacher_staffing(directory, walk, 2023)
    assert values(got) == [("A", 15.0, 100.0, 2023), ("B", None, None, 2023), ("C", None, None, 2023), ("E", 0.0, 0.0, 2023)]
    assert context.teacher_staffing(directory.filter("false"), walk, 2023).isEmpty()


def test_poverty_is_a_plain_mean(spark):
    make = lambda *r: spark.createDataFrame(list(r), "SD_NAME string, SAEPOVRAT5_17RV_PT string")
    walk = crosswalk_table(spark, {"A": ["A Elem", "A HS"], "B": ["B"], "N": ["N"]})
    got = context.child_poverty([make(("A Elem ", "10")), make(("A HS", "20")), make(("B", "x"))], walk, 2022)
    assert [(r[0], None if r[1] is None else round(r[1], 6), r[2]) for r in values(got)] == [("A", 0.15, 2022), ("B", None, 2022), ("N", None, 2022)]


def test_finance_keeps_the_code_as_text(spark):
    rows = [("01", "A Elem", "25", "100"), ("01", "A HS ", "25", "x"), ("1", "A HS", "25", "900"), ("10", "B", "25", "5")]
    ledger = spark.createDataFrame(rows, "FundCode string, DistrictName string, StateFY string, SumOfAmount string")
    walk = crosswalk_table(spark, {"A": ["A Elem", "A HS"], "H": ["A HS"], "B": ["B"]})
    assert values(context.general_fund_expenditure(ledger, walk)) == [("A", 100.0, "25"), ("B", None, "25"), ("H", 0.0, "25")]


def test_county_context(spark):
    grid = lambda *r: spark.createDataFrame(list(r), "NAME string, B19013_001E double, B25064_001E double, B01003_001E double")
    now = grid(("A County, State", 5.0, -666.0, 110.0), ("B County, State", 6.0, 7.0, 10.0))
    then = grid(("A County, State", 0.0, 0.0, 100.0))
    jobs = spark.createDataFrame([("A County, State", 50.0, 5.0), ("B County, State", 0.0, 0.0)], "NAME string, S2403_C01_001E double, S2403_C01_004E double")
    got = context.county_context(now, then, jobs, 2022, "State")
    assert values(got, "County", "Median_Gross_Rent", "Mining_Employment_Share", "Population_Change_Pct") == [
        ("A County", None, 0.1, 0.1), ("B County", 7.0, None, None),
    ]


@pytest.fixture(scope="module")
def ids(spark):
    return spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "unitid int, Name string")


def test_salaries_two_slices(spark, ids):
    rows = [(1, 2024, 99, 99, 99, 70000.0, 10.0), (1, 2024, 1, 99, 99, 90000.0, 3.0), (2, 2024, 99, 99, 99, -1.0, -2.0), (1, 2024, 99, 9, 99, 5.0, 5.0), (1, 2023, 99, 99, 99, 65000.0, 9.0)]
    survey = spark.createDataFrame(rows, "unitid int, year int, academic_rank int, contract_length int, sex int, average_salary double, instruc_staff_count double")
    got = context.faculty_salaries(survey.filter("year = 2024"), ids, 2024)
    assert values(got) == [("One", 70000.0, 90000.0, 10.0, "2024"), ("Three", None, None, None, "2024"), ("Two", None, None, None, "2024")]
    trend = context.salary_trend(survey, ids, 2024)
    assert trend.count() == 6 and ("One", 2023, 65000.0) in values(trend)


def test_enrollment_and_pell(spark, ids):
    rows = [(1, 2023, 10.0, None), (1, 2023, -1.0, 5.0), (2, 2023, -1.0, -2.0), (1, 2018, 12.0, None), (1, 2021, 20.0, None)]
    survey = spark.createDataFrame(rows, "unitid int, year int, est_fte double, rep_fte double")
    assert values(context.enrollment(survey.filter("year = 2023"), ids, 2023)) == [("One", 15.0, "2023"), ("Three", None, "2023"), ("Two", None, "2023")]
    assert values(context.enrollment_trend(survey, ids, 2026))[0] == ("One", 0.25)
    assert context.enrollment_trend(survey.filter("year > 2019"), ids, 2026).isEmpty()
    grants = spark.createDataFrame([(1, 2021, 4, 5.0), (1, 2021, 1, 99.0), (2, 2021, 4, -1.0)], "unitid int, year int, grant_type int, grant_recipients_unitid double")
    assert values(context.same_year_pell_share(grants, survey, ids, 2026)) == [("One", 0.25, "2021"), ("Three", None, "2021"), ("Two", None, "2021")]


def test_contexts_keep_last_good_columns(spark):
    registry = spark.createDataFrame([("A", "C1", 1.0, 2.0, "l"), ("New", "C1", 1.0, 2.0, "l")], "District string, County string, Latitude double, Longitude double, Job_Link string")
    previous = conform(spark.createDataFrame([("A", "Old", 0.5, 9.0), ("Gone", "Old", 0.1, 1.0)], "District string, County string, Child_Poverty_Rate double, Enrollment double"), DISTRICT_CONTEXT)
    staffing = spark.createDataFrame([("A", 7.0, 70.0, 2023)], "District string, Teachers_Total_FTE double, Enrollment double, CCD_Year int")
    got = context.district_context(registry, previous, context.DistrictSources(staffing=staffing))
    assert set(got.columns) == set(DISTRICT_CONTEXT.names)
    assert values(got, "District", "County", "Child_Poverty_Rate", "Enrollment", "CCD_Source") == [
        ("A", "C1", 0.5, 70.0, context.STAFFING_TAG), ("New", "C1", None, None, context.STAFFING_TAG),
    ]
    he = spark.createDataFrame([("I", "C1", 1.0, 2.0, "l")], "Institution string, County string, Latitude double, Longitude double, Job_Link string")
    trend = spark.createDataFrame([("I", 2024, 3.0), ("I", 2023, 2.0), ("I", 2022, 1.0)], "Name string, Year int, Faculty_Avg_Salary double")
    salary = spark.createDataFrame([("I", 3.0, 4.0, 5.0, "2024")], "Name string, Faculty_Avg_Salary double, Faculty_Avg_Salary_Professor double, Faculty_Count double, Salary_Year string")
    built = context.institution_context(he, None, context.InstitutionSources(salary=salary, salary_trend=trend))
    assert values(built, "Name", "Faculty_Avg_Salary_Y1Ago", "Faculty_Avg_Salary_Y2Ago", "Link") == [("I", 2.0, 1.0, "l")]


# -- cubes -------------------------------------------------------------------


def counts(spark):
    rows = [
        ("Math", OLD, "A", 2), ("Math", OLD, "Total", 2), ("Math", NEW, "A", 1), ("Math", NEW, "B", 4), ("Math", NEW, "Total", 5),
        ("Secondary Social Studies", NEW, " B ", 3), ("Secondary Social Studies", NEW, "Total", 3), ("Other", NEW, "A", 9),
    ]
    return spark.createDataFrame(rows, "Broad_Category string, Archive_Date date, District string, sum long")


def test_total_means_the_sum_of_parts(spark):
    cube = views.k12_cube(counts(spark))
    assert cube.count() == 2 * 2 * 3
    assert values(views.trend_series(cube, "District", "Broad_Category")) == [
        ("Math", OLD, 2), ("Math", NEW, 5), ("Soc. St.", OLD, 0), ("Soc. St.", NEW, 3),
    ]
    one = views.trend_series(cube, "District", "Broad_Category", "B", categories=["Math"], start=NEW, end=NEW)
    assert values(one) == [("Math", NEW, 4)]
    coarse = views.k12_cube(counts(spark), collapse=True)
    assert values(views.trend_series(coarse, "District", "Broad_Category", start=NEW)) == [("Core Academic", NEW, 8)]
    trends = {r.Category: r for r in views.current_trends_view(cube, "District", "Broad_Category").collect()}
    assert (trends["Math"].current, trends["Math"].series, trends["Math"].vs_month_ago) == (5, [2, 5], None)


def test_he_cube_filters(spark):
    rows = [("Math", NEW, "I", "F", 2), ("Math", NEW, "Total", "F", 2), ("Math", OLD, "I", "P", 1), ("Uncategorized", NEW, "I", "F", 7)]
    df = spark.createDataFrame(rows, "Category string, Archive_Date date, Institution string, Job_Type string, sum long")
    cube = views.he_cube(df)
    assert values(views.trend_series(cube, "Institution", "Category", Job_Type="F")) == [("Math", OLD, 0), ("Math", NEW, 2)]
    assert values(views.trend_series(cube, "Institution", "Category", Job_Type="all")) == [("Math", OLD, 1), ("Math", NEW, 2)]
    assert views.he_cube(df, collapse=True).select("Category").distinct().first()[0] == "STEM"


# -- entity map and summaries ------------------------------------------------


@pytest.fixture(scope="module")
def entities(spark):
    history = conform(
        spark.createDataFrame(
            [("Math", OLD, "A", "1"), ("Math", NEW, "A", "1"), ("Art", NEW, "A", "2"), ("Art", NEW, "A", "2")],
            "title string, Archive_Date date, District string, Posting_ID string",
        ),
        TEACHER_HISTORY,
    )
    now = [("Zoo", "A ", "9"), ("Math", "A", "1"), ("Art", "A", "2"), ("Cook", "A", "3"), ("Art", "A", "2")]
    current = spark.createDataFrame([(t, d, i, "u", "l", None) for t, d, i in now], "title string, District string, Posting_ID string, url string, location string, date_posted string")
    districts = conform(
        spark.createDataFrame([("A", 20.0, 100.0, "2023-24", 51000.0), ("Tiny", 9.0, 30.0, "2023-24", None)], "District string, Teachers_Total_FTE double, Enrollment double, Salary_Year string, Teacher_Avg_Salary double"),
        DISTRICT_CONTEXT,
    )
    k12 = views.district_map(districts, current, history)
    jobs = [("Math Professor", "X", "I", "Instructor/Teacher/Faculty"), ("Adjunct, Art", None, "I", "Adjunct/Part-Time Faculty")]
    faculty = spark.createDataFrame([(t, p, None, i, "u", d, j, "Math") for t, p, i, j in jobs for d in (OLD, NEW)], "Title string, Location string, Posted_Date string, Institution string, Link string, Archive_Date date, Job_Type string, Category string")
    institutions = conform(spark.createDataFrame([("I", 10.0, 50.0, "2024", 0.05)], "Name string, Faculty_Count double, Enrollment double, Salary_Year string, Enrollment_Change_Pct double"), INSTITUTION_CONTEXT)
    postings = faculty.filter(F.col("Archive_Date") == NEW).select("Title", "Location", "Posted_Date", "Institution", "Link", "Archive_Date")
    he = views.institution_map(institutions, postings, faculty)
    return views.entity_map(k12, he), postings, faculty


def test_entity_map(entities):
    got, _postings, _faculty = entities
    rows = {r.Name: r for r in got.collect()}
    assert set(ENTITY_MAP.names) | {"Marker_Radius"} == set(got.columns)
    a = rows["A"]
    assert (a.CurrentCount, a.WeeklyNew, a.SampleTitles, a.Vacancy_Numerator, a.Vacancy_Rate) == (4, 2, "Art; Cook; Math", 2, 0.1)
    assert (rows["Tiny"].CurrentCount, rows["Tiny"].SampleTitles, rows["Tiny"].Vacancy_Rate) == (0, "", None)
    assert round(rows["Tiny"].Students_Per_Teacher, 4) == 3.3333
    i = rows["I"]
    assert (i.CurrentCount, i.WeeklyNew, i.Vacancy_Numerator, i.Vacancy_Rate) == (2, 0, 1, 0.1), "only full-time faculty count; a missing location is not new"
    assert values(views.vacancy_domain(got)) == [(0.1, 0.1)]
    assert [r.Rate_Text for r in views.vacancy_leaders(got, views.K12_TYPE).collect()] == ["10.0%"]


def test_summaries(entities):
    got, postings, _faculty = entities
    district = views.district_summary(got).collect()
    assert [r["District"] for r in district] == ["A", "Tiny"]
    assert district[0]["Teacher Avg Salary (2023-24)"] == "$51,000" and "General Fund Expenditure (FYcurrent fiscal year)" in district[0].asDict()
    he = views.institution_summary(got, postings).first()
    assert (he[FACULTY_APPOINTMENT], he[ADJUNCT_APPOINTMENT], he["Enrollment Trend (5yr)"]) == (1, 1, "+5.0%")
    assert "Avg Faculty Salary (2022)" in he.asDict()


def test_lists_and_headlines(spark, entities):
    _got, postings, faculty = entities
    assert views.faculty_totals(postings).first() == (1, 1)
    assert views.he_job_list(postings, NEW, institution="I", appointment=ADJUNCT_APPOINTMENT).count() == 1
    assert views.he_new(higher_ed.with_appointment(faculty), FACULTY_APPOINTMENT).count() == 0
    weekly = spark.createDataFrame([("A", OLD, 3), ("B", OLD, 1), ("A", NEW, 5), ("B", NEW, 2)], "District string, Archive_Date date, n long")
    kpi = views.side_kpis(weekly, postings).first()
    assert (kpi.open_postings, kpi.delta, kpi.series) == (2, 3, [4, 7])
    jobs = spark.createDataFrame([("A",), ("A",), ("B",)], "District string")
    assert [tuple(r) for r in views.top_hiring(jobs, weekly, "District", 1).collect()] == [("A", 2, [3, 5])]
    assert views.mover(weekly, "District").count() == 0


def test_k12_list(spark):
    rows = [("T", "2020-01-01", "Teacher", "L", "u", " A  B", "S", "M", "1"), ("T", "2026-08-01", "Teacher", "L", "u", "C", "S", "M", "2")]
    df = spark.createDataFrame(rows, "title string, date_posted string, position string, location string, url string, District string, Posting_Source string, Posting_Identity_Method string, Posting_ID string")
    assert values(views.k12_job_list(df, NEW, "A B"), "District", "Posted / listed") == [("A B", "Listed since 2020-01-01")]
