"""Entity context: salary, staffing, census, finance, enrolment and grants,
each joined onto the registry with keep-last-good refreshes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import first_clean, guarded_ratio, non_negative, number_or_null
from ..functions.text import strip_suffix
from ..operators.counts import mean_of_present, sum_null_if_all_null, sum_zero_if_matched
from ..operators.joins import (
    change_between,
    crosswalk_aggregate,
    onto_registry,
    refresh_columns,
    unless_empty,
    years_ago_columns,
)
from ..sources.shape import union_sources
from ..sources.vintages import YEARS_BACK, at_year, latest_year

# Survey codes and variable names.
ALL_CODE = 99
PROFESSOR_RANK = 1
REGULAR_AGENCY = 1
PELL_GRANT = 4
GENERAL_FUND = "01"
INCOME, RENT, POPULATION = "B19013_001E", "B25064_001E", "B01003_001E"
WORKERS, MINING_WORKERS = "S2403_C01_001E", "S2403_C01_004E"
POVERTY_RATE = "SAEPOVRAT5_17RV_PT"

# Source tags written beside refreshed columns.
SALARY_TAG = "MT Dept. of Labor & Industry Teacher Compensation Report (lmi.mt.gov/publications)"
STAFFING_TAG = "NCES Common Core of Data via Urban Institute Education Data Portal (educationdata.urban.org)"
FINANCE_TAG = (
    "OPI School Finance Data Files (opi.mt.gov/Leadership/Finance-Grants/School-Finance/OPI-Financial-Data-Files)"
)
HE_SALARY_TAG = "IPEDS via Urban Institute Education Data Portal (educationdata.urban.org)"


# -- districts ---------------------------------------------------------------


def teacher_staffing(directory: DataFrame, crosswalk: DataFrame, year: int | None = None) -> DataFrame:
    """Teacher FTE and enrolment per district, summed over its source names."""
    source = directory.filter((F.col("agency_type") == REGULAR_AGENCY) & (F.col("number_of_schools") >= 1)).select(
        F.trim("lea_name").alias("lea_name"),
        non_negative("teachers_total_fte").alias("fte"),
        non_negative("enrollment").alias("enrolled"),
    )
    out = crosswalk_aggregate(
        crosswalk, source, "lea_name", "District",
        Teachers_Total_FTE=sum_zero_if_matched("fte"),
        Enrollment=sum_zero_if_matched("enrolled"),
    )
    out = unless_empty(out, directory)
    return out if year is None else out.withColumn("CCD_Year", F.lit(year))


def child_poverty(geographies: list[DataFrame], crosswalk: DataFrame, year: int) -> DataFrame:
    """Unweighted mean rate over a district's geographies; percent text in, share out."""
    landed = union_sources(*geographies)
    rates = landed.select(
        F.trim("SD_NAME").alias("name"), (non_negative(number_or_null(POVERTY_RATE)) / 100).alias("rate")
    )
    out = crosswalk_aggregate(crosswalk, rates, "name", "District", Child_Poverty_Rate=mean_of_present("rate"))
    return unless_empty(out, landed).withColumn("SAIPE_Year", F.lit(year))


def general_fund_expenditure(ledger: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """General-fund spending per district.  The ledger is summed per source name
    before it meets the crosswalk; a name without any amount counts 0."""
    per_name = (
        ledger.filter(F.col("FundCode") == GENERAL_FUND)
        .groupBy(F.trim("DistrictName").alias("name"))
        .agg(F.coalesce(F.sum(number_or_null("SumOfAmount")), F.lit(0.0)).alias("total"))
    )
    out = crosswalk_aggregate(
        crosswalk, per_name, "name", "District", Total_General_Fund_Expenditure=sum_null_if_all_null("total")
    )
    year = ledger.agg(F.min("StateFY")).scalar() if "StateFY" in ledger.columns else F.lit(None)
    return unless_empty(out, ledger).withColumn("Finance_FY", year.cast("string"))


def county_income(grid: DataFrame, year: int, state: str) -> DataFrame:
    return grid.select(
        strip_suffix("NAME", ", " + state).alias("County"),
        non_negative(INCOME).alias("Median_Household_Income"),
        non_negative(RENT).alias("Median_Gross_Rent"),
        non_negative(POPULATION).alias("Population"),
        F.lit(year).alias("ACS_Year"),
    )


def county_mining(grid: DataFrame, state: str) -> DataFrame:
    return grid.select(
        strip_suffix("NAME", ", " + state).alias("County"),
        guarded_ratio(non_negative(MINING_WORKERS), non_negative(WORKERS)).alias("Mining_Employment_Share"),
    )


def county_context(detail: DataFrame, prior_detail: DataFrame, subject: DataFrame, year: int, state: str) -> DataFrame:
    """Income, rent, population and its change over the prior vintage, mining share."""
    current = county_income(detail, year, state)
    prior = county_income(prior_detail, year, state)
    change = change_between(current, prior, "County", "Population", "Population_Change_Pct")
    return current.join(county_mining(subject, state), "County", "left").join(change, "County", "left")


COUNTY_COLUMNS = (
    "Median_Household_Income", "Median_Gross_Rent", "Population", "ACS_Year",
    "Mining_Employment_Share", "Population_Change_Pct",
)


@dataclass
class Refresh:
    """One landed group of columns: the fresh frame, its key and columns, its tag."""

    fresh: DataFrame
    key: str
    columns: tuple[str, ...]
    tag: tuple[str, str] | None = None


@dataclass
class DistrictSources:
    """What landed this time; leave out what did not, and its columns stay as they were."""

    salary: DataFrame | None = None
    staffing: DataFrame | None = None
    county: DataFrame | None = None
    poverty: DataFrame | None = None
    finance: DataFrame | None = None


def apply_refreshes(base: DataFrame, refreshes: list[Refresh]) -> DataFrame:
    for r in refreshes:
        base = refresh_columns(base, r.fresh, r.key, r.columns, r.tag)
    return base


def district_context(registry: DataFrame, previous: DataFrame | None, landed: DistrictSources) -> DataFrame:
    """One row per registered district, each group of columns fresh or last good."""
    base = onto_registry(
        registry.select("District", "County", "Latitude", "Longitude", "Job_Link"), previous, "District"
    )
    salary = (
        "Teacher_Count", "Teacher_Salary_10th_Pctile", "Teacher_Avg_Salary", "Teacher_Salary_90th_Pctile", "Salary_Year",
    )
    groups = [
        (landed.salary, "District", salary, ("Salary_Source", SALARY_TAG)),
        (landed.staffing, "District", ("Teachers_Total_FTE", "Enrollment", "CCD_Year"), ("CCD_Source", STAFFING_TAG)),
        (landed.county, "County", COUNTY_COLUMNS, None),
        (landed.poverty, "District", ("Child_Poverty_Rate", "SAIPE_Year"), None),
        (landed.finance, "District", ("Total_General_Fund_Expenditure", "Finance_FY"), ("Finance_Source", FINANCE_TAG)),
    ]
    return apply_refreshes(base, [Refresh(*g) for g in groups if g[0] is not None])


# -- institutions ------------------------------------------------------------


def faculty_salaries(survey: DataFrame, ids: DataFrame, year: int | str) -> DataFrame:
    """Average salary and headcount over all ranks, and the professors' average.
    One pass over the survey serves both slices; ``ids`` is (unitid, Name)."""
    overall = (F.col("contract_length") == ALL_CODE) & (F.col("sex") == ALL_CODE)
    all_ranks = overall & (F.col("academic_rank") == ALL_CODE)
    professors = overall & (F.col("academic_rank") == PROFESSOR_RANK)
    slices = survey.groupBy("unitid").agg(
        F.max(F.when(all_ranks, non_negative("average_salary"))).alias("Faculty_Avg_Salary"),
        F.max(F.when(professors, non_negative("average_salary"))).alias("Faculty_Avg_Salary_Professor"),
        F.max(F.when(all_ranks, non_negative("instruc_staff_count"))).alias("Faculty_Count"),
    )
    out = ids.join(slices, "unitid", "left").select(
        "Name", "Faculty_Avg_Salary", "Faculty_Avg_Salary_Professor", "Faculty_Count",
        F.lit(str(year)).alias("Salary_Year"),
    )
    return unless_empty(out, survey)


def salary_trend(survey: DataFrame, ids: DataFrame, latest_year: int, n_years: int = 3) -> DataFrame:
    """Long (Name, Year, Faculty_Avg_Salary): every institution in each year that has landed."""
    window = survey.filter(F.col("year").between(latest_year - n_years + 1, latest_year))
    overall = window.filter(
        (F.col("academic_rank") == ALL_CODE) & (F.col("contract_length") == ALL_CODE) & (F.col("sex") == ALL_CODE)
    ).groupBy("unitid", "year").agg(F.max(non_negative("average_salary")).alias("Faculty_Avg_Salary"))
    # At most n_years values, attached as an array.
    years = window.agg(F.collect_set("year")).scalar()
    return (
        ids.withColumn("year", F.explode(years))
        .join(overall, ["unitid", "year"], "left")
        .select("Name", F.col("year").alias("Year"), "Faculty_Avg_Salary")
    )


def enrollment(survey: DataFrame, ids: DataFrame, year: int | str) -> DataFrame:
    """Estimated FTE, else reported, summed over levels of study; all missing stays missing."""
    totals = (
        survey.select("unitid", first_clean("est_fte", "rep_fte").alias("fte"))
        .groupBy("unitid")
        .agg(F.sum("fte").alias("Enrollment"))
    )
    out = ids.join(totals, "unitid", "left").select(
        "Name", "Enrollment", F.lit(str(year)).alias("Enrollment_Year")
    )
    return unless_empty(out, survey)


def enrollment_trend(survey: DataFrame, ids: DataFrame, start_year: int, years_back: int = 5) -> DataFrame:
    """Change of enrolment from ``years_back`` years before the newest vintage."""
    newest = latest_year(survey, start_year, YEARS_BACK["enrollment"])
    current = enrollment(at_year(survey, newest), ids, "latest")
    earlier = None if newest is None else newest - years_back
    prior = enrollment(at_year(survey, earlier), ids, "prior")
    return change_between(current, prior, "Name", "Enrollment", "Enrollment_Change_Pct")


def pell_share(grants: DataFrame, enrolled: DataFrame, ids: DataFrame, year: int | str) -> DataFrame:
    """Pell recipients over the same year's enrolment."""
    pell = grants.filter(F.col("grant_type") == PELL_GRANT).select(
        "unitid", non_negative("grant_recipients_unitid").alias("_recipients")
    )
    out = (
        ids.join(pell, "unitid", "left")
        .join(enrolled.select("Name", F.col("Enrollment").alias("_enrolled")), "Name", "left")
        .select(
            "Name", guarded_ratio("_recipients", "_enrolled").alias("Pell_Recipient_Share"),
            F.lit(str(year)).alias("Pell_Year"),
        )
    )
    return unless_empty(out, grants, enrolled)


def same_year_pell_share(grants: DataFrame, survey: DataFrame, ids: DataFrame, start_year: int) -> DataFrame:
    """The newest grants vintage against the enrolment of that very year."""
    newest = latest_year(grants, start_year, YEARS_BACK["grants"])
    enrolled = enrollment(at_year(survey, newest), ids, str(newest))
    return pell_share(at_year(grants, newest), enrolled, ids, str(newest))


@dataclass
class InstitutionSources:
    salary: DataFrame | None = None
    salary_trend: DataFrame | None = None
    enrollment: DataFrame | None = None
    enrollment_trend: DataFrame | None = None
    pell: DataFrame | None = None
    county: DataFrame | None = None
    extra: list[Refresh] = field(default_factory=list)


def institution_context(registry: DataFrame, previous: DataFrame | None, landed: InstitutionSources) -> DataFrame:
    """One row per registered institution, each group of columns fresh or last good."""
    base = onto_registry(
        registry.select(
            F.col("Institution").alias("Name"), "County", "Longitude", "Latitude", F.col("Job_Link").alias("Link")
        ),
        previous,
        "Name",
    )
    trend = None
    if landed.salary_trend is not None:
        trend = years_ago_columns(landed.salary_trend, "Name", "Year", "Faculty_Avg_Salary", "Faculty_Avg_Salary")
    salary = ("Faculty_Avg_Salary", "Faculty_Avg_Salary_Professor", "Faculty_Count", "Salary_Year")
    groups = [
        (landed.salary, "Name", salary, ("Salary_Source", HE_SALARY_TAG)),
        (trend, "Name", ("Faculty_Avg_Salary_Y1Ago", "Faculty_Avg_Salary_Y2Ago"), None),
        (landed.enrollment, "Name", ("Enrollment", "Enrollment_Year"), None),
        (landed.enrollment_trend, "Name", ("Enrollment_Change_Pct",), None),
        (landed.pell, "Name", ("Pell_Recipient_Share", "Pell_Year"), None),
        (landed.county, "County", COUNTY_COLUMNS, None),
    ]
    return apply_refreshes(base, [Refresh(*g) for g in groups if g[0] is not None] + landed.extra)
