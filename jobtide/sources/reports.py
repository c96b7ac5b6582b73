"""Fixed-layout report pages: one line per reported name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import suppressed_number
from ..functions.text import repair_invalid_bytes

# The four trailing fields of a line, and the footer with the year.
_NUMBER = "(ND|<5|[0-9][0-9,]*)"
TRAILING_FIELDS = rf"(<5|[0-9][0-9,]*)\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s*$"
REPORT_YEAR = "OPI GEMS ([0-9]{4}-[0-9]{2})"

COMPENSATION_FIELDS = (
    "Teacher_Count",
    "Teacher_Salary_10th_Pctile",
    "Teacher_Avg_Salary",
    "Teacher_Salary_90th_Pctile",
)


def first_line_with(body: Column, name: Column) -> Column:
    """First line of a page that contains a name.  Lines keep their order, as a
    name may also occur inside a longer one further down."""
    return F.try_element_at(F.filter(F.split(body, "\n"), lambda line: line.contains(name)), F.lit(1))


def report_year(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, REPORT_YEAR, 1), F.lit(""))


def compensation_rows(
    crosswalk: DataFrame, pages: DataFrame, year_region: str | None = None
) -> DataFrame:
    """One row per entity of the crosswalk (entity, region, report_name).

    Each entity meets only the page of its own region (an equality join), and
    picks its line there; entities without a line keep nulls.  One year holds
    for all rows: the footer of ``year_region``, or else the smallest one found.
    """
    texts = pages.select("region", repair_invalid_bytes("body").alias("_body"))
    line = first_line_with(F.col("_body"), F.col("report_name"))
    rows = crosswalk.join(texts, "region", "left").withColumn("_line", line)
    years = texts if year_region is None else texts.filter(F.col("region") == year_region)
    year = years.agg(F.min(report_year(F.col("_body")))).scalar()
    return rows.select(
        F.col("entity").alias("District"),
        *[
            suppressed_number(F.regexp_extract("_line", TRAILING_FIELDS, i)).alias(c)
            for i, c in enumerate(COMPENSATION_FIELDS, start=1)
        ],
        year.alias("Salary_Year"),
    )
