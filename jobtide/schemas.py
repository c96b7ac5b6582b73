"""Declared schemas of the data sets, and the columns readers require."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_TYPES = {
    "s": T.StringType(),
    "d": T.DateType(),
    "n": T.LongType(),
    "x": T.DoubleType(),
    "i": T.IntegerType(),
    "t": T.TimestampType(),
    "b": T.BinaryType(),
}


def struct(**columns: str) -> T.StructType:
    """``struct(title="s", n="n")``: one letter per type, see ``_TYPES``."""
    return T.StructType([T.StructField(name, _TYPES[code]) for name, code in columns.items()])


RAW_PAYLOAD = struct(
    source="s", platform="s", entity="s", url="s", snapshot_date="d", seq="n", body="b"
)

POSTING = struct(
    title="s", date_posted="s", position="s", location="s", url="s", District="s", Posting_Source="s"
)
BOARD_ROW = struct(Title="s", Location="s", Posted_Date="s", Link="s")

POSTINGS_CURRENT = struct(
    title="s", Archive_Date="d", date_posted="d", position="s", location="s", url="s", District="s",
    Posting_Source="s", Posting_Identity_Method="s", Posting_ID="s",
)
TEACHER_HISTORY = struct(
    title="s", Archive_Date="d", position="s", location="s", url="s", District="s", Posting_Source="s",
    Posting_Identity_Method="s", Posting_ID="s", Category="s", Broad_Category="s",
)
CATEGORY_COUNTS = struct(Broad_Category="s", Archive_Date="d", District="s", sum="n")
CATEGORY_COUNTS_NOW = struct(Broad_Category="s", Sum="n", District="s")
DISTRICT_TOTALS = struct(District="s", Archive_Date="d", n="n")
INSTITUTION_TOTALS = struct(Institution="s", Archive_Date="d", n="n")
HE_POSTINGS_CURRENT = struct(
    Title="s", Location="s", Posted_Date="s", Institution="s", Link="s", Archive_Date="d"
)
FACULTY_HISTORY = struct(
    Title="s", Location="s", Posted_Date="s", Institution="s", Link="s", Archive_Date="d",
    Job_Type="s", Category="s",
)
HE_CATEGORY_COUNTS = struct(Category="s", Archive_Date="d", Institution="s", Job_Type="s", sum="n")
HE_CATEGORY_COUNTS_NOW = struct(Category="s", Job_Type="s", Sum="n", Institution="s")
SALARY_HISTORY = struct(
    District="s", Salary_Year="s", Teacher_Count="x", Teacher_Salary_10th_Pctile="x",
    Teacher_Avg_Salary="x", Teacher_Salary_90th_Pctile="x",
)
DISTRICT_CONTEXT = struct(
    District="s", County="s", Latitude="x", Longitude="x", Job_Link="s",
    Teacher_Count="x", Teacher_Salary_10th_Pctile="x", Teacher_Avg_Salary="x",
    Teacher_Salary_90th_Pctile="x", Salary_Year="s", Salary_Source="s",
    Teachers_Total_FTE="x", Enrollment="x", CCD_Year="i", CCD_Source="s",
    Median_Household_Income="x", Median_Gross_Rent="x", Mining_Employment_Share="x",
    Population_Change_Pct="x", ACS_Year="i", Child_Poverty_Rate="x", SAIPE_Year="i",
    Total_General_Fund_Expenditure="x", Finance_FY="s", Finance_Source="s",
)
INSTITUTION_CONTEXT = struct(
    Name="s", County="s", Longitude="x", Latitude="x", Link="s",
    Faculty_Avg_Salary="x", Faculty_Avg_Salary_Professor="x", Faculty_Count="x",
    Salary_Year="s", Salary_Source="s", Faculty_Avg_Salary_Y1Ago="x", Faculty_Avg_Salary_Y2Ago="x",
    Enrollment="x", Enrollment_Year="s", Enrollment_Change_Pct="x",
    Pell_Recipient_Share="x", Pell_Year="s",
    Median_Household_Income="x", Median_Gross_Rent="x", Mining_Employment_Share="x",
    Population_Change_Pct="x", ACS_Year="i",
)
ENTITY_MAP = struct(
    Name="s", Longitude="x", Latitude="x", Type="s", CurrentCount="n", WeeklyNew="n", SampleTitles="s",
    Link="s", Teacher_Count="x", Teacher_Salary_10th_Pctile="x", Teacher_Avg_Salary="x",
    Teacher_Salary_90th_Pctile="x", Salary_Year="s", Faculty_Avg_Salary="x",
    Faculty_Avg_Salary_Professor="x", Faculty_Count="x", Faculty_Avg_Salary_Y1Ago="x",
    Faculty_Avg_Salary_Y2Ago="x", Vacancy_Rate="x", Vacancy_Numerator="n", Vacancy_Denominator="x",
    Salary_Source="s", County="s", Enrollment="x", Students_Per_Teacher="x", Enrollment_Change_Pct="x",
    Pell_Recipient_Share="x", Pell_Year="s", Median_Household_Income="x", Median_Gross_Rent="x",
    Mining_Employment_Share="x", Population_Change_Pct="x", ACS_Year="i", Child_Poverty_Rate="x",
    SAIPE_Year="i", Total_General_Fund_Expenditure="x", Finance_FY="s", Finance_Source="s",
)
RUN_LOG = struct(timestamp="t", source="s", status="s", n_rows="n", error_message="s")

# Columns each data set must carry before a reader may use it.
REQUIRED_COLUMNS: dict[str, list[str]] = {
    "postings_current": [c for c in POSTINGS_CURRENT.names if c != "Archive_Date"],
    "teacher_history": [
        c for c in TEACHER_HISTORY.names if c not in ("position", "url", "Category", "Broad_Category")
    ],
    "category_counts": CATEGORY_COUNTS.names,
    "category_counts_now": CATEGORY_COUNTS_NOW.names,
    "district_totals": DISTRICT_TOTALS.names,
    "district_context": DISTRICT_CONTEXT.names,
    "faculty_history": [c for c in FACULTY_HISTORY.names if c != "Posted_Date"],
    "he_category_counts": HE_CATEGORY_COUNTS.names,
    "he_category_counts_now": HE_CATEGORY_COUNTS_NOW.names,
    "institution_totals": INSTITUTION_TOTALS.names,
    "institution_context": INSTITUTION_CONTEXT.names,
    "he_postings_current": HE_POSTINGS_CURRENT.names,
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A typed frame with no rows."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns, in order and cast; absent ones become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
