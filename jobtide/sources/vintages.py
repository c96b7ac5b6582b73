"""The newest landed year within a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# How many years back each survey may lag.
YEARS_BACK = {"salaries": 5, "staffing": 5, "enrollment": 5, "grants": 6, "county": 3, "poverty": 4}


def latest_year(df: DataFrame, start_year: int, years_back: int, year: str = "year") -> int | None:
    """The newest year in [start_year - years_back, start_year] that has landed.

    One number is fetched, so that the filters made from it reach the files.
    """
    return df.filter(F.col(year).between(start_year - years_back, start_year)).agg(F.max(year)).first()[0]


def at_year(df: DataFrame, value: int | None, year: str = "year") -> DataFrame:
    """Rows of one year; none if there is no such year."""
    return df.filter(F.lit(False) if value is None else F.col(year) == F.lit(value))


def latest_vintage(
    df: DataFrame, start_year: int, years_back: int, year: str = "year", required: bool = False
) -> DataFrame:
    """Rows of the newest landed year within the window.

    Without any such row the result is empty, or an error where ``required``.
    """
    newest = latest_year(df, start_year, years_back, year)
    if newest is None and required:
        raise LookupError(f"no vintage between {start_year - years_back} and {start_year}")
    return at_year(df, newest, year)
