"""Date parsing and date windows.  Nothing here raises on bad input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .text import as_column, computed_once

# Tried in this order, so month-first wins over day-first where both fit.
# Separators are folded to one space before parsing.  Each layout is tried only
# on text of its shape, as a failed attempt costs far more than the look.
_N, _MON, _MONTH, _CLOCK = r"\d{1,2}", "[A-Za-z]{3}", "[A-Za-z]{3,9}", r"\d{1,2}:\d{2}"
DATE_LAYOUTS = (
    ("MMM d yyyy h:mm a", rf"{_MON} {_N} \d{{4}} {_CLOCK} [A-Za-z]{{2}}"),
    ("MMMM d yyyy h:mm a", rf"{_MONTH} {_N} \d{{4}} {_CLOCK} [A-Za-z]{{2}}"),
    ("yyyy M d", rf"\d{{4}} {_N} {_N}"),
    ("yyyyMMdd", r"\d{8}"),
    ("yyyy MMM d", rf"\d{{4}} {_MON} {_N}"),
    ("M d yyyy", rf"{_N} {_N} \d{{4}}"),
    ("M d yy", rf"{_N} {_N} \d{{2}}"),
    ("MMM d yyyy", rf"{_MON} {_N} \d{{4}}"),
    ("MMMM d yyyy", rf"{_MONTH} {_N} \d{{4}}"),
    ("d M yyyy", rf"{_N} {_N} \d{{4}}"),
    ("d M yy", rf"{_N} {_N} \d{{2}}"),
    ("d MMM yyyy", rf"{_N} {_MON} \d{{4}}"),
    ("d MMMM yyyy", rf"{_N} {_MONTH} \d{{4}}"),
    ("yyyy M d H:mm:ss", rf"\d{{4}} {_N} {_N} {_CLOCK}:\d{{2}}"),
)


def parse_with(x: Column | str, pattern: str) -> Column:
    return F.try_to_timestamp(as_column(x), F.lit(pattern)).cast("date")


def parse_any_date(x: Column | str) -> Column:
    """First listed layout that fits, else null."""
    folded = F.trim(F.regexp_replace(as_column(x).cast("string"), r"[\s,/.\-]+", " "))
    return computed_once(
        folded, lambda t: F.coalesce(*[F.when(t.rlike(f"^{shape}$"), parse_with(t, p)) for p, shape in DATE_LAYOUTS])
    )


#: Dates in ISO form, which the layout "yyyy M d" reads as a cast does.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def standardize_date(x: Column | str) -> Column:
    """Drop a trailing parenthesised remark, then parse.  Dates in ISO form, the most common one, are cast, with the same outcome."""
    text = as_column(x).cast("string")
    return F.when(text.rlike(ISO_DATE), text.try_cast("date")).otherwise(parse_any_date(F.regexp_replace(text, r"\s*\(.*\)$", "")))


def archive_date(x: Column | str) -> Column:
    """Snapshot stamps come as m/d/Y or Y-m-d; anything else is null."""
    x = as_column(x).cast("string")
    return F.when(x.contains("/"), parse_with(x, "M/d/yyyy")).when(
        x.contains("-"), parse_with(x, "yyyy-M-d")
    )


def posted_or_listed(x: Column | str, as_of: dt.date | Column, stale_after_days: int = 180) -> Column:
    """Prefix old dates with "Listed since"; the given text itself is kept."""
    x = as_column(x).cast("string")
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    stale = parse_any_date(x) < F.date_sub(today, stale_after_days)
    return F.concat(F.when(stale, F.lit("Listed since ")).otherwise(F.lit("")), x)


def leading_date(x: Column | str) -> Column:
    """The first ten characters, where ISO stamps carry the day."""
    return F.substring(as_column(x), 1, 10)


def timeline_window(df: DataFrame, date_col: str = "Archive_Date", days: int = 365) -> DataFrame:
    """One row: window start and end, plus the note for short histories."""
    first, last = F.min(date_col), F.max(date_col)
    span = F.datediff(last, first)
    return df.agg(
        F.greatest(first, F.date_sub(last, days)).alias("window_start"),
        last.alias("window_end"),
        span.alias("span_days"),
        F.when(
            span < 365,
            F.concat(F.lit("Only "), span.cast("string"), F.lit(" days of archived history are currently available.")),
        )
        .otherwise(F.lit(""))
        .alias("history_note"),
    )
