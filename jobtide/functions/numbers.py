"""Survey number cleaning, guarded ratios and display forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_column

# Map marker radius limits and growth.
MARKER_MIN, MARKER_MAX, MARKER_GROWTH = 6.0, 24.0, 1.2

# Fixed value: a vacancy rate below this many positions is not reported.
VACANCY_MIN_POSITIONS = 10


def non_negative(x: Column | str) -> Column:
    """Survey sentinels (-1, -2, -666666666 ...) are negative: make them null."""
    x = as_column(x)
    return F.when(x >= 0, x)


def number_or_null(x: Column | str) -> Column:
    return as_column(x).try_cast("double")


def suppressed_number(x: Column | str) -> Column:
    """"1,234" -> 1234.0; suppressed cells ("ND", "<5") -> null."""
    return number_or_null(F.replace(as_column(x), F.lit(","), F.lit("")))


def first_clean(*alternatives: Column | str) -> Column:
    """First alternative that is present and not a sentinel."""
    return F.coalesce(*[non_negative(a) for a in alternatives])


def guarded_ratio(num: Column | str, den: Column | str, at_least: float | None = None) -> Column:
    """num / den where den is positive (or reaches ``at_least``), else null."""
    num, den = as_column(num).cast("double"), as_column(den).cast("double")
    ok = den > 0 if at_least is None else den >= at_least
    return F.when(ok, F.try_divide(num, den))


def change_ratio(current: Column | str, prior: Column | str) -> Column:
    """Relative change, null unless the prior value is positive."""
    current, prior = as_column(current).cast("double"), as_column(prior).cast("double")
    return guarded_ratio(current - prior, prior)


def marker_radius(n: Column | str) -> Column:
    return F.least(F.lit(MARKER_MAX), F.lit(MARKER_MIN) + F.lit(MARKER_GROWTH) * F.sqrt(as_column(n)))


def percent(x: Column | str, signed: bool = False) -> Column:
    """0.0655 -> 6.6%; ``signed`` adds a plus to values that are not negative."""
    x = as_column(x)
    shown = F.format_string("%.1f%%", F.bround(x * 1000, 0) / 10)
    if signed:
        shown = F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), shown)
    return F.when(x.isNotNull(), shown)


def dollars(x: Column | str, suffix: str = "") -> Column:
    """Whole dollars with thousands marks."""
    x = as_column(x).cast("double")
    sign = F.when(x < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.when(
        x.isNotNull(),
        F.concat(sign, F.format_number(F.bround(F.abs(x), 0), 0), F.lit(suffix)),
    )


def one_decimal(x: Column | str) -> Column:
    x = as_column(x)
    return F.when(x.isNotNull(), F.format_string("%.1f", F.bround(x * 10, 0) / 10))
