"""What changed since when: deltas, movers, short series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .asof import DATE, mark_dates
from .ordering import top_per_key

TREND_OFFSETS = {"month": 28, "quarter": 90, "year": 365}
SERIES_LENGTH = 12


def daily_totals(totals: DataFrame, date: str = DATE, n: str = "n") -> DataFrame:
    """Sum over all entities: one row per snapshot date."""
    return totals.groupBy(date).agg(F.sum(n).alias(n))


def week_over_week(totals: DataFrame, min_days_back: int = 5, date: str = DATE, n: str = "n") -> DataFrame:
    """One row: latest total, the as-of earlier total, and their difference
    (null when no snapshot is old enough)."""
    daily = daily_totals(totals, date, n)
    marks = mark_dates(totals, date, prior=min_days_back)
    latest, prior = marks["latest"], marks["prior"]
    at = lambda day: F.max(F.when(F.col(date) == day, F.col(n)))
    return daily.agg(
        F.max(date).alias("latest_date"),
        F.max(F.when(F.col(date) == prior, F.col(date))).alias("prior_date"),
        at(latest).alias("latest_n"),
        at(prior).alias("prior_n"),
        (at(latest) - at(prior)).alias("delta"),
    )


def deltas_by_date(totals: DataFrame, pairs: DataFrame, date: str = DATE, n: str = "n") -> DataFrame:
    """Every date in ``pairs`` (date, _base) with its total, its base's, and the difference (null without a base)."""
    daily = daily_totals(totals, date, n)
    base = daily.select(F.col(date).alias("prior_date"), F.col(n).alias("prior_n"))
    dated = daily.join(F.broadcast(pairs), date).withColumnRenamed("_base", "prior_date")
    joined = dated.join(base, "prior_date", "left")
    return joined.select(
        date, F.col(n).alias("latest_n"), "prior_date", "prior_n", (F.col(n) - F.col("prior_n")).alias("delta")
    )


def movers(
    totals: DataFrame, name: str, min_days_back: int = 21, date: str = DATE, n: str = "n", marks: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per entity: prior, latest and delta between two as-of dates; an entity
    absent on one side counts as 0 there.  No rows when no snapshot is old enough."""
    marks = marks or mark_dates(totals, date, prior=min_days_back)
    latest, prior = marks["latest"], marks["prior"]
    wide = (
        totals.filter(prior.isNotNull() & ((F.col(date) == latest) | (F.col(date) == prior)))
        .groupBy(name)
        .agg(
            F.sum(F.when(F.col(date) == prior, F.col(n)).otherwise(F.lit(0))).alias("prior"),
            F.sum(F.when(F.col(date) == latest, F.col(n)).otherwise(F.lit(0))).alias("latest"),
        )
    )
    return wide.withColumn("delta", F.col("latest") - F.col("prior"))


def biggest_mover(totals: DataFrame, name: str, min_days_back: int = 21, date: str = DATE, n: str = "n") -> DataFrame:
    """The entity with the largest absolute change; name order breaks ties."""
    marks = mark_dates(totals, date, prior=min_days_back)
    top = movers(totals, name, min_days_back, date, n, marks).orderBy(F.desc(F.abs("delta")), F.col(name)).limit(1)
    return top.withColumn("prior_date", marks["prior"]).withColumn("latest_date", marks["latest"])


def last_n_series(
    totals: DataFrame, keys: Sequence[str], k: int = SERIES_LENGTH, date: str = DATE, n: str = "n", out: str = "series"
) -> DataFrame:
    """Per key the values at its ``k`` newest dates, oldest first, as an array."""
    daily = totals.groupBy(*keys, date).agg(F.sum(n).alias(n))
    recent = top_per_key(daily, list(keys), [F.desc(date)], k)
    points = F.sort_array(F.collect_list(F.struct(F.col(date).alias("_d"), F.col(n).alias("_n"))))
    return recent.groupBy(*keys).agg(F.transform(points, lambda p: p["_n"]).alias(out))


def current_trends(
    history: DataFrame,
    category: str = "Category",
    date: str = DATE,
    n: str = "n",
    offsets: Mapping[str, int] = TREND_OFFSETS,
    k: int = SERIES_LENGTH,
) -> DataFrame:
    """One row per category present at the latest date: current count, change
    against each as-of date, and its recent series.

    A category missing at an existing earlier date counts as 0 there; when the
    date itself does not exist the change is null.
    """
    daily = history.groupBy(category, date).agg(F.sum(n).alias(n))
    marks = mark_dates(history, date, **offsets)
    latest = marks["latest"]
    earlier: dict[str, Column] = {name: marks[name] for name in offsets}

    def value_at(day: Column) -> Column:
        return F.sum(F.when(F.col(date) == day, F.col(n)).otherwise(F.lit(0)))

    now = (
        daily.groupBy(category)
        .agg(
            F.max(date).alias("_seen"),
            value_at(latest).alias("current"),
            *[value_at(day).alias(f"_{name}") for name, day in earlier.items()],
        )
        .filter(F.col("_seen") == latest)
    )
    deltas = [
        F.when(day.isNotNull(), F.col("current") - F.col(f"_{name}")).alias(f"vs_{name}_ago")
        for name, day in earlier.items()
    ]
    series = last_n_series(daily, [category], k, date, n)
    return (
        now.select(category, "current", *deltas)
        .join(series, category, "left")
        .orderBy(F.desc("current"), F.col(category))
    )


def top_k(df: DataFrame, by: str, k: int, tie_break: str) -> DataFrame:
    """The k largest values (nulls left out); becomes a bounded heap per task."""
    return df.filter(F.col(by).isNotNull()).orderBy(F.desc(by), F.col(tie_break)).limit(k)
