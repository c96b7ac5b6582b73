"""Source health: drift against each source's own past, value checks, page signals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..functions.signals import page_signal
from ..operators.asof import DATE, snapshot_marks
from ..operators.quality import OUTLIER_MADS, change_outliers, drift_flags, failed_checks, historical_counts

# Fixed value: earlier snapshots did not cover all sources.
BASELINE_VALID_FROM = dt.date(2026, 8, 6)


def source_drift(snapshots: DataFrame, name: str, valid_from: dt.date | None = BASELINE_VALID_FROM) -> DataFrame:
    """Sources whose latest snapshot is far below their mean over the earlier ones."""
    latest = snapshot_marks(snapshots, DATE)["latest"]
    baseline = historical_counts(snapshots.filter(F.col(DATE) < latest), name, DATE, valid_from)
    current = (
        snapshots.filter(F.col(DATE) == latest)
        .groupBy(F.col(name).alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return drift_flags(current, baseline)


def corroborated(flagged: DataFrame, urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Flagged sources with their address and what the page there looks like.

    ``urls`` is (name, url), ``pages`` is (url, text) of freshly landed pages.
    """
    seen = pages.select("url", page_signal("text").alias("signal"))
    return (
        flagged.join(urls, "name", "left")
        .join(seen, "url", "left")
        .withColumn("signal", F.coalesce("signal", F.lit("inconclusive")))
    )


def value_checks(
    df: DataFrame, entity: str, covered: Sequence[str], ranges: Mapping[str, tuple[float, float]], min_ok: int | None = None
) -> DataFrame:
    """(check, name, entity, actual, detail): columns of ``covered`` with fewer values than ``min_ok`` (than there are
    rows, if not given), and values of ``ranges`` columns outside their bounds.

    One pass: every row gives what each check has to say about it, which is then added up by check.
    """
    said = [
        F.struct(
            F.lit("coverage").alias("check"), F.lit(c).alias("name"), F.lit(None).cast("string").alias("entity"),
            F.lit(None).cast("double").alias("value"), F.col(c).isNotNull().cast("long").alias("present"), F.lit(None).cast("string").alias("bounds"),
        )
        for c in covered
    ] + [
        F.struct(
            F.lit("bounds").alias("check"), F.lit(c).alias("name"), F.col(entity).cast("string").alias("entity"),
            F.col(c).cast("double").alias("value"), F.lit(None).cast("long").alias("present"), F.lit(f"{low} to {high}").alias("bounds"),
        )
        for c, (low, high) in ranges.items()
    ]
    outside = [(F.col("name") == c) & ((F.col("value") < low) | (F.col("value") > high)) for c, (low, high) in ranges.items()]
    rows = df.select(F.explode(F.array(*said)).alias("r")).select("r.*")
    kept = rows.filter(reduce(or_, outside, F.col("check") == "coverage"))
    added = kept.groupBy("check", "name", "entity", "value", "bounds").agg(F.sum("present").alias("present"), F.count(F.lit(1)).alias("rows"))
    floor = F.col("rows") if min_ok is None else F.lit(min_ok).cast("long")
    gap = (F.col("check") == "coverage") & (F.col("present") < floor)
    return added.filter((F.col("check") == "bounds") | gap).select(
        "check", "name", "entity", F.coalesce("value", F.col("present").cast("double")).alias("actual"),
        F.when(gap, F.concat(F.lit("at least "), floor.cast("string"))).otherwise(F.col("bounds")).alias("detail"),
    )


def salary_checks(current: DataFrame, prior: DataFrame, name: str = "name", value: str = "value", mads: float = OUTLIER_MADS) -> DataFrame:
    """(check, name, entity, actual, detail) of entities whose value changed implausibly; actual is the relative change."""
    return change_outliers(current, prior, name, value, mads=mads).select(
        F.lit("plausibility").alias("check"), F.lit(value).alias("name"), F.col(name).cast("string").alias("entity"),
        F.col("pct_change").alias("actual"),
        F.concat_ws(" to ", F.col("prior").cast("decimal(38,2)").cast("string"), F.col("current").cast("decimal(38,2)").cast("string")).alias("detail"),
    )


def source_checks(snapshots: DataFrame, name: str, urls: DataFrame, pages: DataFrame, valid_from: dt.date | None = BASELINE_VALID_FROM) -> DataFrame:
    """(check, name, entity, actual, detail): a drift row for every source far below its past, and a page row with
    what its page looks like.  actual is its count now; the drift detail is its mean."""
    flagged = corroborated(source_drift(snapshots, name, valid_from), urls, pages)
    mean = F.concat(F.lit("mean "), F.round("mean_count", 2).cast("decimal(38,2)").cast("string"))
    found = F.array(
        F.struct(F.lit("drift").alias("check"), mean.alias("detail")),
        F.struct(F.lit("page").alias("check"), F.col("signal").alias("detail")),
    )
    return flagged.select(F.explode(found).alias("r"), "name", "count").select(
        "r.check", F.lit(name).alias("name"), F.col("name").alias("entity"), F.col("count").cast("double").alias("actual"), "r.detail"
    )


def source_health(*checks: DataFrame) -> DataFrame:
    """One report of all checks: what failed, in which column or source, for which entity, the value and the detail."""
    return reduce(DataFrame.unionByName, checks)


def health_report(**checks: DataFrame) -> DataFrame:
    """Failed checks of any shape in one table, each row as JSON."""
    return failed_checks(checks)
