"""Data-quality checks.  Each returns the offending rows; ``require_*`` raises."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.text import has_encoding_fault
from ..session import settled
from .ordering import exact_median

# R's mad() scales by this constant so that it estimates a standard deviation.
MAD_CONSTANT = 1.4826

DRIFT_MIN_WEEKS = 2
DRIFT_DROP_THRESHOLD = 0.2
OUTLIER_CEILING = 0.25
OUTLIER_MADS = 5.0
OUTLIER_MIN_ENTITIES = 3
HALVING_LIMIT = 0.5


class QualityError(ValueError):
    """A check that must stop a write has failed."""


class HalvedError(QualityError):
    """More than half of the postings are gone: the one refusal that may be overruled, as boards do empty."""


def missing_columns(spark: SparkSession, data_set: str, actual: Sequence[str], required: Sequence[str]) -> DataFrame:
    """One row per required column that is absent; extra columns are fine."""
    absent = [c for c in required if c not in set(actual)]
    return spark.createDataFrame([(data_set, c) for c in absent], "file string, missing_column string")


def pad_columns(df: DataFrame, schema: T.StructType, source: str) -> tuple[DataFrame, DataFrame]:
    """Add the schema's absent columns as typed nulls, and report them."""
    report = missing_columns(df.sparkSession, source, df.columns, schema.names)
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in set(df.columns)}
    return (df.withColumns(absent) if absent else df), report


def require_same_columns(existing: T.StructType, new: T.StructType, what: str) -> None:
    """An append may not add, drop or retype columns silently."""
    held, given = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (existing, new))
    if held != given:
        raise QualityError(
            f"{what}: column mismatch between existing ({', '.join(f'{n} {t}' for n, t in sorted(held.items()))}) "
            f"and new rows ({', '.join(f'{n} {t}' for n, t in sorted(given.items()))})"
        )


def total_mismatches(totals: DataFrame, parts: DataFrame, keys: Sequence[str], value: str = "sum") -> DataFrame:
    """Groups whose total row is not the sum of its parts, or that one side lacks."""
    left = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(value).alias("total_value"))
    right = (
        parts.groupBy(*keys)
        .agg(F.sum(value).alias("parts_sum"))
        .select(*[F.col(k).alias(f"_p_{k}") for k in keys], "parts_sum")
    )
    same = reduce(and_, (F.col(f"_t_{k}").eqNullSafe(F.col(f"_p_{k}")) for k in keys))
    joined = left.withColumn("_in_t", F.lit(True)).join(right, same, "full")
    unequal = (
        F.col("total_value").isNull() | F.col("parts_sum").isNull() | (F.col("total_value") != F.col("parts_sum"))
    )
    return joined.filter(unequal).select(
        *[F.when(F.col("_in_t"), F.col(f"_t_{k}")).otherwise(F.col(f"_p_{k}")).alias(k) for k in keys],
        "total_value",
        "parts_sum",
    )


def require_totals_match(totals: DataFrame, parts: DataFrame, keys: Sequence[str], value: str = "sum") -> None:
    sample = total_mismatches(totals, parts, keys, value).take(20)
    if sample:
        raise QualityError("total rows differ from the sum of their parts: " + "; ".join(map(str, sample)))


def historical_counts(
    snapshots: DataFrame, name: str, date: str = "Archive_Date", valid_from: dt.date | None = None
) -> DataFrame:
    """Per source: number of snapshots it occurs in and its mean count there.
    A snapshot without the source adds no zero."""
    kept = snapshots.filter(F.col(name).isNotNull())
    if valid_from is not None:
        kept = kept.filter(F.col(date) >= F.lit(valid_from))
    weekly = kept.groupBy(F.col(name).alias("name"), F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return weekly.groupBy("name").agg(F.count(F.lit(1)).alias("n_weeks"), F.avg("_n").alias("mean_count"))


def drift_flags(
    current: DataFrame,
    baseline: DataFrame,
    min_weeks: int = DRIFT_MIN_WEEKS,
    drop_threshold: float = DRIFT_DROP_THRESHOLD,
) -> DataFrame:
    """Sources far below their own baseline; a vanished source counts 0."""
    joined = baseline.join(current.select("name", "count"), "name", "left").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0))
    )
    return (
        joined.filter((F.col("n_weeks") >= min_weeks) & (F.col("mean_count") > 0))
        .filter(F.col("count") <= F.col("mean_count") * drop_threshold)
        .select("name", "mean_count", "n_weeks", "count")
        .orderBy(F.desc("mean_count"), "name")
    )


def coverage_gaps(df: DataFrame, columns: Sequence[str], expected: int, min_ok: int | None = None) -> DataFrame:
    """One row per column with fewer values present than acceptable."""
    floor = expected if min_ok is None else min_ok
    counted = df.agg(*[F.count(c).alias(c) for c in columns])
    long = counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.lit(expected).alias("expected"), F.col(c).alias("actual")) for c in columns])
        ).alias("r")
    ).select("r.*")
    return long.filter(F.col("actual") < floor)


def out_of_bounds(df: DataFrame, entity: str, value: str, low: float, high: float, name: str) -> DataFrame:
    """Values outside [low, high]; missing values are not judged."""
    return df.filter((F.col(value) < low) | (F.col(value) > high)).select(
        F.lit(name).alias("name"),
        F.col(entity).alias("entity"),
        F.col(value).alias("value"),
        F.lit(low).alias("min_ok"),
        F.lit(high).alias("max_ok"),
    )


def robust_spread(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """(center, spread): exact median and scaled median absolute deviation.

    The second median needs the first, so each is computed as one number and
    goes into the next plan as a literal.  (None, None) without any value.
    """
    center = exact_median(df, column)
    if center is None:
        return None, None
    deviations = df.select(F.abs(F.col(column) - F.lit(center)).alias("_dev"))
    return center, MAD_CONSTANT * exact_median(deviations, "_dev")


def change_outliers(
    current: DataFrame,
    prior: DataFrame,
    name: str = "name",
    value: str = "value",
    ceiling: float = OUTLIER_CEILING,
    mads: float = OUTLIER_MADS,
) -> DataFrame:
    """Entities whose relative change is both large and unlike everybody else's.

    Needs three comparable entities.  With a spread of zero the ceiling alone
    decides.  The compared pairs are settled once, as three passes read them.
    """
    pairs = settled(
        current.select(name, F.col(value).cast("double").alias("current"))
        .join(prior.select(name, F.col(value).cast("double").alias("prior")), name)
        .filter(F.col("current").isNotNull() & (F.col("prior") != 0))
        .withColumn("pct_change", (F.col("current") - F.col("prior")) / F.col("prior"))
    )
    if pairs.limit(OUTLIER_MIN_ENTITIES).count() < OUTLIER_MIN_ENTITIES:
        return pairs.filter(F.lit(False)).select(name, "prior", "current", "pct_change")
    center, spread = robust_spread(pairs, "pct_change")
    flagged = F.abs("pct_change") > ceiling
    if spread > 0:
        flagged &= F.abs(F.col("pct_change") - F.lit(center)) > mads * spread
    return pairs.filter(flagged).select(name, "prior", "current", "pct_change")


def halved(before: DataFrame, after: DataFrame, side: str) -> DataFrame:
    """Sides whose posting count fell by more than half; both frames are (side, n)."""
    joined = before.groupBy(side).agg(F.sum("n").alias("before_n")).join(
        after.groupBy(side).agg(F.sum("n").alias("after_n")), side, "left"
    )
    return joined.withColumn("after_n", F.coalesce("after_n", F.lit(0))).filter(
        F.col("after_n") < F.col("before_n") * HALVING_LIMIT
    )


def require_not_halved(before: DataFrame, after: DataFrame, side: str, accepted: Sequence[str] = ()) -> list[Row]:
    """Refuses every side that ``halved`` finds, except the ``accepted`` ones: theirs are given back."""
    found = halved(before, after, side)
    may_pass = F.coalesce(F.col(side).isin(*accepted), F.lit(False))
    lost = (found.filter(~may_pass) if accepted else found).take(20)
    if lost:
        raise HalvedError("more than half of the postings are gone: " + "; ".join(map(str, lost)))
    return found.filter(may_pass).collect() if accepted else []


def encoding_faults(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not valid UTF-8 or holds a replacement character."""
    return df.filter(has_encoding_fault(column))


def crosswalk_gaps(crosswalk: DataFrame, registry: DataFrame, entity: str = "entity", registered: str = "entity") -> DataFrame:
    """Entities mapped but not registered, and registered but not mapped."""
    mapped = crosswalk.select(F.col(entity).alias("entity")).distinct()
    known = registry.select(F.col(registered).alias("entity")).distinct()
    return (
        mapped.join(known, "entity", "left_anti").withColumn("problem", F.lit("not registered"))
        .unionByName(known.join(mapped, "entity", "left_anti").withColumn("problem", F.lit("not mapped")))
    )


def failed_checks(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One table out of many checks: (check, detail) with the row as JSON."""
    parts = [
        df.select(F.lit(name).alias("check"), F.to_json(F.struct(*df.columns)).alias("detail"))
        for name, df in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)
