"""Snapshot dates and as-of lookups.

Snapshots come at irregular intervals, so "a week ago" is the newest snapshot
on or before a target day and never the previous row.  All dates a query needs
are read off by one scalar subquery over the distinct snapshot dates, which
Spark runs once; over a table partitioned by date the result prunes partitions
at run time.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settled
from .ordering import HOT_ROWS, apart, hot_keys

DATE = "Archive_Date"


def snapshot_marks(df: DataFrame, date: str = DATE, **days_back: int) -> Column:
    """A struct ``latest``, ``previous`` and, per keyword, the newest date at
    least that many days before the latest.  A mark that does not exist is null.

    ``collect_set`` holds one entry per calendar day, however many rows there are.
    """
    one_row = df.agg(F.sort_array(F.collect_set(date)).alias("_dates"))
    latest = F.try_element_at("_dates", F.lit(-1))
    marks = {"latest": latest, "previous": F.try_element_at("_dates", F.lit(-2))}
    for name, days in days_back.items():
        target = F.date_sub(latest, days)
        marks[name] = F.array_max(F.filter("_dates", _not_after(target)))
    return one_row.select(F.struct(*[c.alias(n) for n, c in marks.items()])).scalar()


def _not_after(day: Column) -> Callable[[Column], Column]:
    return lambda d: d <= day


def at_latest(df: DataFrame, date: str = DATE) -> DataFrame:
    return df.filter(F.col(date) == snapshot_marks(df, date)["latest"])


def mark_dates(df: DataFrame, date: str = DATE, **days_back: int) -> dict[str, Column]:
    """The same marks looked up now and given as literals, so that the plans built on them read the
    table no further times for its dates and prune its partitions while they are planned."""
    kind = df.schema[date].dataType
    names = ["latest", "previous", *days_back]
    row = df.sparkSession.range(1).select(snapshot_marks(df, date, **days_back).alias("m")).first()["m"]
    return {name: F.lit(row[name]).cast(kind) for name in names}


def base_dates(dates: Iterable[dt.date], back: int = 1) -> list[tuple[dt.date, dt.date | None]]:
    """Each date with the newest one at least ``back`` days before it (None where there is none)."""
    known = sorted(set(dates))
    bases = []
    for day in known:
        place = bisect_right(known, day - dt.timedelta(back))
        bases.append((day, known[place - 1] if place else None))
    return bases


def as_of_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_date: str, right_date: str, values: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every left row the right row of the same key with the newest date
    not after the left date; ``right`` holds one row per key and snapshot date.

    Both sides are united and settled, so each is evaluated once, and the newest right row is carried forward in
    order of the date.  Only keys found to be hot are dealt by range of (key, date) over many
    partitions; there the last right row of a key's earlier partitions is handed to the partitions
    after it.  The largest values speak for a date that occurs twice; a left row without a date or a
    key finds nothing.
    """
    per_date = (
        right.filter(reduce(and_, (F.col(c).isNotNull() for c in [right_date, *on])))
        .groupBy(*on, F.col(right_date).alias("_d"))
        .agg(F.max(F.struct(*values)).alias("_v"))
    )
    hit = F.struct(F.col("_d").alias("d"), *[F.col(f"_v.{v}").alias(v) for v in values])
    rows = F.struct(*[F.col(c) for c in left.columns])
    given = per_date.select(*on, "_d", hit.alias("_hit"), F.lit(0).alias("_side"))
    asked = left.select(*on, F.col(left_date).alias("_d"), rows.alias("_row"), F.lit(1).alias("_side"))
    both = given.unionByName(asked, allowMissingColumns=True)
    rows = settled(both)
    hot = hot_keys(rows, on, hot_rows)
    cold, warm = (rows, None) if hot is None else apart(rows, hot, on)
    here = Window.partitionBy(*on).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = cold.withColumn("_found", F.last("_hit", ignorenulls=True).over(here)).filter("_side = 1").select("_row", "_d", "_found")
    if warm is not None:
        found = found.unionByName(_carried_by_range(warm, on))
    hit = F.when(F.col("_d").isNotNull(), F.col("_found"))
    return found.withColumn("_found", hit).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in left.columns],
        F.col("_found.d").alias(right_date),
        *[F.col(f"_found.`{v}`").alias(v) for v in values],
    )


def _carried_by_range(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The asked rows with the newest right row of their key, worked out in ranges of (key, date)."""
    ranged = settled(rows.repartitionByRange(*on, "_d", "_side").withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*on, "_part").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = ranged.withColumn("_own", F.last("_hit", ignorenulls=True).over(here)).filter("_side = 1")
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*on, "_part").agg(F.max("_hit").alias("_end"))  # the newest date is the largest
    handed = ends.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col("_part").alias("_to"), F.last("_end", ignorenulls=True).over(before).alias("_handed"))
    same = [F.col("_part") == F.col("_to"), *[F.col(c) == F.col(f"_on_{c}") for c in on]]
    joined = carried.join(handed.filter(F.col("_handed").isNotNull()), same, "left")
    return joined.select("_row", "_d", F.coalesce("_own", "_handed").alias("_found"))
