"""Joins to dimensions, crosswalks and earlier vintages.

No join is hinted: Catalyst broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, and adaptive
execution revisits the choice with real sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settled

from ..functions.numbers import change_ratio
from .counts import EntityRule, pivot_wide


def left_join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equality join in which a missing key matches a missing key."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))
    return left.join(renamed, same, "left").drop(*[f"_{c}" for c in on])


def onto_registry(registry: DataFrame, previous: DataFrame | None, key: str) -> DataFrame:
    """The registry decides the rows and its own columns; the previous table
    contributes its other columns.  Entities no longer registered disappear."""
    if previous is None:
        return registry
    own = [c for c in registry.columns if c != key]
    return registry.join(previous.drop(*own), key, "left")


def refresh_columns(
    base: DataFrame,
    fresh: DataFrame,
    key: str,
    columns: Sequence[str],
    tag: tuple[str, str] | None = None,
) -> DataFrame:
    """Replace a group of columns by a newly landed one, or keep the last good.

    All or nothing: an empty ``fresh`` leaves the table as it is; otherwise an
    entity missing from ``fresh`` gets nulls and not its old values.  ``fresh`` is worked out
    once, for the look whether it is empty and for the join.
    """
    fresh = settled(fresh.select(key, *columns))
    if fresh.isEmpty():
        return base
    dropped = [*columns, *([tag[0]] if tag else [])]
    out = base.drop(*dropped).join(fresh, key, "left")
    return out.withColumn(tag[0], F.lit(tag[1])) if tag else out


def unless_empty(result: DataFrame, *sources: DataFrame) -> DataFrame:
    """No rows at all when any of the sources landed empty, so that a refresh
    can tell "nothing came" from "came without a value"."""
    return result.filter(F.lit(False)) if any(source.isEmpty() for source in sources) else result


def change_between(
    current: DataFrame, prior: DataFrame, key: str, value: str, out: str
) -> DataFrame:
    """Relative change of entities present in both vintages."""
    earlier = prior.select(key, F.col(value).alias("_prior"))
    return current.join(earlier, key, "inner").select(key, change_ratio(value, "_prior").alias(out))


def canonical_name(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace known misspellings; ``aliases`` has columns (alias, canonical)."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical")).dropDuplicates(["_alias"])
    return (
        df.join(known, F.col(column) == F.col("_alias"), "left")
        .withColumn(column, F.coalesce(F.col("_canonical"), F.col(column)))
        .drop("_alias", "_canonical")
    )


def crosswalk_table(spark: SparkSession, names: dict[str, Sequence[str]]) -> DataFrame:
    """{entity: [names used by the source]} as rows (entity, source_name)."""
    rows = [(entity, name) for entity, listed in names.items() for name in listed]
    return spark.createDataFrame(rows, "entity string, source_name string")


def crosswalk_aggregate(
    crosswalk: DataFrame, source: DataFrame, name: str, entity_out: str, **rules: EntityRule
) -> DataFrame:
    """One row per entity of the crosswalk (1 entity, N source names).

    The source is first reduced to one row per name, with partial sums on the
    map side; a name with most of the rows is no burden to the join.
    """
    values = sorted({r.value for r in rules.values()})
    per_name = source.groupBy(F.col(name).alias("source_name")).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_sum_{v}") for v in values],
        *[F.count(v).alias(f"_present_{v}") for v in values],
    )
    return (
        crosswalk.join(per_name, "source_name", "left")
        .groupBy(F.col("entity").alias(entity_out))
        .agg(*[r.finish(f"_sum_{r.value}", f"_present_{r.value}", "_rows").alias(label) for label, r in rules.items()])
    )


def years_ago_columns(
    trend: DataFrame, key: str, year: str, value: str, prefix: str, years: int = 2, suffix: str = "Ago"
) -> DataFrame:
    """Long (key, year, value) -> one column per number of years before the latest."""
    latest = trend.agg(F.max(year)).scalar()
    return pivot_wide(
        trend.filter(F.col(year) < latest),
        [key],
        latest - F.col(year),
        {k: f"{prefix}_Y{k}{suffix}" for k in range(1, years + 1)},
        value,
    )
