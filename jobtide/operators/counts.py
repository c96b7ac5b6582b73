"""Counts by category, date and entity, with their total rows, and the NA-aware sums."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TOTAL = "Total"


def distinct_counts(df: DataFrame, keys: Sequence[str], identity: str = "Posting_ID", out: str = "sum") -> DataFrame:
    """Exact distinct identities per key.  Spark de-duplicates (key, identity) pairs
    before it groups by key, so a hot key does not pile up in one task."""
    return df.groupBy(*keys).agg(F.countDistinct(identity).alias(out))


def row_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def flagged_totals(parts: DataFrame, keys: Sequence[str], entity: str, value: str = "sum") -> DataFrame:
    """Part rows plus one total row per ``keys``, told apart by ``is_total`` and not by a name.

    The total is the sum of the parts, those without an entity included.  The part rows
    are already aggregated, so the grouping sets double a small table and not the postings.
    """
    cols = [*keys, entity]
    summed = parts.groupingSets([cols, list(keys)], *cols).agg(
        F.sum(value).alias("_value"), (F.grouping(entity) == 1).alias("is_total")
    )
    return summed.select(*keys, entity, F.col("_value").alias(value), "is_total")


def named_totals(flagged: DataFrame, keys: Sequence[str], entity: str, value: str = "sum") -> DataFrame:
    """The stored form of ``flagged_totals``: the entity of a total row is "Total"."""
    label = F.when(F.col("is_total"), F.lit(TOTAL)).otherwise(F.col(entity))
    return flagged.select(*keys, label.alias(entity), value)


def with_total_rows(parts: DataFrame, keys: Sequence[str], entity: str, value: str = "sum") -> DataFrame:
    """Part rows plus one row per ``keys`` whose entity is "Total"."""
    return named_totals(flagged_totals(parts, keys, entity, value), keys, entity, value)


def distinct_counts_with_total(
    df: DataFrame, keys: Sequence[str], entity: str, identity: str = "Posting_ID", out: str = "sum"
) -> DataFrame:
    """Total = sum of the per-entity distinct counts, not a distinct count of its own."""
    return with_total_rows(distinct_counts(df, [*keys, entity], identity, out), keys, entity, out)


def row_counts_with_total(df: DataFrame, keys: Sequence[str], entity: str, out: str = "sum") -> DataFrame:
    return with_total_rows(row_counts(df, [*keys, entity], out), keys, entity, out)


def without_total_rows(df: DataFrame, entity: str) -> DataFrame:
    """Must precede any further summing, or every value doubles.  Rows without an entity are parts."""
    return df.filter(~F.col(entity).eqNullSafe(TOTAL))


def resum(df: DataFrame, keys: Sequence[str], value: str = "sum", relabel: Mapping[str, Column] | None = None) -> DataFrame:
    """Relabel key columns, then add up the rows that now fall together."""
    for name, expression in (relabel or {}).items():
        df = df.withColumn(name, expression)
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def summary_counts(df: DataFrame, key: str, k: int = 10, out: str = "n") -> DataFrame:
    """The k most frequent values, name order breaking ties."""
    return row_counts(df, [key], out).orderBy(F.desc(out), F.col(key).asc_nulls_last()).limit(k)


def value_range(df: DataFrame, column: str, if_none: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """One row (low, high); a column without any value gets ``if_none``."""
    return df.agg(
        F.coalesce(F.min(column), F.lit(if_none[0])).alias("low"),
        F.coalesce(F.max(column), F.lit(if_none[1])).alias("high"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def single_value(df: DataFrame, column: str, default: str) -> DataFrame:
    """One row: how many different values there are, and the smallest or the default."""
    return df.agg(
        F.countDistinct(column).alias("n_values"),
        F.coalesce(F.min(column).cast("string"), F.lit(default)).alias("value"),
    )


def pivot_wide(df: DataFrame, keys: Sequence[str], names: Column | str, values: Mapping[object, str], amount: str) -> DataFrame:
    """One column per listed value.  The list is explicit, so one aggregation
    pass is enough and the schema does not depend on the data."""
    names = F.col(names) if isinstance(names, str) else names
    return df.groupBy(*keys).agg(
        *[F.max(F.when(names == F.lit(v), F.col(amount))).alias(label) for v, label in values.items()]
    )


# The four rules for sums over missing values differ on purpose.  Each works on
# what a source name was reduced to (its sum, its number of present values, its
# number of rows), so raw rows are aggregated before they meet a crosswalk.


@dataclass(frozen=True)
class EntityRule:
    """How the per-name figures of ``value`` become the figure of an entity."""

    value: str
    finish: Callable[[str, str, str], Column]


def sum_zero_if_matched(value: str) -> EntityRule:
    """Matched rows without any value sum to 0; no matched row gives null."""
    return EntityRule(value, lambda total, present, rows: F.when(F.sum(rows) > 0, F.coalesce(F.sum(total), F.lit(0.0))))


def sum_null_if_all_null(value: str) -> EntityRule:
    """No value at all gives null, matched or not."""
    return EntityRule(value, lambda total, present, rows: F.sum(total))


def mean_of_present(value: str) -> EntityRule:
    """Unweighted mean of the values there are; none gives null."""
    return EntityRule(value, lambda total, present, rows: F.try_divide(F.sum(total), F.nullif(F.sum(present), F.lit(0))))


def rows_matched(value: str) -> EntityRule:
    """Number of source rows, 0 for an entity without any."""
    return EntityRule(value, lambda total, present, rows: F.coalesce(F.sum(rows), F.lit(0)))
