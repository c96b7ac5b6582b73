"""Rows of the newest snapshot that the one before it did not have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .asof import DATE, mark_dates


def new_since_previous(
    history: DataFrame, keys: Sequence[str] = ("Posting_ID",), date: str = DATE, marks: Mapping[str, Column] | None = None
) -> DataFrame:
    """Latest-snapshot rows whose keys are absent from the previous snapshot.

    Missing key values match each other (a posting without a location is not
    new every week).  With fewer than two snapshots nothing is new.  ``marks`` are the history's dates if
    the caller has looked them up.

    The earlier side is reduced to its distinct keys, so one key with many rows
    is skew on the streamed side only, which adaptive execution can split.
    """
    marks = marks or mark_dates(history, date)
    latest, previous = marks["latest"], marks["previous"]
    now = history.filter((F.col(date) == latest) & previous.isNotNull()).alias("now")
    before = (
        history.filter(F.col(date) == previous).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    )
    same = reduce(and_, (F.col(f"now.{k}").eqNullSafe(F.col(f"_{k}")) for k in keys))
    return now.join(before, same, "left_anti")


def new_by_date(history: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("Posting_ID",), date: str = DATE) -> DataFrame:
    """The rows of every date in ``pairs`` whose keys the date's base did not have.

    ``pairs`` is (date, _base), one row per snapshot date; a date without a base has nothing new.  Missing key
    values match each other.  The earlier side is reduced to its distinct keys, as above.
    """
    dated = F.broadcast(pairs.filter("_base is not null"))
    now = history.join(dated, date).alias("now")
    before = history.select(F.col(date).alias("_at"), *[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = reduce(and_, (F.col(f"now.{k}").eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return now.join(before, (F.col("now._base") == F.col("_at")) & same, "left_anti").drop("_base").select(*history.columns)
