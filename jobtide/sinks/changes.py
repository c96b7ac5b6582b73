"""Tables of what changed since an earlier snapshot, kept per date.

A row of such a table belongs to one snapshot date and was derived from that date and its base, the newest date at
least some days before it.  When a date is replaced, arrives late, or is emptied, its own changes are
derived again and so are those of every later date whose base it is, becomes or was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.asof import DATE, base_dates
from . import store

#: (rows of the dates and of their bases, pairs (date, base)) -> rows of the dates.
DeriveChange = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Change:
    """A change table at ``path`` over the history at ``source``; a date's base lies ``back`` days before it or more."""

    source: str
    path: str
    derive: DeriveChange
    back: int = 1
    date: str = DATE


def affected(dates: Iterable[dt.date], replaced: Iterable[dt.date], back: int) -> list[dt.date]:
    """The replaced dates, and the dates there are now whose base is, becomes or was one of them."""
    known, changed = sorted(set(dates)), set(replaced)

    def rests_on(day: dt.date) -> bool:
        newest = day - dt.timedelta(back)
        base = max((d for d in known if d <= newest), default=None)
        # A changed date at or after the base is the base, or was it before it was emptied.
        return any(d <= newest and (base is None or d >= base) for d in changed)

    return sorted(changed | {d for d in known if rests_on(d)})


def _derived(spark: SparkSession, change: Change, days: list[dt.date]) -> DataFrame:
    known = store.stored_dates(spark, change.source, change.date)
    pairs = [(d, b) for d, b in base_dates(known, change.back) if d in set(days)]
    needed = sorted({x for pair in pairs for x in pair if x is not None})
    history = store.read_history(spark, change.source)
    rows = history.filter(history[change.date].isin(needed)) if needed else history.limit(0)
    return change.derive(rows, spark.createDataFrame(pairs, f"`{change.date}` date, _base date"))


def refresh(spark: SparkSession, change: Change, replaced: Iterable[dt.date]) -> None:
    """Derive again what the replaced dates have changed; only those dates and their bases are read."""
    days = affected(store.stored_dates(spark, change.source, change.date), replaced, change.back)
    if days and store.table_exists(spark, change.source):
        store.replace_dates(_derived(spark, change, days), change.path, days, change.date)


def rebuild(spark: SparkSession, change: Change) -> None:
    """Derive the whole table anew."""
    days = store.stored_dates(spark, change.source, change.date)
    store.replace_table(_derived(spark, change, days), change.path, change.date)
