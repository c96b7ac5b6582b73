"""Checks that are counted in a pass that is made anyway.

A check names aggregate columns; ``observed`` attaches them to a frame, and whatever action then reads
the frame, a write for instance, counts them as the rows go by.  ``failures`` judges the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import has_encoding_fault


@dataclass(frozen=True)
class Failure:
    """A check that found something: what, where, how many, and what would have been fine."""

    check: str
    name: str
    actual: Any
    expected: str


@dataclass(frozen=True)
class Check:
    """``metrics`` are counted; ``judge`` turns them into failures."""

    metrics: Mapping[str, Column]
    judge: Callable[[Mapping[str, Any]], list[Failure]]


def one_date(date: str) -> Check:
    """Counts the first and last date and the rows without one; judged by who asks for them."""
    value = F.col(date)
    metrics = {f"{date}_first": F.min(value), f"{date}_last": F.max(value), f"{date}_missing": F.count_if(value.isNull())}
    return Check(metrics, lambda seen: [])


def coverage(columns: Sequence[str], expected: int | None = None, min_ok: int | None = None) -> Check:
    """Columns with fewer values than ``min_ok``, or than ``expected``, or than there are rows."""
    metrics = {f"{c}_values": F.count(F.col(c)) for c in columns} | {"rows": F.count(F.lit(1))}

    def judge(seen: Mapping[str, Any]) -> list[Failure]:
        floor = min_ok if min_ok is not None else expected if expected is not None else seen["rows"]
        return [Failure("coverage", c, seen[f"{c}_values"], f"at least {floor}") for c in columns if seen[f"{c}_values"] < floor]

    return Check(metrics, judge)


def bounds(column: str, low: float, high: float) -> Check:
    """Values outside [low, high]; missing ones are not judged."""
    name = f"{column}_outside"
    outside = (F.col(column) < low) | (F.col(column) > high)
    return Check({name: F.count_if(outside)}, lambda seen: [Failure("bounds", column, seen[name], f"{low} to {high}")] if seen[name] else [])


def encoding(column: str) -> Check:
    """Texts that are not valid UTF-8 or hold a replacement character."""
    name = f"{column}_faulty"
    return Check({name: F.count_if(has_encoding_fault(column))}, lambda seen: [Failure("encoding", column, seen[name], "valid text")] if seen[name] else [])


def totals(is_total: str, value: str) -> Check:
    """Total rows that do not add up to the part rows, over the whole table."""
    flag = F.col(is_total)
    metrics = {f"{value}_totals": F.sum(F.when(flag, F.col(value))), f"{value}_parts": F.sum(F.when(~flag, F.col(value)))}

    def judge(seen: Mapping[str, Any]) -> list[Failure]:
        total, parts = seen[f"{value}_totals"], seen[f"{value}_parts"]
        return [] if total == parts else [Failure("totals", value, total, str(parts))]

    return Check(metrics, judge)


def observed(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, Observation]:
    """The frame with the checks' counts attached; they are known once an action has read it.

    A frame that Spark knows to be empty is not read, and nothing is counted: ask for its rows first.
    """
    metrics: dict[str, Column] = {}
    for check in checks:
        metrics |= check.metrics
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


def failures(checks: Sequence[Check], metrics: Mapping[str, Any]) -> list[Failure]:
    return [failure for check in checks for failure in check.judge(metrics)]
