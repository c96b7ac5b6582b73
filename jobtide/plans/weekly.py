"""The weekly job: check, archive, append, log; of one side, or of several that are taken or refused together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, functions as F

from ..operators.asof import DATE
from ..operators.checks import Check, failures, observed, one_date
from ..operators.quality import QualityError, require_not_halved
from ..session import settled_for_now
from ..sinks import store
from ..sinks.changes import Change, refresh
from ..sources.shape import ingest_audit

Derive = Callable[[DataFrame], Mapping[str, DataFrame]]


@dataclass(frozen=True)
class Side:
    """One side's snapshot and where it goes.

    ``derive`` (``history_tables`` of a side) works out all tables and raises if totals do not add up;
    its table ``totals`` has (entity, date, n).  ``checks`` are judged on the snapshot's rows while they are
    read; ``changes`` are kept over tables in ``targets``.  ``failures`` holds (source, error_message) of the
    ``expected`` sources whose fetch did not land.  ``loss_accepted`` takes a loss of more than half of the
    postings, which the log then tells; every other check still refuses.
    """

    name: str
    raw: DataFrame
    derive: Derive
    raw_path: str
    targets: Mapping[str, str]
    totals: str
    entity: str
    expected: DataFrame | None = None
    checks: Sequence[Check] = ()
    changes: Sequence[Change] = ()
    failures: DataFrame | None = None
    loss_accepted: bool = False


def _earlier(side: Side, day: dt.date, date: str = DATE) -> DataFrame | None:
    """(side, n) of the newest earlier date in the history of totals."""
    spark, path = side.raw.sparkSession, side.targets[side.totals]
    days = [d for d in store.stored_dates(spark, path, date) if d < day]
    if not days:
        return None
    return store.read_history(spark, path).filter(F.col(date) == F.lit(days[-1])).select(F.lit(side.name).alias("side"), "n")


def _audits(side: Side, rows: DataFrame, losses: Sequence[Row]) -> list[DataFrame]:
    """What the run log is told of a side: how its expected sources did, and a loss that was accepted."""
    audits = []
    if side.expected is not None:
        source = side.expected.columns[0]
        audits.append(ingest_audit(side.expected, rows.select(F.col(side.entity).alias(source)), side.failures, source))
    lost = [
        (side.name, "halved", r["after_n"], f"accepted: more than half of {r['before_n']} postings are gone")
        for r in losses if r["side"] == side.name
    ]
    if lost:
        audits.append(rows.sparkSession.createDataFrame(lost, "source string, status string, n_rows long, error_message string"))
    return audits


def run_sides(sides: Sequence[Side], log_path: str | None = None, at: dt.datetime | None = None) -> None:
    """One snapshot date of every side through all steps.

    Each side's rows are read once: the pass that puts them aside also counts what the checks
    need.  If any side has more than one date, fails a check, has totals that do not add up, or has less than half the
    postings of its newest earlier date without ``loss_accepted``, nothing of any side is written: the last is a
    ``HalvedError``, raised when nothing else is wrong.  Only then are the snapshots
    archived, every table in ``targets`` appended, the changes derived, and the
    audit of the ``expected`` sources logged, with their ``failures`` and accepted losses.
    """
    for side in sides:
        if side.failures is not None and (side.expected is None or log_path is None):
            raise ValueError(f"{side.name}: failures are logged by expected source: give expected and log_path")
    with ExitStack() as held:
        taken, before, after = [], [], []
        for side in sides:
            checks = [one_date(DATE), *side.checks]
            watched, seen = observed(side.raw, checks)
            rows = held.enter_context(settled_for_now(watched))
            if rows.isEmpty():  # nothing was counted then
                raise ValueError(f"{side.name}: expected one snapshot date, got no rows")
            metrics = seen.get
            days = {metrics[f"{DATE}_first"], metrics[f"{DATE}_last"]}
            if len(days) != 1 or None in days or metrics[f"{DATE}_missing"]:
                raise ValueError(f"{side.name}: expected one snapshot date, got {sorted(map(str, days))}")
            failed = failures(checks, metrics)
            if failed:
                raise QualityError(f"{side.name}: " + "; ".join(map(str, failed)))
            tables, day = side.derive(rows), days.pop()
            after.append(tables[side.totals].select(F.lit(side.name).alias("side"), "n"))
            earlier = _earlier(side, day)
            before += [] if earlier is None else [earlier]
            taken.append((side, rows, tables, day))
        losses: list[Row] = []
        if before:
            accepted = [side.name for side in sides if side.loss_accepted]
            losses = require_not_halved(reduce(DataFrame.unionByName, before), reduce(DataFrame.unionByName, after), "side", accepted)
        for side, rows, tables, day in taken:
            store.write_snapshot(rows, side.raw_path)
            for name, path in side.targets.items():
                store.replace_dates(tables[name], path, [day])
            for change in side.changes:
                refresh(rows.sparkSession, change, [day])
            if log_path is not None:
                now = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
                for audit in _audits(side, rows, losses):
                    store.append_log(audit, log_path, now)


def run_week(
    raw: DataFrame,
    derive: Derive,
    raw_path: str,
    targets: Mapping[str, str],
    totals: str,
    entity: str,
    expected: DataFrame | None = None,
    log_path: str | None = None,
    at: dt.datetime | None = None,
    checks: Sequence[Check] = (),
    failures: DataFrame | None = None,
    loss_accepted: bool = False,
) -> None:
    """``run_sides`` for a side on its own."""
    side = Side(entity, raw, derive, raw_path, targets, totals, entity, expected, checks, failures=failures, loss_accepted=loss_accepted)
    run_sides([side], log_path, at)
