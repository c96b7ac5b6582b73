"""History kept up to date as snapshot files arrive.

Each micro-batch only tells which snapshot dates have new files.  Those dates
are derived again from all their rows in the snapshot zone, which is partitioned by date so
that only they are read, and replace what the history holds for them.  A snapshot that arrives in several files, twice, or late thus ends
in the same tables, and a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.asof import DATE
from ..sinks.changes import Change, refresh
from ..sinks.store import replace_dates


Derive = Callable[[DataFrame], Mapping[str, DataFrame]]


def refresh_dates(
    raw: DataFrame, arrived: DataFrame, derive: Derive, targets: Mapping[str, str], date: str = DATE, changes: Sequence[Change] = ()
) -> None:
    """Derive the dates present in ``arrived`` from all their rows in ``raw``; replace them, also
    in tables that now have no rows for them.  Then derive again the changes that rest on these dates,
    those of later dates included."""
    # One value per snapshot date in the batch; as literals they prune partitions.
    dates = [r[0] for r in arrived.select(date).distinct().collect()]
    if not dates:
        return
    frames = derive(raw.filter(F.col(date).isin(dates)))
    for name, path in targets.items():
        replace_dates(frames[name], path, dates, date)
    for change in changes:
        refresh(raw.sparkSession, change, dates)


def follow_snapshots(
    spark: SparkSession,
    raw_path: str,
    schema: T.StructType,
    derive: Derive,
    targets: Mapping[str, str],
    checkpoint: str,
    date: str = DATE,
    files_per_batch: int = 1000,
    once: bool = False,
    changes: Sequence[Change] = (),
) -> StreamingQuery:
    """Start the stream over a folder partitioned by ``date``; ``once`` takes what is there and stops.

    ``changes`` are kept over tables in ``targets``.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(raw_path)

    def on_batch(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        refresh_dates(session.read.schema(schema).parquet(raw_path), batch, derive, targets, date, changes)

    writer = arriving.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
