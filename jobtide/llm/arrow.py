"""Add computed columns to documents, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .words import batches
from .workspace import ship


def with_computed(
    docs: DataFrame,
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    fields: list[StructField],
    keep: list[str],
    reads: tuple[str, ...] = (),
) -> DataFrame:
    """``keep`` columns of ``docs`` and the columns that ``compute`` gives for each slice of a few MB of text.

    ``compute`` sees the text, the kept columns and those in ``reads``.  Computed columns replace columns
    of the same name.
    """
    ship(docs.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in keep if c not in names]
    schema = StructType([docs.schema[c] for c in kept] + fields)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + compute(batch), names=kept + names)

    return docs.select(*dict.fromkeys([f"`{c}`" for c in [*kept, "text", *reads]])).mapInArrow(run, schema)
