"""Grid payloads: a JSON array of arrays whose first row names the columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import number_or_null
from ..functions.text import repair_invalid_bytes

GRID = "array<array<string>>"


def grid_rows(pages: DataFrame) -> DataFrame:
    """Every data row as a map {column name: text} in ``cell``, beside the page's
    other columns.  A grid with fewer than two rows gives nothing."""
    kept = [c for c in pages.columns if c != "body"]
    return (
        pages.select(*kept, F.from_json(repair_invalid_bytes("body"), GRID).alias("grid"))
        .filter(F.size("grid") >= 2)
        .select(*kept, F.col("grid")[0].alias("header"), F.explode(F.slice("grid", 2, F.size("grid") - 1)).alias("row"))
        .select(*kept, F.map_from_arrays("header", "row").alias("cell"))
    )


def grid_columns(pages: DataFrame, text: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """Named columns out of the grids; numeric ones become double or null."""
    rows = grid_rows(pages)
    kept = [c for c in rows.columns if c != "cell"]
    return rows.select(
        *kept,
        *[F.try_element_at("cell", F.lit(c)).alias(c) for c in text],
        *[number_or_null(F.try_element_at("cell", F.lit(c))).alias(c) for c in numeric],
    )
