"""Make absent combinations explicit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from math import prod
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..session import settled

#: Rows a gap-filled table may have unless the caller allows more.
AT_MOST = 1_000_000_000


def gap_fill(
    df: DataFrame,
    keys: Sequence[str],
    fill: Mapping[str, Any],
    values: Mapping[str, Sequence[Any]] | None = None,
    at_most: int = AT_MOST,
) -> DataFrame:
    """Every combination of the keys' values; absent ones carry ``fill``.

    ``values`` fixes the value list of a key instead of reading it off the data.  The result has
    (product of the value counts) rows by definition, and it is made as what it is: the
    product of the keys' distinct values, each a distributed table of its own.  No list of
    values is gathered anywhere.

    The exact value counts are taken first; a product of more than ``at_most`` rows is refused with a ValueError
    that names them, before anything is multiplied.
    """
    values = dict(values or {})
    df = settled(df)  # read for the counts, for each key's values and for the join
    read = [k for k in keys if k not in values]
    # Counts of distinct values leave out null, which is a value here.
    counted = df.agg(*[(F.count_distinct(k) + F.max(F.col(k).isNull().cast("int"))).alias(k) for k in read], F.count(F.lit(1)).alias("_rows")).first()
    sizes = {k: len(values[k]) if k in values else counted[k] or 0 for k in keys}
    if prod(sizes.values()) > at_most:
        raise ValueError(f"gap_fill: {prod(sizes.values()):,} combinations of {sizes} are more than {at_most:,}")
    tables = []
    for key in keys:
        if key in values:
            kind = df.schema[key].dataType
            listed = F.array(*[F.lit(v).cast(kind) for v in values[key]]) if values[key] else F.array().cast(f"array<{kind.simpleString()}>")
            tables.append(df.sparkSession.range(1).select(F.explode(listed).alias(key)))
        else:
            tables.append(df.select(key).distinct())
    spine = reduce(DataFrame.crossJoin, tables)
    rest = [c for c in df.columns if c not in keys]
    right = df.select(*[F.col(k).alias(f"_{k}") for k in keys], *rest)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    filled = spine.join(right, same, "left")
    return filled.select(
        *keys,
        *[
            F.coalesce(F.col(c), F.lit(fill[c]).cast(df.schema[c].dataType)).alias(c) if c in fill else F.col(c)
            for c in rest
        ],
    )
