"""Order-dependent operators that stay safe when one key holds most of the rows.

A plain window sorts a whole key group in one task.  The operators here never
do: either Spark prunes the group on the map side first (``keep_first``,
``top_per_key``), or the rows of keys found to be hot are dealt by range and the ranges are stitched
together by their counts (``number_within``), or only counts travel (``exact_median``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settled, settled_for_now


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in the given order, payload intact.

    ``row_number() <= 1`` lets Spark drop all but one row per key in every map
    task before the shuffle (WindowGroupLimit), so a hot key costs nothing.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; at most ``k`` per key and map task are shuffled."""
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


#: A key is hot with at least this many rows and this share of all rows; so at most 100,000 keys are.
HOT_ROWS = 100_000
HOT_SHARE = 1 / 100_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with too many rows to be put in order by one task; None where there are none.

    Counts are added up before they are shuffled.  At most 1 / HOT_SHARE keys can be hot.
    """
    bar = max(hot_rows, int(rows.count() * HOT_SHARE))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = settled(counts.filter(F.col("_n") >= bar).select(*keys))
    return None if hot.isEmpty() else hot


def apart(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows without and with a hot key (missing keys match each other); hot keys are few enough to broadcast."""
    named = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return rows.join(named, same, "left_anti"), rows.join(named, same, "left_semi")


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | str, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1, 2, 3 ... within each key, in the given order; rows equal in it are numbered in any order.

    The rows are settled, so the input is evaluated once, and the rows of each key are counted on the copy.
    Most keys are numbered by a window.  Only the rows of hot keys are dealt by range of (key,
    order) over many partitions and numbered there; the counts of the key's earlier
    partitions are added, of which a key has at most one per partition.
    """
    return number_settled(settled(df), keys, order, out, hot_rows)


def number_settled(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | str, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``number_within`` for rows that are cheap to read more than once."""
    by = _columns([order] if isinstance(order, str) else order)
    kept = [F.col(c) for c in rows.columns if c != out]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long").alias(out)
    hot = hot_keys(rows, keys, hot_rows)
    if hot is None:
        return rows.select(*kept, number)
    cold, warm = apart(rows, hot, keys)
    return cold.select(*kept, number).unionByName(_number_by_range(warm, keys, by, out))


def _number_by_range(rows: DataFrame, keys: Sequence[str], by: list[Column], out: str) -> DataFrame:
    ranged = settled(rows.repartitionByRange(*keys, *by).withColumn("_part", F.spark_partition_id()))
    parts = [*keys, "_part"]
    numbered = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(*by)))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.sum("_n").over(earlier).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return numbered.join(before.filter(F.col("_before").isNotNull()), [F.col("_part") == F.col("_p"), *same], "left").select(
        *[F.col(c) for c in rows.columns if c != out], (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("long").alias(out)
    )


#: The sketch's guaranteed error is this share of the rows.
SKETCH = 10_000


def _doubles(column: Column) -> Column:
    return F.when(~F.isnan(column.cast("double")), column.cast("double"))


def exact_median(df: DataFrame, column: str, ranges: int = 1024) -> float | None:
    """The exact median of a whole column (nulls and NaN ignored; None if there is no value).

    The column is read twice, for even and odd counts alike.  First a quantile sketch brackets the middle;
    then the values inside the bracket are counted by value and kept, and those below it
    are counted.  The ranks are found on what was kept, which is a few ten-thousandths of the rows.
    """
    values = df.select(_doubles(F.col(column)).alias("v")).filter(F.col("v").isNotNull())
    room = 2 / SKETCH
    sketch = F.percentile_approx("v", [0.5 - room, 0.5 + room], SKETCH).alias("bracket")
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), sketch).first()
    if whole.n == 0:
        return None
    ranks = sorted({(whole.n + 1) // 2, (whole.n + 2) // 2})
    # The sketch promises ranks, not places in this count: check, and open the bracket if need be.
    for low, high in (whole.bracket, (whole.low, whole.high)):
        inside = F.col("v").between(low, high)
        counted = values.filter(F.col("v") <= high).groupBy(F.when(inside, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        with settled_for_now(counted) as kept:
            # The rows below the bracket are the group without a value.
            sums = kept.agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"), F.sum("n").alias("n")).first()
            below = sums.below or 0
            if below < ranks[0] and ranks[-1] <= sums.n:
                found = _ranked(kept.filter("v is not null"), [r - below for r in ranks], low, high, ranges)
                return sum(found) / len(found)
    raise AssertionError("unreachable: the whole range holds every rank")


def _ranked(values: DataFrame, ranks: list[int], low: float, high: float, ranges: int) -> list[float]:
    """The values of these ranks (1 is the smallest) among (v, n), all of which lie in [low, high].

    Each pass counts the values in ``ranges`` equal parts of the interval and goes on with the part that
    holds a rank, until it holds one value only.  Ranks that fall into one part go on together.
    """
    found: list[float] = []
    open_ = [(low, high, 0, ranks)]
    while open_:
        low, high, below, wanted = open_.pop(0)
        if low == high:
            found += [low] * len(wanted)
            continue
        step = high / ranges - low / ranges  # the difference itself may overflow
        if 0 < step < float("inf"):
            part = F.least(F.floor((F.col("v") / 2 - low / 2) / (step / 2)), F.lit(ranges - 1))
        else:  # neighbouring values, or infinite ones
            part = F.when(F.col("v") <= low, 0).when(F.col("v") < high, 1).otherwise(2)
        inside = values.filter(F.col("v").between(low, high)).groupBy(part.alias("part"))
        cells = inside.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
        for cell in cells:
            own = [r for r in wanted if below < r <= below + cell.n]
            if own:
                open_.append((cell.low, cell.high, below, own))
            below += cell.n
    return found
