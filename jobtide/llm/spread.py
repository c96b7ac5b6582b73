"""Look up one value per key for rows whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: A key with at least this share of the rows (and at least HOT_ROWS of them) is looked up by broadcast.
HOT_SHARE = 1 / 1_000
HOT_ROWS = 1_000


def look_up(rows: DataFrame, values: DataFrame, counts: DataFrame, key: str, total: int, spread: Column) -> DataFrame:
    """``rows`` with the other columns of ``values``, null where their key has none.

    ``key`` is a string or long column of all three; ``values`` and ``counts`` (key, n: how many rows have it) hold a
    key once and no null.  At most 1 / HOT_SHARE keys can have that share of ``total`` rows: so many rows of
    ``values`` are broadcast at most.  Rows with such a key, or with none, go through the shuffle under keys of
    their own, made from ``spread``, so that no task gets more than that share of the rows by one key.
    """
    names = [c for c in values.columns if c != key]
    bar = max(HOT_ROWS, total * HOT_SHARE)
    hot = values.join(F.broadcast(counts.where(F.col("n") >= bar).select(key)), key, "left_semi")
    hot = hot.select(key, F.struct(*names).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    # A key of its own may be another row's key; what is found by it is not looked at.
    text = rows.schema[key].dataType == StringType()
    own = F.concat(F.lit("\0"), spread.cast("string")) if text else F.xxhash64(spread)
    marked = marked.withColumn("_meet", F.when(alone, own).otherwise(F.col(key)))
    cold = values.select(F.col(key).alias("_meet"), F.struct(*names).alias("_cold"))
    found = F.when(alone, F.col("_hot")).otherwise(F.col("_cold"))
    return marked.join(cold, "_meet", "left").select(
        *[f"`{c}`" for c in rows.columns], *[found[c].alias(c) for c in names]
    )
