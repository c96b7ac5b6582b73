"""Shards of near-equal bytes by histogram sort.

Rows get a key whose upper half hashes the text and whose lower half hashes the row, so equal texts stand
together and yet a large group of them can be cut anywhere.  Boundaries start from a coarse histogram of the
keys; each round counts exact bytes and rows below finer candidate boundaries inside the brackets that are
still too wide.  Once all boundaries are close enough the rows are exchanged once and sorted in place.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import Workspace

KEY_BITS = 63
FIRST_BITS = 12
MORE_BITS = 6


@dataclass
class Target:
    """A wanted boundary: so much of a measure below it.  ``low`` is the largest candidate at or below it."""

    measure: str
    amount: float
    low: int = 0
    below: int = 0  # exact measure below ``low``
    inside: int = 0  # exact measure in the bracket that starts at ``low``
    rows: int = 0  # rows in that bracket
    done: bool = False
    boundary: int = 0


#: Copies of a row that one array lists at a time.
_AT_ONCE = 65_536


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every row.

    key: 31 bits of the text's hash, then 32 bits of the row's.  Rows alike in id and text are counted and told apart
    by their number, so keys depend on the rows alone, and not on how they are dealt over files or tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.xxhash64(F.lit(17), text).alias("other"),
    )
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _AT_ONCE)))
    some = F.least(F.lit(_AT_ONCE).cast("long"), F.col("n") - F.col("block") * _AT_ONCE)
    numbered = alike.withColumn("block", many).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), some)))
    upper = F.shiftleft(F.col("hash").bitwiseAND(F.lit((1 << 31) - 1)), 32)
    number = F.col("block") * _AT_ONCE + F.col("at")
    lower = F.xxhash64("doc_id", "hash", "other", number).bitwiseAND(F.lit((1 << 32) - 1))
    return numbered.select("doc_id", "size", "text_crc32", upper.bitwiseOR(lower).alias("key"))


def _refine(rows: DataFrame, targets: list[Target], tolerances: dict[str, float]) -> None:
    """Narrow every target's bracket until one of its ends is within tolerance of the wanted amount.

    Each round is one aggregation over the narrow key table; what reaches the driver is one row for each
    candidate, at most 2^FIRST_BITS in the first round and 2^MORE_BITS for each open target later.
    """
    bits = 0
    while True:
        open_ = [t for t in targets if not t.done]
        if not open_:
            return
        step = min(MORE_BITS if bits else FIRST_BITS, KEY_BITS - bits)
        shift = KEY_BITS - bits - step
        part = rows
        if bits:
            brackets = sorted({t.low >> (shift + step) for t in open_})
            part = rows.where(F.shiftright("key", shift + step).isin(brackets))
        counted = (
            part.groupBy(F.shiftright("key", shift).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            .orderBy("cell")
            .collect()
        )
        cells: dict[int, list] = {}
        for row in counted:
            cells.setdefault(row["cell"] >> step if bits else 0, []).append(row)
        for t in open_:
            below = t.below
            for row in cells.get(t.low >> (shift + step) if bits else 0, []):
                if below + row[t.measure] >= t.amount:
                    break
                below += row[t.measure]
            t.low, t.below, t.inside, t.rows = row["cell"] << shift, below, row[t.measure], row["rows"]
            left, right = t.amount - below, below + t.inside - t.amount
            if min(left, right) <= tolerances[t.measure] or t.rows <= 1 or shift == 0:
                t.done, t.boundary = True, t.low if left <= right else t.low + (1 << shift)
        bits += step


def _place(key: Column, boundaries: list[int], low: int = 0) -> Column:
    """How many boundaries are at or below the key, by halving."""
    if not boundaries:
        return F.lit(low)
    middle = len(boundaries) // 2
    return F.when(key < F.lit(boundaries[middle]), _place(key, boundaries[:middle], low)).otherwise(
        _place(key, boundaries[middle + 1 :], low + middle + 1)
    )


#: Key ranges that slots are numbered in: so many at least and at most, and about so many rows in each between.
LEAST_CELLS, MOST_CELLS, CELL_ROWS = 256, 4096, 1_000_000


def shard_by_bytes(docs: DataFrame, *, shards: int = 16, cells: int | None = None, tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    size is the UTF-8 bytes of the text plus 1; a null text has none.  Shard sizes differ by at most
    ``tolerance`` of a mean shard at each boundary, or by one row where a row is larger.  slot numbers a
    shard's rows without gaps from 0 in key order, so equal texts are neighbours.  Repeated rows are rows
    of their own.  The same rows give the same shards and slots, in whatever files they come.  An empty table
    gives no rows.

    Slots are ranks in one of about ``cells`` key ranges of equal row counts plus the rows in the ranges
    before it, so no task orders a whole shard.  Without a number given, there are more ranges for more rows, from
    LEAST_CELLS to MOST_CELLS.
    """
    work = Workspace(docs.sparkSession, "shard")
    rows = work.settle(keyed_rows(docs), "rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    whole = {"bytes": total["bytes"] or 0, "rows": total["rows"]}
    cells = cells or max(LEAST_CELLS, min(MOST_CELLS, whole["rows"] // CELL_ROWS))
    cuts = [Target("bytes", whole["bytes"] * i / shards) for i in range(1, shards)]
    fine = [Target("rows", whole["rows"] * i / cells) for i in range(1, cells)]
    if whole["rows"]:
        _refine(rows, cuts + fine, {"bytes": tolerance * whole["bytes"] / shards, "rows": 0.1 * whole["rows"] / cells})
    splitters = sorted(t.boundary for t in cuts)
    ranges = sorted({t.boundary for t in cuts + fine})
    # A shard's first range is the one that starts at its splitter.
    shard_of_range = [bisect_right(splitters, start) for start in [0, *ranges]]
    placed = rows.withColumn("range", _place(F.col("key"), ranges))
    counts = dict(placed.groupBy("range").count().collect()) if whole["rows"] else {}
    before, seen, at = [], 0, -1
    for number, shard in enumerate(shard_of_range):
        seen, at = (seen, at) if shard == at else (0, shard)
        before.append(seen)
        seen += counts.get(number, 0)
    literal = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    order = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32")
    result = placed.select(
        "doc_id", "size", "text_crc32",
        F.get(literal(shard_of_range, "int"), F.col("range")).alias("shard"),
        (F.get(literal(before, "long"), F.col("range")) + F.row_number().over(order) - 1).alias("slot"),
    )
    return work.finish(result)
