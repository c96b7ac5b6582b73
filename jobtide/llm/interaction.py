"""What each of five filters removes in every order, by wide packed counters.

Whether a document fails a filter does not depend on the order; the five answers are its mask.  A mask
decides, for all 120 orders of five steps, at which step the document goes.  So each mask is one big
integer of 600 fields, one for each (order, step), in which the fields where it goes hold a one.  The
integers of a part's documents are added; the fields then count what goes at each step of each order,
and what is kept, redundant, unique and owed to a filter follows from them.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: A field holds counts below 2^64, more than any table has rows, so no field runs over into the next.
FIELD_BITS = 64

FEWEST_WORDS = 200
SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#$%&*|]"

FIELDS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> Column:
    """The mask of the filters that look at one text alone: bit 0 is A, bit 3 is D. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [
        F.size(words) < FEWEST_WORDS,
        F.lit(100) * distinct < F.lit(50) * F.size(words),
        F.lit(100) * capitals.cast("long") > F.lit(3) * F.length(text),
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for bit, failed in enumerate(tests):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask.cast("int")


def packed(mask: int) -> int:
    """The mask's 600 fields: a one in the field of each order's step at which a document so marked goes."""
    fields = 0
    for at, order in enumerate(ORDERS):
        for step, letter in enumerate(order):
            if mask >> FILTERS.index(letter) & 1:
                fields |= 1 << FIELD_BITS * (at * STEPS + step)
                break
    return fields


def unpacked(total: int) -> list[list[int]]:
    """A sum of packed masks as counts by order and step."""
    low = (1 << FIELD_BITS) - 1
    flat = [total >> FIELD_BITS * i & low for i in range(len(ORDERS) * STEPS)]
    return [flat[i : i + STEPS] for i in range(0, len(flat), STEPS)]


def _report(part: str, masks: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The 600 rows of one part; masks: (mask, documents, good ones, toxic ones)."""
    everyone = sum(n for _, n, _, _ in masks)
    gone, good, toxic = (unpacked(sum(packed(row[0]) * row[at] for row in masks)) for at in (1, 2, 3))
    fails, alone, credit = ({letter: 0 for letter in FILTERS} for _ in range(3))
    for order, counts in zip(ORDERS, gone, strict=True):
        fails[order[0]] = counts[0]  # the first filter removes all that fail it
        alone[order[-1]] = counts[-1]  # the last one only what fails nothing else
        for letter, count in zip(order, counts, strict=True):
            credit[letter] += count
    rows = []
    for at, order in enumerate(ORDERS):
        kept = everyone
        for step, letter in enumerate(order):
            kept -= gone[at][step]
            rows.append(
                (part, order, step + 1, kept, gone[at][step], fails[letter] - gone[at][step], alone[letter],
                 good[at][step], toxic[at][step], credit[letter])
            )
    return rows


def mark(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, documents, good, toxic: how many documents of a part have each mask, at most 32 rows a part.

    Filter E fails a document if a smaller doc_id has the same text, anywhere in the table.  Every step adds
    up rows before it shuffles them, so a text or an id that a third of all rows share is a few rows a task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        failures(F.col("text")).alias("mask"),
    )
    rows = own.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
        )
    )
    flagged = rows.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    alike = flagged.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("at_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
    )
    # Now a text has a row for each part and label at most, however many copies there are.
    smallest = alike.groupBy("key").agg(F.min("first").alias("smallest"))
    judged = alike.join(smallest, "key")
    original = F.col("without_id") + F.when(F.col("first") == F.col("smallest"), F.col("at_first")).otherwise(0)
    cases = F.array(
        F.struct(F.col("mask"), original.alias("n")),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - original).alias("n")),
    )
    split = judged.select("part", "good", "toxic", F.explode(cases).alias("case")).select("part", "good", "toxic", "case.*")
    return (
        split.where("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("documents"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per part, one for each (filter_order, step), zeros included.

    The filters, in the order A to E: fewer than 200 words; fewer than half of the words distinct; more than
    3 capitals A-Z in 100 code points; any of #$%&*| in the text; same text as a smaller doc_id.  Words are
    runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.

    kept: documents left after the step.  removed: those that go at it.  redundant: those that fail its filter
    but had gone before.  unique_fails: those that fail its filter only.  good_lost, toxic_lost: of the removed,
    those labelled quality = 1 and toxic = 1.  shapley: what its filter removes, summed over all orders.

    A part is a language; a missing one is the empty string.  A null text is empty, and so equal to any other
    empty text.  A document without id is neither a copy nor the original of one.  Repeated rows count each;
    as none has the smaller id, the first id's repeats all stay originals.  Where labels name a document twice
    it is good (toxic) if one row says so.  Only the columns named here are read, whatever others there are.
    An empty table has no parts and so no rows.
    """

    def report(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("mask", "documents", "good", "toxic")]
        rows = _report(key[0].as_py(), list(zip(*columns, strict=True)))
        return pa.Table.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES
        )

    return mark(docs, labels).groupBy("part").applyInArrow(report, FIELDS)


_NAMES = [field.split(" ")[0] for field in FIELDS.split(", ")]
_KINDS = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[field.split(" ")[1]] for field in FIELDS.split(", ")]


def audit_sql() -> str:
    """The same by comparing every mask with every order."""
    orders = ", ".join(f"('{order}')" for order in ORDERS)
    return rf"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < {FEWEST_WORDS} THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l USING (doc_id)), m AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed), o AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) v(filter_order)), x AS (
  SELECT m.*, o.filter_order, o.step, substr(filter_order, step, 1) AS letter, contains(failed, substr(filter_order, step, 1)) AS fails,
         list_any_value(list_filter(range(1, 6), lambda i: contains(failed, substr(filter_order, i, 1)))) AS gone FROM m, o), r AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""
