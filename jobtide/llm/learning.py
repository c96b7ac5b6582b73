"""Labelled rows to learn from: a bounded sample that never holds held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .keys import text_keys


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the document id as text, modulo ``modulus``; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """text, _label (0 or 1) and the text's key (hi, lo): up to ``rows`` different whole texts.

    Rows of the held-out fold are left out before anything is chosen.  The choice goes by a hash of the
    id, so it is the same in every run; the chosen ids are at most ``rows``, which makes their broadcast
    safe.  Of one text with several labels the smaller counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out)
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    different = texts.select("text", "_label", *text_keys()).groupBy("hi", "lo")
    return different.agg(F.first("text").alias("text"), F.min("_label").alias("_label")).orderBy("hi", "lo").limit(rows)
