"""A key for whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_keys(hi: str = "hi", lo: str = "lo") -> list[Column]:
    """128 bits of the column text, as two numbers hashed from different seeds; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias(hi), F.xxhash64(F.lit(17), text).alias(lo)]
