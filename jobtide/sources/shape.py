"""From per-platform rows to the common posting shape, and the ingest audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Source tags of the K-12 platforms, in order of precedence (the
# first source to show an identity wins).
K12_SOURCES = {
    "AppliTrack": "AppliTrack (direct district board)",
    "SchoolSpring": "SchoolSpring (direct district board)",
    "Tyler Portico": "Tyler Portico (direct district board)",
    "TedK12": "TedK12 (direct district board)",
    "Livingston": "Livingston district site (direct board)",
    "Lodge Grass": "Lodge Grass district site (direct board)",
    "Apptegy": "Apptegy district site (direct board)",
    "Statewide": "OPI Jobs for Teachers (statewide)",
}
SOURCE_RANK = {name: rank for rank, name in enumerate(K12_SOURCES)}


def posting_order(rows: DataFrame, page: str = "seq", item: str = "item") -> Column:
    """struct<page, item>: page order first, then the place on the page.  Compared field by
    field, so neither part has a limit; rows that were not read off a page have item 0."""
    place = F.col(item) if item in rows.columns else F.lit(0)
    return F.struct(F.col(page).cast("long").alias("page"), place.cast("long").alias("item"))


def k12_posting(
    rows: DataFrame, platform: str, district: Column | str = "District", url: Column | str = "Link"
) -> DataFrame:
    """Board rows (Title, Location, Posted_Date, Link, seq, item) in the posting shape.

    ``seq`` becomes the order of the posting: its page, then its place there.  The
    position is recomputed from the title later, so it starts as null.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(
        F.col("Title").alias("title"),
        F.col("Posted_Date").cast("string").alias("date_posted"),
        F.lit(None).cast("string").alias("position"),
        F.col("Location").alias("location"),
        as_col(url).alias("url"),
        as_col(district).alias("District"),
        F.lit(K12_SOURCES[platform]).alias("Posting_Source"),
        F.lit(SOURCE_RANK[platform]).alias("source_rank"),
        posting_order(rows).alias("seq"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all sources, matched by column name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rank_sources(df: DataFrame, seq: str = "seq", rank: str = "source_rank") -> DataFrame:
    """Put the source precedence in front of the order: struct<rank, then the fields of ``seq``>."""
    kind = df.schema[seq].dataType
    fields = [F.col(f"{seq}.{n}").alias(n) for n in kind.names] if isinstance(kind, T.StructType) else [F.col(seq).alias("place")]
    return df.withColumn(seq, F.struct(F.col(rank).alias("rank"), *fields)).drop(rank)


def ingest_audit(expected: DataFrame, rows: DataFrame, failures: DataFrame | None = None, source: str = "source") -> DataFrame:
    """ok / empty / error per expected source, ready for the run log.

    ``failures`` holds (source, error_message) of fetches that did not land.
    """
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))
    audit = expected.select(source).distinct().join(counts, source, "left")
    if failures is not None:
        audit = audit.join(failures.groupBy(source).agg(F.min("error_message").alias("error_message")), source, "left")
    else:
        audit = audit.withColumn("error_message", F.lit(None).cast("string"))
    failed = F.col("error_message").isNotNull()
    n_rows = F.when(failed, F.lit(0)).otherwise(F.coalesce(F.col("n_rows"), F.lit(0))).cast("long")
    return audit.select(
        F.col(source).alias("source"),
        F.when(failed, "error").when(n_rows == 0, "empty").otherwise("ok").alias("status"),
        n_rows.alias("n_rows"),
        "error_message",
    )


def drop_and_lead(df: DataFrame, drop: list[str], lead: list[str]) -> DataFrame:
    """Drop columns if present, put some in front, keep the rest in order."""
    kept = df.drop(*drop)
    return kept.select(*lead, *[c for c in kept.columns if c not in lead])
