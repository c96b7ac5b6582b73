"""The weekly K-12 build: board rows -> current postings -> counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import standardize_date
from ..functions.rules import k12_broad_category, k12_position, k12_subject
from ..functions.text import normalize_posting_text
from ..operators.asof import DATE, at_latest
from ..operators.counts import (
    distinct_counts,
    distinct_counts_with_total,
    flagged_totals,
    named_totals,
    with_total_rows,
    without_total_rows,
)
from ..operators.dedupe import remove_feed_duplicates
from ..operators.identity import add_distinct_identity
from ..operators.joins import canonical_name, left_join_null_safe
from ..operators.quality import require_totals_match
from ..schemas import CATEGORY_COUNTS, POSTINGS_CURRENT, TEACHER_HISTORY
from ..session import settled
from ..sources.shape import rank_sources, union_sources

TEXT_COLUMNS = ("title", "position", "location", "url", "District", "Posting_Source")
TEACHER = "Teacher"


def combine_sources(direct: list[DataFrame], feed: DataFrame, registry: DataFrame) -> DataFrame:
    """Posting rows of all sources with standard dates, feed duplicates removed.

    ``direct`` and ``feed`` are in the shape of ``sources.shape.k12_posting``;
    ``seq`` comes back with the precedence of the source in front.
    """
    marked = [df.withColumn("_feed", F.lit(df is feed)) for df in (*direct, feed)]
    # Every date is parsed once: the rows are read as rows, as keys of boards and as keys of the feed.
    rows = settled(union_sources(*marked).withColumn("date_posted", standardize_date("date_posted")))
    boards, statewide = rows.filter("not _feed").drop("_feed"), rows.filter("_feed").drop("_feed")
    return rank_sources(union_sources(boards, remove_feed_duplicates(statewide, boards, registry)))


def identify(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Normalise text, give every row its identity, keep each identity once per snapshot."""
    text = {c: normalize_posting_text(c) for c in TEXT_COLUMNS if c in rows.columns}
    return add_distinct_identity(rows.withColumns(text), seq, normalised=True)


def raw_snapshot(
    direct: list[DataFrame], feed: DataFrame, registry: DataFrame, snapshot_date: dt.date
) -> DataFrame:
    """What is archived for one date, names still as the boards spell them."""
    combined = combine_sources(direct, feed, registry).withColumn(DATE, F.lit(snapshot_date))
    return identify(combined)


def current_postings(identified: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Classified postings, for one snapshot date or many, from ``identify``'s rows."""
    named = _named(identified, aliases)
    return named.withColumn("position", k12_position("title", normalised=True)).select(*POSTINGS_CURRENT.names)


def _named(identified: DataFrame, aliases: DataFrame | None) -> DataFrame:
    return identified if aliases is None else canonical_name(identified, "District", aliases)


def title_classes(postings: DataFrame) -> DataFrame:
    """(title, position, Category, Broad_Category), one row per title; Category is null where the title is no teacher's."""
    titles = postings.select("title").distinct().withColumn("position", k12_position("title", normalised=True))
    subject = F.when(F.col("position") == TEACHER, k12_subject("title", normalised=True))
    return titles.withColumn("Category", subject).withColumn("Broad_Category", k12_broad_category("Category"))


def teacher_rows(postings: DataFrame) -> DataFrame:
    subject = k12_subject("title", normalised=True)
    return (
        postings.filter(F.col("position") == TEACHER)
        .withColumn("Category", subject)
        .withColumn("Broad_Category", k12_broad_category("Category"))
        .select(*TEACHER_HISTORY.names)
    )


def district_totals(postings: DataFrame) -> DataFrame:
    """All positions, per district and date."""
    return distinct_counts(postings, ["District", DATE], out="n")


CATEGORY_KEYS = ["Broad_Category", DATE]


def category_counts(teachers: DataFrame) -> DataFrame:
    """Category x date x district with Total rows (a total sums its districts)."""
    return distinct_counts_with_total(teachers, CATEGORY_KEYS, "District").select(*CATEGORY_COUNTS.names)


def checked_category_counts(teachers: DataFrame) -> DataFrame:
    """The same, refused when a total row is not the sum of its parts.  Rows are told apart by a
    flag, so a posting without a district, or of one called "Total", is a part like any other."""
    counts = settled(flagged_totals(distinct_counts(teachers, [*CATEGORY_KEYS, "District"]), CATEGORY_KEYS, "District"))
    require_totals_match(counts.filter("is_total"), counts.filter("not is_total"), CATEGORY_KEYS)
    return named_totals(counts, CATEGORY_KEYS, "District").select(*CATEGORY_COUNTS.names)


def category_counts_now(counts: DataFrame) -> DataFrame:
    """Latest date only, without the date."""
    parts = at_latest(without_total_rows(counts, "District"))
    return with_total_rows(parts, ["Broad_Category"], "District").select(
        "Broad_Category", F.col("sum").alias("Sum"), "District"
    )


def history_tables(snapshots: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """All history tables from raw snapshots of any number of dates.

    One function serves both the weekly append (one date) and the rebuild (all
    dates), which is what keeps the two equal.  The identified postings feed
    every table, so they are computed once.  A title stands in many snapshots and means the same in
    all of them, so each different title is classified once and its labels are joined.  Counts whose
    totals do not add up raise here, before anything is written.
    """
    unclassified = [c for c in POSTINGS_CURRENT.names if c != "position"]
    named = settled(_named(identify(snapshots), aliases).select(*unclassified))
    classes = settled(title_classes(named))
    postings = left_join_null_safe(named, classes.select("title", "position"), ["title"]).select(*POSTINGS_CURRENT.names)
    of_teachers = classes.filter(F.col("position") == TEACHER)
    teachers = left_join_null_safe(named, of_teachers, ["title"]).filter(F.col("position") == TEACHER).select(*TEACHER_HISTORY.names)
    return {
        "postings": postings,
        "teacher_history": teachers,
        "district_totals": district_totals(named),
        "category_counts": checked_category_counts(teachers),
    }
