"""Posting identity: which rows are the same opening.

A link that names one posting is the identity.  Everything else gets an
explicit fallback built from its fields plus an occurrence number, so equal
rows are counted rather than silently merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import identity_component, normalize_posting_text, or_text_na
from ..functions.urls import is_stable_posting_url, is_statewide_posting
from ..session import settled
from .ordering import keep_first, number_settled

REQUIRED = ("title", "location", "date_posted", "url", "District")

# Source names, method descriptions and the field separator.
STATEWIDE_SOURCE = "OPI Jobs for Teachers (statewide)"
DIRECT_SOURCE = "Direct district board"
METHOD_URL = "Stable per-posting URL"
METHOD_STATEWIDE = "OPI fallback: title + raw location + posted date (not a stable OPI ID)"
METHOD_SOURCE = "Source fallback: title + location + posted date (no stable posting URL)"
SEPARATOR = "\x1f"


def posting_source(df: DataFrame, normalised: bool = False) -> Column:
    """The given source tag; without such a column, the one its link implies."""
    if "Posting_Source" in df.columns:
        tag = F.col("Posting_Source") if normalised else normalize_posting_text("Posting_Source")
        given = F.nullif(tag, F.lit(""))
    else:
        given = F.when(is_statewide_posting("url", normalised), F.lit(STATEWIDE_SOURCE))
    return F.coalesce(given, F.lit(DIRECT_SOURCE))


def _component(df: DataFrame, name: str, normalised: bool) -> Column:
    """A field as it enters the fallback; dates are in their normal form already."""
    text = F.col(name).cast("string")
    if isinstance(df.schema[name].dataType, T.DateType):
        return or_text_na(text)
    return or_text_na(identity_component(text, normalised))


def add_posting_identity(
    df: DataFrame, seq: str = "seq", normalised: bool = False
) -> DataFrame:
    """Add Posting_Source, Posting_Identity_Method and Posting_ID.

    ``seq`` fixes the order in which equal rows are numbered: a number or a struct,
    unique within a snapshot.  Rows are grouped by a 128-bit hash of the identity's
    base text, not by the text.  ``normalised`` says that the text columns went
    through ``normalize_posting_text`` already.
    """
    by_link, by_fields = _identified(df, seq, normalised)
    return by_link.unionByName(by_fields)


def add_distinct_identity(df: DataFrame, seq: str = "seq", normalised: bool = False) -> DataFrame:
    """``distinct_postings`` of ``add_posting_identity``, per snapshot and in the order of ``seq``.

    A numbered identity occurs once in its snapshot, so only rows whose link is their identity are compared.
    """
    by_link, by_fields = _identified(df, seq, normalised)
    return distinct_postings(by_link, order=[seq]).unionByName(by_fields)


def _identified(df: DataFrame, seq: str, normalised: bool) -> tuple[DataFrame, DataFrame]:
    """The rows whose link is their identity, and the rows that are numbered."""
    missing = [c for c in (*REQUIRED, seq) if c not in df.columns]
    if missing:
        raise ValueError(f"add_posting_identity: missing column(s): {', '.join(missing)}")

    url = F.col("url") if normalised else normalize_posting_text("url")
    tagged = df.withColumns({"Posting_Source": posting_source(df, normalised), "_url": url})
    tagged = tagged.withColumn(
        "_statewide", is_statewide_posting("_url", normalised=True) | (F.col("Posting_Source") == STATEWIDE_SOURCE)
    )
    base = F.concat_ws(
        SEPARATOR,
        F.when(F.col("_statewide"), F.lit("opi-fallback")).otherwise(F.lit("source-fallback")),
        *[
            _component(tagged, c, normalised and c != "date_posted")
            for c in ("Posting_Source", "District", "title", "location", "date_posted")
        ],
    )
    marked = tagged.withColumns(
        {"_stable": ~F.col("_statewide") & is_stable_posting_url("_url", normalised=True), "_base": base}
    )
    marked = marked.withColumns({"_hi": F.xxhash64("_base"), "_lo": F.xxhash64(F.lit(17), "_base")})
    group = ["_hi", "_lo"]
    if "Archive_Date" in df.columns:
        marked = marked.withColumn("_day", _component(marked, "Archive_Date", False))
        group.append("_day")
    # One copy, read in two parts. A row whose link is its identity needs no number, but it counts
    # among its equals: it goes through the numbering as a key and a place, without its fields.
    rows = settled(marked)
    own = ["_url", "_statewide", "_stable", "_base", "_hi", "_lo", "_day"]
    needed = [c for c in rows.columns if c not in own or c in ("_statewide", "_base")]
    method = F.when(F.col("_statewide"), METHOD_STATEWIDE).otherwise(METHOD_SOURCE)
    fallback = F.concat(F.lit("fallback:"), F.col("_base"), F.lit("#"), F.col("_occurrence").cast("string"))
    placed = rows.select(*group, F.col(seq).alias("_seq"), F.when(~F.col("_stable"), F.struct(*[F.col(f"`{c}`") for c in needed])).alias("_row"))
    numbered = number_settled(placed, group, "_seq", "_occurrence").filter("_row is not null").select("_row.*", "_occurrence")
    by_link = rows.filter("_stable").withColumns(
        {"Posting_Identity_Method": F.lit(METHOD_URL), "Posting_ID": F.concat(F.lit("url:"), F.lower("_url"))}
    )
    by_fields = numbered.withColumns({"Posting_Identity_Method": method, "Posting_ID": fallback})
    return by_link.drop(*own), by_fields.drop(*own, "_occurrence")


def distinct_postings(
    df: DataFrame, keys: Sequence[str] = ("Posting_ID", "Archive_Date"), order: Sequence[str | Column] = ("seq",)
) -> DataFrame:
    """Keep the first row per identity.  The order must be explicit: sources
    have a precedence, and Spark rows have none by themselves."""
    return keep_first(df, list(keys), order)
