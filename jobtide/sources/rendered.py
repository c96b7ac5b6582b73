"""Rendered page text -> postings, line by line but without a shuffle.

Every rule works on the lines array of its own row (one page), so pages are
never exploded, sorted and regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import parse_with
from ..functions.signals import looks_like_title_line
from ..functions.text import computed_once, repair_invalid_bytes, trim_blanks

# Markers, section header shape and towns of the three layouts.
SECTION_START = "JOB OPENINGS"
SECTION_STOPS = ("Find Us", "Join the Team")
SECTION_HEADER = "[A-Z][A-Za-z0-9 /'*]+:"
SECTION_SKIPPED = "CURRENTLY FILLED"
LIST_START, LIST_END = "Current Job Openings", "Download SCC Employment Application"
NUMBERED_LINE = "^Classified Positions available|^Certified Positions available"
NUMBERED_ITEM = r"[0-9]+\.\s*([A-Za-z][A-Za-z '&/-]*)"
NUMBERED_DATE = r"as of ([A-Za-z]+ [0-9]+,\s*[0-9]{4})"


def clean_lines(body: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(body, "\n"), trim_blanks), lambda line: line != "")


def _after_first(lines: Column, marker: str) -> Column:
    """Lines after the first one equal to ``marker``; null without such a line."""
    at = F.array_position(lines, F.lit(marker))
    return F.when(at > 0, F.slice(lines, (at + 1).cast("int"), F.size(lines)))


def _before_first(lines: Column, *markers: str) -> Column:
    """Lines before the first one equal to any marker; all lines if there is none."""
    found = F.filter(F.array(*[F.array_position(lines, F.lit(m)) for m in markers]), lambda p: p > 0)
    return F.slice(lines, 1, F.coalesce(F.array_min(found) - 1, F.size(lines)).cast("int"))


def sections(lines: Column, header: str) -> Column:
    """array<struct<header, lines>>: what follows each header line, in order.

    The lines are looked at once, for headers; a section is then a slice between two of them.  Lines
    before the first header belong to no section.
    """

    def between(own: Column) -> Column:
        places = F.filter(F.transform(own, lambda line, at: F.when(line.rlike(f"^({header})$"), at)), lambda at: at.isNotNull())
        return computed_once(places, lambda heads: F.transform(heads, lambda at, number: F.struct(
            F.get(own, at).alias("header"),
            F.slice(own, at + 2, F.coalesce(F.get(heads, number + 1), F.size(own)) - at - 1).alias("lines"),
        )))

    return computed_once(lines, between)


def _titles(pages: DataFrame, titles: Column, location: str, posted: Column | None = None) -> DataFrame:
    """One row per title; ``titles`` is an array of text or of (title, posted) structs."""
    kept = [c for c in pages.columns if c not in ("body", "url")]
    rows = pages.select(*kept, F.col("url").alias("Link"), F.posexplode(titles).alias("item", "Title"))
    return rows.select(
        *kept, "item", "Title", F.lit(location).alias("Location"),
        F.lit(None).cast("string").alias("Posted_Date"), "Link",
    )


def sectioned_postings(pages: DataFrame, location: str = "Wolf Point") -> DataFrame:
    """Title-like lines below section headers, except in sections of filled jobs."""
    lines = _before_first(_after_first(clean_lines(repair_invalid_bytes("body")), SECTION_START), *SECTION_STOPS)
    open_sections = F.filter(sections(lines, SECTION_HEADER), lambda s: ~s["header"].contains(SECTION_SKIPPED))
    titles = F.flatten(F.transform(open_sections, lambda s: F.filter(s["lines"], looks_like_title_line)))
    return _titles(pages, titles, location)


def listed_postings(
    pages: DataFrame, location: str = "Box Elder", start: str = LIST_START, end: str = LIST_END
) -> DataFrame:
    """The lines strictly between two marker lines; none unless both are there, in order."""
    lines = clean_lines(repair_invalid_bytes("body"))
    first = F.array_position(lines, F.lit(start))
    last = F.array_position(lines, F.lit(end))
    between = F.when(
        (first > 0) & (last > first + 1),
        F.slice(lines, (first + 1).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")),
    )
    return _titles(pages, between, location)


def numbered_postings(pages: DataFrame, location: str = "Plentywood") -> DataFrame:
    """Numbered titles inside announcement lines that may carry an "as of" date; ``item`` counts them through the page."""
    kept = [c for c in pages.columns if c not in ("body", "url")]
    announcements = F.filter(F.split(repair_invalid_bytes("body"), "\n"), lambda line: line.rlike(NUMBERED_LINE))

    def titles_of(line: Column) -> Column:
        # The date is parsed once a line, not once a title.
        written = F.regexp_replace(F.regexp_extract(line, NUMBERED_DATE, 1), r",\s*", ",")
        posted = parse_with(written, "MMMM d,yyyy").cast("string")
        found = F.transform(F.regexp_extract_all(line, F.lit(NUMBERED_ITEM), F.lit(1)), trim_blanks)
        titles = F.filter(found, lambda t: t != "")
        return computed_once(posted, lambda day: F.transform(titles, lambda t: F.struct(t.alias("title"), day.alias("day"))))

    titles = F.flatten(F.transform(announcements, titles_of))
    rows = pages.select(*kept, F.col("url").alias("Link"), F.posexplode(titles).alias("item", "_t"))
    return rows.select(
        *kept, F.col("item").cast("long").alias("item"), F.col("_t.title").alias("Title"),
        F.lit(location).alias("Location"), F.col("_t.day").alias("Posted_Date"), "Link",
    )
