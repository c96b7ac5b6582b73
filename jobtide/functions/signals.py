"""Signals read off page text and line text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_column, trim_blanks

# Phrases that say a board is empty, and phrases that only a
# board with postings shows; this many of the latter count as proof.
EMPTY_BOARD = (
    r"no (open |current )?(job|position|vacan)|no openings"
    r"|not currently (hiring|accepting)|there are (currently )?no"
)
LIVE_BOARD = r"apply now|view details|job title|posted:|closing date|date posted|JobID"
LIVE_BOARD_MIN_HITS = 3

# Shape of a line that can be a posting title.
TITLE_LINE_MAX = 55


def page_signal(text: Column | str) -> Column:
    """likely_broken / looks_genuinely_empty / inconclusive."""
    text = as_column(text)
    says_empty = text.rlike("(?i)" + EMPTY_BOARD)
    hits = F.regexp_count(text, F.lit("(?i)" + LIVE_BOARD))
    return (
        F.when(hits >= LIVE_BOARD_MIN_HITS, F.lit("likely_broken"))
        .when(says_empty, F.lit("looks_genuinely_empty"))
        .otherwise(F.lit("inconclusive"))
    )


def visible_text(html: Column | str) -> Column:
    """Page source reduced to what a reader sees, entities left as written."""
    html = as_column(html)
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return trim_blanks(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def looks_like_title_line(line: Column | str) -> Column:
    line = as_column(line)
    return (
        (F.char_length(line) <= TITLE_LINE_MAX)
        & ~line.rlike(r"[.:]$")
        & ~line.rlike(r"^[0-9]+\.")
        & line.rlike("[A-Za-z]")
        & ~line.startswith("*")
    )
