"""Link predicates and link shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import as_column, normalize_posting_text

# The statewide feed's address and the five URL shapes that
# identify one posting (the second pattern is case-sensitive).
STATEWIDE_FEED = r"apps\.opi\.mt\.gov/mtjobsforteachers"
STABLE_POSTING_URL = (
    r"(/jobs?/[^/?#]+|/job-list/[^/?#]+|ViewJob\.aspx\?JobID="
    r"|[?&](jobId|jobID|id)=|\.pdf(?:[?#]|$))"
)
# Every one of these shapes holds one of these texts, which are found faster than a shape.
_IN_STABLE = ("/job", "=", ".pdf")


def is_statewide_posting(url: Column | str, normalised: bool = False) -> Column:
    """``normalised`` says that the text went through ``normalize_posting_text`` already."""
    url = as_column(url) if normalised else normalize_posting_text(url)
    return F.coalesce(url.rlike("(?i)" + STATEWIDE_FEED), F.lit(False))


def is_stable_posting_url(url: Column | str, normalised: bool = False) -> Column:
    url = as_column(url) if normalised else normalize_posting_text(url)
    may_be = reduce(lambda a, b: a | b, [url.contains(text) for text in _IN_STABLE])
    return F.coalesce(may_be & url.rlike(STABLE_POSTING_URL), F.lit(False))


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """Relative links get the base in front; links with a scheme are kept."""
    href = as_column(href)
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(href.rlike("^https?://"), href).otherwise(F.concat(base, href))


def resolve_url(href: Column | str, page: Column | str) -> Column:
    """A link as the page at ``page`` would follow it (absolute, rooted or relative)."""
    href, page = as_column(href), as_column(page)
    scheme = F.regexp_extract(page, r"^(https?:)", 1)
    site = F.regexp_extract(page, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_replace(page, r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def without_query(href: Column | str) -> Column:
    return F.regexp_replace(as_column(href), r"\?.*$", "")
