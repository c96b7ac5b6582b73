"""Board payloads with a structured body (JSON, Atom) -> posting rows.

Input: one row per landed page with the text or bytes in ``body`` and any
other columns, which are carried along.  Output: those columns, the
position ``item`` within the page, and Title, Location, Posted_Date, Link.
A page that is empty or does not parse gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import leading_date, parse_with
from ..functions.text import or_text_na, repair_invalid_bytes, trim_blanks
from ..functions.rules import matches

SAMPLE_POSTING = "^Sample (Classified|Certified) Position$"

# Only the fields that are used; everything else in a payload is never decoded.
SCHOOLSPRING = (
    "value struct<jobsList: array<struct<jobId: string, title: string, location: string, displayDate: string>>>"
)
TYLER_PORTICO = "array<struct<id: string, title: string, locationDescription: string, postingStartDate: string>>"
PAYCOM = "jobPostingPreviews array<struct<jobId: string, jobTitle: string, locations: string, postedOn: string>>"
ISOLVED = "data struct<jobs: array<struct<title: string, city: string, startDateRef: string, jobUrl: string>>>"
ADP = (
    "jobRequisitions array<struct<requisitionTitle: string, postDate: string, "
    "requisitionLocations: array<struct<address: struct<cityName: string>>>, "
    "customFieldGroup: struct<stringFields: array<struct<nameCode: struct<codeValue: string>, stringValue: string>>>>>"
)
ATOM = (
    "entry array<struct<title: string, link: array<struct<_href: string>>, published: string, "
    "author: struct<name: string>>>"
)


def _value(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def _items(pages: DataFrame, listed: Column) -> DataFrame:
    kept = [c for c in pages.columns if c != "body"]
    return pages.select(*kept, F.posexplode(listed).alias("item", "job"))


def _board_rows(items: DataFrame, title: Column, location: Column, posted: Column, link: Column) -> DataFrame:
    kept = [c for c in items.columns if c != "job"]
    return items.select(
        *kept, title.alias("Title"), location.alias("Location"), posted.alias("Posted_Date"), link.alias("Link")
    )


def _json(schema: str) -> Column:
    return F.from_json(repair_invalid_bytes("body"), schema)


def schoolspring_postings(pages: DataFrame, domain: Column | str) -> DataFrame:
    """Flat list; placeholder postings are dropped; the link is built from the job id."""
    job = F.col("job")
    items = _items(pages, _json(SCHOOLSPRING)["value"]["jobsList"])
    items = items.filter(~F.coalesce(matches(job["title"], SAMPLE_POSTING), F.lit(False)))
    link = F.concat(F.lit("https://"), _value(domain), F.lit("/jobs/"), or_text_na(job["jobId"]))
    return _board_rows(items, job["title"], job["location"], leading_date(job["displayDate"]), link)


def tyler_portico_postings(pages: DataFrame, institution: Column | str, base_url: Column | str) -> DataFrame:
    """A missing or empty location falls back to the institution."""
    job = F.col("job")
    location = F.coalesce(F.nullif(job["locationDescription"], F.lit("")), _value(institution))
    link = F.concat(_value(base_url), F.lit("/jobs/job-list/"), or_text_na(job["id"]))
    items = _items(pages, _json(TYLER_PORTICO))
    return _board_rows(items, job["title"], location, leading_date(job["postingStartDate"]), link)


def paycom_postings(pages: DataFrame, portal_key: Column | str) -> DataFrame:
    """An empty posting date means it is not given."""
    job = F.col("job")
    link = F.concat(
        F.lit("https://www.paycomonline.net/v4/ats/web.php/portal/"), _value(portal_key),
        F.lit("/jobs/"), or_text_na(job["jobId"]),
    )
    items = _items(pages, _json(PAYCOM)["jobPostingPreviews"])
    return _board_rows(items, job["jobTitle"], job["locations"], F.nullif(job["postedOn"], F.lit("")), link)


def isolvedhire_postings(pages: DataFrame) -> DataFrame:
    """Dates are spelled out ("Jul 22, 2026")."""
    job = F.col("job")
    posted = parse_with(job["startDateRef"], "MMM d, yyyy").cast("string")
    items = _items(pages, _json(ISOLVED)["data"]["jobs"])
    return _board_rows(items, trim_blanks(job["title"]), job["city"], posted, job["jobUrl"])


def adp_postings(pages: DataFrame, cid: Column | str, cc_id: Column | str) -> DataFrame:
    """The external id is the first string field with that code.  Without one
    the link ends in the text NA, and ``has_external_id`` is false."""
    job = F.col("job")
    coded = F.filter(
        job["customFieldGroup"]["stringFields"], lambda f: f["nameCode"]["codeValue"] == "ExternalJobID"
    )
    external = F.try_element_at(coded, F.lit(1))["stringValue"]
    city = F.try_element_at(job["requisitionLocations"], F.lit(1))["address"]["cityName"]
    link = F.concat(
        F.lit("https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid="), _value(cid),
        F.lit("&ccId="), _value(cc_id), F.lit("&type=JS&lang=en_US&jobId="), or_text_na(external),
    )
    items = _items(pages, _json(ADP)["jobRequisitions"]).withColumn("has_external_id", external.isNotNull())
    return _board_rows(items, job["requisitionTitle"], city, leading_date(job["postDate"]), link)


def peopleadmin_postings(pages: DataFrame, location_fallback: Column | str | None = None) -> DataFrame:
    """Atom feed: the author names the department, which serves as location."""
    job = F.col("job")
    feed = F.from_xml(repair_invalid_bytes("body"), ATOM, {"ignoreNamespace": "true", "attributePrefix": "_"})
    location = F.coalesce(F.nullif(job["author"]["name"], F.lit("")), _value(location_fallback))
    posted = parse_with(leading_date(job["published"]), "yyyy-MM-dd").cast("string")
    link = F.try_element_at(job["link"], F.lit(1))["_href"]
    return _board_rows(_items(pages, feed["entry"]), job["title"], location, posted, link)
