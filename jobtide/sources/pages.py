"""HTML board pages -> postings, by small per-platform rules.

A page is read once for the few elements its rule names (``outline``), and the
reader gives back whole cards or single elements; nothing is shuffled.  The rest of
each rule is Spark code over those rows.  Input frames have one row per landed
page with ``body`` and ``url``; other columns are carried along unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rules import department_institution, location_institution, matches
from ..functions.text import computed_once, repair_invalid_bytes, trim_blanks
from ..functions.urls import absolute_url, resolve_url, without_query
from ..session import settled
from . import outline as _outline_module
from .outline import Outline, Pick

# The reader travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(_outline_module)

_LINK = T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])
_FOUND = T.StructType(
    [
        T.StructField("item", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.ArrayType(_LINK))),
        *[T.StructField(n, T.StringType()) for n in ("role", "text", "href", "classes", "lead", "header", "before")],
        T.StructField("first", T.BooleanType()),
    ]
)

#: Rows and links a reader holds before it gives them back; a page's own stay together.
GIVEN_BACK_AT = 8192


def read_pages(pages: DataFrame, outline: Outline | Mapping[str, Outline], by: str = "platform") -> DataFrame:
    """The cards or elements of every page, whole pages read; a mapping gives the outline by column ``by``.

    The page's own columns are taken along as they are, in Arrow, so no value is converted.
    """
    kept = [c for c in pages.columns if c != "body" and c not in _FOUND.names]
    schema = T.StructType([*pages.select(*kept).schema.fields, *_FOUND.fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, bodies = batch.select(kept), batch.column("body")
            which = batch.column(by) if isinstance(outline, Mapping) else None
            owner, found = [], _outline_module.Found()
            for page in range(batch.num_rows):
                plan, body = outline if which is None else outline.get(which[page].as_py()), bodies[page].as_py()
                before = len(found.item)
                if plan is not None and body is not None:
                    plan.add(body, found)
                owner += [page] * (len(found.item) - before)
                # What is held does not grow with the pages of a batch.
                if found.size >= GIVEN_BACK_AT or page == batch.num_rows - 1:
                    taken = own.take(pa.array(owner, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *found.arrays(_FOUND.names)], names=schema.names)
                    owner, found = [], _outline_module.Found()

    source = pages.filter(F.col(by).isin(*outline)) if isinstance(outline, Mapping) else pages
    return source.select(*kept, repair_invalid_bytes("body").alias("body")).mapInArrow(find, schema)


def unwrap_script(js: Column | str) -> Column:
    """The HTML inside ``document.write('...');`` calls, quotes unescaped and joined."""
    js = F.col(js) if isinstance(js, str) else js
    literals = F.regexp_extract_all(js, F.lit(r"(?s)document\.write\('(.*?)'\);"), F.lit(1))
    return F.replace(F.array_join(literals, ""), F.lit("\\'"), F.lit("'"))


def _page_columns(found: DataFrame) -> list[str]:
    return [c for c in found.columns if c not in _FOUND.names]


def with_fields(cards: DataFrame, **fields: tuple[str, int] | tuple[str, int, str]) -> DataFrame:
    """Cards with named fields; a field is the n-th element of a role: (role, n) or (role, n, "href")."""
    return cards.select(
        *_page_columns(cards),
        "item",
        *[
            F.try_element_at(F.col("fields")[spec[0]], F.lit(spec[1]))[spec[2] if len(spec) > 2 else "text"].alias(name)
            for name, spec in fields.items()
        ],
    )


@dataclass(frozen=True)
class PageRule:
    """What to find on a page, and how the found rows become postings."""

    outline: Outline
    finish: Callable[[DataFrame], DataFrame]

    def __call__(self, pages: DataFrame) -> DataFrame:
        return self.finish(read_pages(pages, self.outline))


def _postings(
    df: DataFrame, title: Column, location: Column, link: Column, posted: Column | None = None, **more: Column
) -> DataFrame:
    own = {"item", "title", "location", "link", "posted", *_FOUND.names}
    kept = [c for c in df.columns if c not in own and not c.startswith("_") and c != "url"]
    return df.select(
        *kept,
        "item",
        title.alias("Title"),
        location.alias("Location"),
        (F.lit(None).cast("string") if posted is None else posted).alias("Posted_Date"),
        link.alias("Link"),
        *[c.alias(n) for n, c in more.items()],
    )


def _non_empty(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


# -- label and value lists ---------------------------------------------------

# Field labels of the listing; the first may own two values.
TWO_VALUE_LABEL = "Position Type:"
FIELD_LABELS = {"Date Posted:": "date_posted", "Location:": "location", "Closing Date:": "closing_date"}


def _pair_labels(labels: Column, values: Column) -> Column:
    """Walk the labels with a cursor into the values.  The type label takes a second
    value when the next one has no colon; getting that wrong shifts all later fields."""
    text = F.lit(None).cast("string")
    names = ["position", "position2", *FIELD_LABELS.values()]
    start = F.struct(F.lit(1).alias("at"), *[text.alias(n) for n in names])

    def step(state: Column, label: Column) -> Column:
        value = F.try_element_at(values, state["at"])
        following = F.try_element_at(values, state["at"] + 1)
        is_type = label == TWO_VALUE_LABEL
        takes_two = is_type & F.coalesce(~following.contains(":"), F.lit(False))
        return F.struct(
            (state["at"] + F.when(takes_two, 2).otherwise(1)).alias("at"),
            F.when(is_type, value).otherwise(state["position"]).alias("position"),
            F.when(takes_two, following).otherwise(state["position2"]).alias("position2"),
            *[F.when(label == known, value).otherwise(state[n]).alias(n) for known, n in FIELD_LABELS.items()],
        )

    return F.aggregate(labels, start, step)


def label_value_postings(pages: DataFrame) -> DataFrame:
    """Script-wrapped listing: title plus labelled fields per posting."""
    html = pages.withColumn("body", unwrap_script(repair_invalid_bytes("body")))
    outline = Outline(
        {
            "title": Pick("table.title td#wrapword"),
            "label": Pick("li span.label"),
            "value": Pick("li span.normal"),
        },
        card="ul.postingsList",
    )
    cards = read_pages(html, outline)
    texts = lambda role: F.coalesce(F.transform(F.col("fields")[role], lambda e: e["text"]), F.array().cast("array<string>"))
    paired = computed_once(texts("value"), lambda values: _pair_labels(texts("label"), values))
    return cards.withColumn("_f", paired).select(
        *_page_columns(cards),
        "item",
        F.try_element_at(texts("title"), F.lit(1)).alias("title"),
        *[F.col(f"_f.{n}").alias(n) for n in ("position", "position2", "date_posted", "location", "closing_date")],
    )


# -- tables ------------------------------------------------------------------


def _table(cards: DataFrame) -> DataFrame:
    rows = with_fields(
        cards,
        title=("title", 1), _href=("title", 1, "href"), posted=("posted", 1), _position=("position", 1), location=("location", 1),
    ).filter(_non_empty("title") & (F.col("title") != "Job Title"))
    return _postings(
        rows, F.col("title"), F.col("location"), resolve_url("_href", "url"), F.col("posted"), position=F.col("_position")
    )


#: Rows whose first cell links to the posting; the header row is dropped.
table_postings = PageRule(
    Outline(
        {
            "title": Pick("td:nth-child(1) a"),
            "posted": Pick("td:nth-child(2)"),
            "position": Pick("td:nth-child(3)"),
            "location": Pick("td:nth-child(4)"),
        },
        card="tr",
    ),
    _table,
)


def _statewide_table(cards: DataFrame) -> DataFrame:
    rows = with_fields(
        cards, title=("cell", 1), location=("cell", 2), posted=("cell", 4), _details=("details", 1)
    ).filter(F.col("_details").isNotNull())
    return _postings(rows, F.col("title"), F.col("location"), F.col("url"), F.col("posted"))


#: Rows of the listing table that hold a details link; the link is the page's own.
statewide_table_postings = PageRule(
    Outline(
        {"cell": Pick("td"), "details": Pick("a[id*=btnJobDetailsPublic]")},
        card="#ctl00_ContentPlaceHolder1_grdJobListing tr",
    ),
    _statewide_table,
)


# -- cards -------------------------------------------------------------------


def jazzhr_postings(pages: DataFrame, institution: Column | str) -> DataFrame:
    """The second detail of a card is the department, which stands in for the location."""
    owner = institution if isinstance(institution, Column) else F.lit(institution)
    outline = Outline(
        {"title": Pick("h3 a"), "detail": Pick("ul.list-group-item-text > li")},
        card=".jobs-list li.list-group-item",
    )
    rows = with_fields(read_pages(pages, outline), title=("title", 1), link=("title", 1, "href"), _department=("detail", 2))
    department = F.coalesce(F.col("_department"), owner)
    return _postings(
        rows, F.col("title"), department, F.col("link"), Institution=department_institution(department, owner)
    )


def neogov_postings(pages: DataFrame, institution: Column | str) -> DataFrame:
    """The whole card is the link, without its query string; the location tells the institution."""
    owner = institution if isinstance(institution, Column) else F.lit(institution)
    outline = Outline(
        {
            "box": Pick("a.jobs__box"),
            "title": Pick(".jobs__box__heading"),
            "location": Pick(".jobs__box__text"),
        },
        card="a.jobs__box",
    )
    rows = with_fields(
        read_pages(pages, outline), title=("title", 1), location=("location", 1), link=("box", 1, "href")
    )
    return _postings(
        rows, F.col("title"), F.col("location"), without_query("link"),
        Institution=location_institution("location", owner),
    )


def _tiles(cards: DataFrame) -> DataFrame:
    rows = with_fields(cards, title=("title", 1), location=("field", 2), link=("link", 1, "href")).filter(_non_empty("title"))
    return _postings(rows, F.col("title"), F.nullif("location", F.lit("")), F.col("link"))


#: Tiles: the second field is the location, untitled tiles are skipped.
tile_postings = PageRule(
    Outline(
        {"title": Pick("h2.heading-h4"), "field": Pick("h3.heading-h5"), "link": Pick("a.btn-secondary")},
        card=".tile.w-dyn-item",
    ),
    _tiles,
)


def _loop_items(cards: DataFrame, town: str = "Billings") -> DataFrame:
    rows = with_fields(cards, title=("title", 1), link=("title", 1, "href"), _department=("department", 1)).filter(_non_empty("title"))
    return _postings(rows, F.col("title"), F.coalesce(F.col("_department"), F.lit(town)), F.col("link"))


#: Loop items: department or the town as location; the template item has no title.
loop_item_postings = PageRule(
    Outline(
        {
            "title": Pick(".elementor-heading-title a"),
            "department": Pick(".elementor-post-info__terms-list-item"),
        },
        card="div.e-loop-item",
    ),
    _loop_items,
)

NOT_A_JOB = "trustee"


def _file_blocks(cards: DataFrame, town: str = "Lame Deer") -> DataFrame:
    rows = with_fields(cards, title=("title", 1), link=("title", 1, "href")).filter(
        _non_empty("title") & ~matches(F.col("title"), NOT_A_JOB)
    )
    return _postings(rows, F.col("title"), F.lit(town), F.col("link"))


#: File blocks: the first link without a class; board-of-trustees files are no jobs.
file_block_postings = PageRule(Outline({"title": Pick("a:no-class")}, card="div.wp-block-file"), _file_blocks)


# -- single elements ---------------------------------------------------------

# Bold section labels that are not job titles.
SECTION_LABELS = ("Qualifications:", "Application Process:", "Preferred:", "Required:", "Work Schedule:")


def _bold_labels(bold: DataFrame, town: str = "Miles City") -> DataFrame:
    kept = bold.filter(F.col("first") & F.col("text").endswith(":") & ~F.col("text").isin(*SECTION_LABELS))
    rows = kept.withColumn("text", F.regexp_replace("text", ":$", "")).filter(F.col("text") != "")
    return _postings(rows, F.col("text"), F.lit(town), F.col("url"))


#: Bold texts ending in a colon, except section labels; repeats on a page count once.
bold_label_postings = PageRule(Outline({"x": Pick("strong")}), _bold_labels)


def _openings(links: DataFrame, town: str = "Glendive", base: str = "https://www.dawson.edu", heading: str = "Openings") -> DataFrame:
    links = links.filter(F.col("lead").contains(heading))
    return _postings(links, F.col("text"), F.lit(town), absolute_url("href", base))


#: Links in the block right after a heading about openings.
openings_list_postings = PageRule(Outline({"x": Pick("div .collection-item-label a")}, lead="h4"), _openings)


def accordion_rule(selector: str, town: str) -> PageRule:
    """Every accordion label is a title."""
    return PageRule(Outline({"x": Pick(selector)}), lambda labels: _postings(labels, F.col("text"), F.lit(town), F.col("url")))


button_accordion_postings = accordion_rule(".uabb-adv-accordion-button-label", "Pablo")
trigger_accordion_postings = accordion_rule(".accordion__trigger", "Helena")


def _pdf_links(links: DataFrame, town: str = "Crow Agency", base: str = "http://lbhc.edu") -> DataFrame:
    return _postings(links, F.col("text"), F.lit(town), absolute_url("href", base))


#: PDF links in the table of the page body.
pdf_link_postings = PageRule(Outline({"x": Pick(".field--name-body table a", href=r"\.pdf$")}), _pdf_links)


def _here_links(links: DataFrame, town: str = "Harlem") -> DataFrame:
    here = lambda c: F.col(c).rlike(r"(?i)^here\.?$")
    paired = links.filter(here("text") & F.col("before").isNotNull() & ~here("before"))
    return _postings(paired, F.col("before"), F.lit(town), F.col("href"))


#: Title link followed by a "here" link to the document: the title comes from the first, the address from the second.
here_link_postings = PageRule(Outline({"x": Pick("a", href="_files/ugd")}), _here_links)

# Attachments that are forms or policies, and header length.
NOT_A_JOB_FILE = r"Application|W-4|\bI-9\b|Agreement|\bCBA\b|Handbook|Policy"
HEADER_MAX = 60


def _file_sections(found: DataFrame) -> DataFrame:
    files = found.filter((F.col("role") == "file") & ~matches(F.col("text"), NOT_A_JOB_FILE))
    return _postings(files, F.col("text"), F.col("header"), F.col("href"))


#: PDF attachments; the last short text block above them is their location.
file_section_postings = PageRule(
    Outline(
        {
            "header": Pick("div.page-block.page-block-text"),
            "file": Pick("div.page-block.page-block-files .attachment-type-pdf"),
        },
        header_below=HEADER_MAX,
    ),
    _file_sections,
)


# Buttons that lead to a form and not to a job.
APPLY_BUTTONS = (
    "Apply Now – Certified Educator Application",
    "Apply Now – Classified Application",
    "Apply Now – Coach Application",
)


def button_postings(pages: DataFrame, location: Column | str) -> DataFrame:
    """Button titles, each once a page; the tab a page came from is the location."""
    buttons = read_pages(pages, Outline({"x": Pick("a.en-pe-btn")})).withColumn("text", trim_blanks("text"))
    rows = buttons.filter(F.col("first") & (F.col("text") != "") & ~F.col("text").isin(*APPLY_BUTTONS))
    place = location if isinstance(location, Column) else F.lit(location)
    return _postings(rows, F.col("text"), place, F.col("url"))


# Rules that need nothing but the landed pages, by platform.
PAGE_RULES: dict[str, PageRule] = {
    "TedK12": table_postings,
    "Statewide": statewide_table_postings,
    "Livingston": file_section_postings,
    "MilesCC": bold_label_postings,
    "DawsonCC": openings_list_postings,
    "SKC": button_accordion_postings,
    "Carroll": trigger_accordion_postings,
    "LBHC": pdf_link_postings,
    "FPCC": tile_postings,
    "RockyMountain": loop_item_postings,
    "ANC": here_link_postings,
    "CDKC": file_block_postings,
}


def extract_postings(payloads: DataFrame, rules: Mapping[str, PageRule] | None = None) -> DataFrame:
    """Every platform's rule over its own landed pages, the rows united.

    ``payloads`` is the landed table (platform, entity, url, seq, body, ...).  It is read in one pass, in
    which the platform of a page picks what is looked for; what was found is settled, as every
    rule then takes its own part of it.
    """
    rules = PAGE_RULES if rules is None else rules
    if not rules:
        raise ValueError("extract_postings: no rules given")
    columns = [c for c in payloads.columns if c not in ("body", "url")]
    found = settled(read_pages(payloads, {name: rule.outline for name, rule in rules.items()}))
    out = None
    for platform, rule in rules.items():
        rows = rule.finish(found.filter(F.col("platform") == platform)).select(
            *columns, "item", "Title", "Location", "Posted_Date", "Link"
        )
        out = rows if out is None else out.unionByName(rows)
    return out
