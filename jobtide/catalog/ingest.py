"""Queries over the sources.  Board payloads are assembled by Spark from the
driver tables, one landed page per fifty rows, and then read back: the result must
be the rows they were made of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import context, k12
from ..sources import boards, census, files, pages, rendered, reports, shape, vintages
from ..sources.outline import Outline, Pick
from .base import events, query, table

PER_PAGE = 50


def lit(x: str) -> Column:
    return F.lit(x)


def _page_no(key: str) -> Column:
    return F.expr(f"{key} div {PER_PAGE}")


def landed(rows: DataFrame, key: str, item: Column, wrap) -> DataFrame:
    """(page, url, body): the items of up to fifty rows in key order, wrapped."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("v"))))
    grouped = rows.withColumn("page", _page_no(key)).groupBy("page").agg(F.transform(pairs, lambda p: p["v"]).alias("items"))
    return grouped.select(
        "page",
        F.concat(lit("https://board.example/list/"), F.col("page")).alias("url"),
        wrap(F.col("items")).cast("string").alias("body"),
    )


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _job_title() -> Column:
    return F.concat(F.col("o_orderpriority"), lit(" & job "), F.col("o_orderkey"))


_TITLE_SQL = "o_orderpriority || ' & job ' || o_orderkey"
_PAGE_SQL = f"o_orderkey // {PER_PAGE}"
_ITEM_SQL = f"CAST(o_orderkey % {PER_PAGE} AS INTEGER)"


def _as_array(name: str | None = None):
    def wrap(items: Column) -> Column:
        body = F.concat(lit("["), F.array_join(items, ","), lit("]"))
        return F.concat(lit(name.split("@")[0]), body, lit(name.split("@")[1])) if name else body

    return wrap


# -- JSON boards -------------------------------------------------------------


@query(
    "json_flat_board",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, o_orderstatus AS Location,
       strftime(o_orderdate, '%Y-%m-%d') AS Posted_Date, 'https://x.example/jobs/' || o_orderkey AS Link
FROM orders WHERE o_orderpriority <> '3-MEDIUM'""",
)
def json_flat_board(spark: SparkSession, d: str) -> DataFrame:
    """Placeholder postings (here: one priority) are dropped by title."""
    title = F.when(F.col("o_orderpriority") == "3-MEDIUM", lit("SAMPLE Certified Position")).otherwise(_job_title())
    job = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("jobId"), title.alias("title"), F.col("o_orderstatus").alias("location"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("displayDate"),
        )
    )
    board = landed(_orders(spark, d), "o_orderkey", job, _as_array('{"value":{"jobsList":@}}'))
    return boards.schoolspring_postings(board, "x.example").drop("item", "url")


@query(
    "json_fallback_location",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE o_orderstatus WHEN 'F' THEN 'Owner' WHEN 'O' THEN 'Owner'
       ELSE o_orderstatus END AS Location, strftime(o_orderdate, '%Y-%m-%d') AS Posted_Date,
       'https://t.example/jobs/job-list/' || o_orderkey AS Link
FROM orders""",
)
def json_fallback_location(spark: SparkSession, d: str) -> DataFrame:
    """A null (F) and an empty (O) location both fall back to the owner."""
    status = F.col("o_orderstatus")
    job = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"), _job_title().alias("title"),
            F.when(status == "O", lit("")).when(status != "F", status).alias("locationDescription"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("postingStartDate"),
        )
    )
    board = landed(_orders(spark, d), "o_orderkey", job, _as_array())
    return boards.tyler_portico_postings(board, "Owner", "https://t.example").drop("item", "url")


@query(
    "json_blank_date",
    f"""SELECT {_PAGE_SQL} AS page, {_ITEM_SQL} AS item, {_TITLE_SQL} AS Title, o_orderstatus AS Location,
       CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS Posted_Date,
       'https://www.paycomonline.net/v4/ats/web.php/portal/K/jobs/' || o_orderkey AS Link
FROM orders""",
)
def json_blank_date(spark: SparkSession, d: str) -> DataFrame:
    posted = F.when(F.col("o_orderstatus") == "P", lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    job = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("jobId"), _job_title().alias("jobTitle"),
            F.col("o_orderstatus").alias("locations"), posted.alias("postedOn"),
        )
    )
    board = landed(_orders(spark, d), "o_orderkey", job, _as_array('{"jobPostingPreviews":@}'))
    return boards.paycom_postings(board, "K").drop("url")


@query(
    "json_text_date",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, o_orderstatus AS Location,
       strftime(o_orderdate, '%Y-%m-%d') AS Posted_Date, 'https://i.example/' || o_orderkey AS Link
FROM orders""",
)
def json_text_date(spark: SparkSession, d: str) -> DataFrame:
    job = F.to_json(
        F.struct(
            F.concat(lit("  "), _job_title(), lit(" ")).alias("title"), F.col("o_orderstatus").alias("city"),
            F.date_format("o_orderdate", "MMM d, yyyy").alias("startDateRef"),
            F.concat(lit("https://i.example/"), F.col("o_orderkey")).alias("jobUrl"),
        )
    )
    board = landed(_orders(spark, d), "o_orderkey", job, _as_array('{"data":{"jobs":@}}'))
    return boards.isolvedhire_postings(board).drop("item", "url")


@query(
    "json_nested_code",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS Location,
       strftime(o_orderdate, '%Y-%m-%d') AS Posted_Date, o_orderkey % 4 <> 0 AS has_external_id,
       'https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid=c&ccId=cc&type=JS&lang=en_US&jobId='
         || CASE WHEN o_orderkey % 4 = 0 THEN 'NA' ELSE 'E' || o_orderkey END AS Link
FROM orders""",
)
def json_nested_code(spark: SparkSession, d: str) -> DataFrame:
    """The id is the first field with the right code; some jobs have none, some no location."""

    def coded(code: str, value: Column) -> Column:
        return F.struct(F.struct(lit(code).alias("codeValue")).alias("nameCode"), value.alias("stringValue"))

    other = coded("Other", lit("x"))
    mine = coded("ExternalJobID", F.concat(lit("E"), F.col("o_orderkey")))
    fields = F.when(F.col("o_orderkey") % 4 == 0, F.array(other)).otherwise(
        F.array(other, mine, coded("ExternalJobID", lit("later")))
    )
    place = F.struct(F.struct(F.col("o_orderstatus").alias("cityName")).alias("address"))
    job = F.to_json(
        F.struct(
            _job_title().alias("requisitionTitle"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("postDate"),
            F.when(F.col("o_orderstatus") != "P", F.array(place)).otherwise(F.array_remove(F.array(place), place))
            .alias("requisitionLocations"),
            F.struct(fields.alias("stringFields")).alias("customFieldGroup"),
        )
    )
    board = landed(_orders(spark, d), "o_orderkey", job, _as_array('{"jobRequisitions":@}'))
    return boards.adp_postings(board, "c", "cc").drop("item", "url")


@query(
    "atom_feed",
    f"""SELECT {_PAGE_SQL} AS page, {_ITEM_SQL} AS item, {_TITLE_SQL} AS Title,
       CASE WHEN o_orderstatus = 'F' THEN 'Fallback' ELSE o_orderstatus END AS Location,
       strftime(o_orderdate, '%Y-%m-%d') AS Posted_Date, 'https://p.example/postings/' || o_orderkey AS Link
FROM orders""",
)
def atom_feed(spark: SparkSession, d: str) -> DataFrame:
    author = F.when(F.col("o_orderstatus") == "F", lit("")).otherwise(F.col("o_orderstatus"))
    entry = F.concat(
        lit("<entry><title>"), F.replace(_job_title(), lit("&"), lit("&amp;")),
        lit('</title><published>'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        lit('</published><link rel="alternate" href="https://p.example/postings/'), F.col("o_orderkey"),
        lit('"/><author><name>'), author, lit("</name></author></entry>"),
    )

    def wrap(items: Column) -> Column:
        return F.concat(
            lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>All</title>'),
            F.array_join(items, ""), lit("</feed>"),
        )

    return boards.peopleadmin_postings(landed(_orders(spark, d), "o_orderkey", entry, wrap), "Fallback").drop("url")


@query(
    "census_grid",
    f"""SELECT c_custkey // {PER_PAGE} AS page, c_name || ', State' AS NAME, c_acctbal AS balance,
       CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS nation
FROM customer""",
)
def census_grid(spark: SparkSession, d: str) -> DataFrame:
    """Grids whose first row names the columns; a word where a number belongs becomes null."""
    nation = F.when(F.col("c_nationkey") % 5 == 0, lit("N/A")).otherwise(F.col("c_nationkey").cast("string"))
    row = F.to_json(F.array(F.concat("c_name", lit(", State")), F.col("c_acctbal").cast("string"), nation, lit("30")))
    grids = landed(
        table(spark, d, "customer"), "c_custkey", row, _as_array('[["NAME","balance","nation","state"],@]')
    ).withColumn("body", F.replace(F.replace("body", lit('],[["'), lit('],["')), lit(']]]'), lit(']]')))
    return census.grid_columns(grids, text=["NAME"], numeric=["balance", "nation"]).drop("url")


# -- HTML boards -------------------------------------------------------------


@query(
    "script_unwrap",
    """SELECT page_id, md5(html) AS html FROM pages""",
)
def script_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages written out by a script, two calls per page, quotes escaped."""
    half = F.floor(F.length("html") / 2).cast("int")
    part = lambda c: F.concat(lit("document.write('"), F.replace(c, lit("'"), lit("\\'")), lit("');\n"))
    js = F.concat(part(F.substr("html", F.lit(1), half)), part(F.substr("html", half + 1)))
    return table(spark, d, "pages").select("page_id", js.alias("js")).select(
        "page_id", F.md5(pages.unwrap_script("js")).alias("html")
    )


def _html(items: Column, before: str = "<html><body>", after: str = "</body></html>") -> Column:
    return F.concat(lit(before), F.array_join(items, "\n"), lit(after))


def _tag_text(c: Column | str) -> Column:
    return F.replace(c, lit("&"), lit("&amp;"))


def _html_page(spark: SparkSession, d: str, item: Column, before: str = "", after: str = "") -> DataFrame:
    def wrap(items: Column) -> Column:
        return _html(items, "<html><body>" + before, after + "</body></html>")

    return landed(_orders(spark, d), "o_orderkey", item, wrap)


@query(
    "label_value_list",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS title, o_orderpriority AS position,
       CASE WHEN o_orderstatus = 'P' THEN 'Second type' END AS position2,
       strftime(o_orderdate, '%m/%d/%Y') AS date_posted, 'Town ' || o_custkey AS location,
       CASE WHEN o_orderstatus <> 'O' THEN 'Until: filled' END AS closing_date
FROM orders""",
)
def label_value_list(spark: SparkSession, d: str) -> DataFrame:
    """Script-written listing; the type label owns two values for one status."""
    status = F.col("o_orderstatus")

    def entry(label: str, *values: Column) -> Column:
        cells = [F.concat(lit('<span class="normal">'), v, lit("</span>")) for v in values]
        return F.concat(lit(f'<li><span class="label">{label}</span>'), *cells, lit("</li>"))

    second = F.when(status == "P", lit('<li><span class="normal">Second type</span></li>')).otherwise(lit(""))
    closing = F.when(status != "O", entry("Closing Date:", lit("Until: filled"))).otherwise(lit(""))
    # The posting date holds a colon, so it is never taken for a second type.
    posted = F.date_format("o_orderdate", "MM/dd/yyyy")
    item = F.concat(
        lit('<ul class="postingsList"><table class="title"><tr><td id="wrapword">'), _tag_text(_job_title()),
        lit("</td></tr></table>"), entry("Position Type:", F.col("o_orderpriority")), second,
        lit('<li><span class="label">Skipped:</span><span class="normal">a: b</span></li>'),
        entry("Date Posted:", posted), entry("Location:", F.concat(lit("Town "), F.col("o_custkey"))), closing,
        lit("</ul>"),
    )
    written = _html_page(spark, d, item)
    js = F.concat(lit("document.write('"), F.replace("body", lit("'"), lit("\\'")), lit("');"))
    return pages.label_value_postings(written.withColumn("body", js)).drop("url", "item")


@query(
    "table_rows",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, o_orderstatus AS position, 'Town ' || o_custkey AS Location,
       strftime(o_orderdate, '%m/%d/%Y') AS Posted_Date,
       CASE o_orderkey % 3 WHEN 0 THEN 'https://board.example/view/' WHEN 1 THEN 'https://board.example/list/view/'
            ELSE 'https://other.example/' END || o_orderkey AS Link
FROM orders""",
)
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Table rows with rooted, relative and absolute links; the header row is dropped."""
    href = (
        F.when(F.col("o_orderkey") % 3 == 0, lit("/view/"))
        .when(F.col("o_orderkey") % 3 == 1, lit("view/"))
        .otherwise(lit("https://other.example/"))
    )
    item = F.concat(
        lit('<tr><td><a href="'), href, F.col("o_orderkey"), lit('">'), _tag_text(_job_title()), lit("</a></td><td> "),
        F.date_format("o_orderdate", "MM/dd/yyyy"), lit("</td><td>"), F.col("o_orderstatus"), lit("</td><td>Town "),
        F.col("o_custkey"), lit("</td></tr>"),
    )
    header = '<table><tr><td><a href="?sort">Job Title</a></td><td>Posted</td><td>Type</td><td>Place</td></tr>'
    return pages.table_postings(_html_page(spark, d, item, header, "</table>")).drop("item")


@query(
    "statewide_table",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, 'Town ' || o_custkey AS Location,
       strftime(o_orderdate, '%m/%d/%Y') AS Posted_Date, 'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM orders WHERE o_orderstatus <> 'P'""",
)
def statewide_table(spark: SparkSession, d: str) -> DataFrame:
    """Only rows with a details link are postings."""
    details = F.when(
        F.col("o_orderstatus") != "P",
        F.concat(lit('<a id="ctl00_x_btnJobDetailsPublic_'), F.col("o_orderkey"), lit('">Details</a>')),
    ).otherwise(lit(""))
    item = F.concat(
        lit("<tr><td>"), _tag_text(_job_title()), lit("</td><td>Town "), F.col("o_custkey"), lit("</td><td>x</td><td>"),
        F.date_format("o_orderdate", "MM/dd/yyyy"), lit("</td><td>"), details, lit("</td></tr>"),
    )
    before = '<table id="ctl00_ContentPlaceHolder1_grdJobListing"><tr><th>Title</th></tr>'
    return pages.statewide_table_postings(_html_page(spark, d, item, before, "</table>")).drop("item")


@query(
    "card_department",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE o_orderstatus WHEN 'P' THEN 'Owner' WHEN 'F' THEN 'Highlands College'
       ELSE 'Town ' || o_custkey END AS Location, CAST(NULL AS VARCHAR) AS Posted_Date, 'https://j.example/' || o_orderkey AS Link,
       CASE o_orderstatus WHEN 'F' THEN 'Highlands College' ELSE 'Owner' END AS Institution
FROM orders""",
)
def card_department(spark: SparkSession, d: str) -> DataFrame:
    """The second detail is the department; one department is an institution of its own."""
    status = F.col("o_orderstatus")
    department = F.when(status == "F", lit("<li>Highlands College</li>")).when(
        status != "P", F.concat(lit("<li>Town "), F.col("o_custkey"), lit("</li>"))
    ).otherwise(lit(""))
    item = F.concat(
        lit('<li class="list-group-item"><h3><a href="https://j.example/'), F.col("o_orderkey"), lit('">\n  '),
        _tag_text(_job_title()), lit('\n</a></h3><ul class="inline list-group-item-text"><li>City</li>'), department,
        lit("</ul></li>"),
    )
    html = _html_page(spark, d, item, '<div class="col jobs-list"><ul>', "</ul></div>")
    return pages.jazzhr_postings(html, "Owner").drop("item")


@query(
    "card_links",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE o_orderstatus WHEN 'P' THEN 'Helena, MT 5' ELSE 'Elsewhere' END AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://n.example/' || o_orderkey AS Link,
       CASE o_orderstatus WHEN 'P' THEN 'Helena College' ELSE 'Owner' END AS Institution
FROM orders""",
)
def card_links(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("o_orderstatus") == "P", lit("Helena, MT 5")).otherwise(lit("Elsewhere"))
    item = F.concat(
        lit('<a class="jobs__box" href="https://n.example/'), F.col("o_orderkey"), lit('?a=1&amp;b=2"><div class="jobs__box__heading">'),
        _tag_text(_job_title()), lit('</div><p class="jobs__box__text">'), place, lit("</p></a>"),
    )
    return pages.neogov_postings(_html_page(spark, d, item), "Owner").drop("item")


@query(
    "card_tiles",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE WHEN o_orderkey % 2 = 0 THEN 'Town ' || o_custkey END AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://f.example/' || o_orderkey AS Link
FROM orders WHERE o_orderstatus <> 'P'""",
)
def card_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles without a title are skipped; an empty second field is no location."""
    title = F.when(F.col("o_orderstatus") == "P", lit("")).otherwise(_tag_text(_job_title()))
    place = F.when(F.col("o_orderkey") % 2 == 0, F.concat(lit("Town "), F.col("o_custkey"))).otherwise(lit(" "))
    item = F.concat(
        lit('<div class="tile w-dyn-item"><h2 class="heading-h4">'), title, lit('</h2><h3 class="heading-h5">Full time</h3>'),
        lit('<h3 class="heading-h5">'), place, lit('</h3><a class="btn btn-secondary" href="https://f.example/'),
        F.col("o_orderkey"), lit('">Apply</a></div>'),
    )
    return pages.tile_postings(_html_page(spark, d, item)).drop("item")


@query(
    "card_loop_items",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE o_orderstatus WHEN 'F' THEN 'Billings' ELSE 'Dept ' || o_custkey END AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://r.example/' || o_orderkey AS Link
FROM orders""",
)
def card_loop_items(spark: SparkSession, d: str) -> DataFrame:
    department = F.when(
        F.col("o_orderstatus") != "F",
        F.concat(lit('<span class="elementor-post-info__terms-list-item">Dept '), F.col("o_custkey"), lit("</span>")),
    ).otherwise(lit(""))
    item = F.concat(
        lit('<div class="e-loop-item"><h2 class="elementor-heading-title"><a href="https://r.example/'), F.col("o_orderkey"),
        lit('">'), _tag_text(_job_title()), lit("</a></h2>"), department, lit("</div>"),
    )
    template = '<div class="e-loop-item template"><h2 class="elementor-heading-title"></h2></div>'
    return pages.loop_item_postings(_html_page(spark, d, item, template)).drop("item")


@query(
    "file_blocks",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, 'Lame Deer' AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       'https://c.example/' || o_orderkey || '.pdf' AS Link
FROM orders WHERE o_orderstatus <> 'P'""",
)
def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The link without a class counts; files about trustees are no jobs."""
    title = F.when(F.col("o_orderstatus") == "P", lit("Trustee vacancy")).otherwise(_tag_text(_job_title()))
    href = F.concat(lit("https://c.example/"), F.col("o_orderkey"), lit(".pdf"))
    item = F.concat(
        lit('<div class="wp-block-file"><a class="download" href="x">Download</a><a href="'), href, lit('">'), title,
        lit("</a></div>"),
    )
    return pages.file_block_postings(_html_page(spark, d, item)).drop("item")


@query(
    "bold_labels",
    f"""SELECT DISTINCT {_PAGE_SQL} AS page, o_orderpriority || ' clerk' AS Title, 'Miles City' AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM orders""",
)
def bold_labels(spark: SparkSession, d: str) -> DataFrame:
    """Bold texts with a colon are titles, section labels are not, repeats count once."""
    item = F.concat(
        lit("<p><strong>"), F.col("o_orderpriority"), lit(" clerk:</strong><strong>Required:</strong> x <strong>no colon</strong></p>")
    )
    return pages.bold_label_postings(_html_page(spark, d, item)).drop("item")


@query(
    "openings_list",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, 'Glendive' AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.dawson.edu/jobs/' ELSE 'http://x.example/' END || o_orderkey AS Link
FROM orders WHERE o_orderstatus = 'O'""",
)
def openings_list(spark: SparkSession, d: str) -> DataFrame:
    """Only blocks right after a heading about openings count."""
    heading = F.when(F.col("o_orderstatus") == "O", lit("Staff Openings")).otherwise(lit("Benefits"))
    href = F.when(F.col("o_orderkey") % 2 == 0, lit("/jobs/")).otherwise(lit("http://x.example/"))
    item = F.concat(
        lit("<h4>"), heading, lit('</h4><div><span class="collection-item-label"><a href="'), href, F.col("o_orderkey"),
        lit('">'), _tag_text(_job_title()),
        lit('</a></span></div><div><span class="collection-item-label"><a href="/no">Not next</a></span></div>'),
    )
    return pages.openings_list_postings(_html_page(spark, d, item)).drop("item")


@query(
    "accordion_labels",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, CASE WHEN o_orderstatus = 'P' THEN 'Pablo' ELSE 'Helena' END AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM orders""",
)
def accordion_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two accordion layouts on the same pages, told apart by class."""
    cls = F.when(F.col("o_orderstatus") == "P", lit("uabb-adv-accordion-button-label")).otherwise(lit("accordion__trigger"))
    item = F.concat(lit('<div class="x '), cls, lit('">'), _tag_text(_job_title()), lit("</div>"))
    html = _html_page(spark, d, item)
    both = pages.button_accordion_postings(html).unionByName(pages.trigger_accordion_postings(html))
    return both.drop("item")


@query(
    "pdf_links",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, 'Crow Agency' AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       'http://lbhc.edu/files/' || o_orderkey || '.pdf' AS Link
FROM orders WHERE o_orderstatus <> 'F'""",
)
def pdf_links(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("o_orderstatus") == "F", lit(".docx")).otherwise(lit(".pdf"))
    item = F.concat(
        lit('<tr><td><a href="/files/'), F.col("o_orderkey"), ending, lit('">'), _tag_text(_job_title()), lit("</a></td></tr>")
    )
    before = '<a href="/menu.pdf">Menu</a><div class="field--name-body"><table>'
    return pages.pdf_link_postings(_html_page(spark, d, item, before, "</table></div>")).drop("item")


@query(
    "here_links",
    f"""SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, 'Harlem' AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       'https://a.example/_files/ugd/' || o_orderkey AS Link
FROM orders""",
)
def here_links(spark: SparkSession, d: str) -> DataFrame:
    """Each title link is followed by a "here" link; a second "here" in a row is left out."""
    again = F.when(
        F.col("o_orderstatus") == "P", lit('<a href="https://a.example/_files/ugd/dup">HERE</a>')
    ).otherwise(lit(""))
    item = F.concat(
        lit('<p><a href="https://a.example/_files/ugd/t">'), _tag_text(_job_title()),
        lit('</a> apply <a href="/other">x</a><a href="https://a.example/_files/ugd/'), F.col("o_orderkey"),
        lit('">here.</a>'), again, lit("</p>"),
    )
    return pages.here_link_postings(_html_page(spark, d, item)).drop("item")


@query(
    "file_sections",
    f"""WITH h AS (SELECT *, last_value(CASE WHEN o_orderstatus = 'P' THEN 'Section ' || o_orderkey END IGNORE NULLS)
         OVER (PARTITION BY {_PAGE_SQL} ORDER BY o_orderkey) AS header FROM orders)
SELECT {_PAGE_SQL} AS page, {_TITLE_SQL} AS Title, header AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       'https://l.example/' || o_orderkey || '.pdf' AS Link
FROM h WHERE o_orderstatus = 'O'""",
)
def file_sections(spark: SparkSession, d: str) -> DataFrame:
    """Short text blocks are running headers, file blocks below them hold the postings;
    long blocks change nothing and forms are no jobs."""
    key = F.col("o_orderkey")

    def block(kind: str, *inner: Column) -> Column:
        return F.concat(lit(f'<div class="page-block page-block-{kind}">'), *inner, lit("</div>"))

    def attachment(title: Column) -> Column:
        return block(
            "files", lit('<a class="attachment-type-pdf" href="https://l.example/'), key, lit('.pdf">'), title, lit("</a>")
        )

    item = (
        F.when(F.col("o_orderstatus") == "P", block("text", lit("<p>Section "), key, lit("</p>")))
        .when(F.col("o_orderstatus") == "F", F.concat(block("text", F.repeat(lit("long "), 20)), attachment(lit("W-4 form"))))
        .otherwise(attachment(_tag_text(_job_title())))
    )
    return pages.file_section_postings(_html_page(spark, d, item)).drop("item")


@query(
    "button_titles",
    f"""SELECT DISTINCT {_PAGE_SQL} AS page, 'Job for ' || o_orderpriority AS Title, 'Tab ' || ({_PAGE_SQL}) AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM orders""",
)
def button_titles(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat(
        lit('<a class="en-pe-btn"> Job for '), F.col("o_orderpriority"),
        lit(' </a><a class="en-pe-btn">Apply Now – Coach Application</a><a class="other">No</a>'),
    )
    html = _html_page(spark, d, item)
    return pages.button_postings(html, F.concat(lit("Tab "), F.col("page"))).drop("item")


@query(
    "extract_postings",
    f"""SELECT {_PAGE_SQL} AS page, CASE ({_PAGE_SQL}) % 2 WHEN 0 THEN 'LBHC' ELSE 'CDKC' END AS platform, {_TITLE_SQL} AS Title,
       CASE ({_PAGE_SQL}) % 2 WHEN 0 THEN 'Crow Agency' ELSE 'Lame Deer' END AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       'https://x.example/' || o_orderkey || '.pdf' AS Link
FROM orders""",
)
def extract_postings(spark: SparkSession, d: str) -> DataFrame:
    """A landed table of several platforms, each read by its own rule."""
    item = F.concat(
        lit('<div class="wp-block-file field--name-body"><table><tr><td><a href="https://x.example/'), F.col("o_orderkey"),
        lit('.pdf">'), _tag_text(_job_title()), lit("</a></td></tr></table></div>"),
    )
    platform = F.when(F.col("page") % 2 == 0, lit("LBHC")).otherwise(lit("CDKC"))
    return pages.extract_postings(_html_page(spark, d, item).withColumn("platform", platform)).drop("item")


@query(
    "page_links",
    r"""WITH n AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
    '<li><a href="[^"]*">[^<]*</a></li>')) AS link FROM pages)
SELECT page_id, trim(regexp_replace(regexp_extract(link, '>([^<]*)</a>', 1), '\s+', ' ', 'g')) AS text,
       regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(link, 'href="([^"]*)"', 1) AS target
FROM n""",
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Menu links of the raw web pages, made absolute."""
    from ..functions.urls import resolve_url

    landed_pages = table(spark, d, "pages").withColumnRenamed("html", "body")
    found = pages.read_pages(landed_pages, Outline({"link": Pick("nav li a")}))
    return found.select("page_id", "text", resolve_url("href", "url").alias("target"))


@query(
    "page_headlines",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g')) AS headline
FROM pages WHERE regexp_matches(html, '<article[^>]*>\s*<h1>')""",
)
def page_headlines(spark: SparkSession, d: str) -> DataFrame:
    landed_pages = table(spark, d, "pages").withColumnRenamed("html", "body")
    found = pages.read_pages(landed_pages, Outline({"h": Pick("article > h1")}))
    return found.select("page_id", F.col("text").alias("headline"))


# -- rendered text -----------------------------------------------------------


def _text_page(spark: SparkSession, d: str, item: Column, before: str, after: str) -> DataFrame:
    return landed(
        _orders(spark, d), "o_orderkey", item, lambda items: F.concat(lit(before), F.array_join(items, "\n"), lit(after))
    )


@query(
    "sectioned_text",
    f"""WITH h AS (SELECT *, last_value(CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'filled' END END IGNORE NULLS)
         OVER (PARTITION BY {_PAGE_SQL} ORDER BY o_orderkey) AS section FROM orders)
SELECT {_PAGE_SQL} AS page, 'Job ' || o_orderkey AS Title, 'Wolf Point' AS Location, CAST(NULL AS VARCHAR) AS Posted_Date,
       'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM h WHERE section = 'open' AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'P'""",
)
def sectioned_text(spark: SparkSession, d: str) -> DataFrame:
    """Section headers switch; filled sections, sentences and everything after the footer are skipped."""
    key = F.col("o_orderkey")
    header = F.when(key % 2 == 0, lit("Open Positions:")).otherwise(lit("Jobs CURRENTLY FILLED:"))
    line = F.when(F.col("o_orderstatus") == "P", F.concat(lit("See job "), key, lit("."))).otherwise(
        F.concat(lit("  Job "), key, lit("\t"))
    )
    item = F.when(key % 7 == 0, header).otherwise(line)
    return rendered.sectioned_postings(
        _text_page(spark, d, item, "Menu\nJob 0\nJOB OPENINGS\n\n", "\nFind Us\nOpen Positions:\nToo Late\n")
    ).drop("item")


@query(
    "listed_text",
    f"""SELECT {_PAGE_SQL} AS page, {_ITEM_SQL} AS item, {_TITLE_SQL} AS Title, 'Box Elder' AS Location,
       CAST(NULL AS VARCHAR) AS Posted_Date, 'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM orders WHERE ({_PAGE_SQL}) % 3 <> 0""",
)
def listed_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines between two markers; every third page lacks the second one and gives nothing."""
    text = _text_page(spark, d, _job_title(), "Home\nCurrent Job Openings\n", "\n\nDownload SCC Employment Application\nMore")
    cut = F.when(F.col("page") % 3 == 0, F.regexp_replace("body", "Download SCC.*", "Other")).otherwise(F.col("body"))
    return rendered.listed_postings(text.withColumn("body", cut))


@query(
    "numbered_text",
    f"""SELECT {_PAGE_SQL} AS page, unnest(['Cook ' || o_orderpriority[3:], 'Bus Driver']) AS Title, 'Plentywood' AS Location,
       strftime(o_orderdate, '%Y-%m-%d') AS Posted_Date, 'https://board.example/list/' || ({_PAGE_SQL}) AS Link
FROM orders WHERE o_orderstatus <> 'P'""",
)
def numbered_text(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", lit("Classified")).when(F.col("o_orderstatus") == "O", lit("Certified"))
    line = F.concat(
        F.coalesce(kind, lit("Other")), lit(" Positions available as of "), F.date_format("o_orderdate", "MMMM d, yyyy"),
        lit(": 1. Cook "), F.substring("o_orderpriority", 3, 99), lit("  2.Bus Driver"),
    )
    return rendered.numbered_postings(_text_page(spark, d, line, "", "")).drop("item")


# -- reports, ledgers, vintages, registries ----------------------------------


@query(
    "report_lines",
    """WITH r AS (SELECT c_custkey, c_nationkey, c_name, c_acctbal FROM customer)
SELECT c_name AS District, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 1000 + 5 AS DOUBLE) END AS Teacher_Count,
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS Teacher_Salary_10th_Pctile,
       CAST(c_nationkey AS DOUBLE) AS Teacher_Avg_Salary, CAST(NULL AS DOUBLE) AS Teacher_Salary_90th_Pctile,
       '2022-23' AS Salary_Year
FROM r""",
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """One report page per nation and fifty customers, found again by region and name."""
    customer = table(spark, d, "customer").withColumn(
        "region", F.concat_ws("/", "c_nationkey", F.expr(f"c_custkey div {PER_PAGE}"))
    )
    count = F.when(F.col("c_custkey") % 5 == 0, lit("<5")).otherwise(F.format_number(F.col("c_custkey") * 1000 + 5, 0))
    low = F.when(F.col("c_custkey") % 3 == 0, lit("ND")).otherwise(F.format_number("c_custkey", 0))
    line = F.concat_ws("   ", "c_name", count, low, F.col("c_nationkey").cast("string"), lit("ND"))
    body = F.concat(lit("Report\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), lit("\nOPI GEMS 2022-23\n"))
    reports_by_region = customer.groupBy("region").agg(body.alias("body"))
    crosswalk = customer.select(F.col("c_name").alias("entity"), "region", F.col("c_name").alias("report_name"))
    return reports.compensation_rows(crosswalk, reports_by_region)


@query(
    "latest_vintage",
    """SELECT o_orderkey, year(o_orderdate) AS year FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000)""",
)
def latest_vintage(spark: SparkSession, d: str) -> DataFrame:
    dated = _orders(spark, d).select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return vintages.latest_vintage(dated, 2000, vintages.YEARS_BACK["salaries"])


@query(
    "source_urls",
    """SELECT s_name AS name, 'https://s.example/' || s_suppkey AS url FROM supplier
UNION ALL SELECT c_name, 'https://c.example/' || c_custkey FROM customer""",
)
def source_urls(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").withColumn("link", F.concat(lit("https://s.example/"), F.col("s_suppkey")))
    customers = table(spark, d, "customer").withColumn("page", F.concat(lit("https://c.example/"), F.col("c_custkey")))
    return files.source_urls((suppliers, "s_name", "link"), (customers, "c_name", "page"))


@query(
    "ledger_totals",
    """WITH m AS (SELECT n_nationkey, r_name AS entity FROM nation JOIN region ON n_regionkey = r_regionkey),
per_name AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS t FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT entity AS District, round(sum(t), 2) AS total, 'FY25' AS Finance_FY
FROM m LEFT JOIN per_name ON n_nationkey = c_nationkey GROUP BY entity""",
)
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    """A ledger with text codes and amounts, summed per name, then per entity."""
    code = F.when(F.col("c_mktsegment") == "BUILDING", lit("01")).otherwise(lit("1"))
    ledger = table(spark, d, "customer").select(
        code.alias("FundCode"), F.concat(lit(" NATION_"), F.col("c_nationkey"), lit(" ")).alias("DistrictName"),
        lit("FY25").alias("StateFY"), F.col("c_acctbal").cast("string").alias("SumOfAmount"),
    )
    crosswalk = _nation_crosswalk(spark, d)
    spent = context.general_fund_expenditure(ledger, crosswalk)
    return spent.select("District", F.round("Total_General_Fund_Expenditure", 2).alias("total"), "Finance_FY")


def _nation_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("entity"), F.col("n_name").alias("source_name")
    )


@query(
    "ingest_audit",
    """WITH n AS (SELECT user_id % 7 AS s, count(*) AS c FROM events WHERE user_id % 7 <> 3 GROUP BY 1),
e AS (SELECT DISTINCT 'source ' || (user_id % 7) AS source, user_id % 7 AS s FROM events)
SELECT source, CASE WHEN e.s = 5 THEN 'error' WHEN c IS NULL THEN 'empty' ELSE 'ok' END AS status,
       CASE WHEN e.s = 5 OR c IS NULL THEN 0 ELSE c END AS n_rows, CASE WHEN e.s = 5 THEN 'timed out' END AS error_message
FROM e LEFT JOIN n USING (s)""",
)
def ingest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Expected sources against what landed: ok, empty or error."""
    rows = events(spark, d).withColumn("source", F.concat(lit("source "), F.col("user_id") % 7))
    arrived = rows.filter(F.col("source") != "source 3")
    failed = rows.filter(F.col("source") == "source 5").select("source", lit("timed out").alias("error_message")).distinct()
    return shape.ingest_audit(rows.select("source"), arrived, failed)


@query(
    "union_with_padding",
    """SELECT 'S' AS kind, s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT 'C', c_custkey, c_name, NULL, c_mktsegment FROM customer""",
)
def union_with_padding(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select(
        lit("S").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    customers = table(spark, d, "customer").select(
        lit("C").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    return shape.union_sources(suppliers, customers)


@query(
    "platform_rows",
    """SELECT 'Job ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date_posted, CAST(NULL AS VARCHAR) AS position,
       o_orderstatus AS location, 'https://x.example/jobs/' || o_orderkey AS url, 'District ' || o_custkey AS District,
       'SchoolSpring (direct district board)' AS Posting_Source, 1 AS source_rank, o_orderkey AS seq
FROM orders""",
)
def platform_rows(spark: SparkSession, d: str) -> DataFrame:
    """One platform's rows in the common posting shape, tagged and ranked."""
    rows = _orders(spark, d).select(
        F.concat(lit("Job "), F.col("o_orderkey")).alias("Title"), F.col("o_orderstatus").alias("Location"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Posted_Date"),
        F.concat(lit("https://x.example/jobs/"), F.col("o_orderkey")).alias("Link"),
        F.concat(lit("District "), F.col("o_custkey")).alias("District"), F.col("o_orderkey").alias("seq"),
    )
    return shape.k12_posting(rows, "SchoolSpring").withColumn("seq", F.col("seq.page"))


# -- from pages to postings --------------------------------------------------


@query(
    "repeated_pages",
    f"""SELECT {_TITLE_SQL} AS Title, 'https://t.example/' || o_orderkey AS Link, count(*) AS n
FROM orders, (SELECT unnest([1, 2])) GROUP BY ALL""",
)
def repeated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page landed twice under one url and one seq: no page takes rows from another."""
    item = F.concat(
        lit('<tr><td><a href="https://t.example/'), F.col("o_orderkey"), lit('">'), _tag_text(_job_title()), lit("</a></td></tr>")
    )
    html = _html_page(spark, d, item, "<table>", "</table>").drop("page")
    same = html.withColumns({"url": lit("https://t.example/list"), "seq": lit("1").cast("long")})
    rows = pages.table_postings(same.unionByName(same))
    return rows.groupBy("Title", "Link").agg(F.count(lit("1")).alias("n"))


@query(
    "numbered_pages",
    """WITH n AS (SELECT o_orderkey // 40 AS page, count(*) AS lines FROM orders GROUP BY 1)
SELECT sum(lines) * 3 AS postings, sum(lines) * 3 AS orders, sum(lines) * 3 AS identities, max(lines) * 3 AS most_on_a_page FROM n""",
)
def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of forty announcement lines with three titles each, through the raw snapshot: every posting has a
    place and an identity of its own."""
    line = lit("Classified Positions available as of July 1, 2024: 1. Cook 2. Driver 3. Aide")
    lines = _orders(spark, d).select(F.expr("o_orderkey div 40").alias("page"), line.alias("line"))
    landed_pages = lines.groupBy("page").agg(F.array_join(F.collect_list("line"), "\n").alias("body")).select(
        F.col("page").alias("seq"), F.concat(lit("https://n.example/"), F.col("page")).alias("url"), "body"
    )
    rows = rendered.numbered_postings(landed_pages)
    board = shape.k12_posting(rows, "Apptegy", district=lit("Plentywood"))
    nothing = shape.k12_posting(rows.filter("false"), "Statewide", district=lit("x"))
    registry = spark.createDataFrame([("Plentywood", "Plentywood")], "District string, City string")
    raw = k12.raw_snapshot([board], nothing, registry, dt.date(2024, 7, 2))
    per_page = raw.groupBy("seq.page").agg(
        F.count(lit("1")).alias("n"), F.countDistinct("seq").alias("places"), F.countDistinct("Posting_ID").alias("ids")
    )
    return per_page.agg(
        F.sum("n").alias("postings"), F.sum("places").alias("orders"), F.sum("ids").alias("identities"), F.max("n").alias("most_on_a_page")
    )


@query(
    "feed_pages",
    f"""WITH p AS (SELECT o_orderkey, o_orderpriority || ' aide' AS title, CAST(o_orderdate AS DATE) AS day, 'Town ' || (o_custkey % 20) AS town, o_orderstatus FROM orders),
known AS (SELECT DISTINCT title, day, town FROM p WHERE o_orderstatus = 'F')
SELECT title, day AS date_posted, town AS location, count(*) AS n FROM p
WHERE o_orderstatus = 'F' OR NOT EXISTS (SELECT 1 FROM known WHERE known.title = p.title AND known.day = p.day AND known.town = p.town) GROUP BY ALL""",
)
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Statewide listing pages of fifty rows against direct rows: a duplicate on a page takes none of its neighbours along."""
    orders = _orders(spark, d)
    title, town = F.concat(F.col("o_orderpriority"), lit(" aide")), F.concat(lit("Town "), F.col("o_custkey") % 20)
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    item = F.when(F.col("o_orderstatus") != "F", F.concat(
        lit("<tr><td>"), title, lit("</td><td>"), town, lit("</td><td>x</td><td>"), day,
        lit('</td><td><a id="ctl_btnJobDetailsPublic" href="#">Details</a></td></tr>'),
    )).otherwise(lit(""))
    html = _html_page(spark, d, item, '<table id="ctl00_ContentPlaceHolder1_grdJobListing">', "</table>").withColumnRenamed("page", "seq")
    feed = shape.k12_posting(pages.statewide_table_postings(html), "Statewide", district="Location")
    direct = orders.filter("o_orderstatus = 'F'").select(
        title.alias("Title"), town.alias("Location"), day.alias("Posted_Date"), lit("https://d.example").alias("Link"),
        F.concat(lit("District "), F.col("o_custkey") % 20).alias("District"), F.col("o_orderkey").alias("seq"),
    )
    registry = direct.select("District", F.col("Location").alias("City")).distinct()
    combined = k12.combine_sources([shape.k12_posting(direct, "SchoolSpring")], feed, registry)
    return combined.groupBy("title", "date_posted", "location").agg(F.count(lit("1")).alias("n"))


@query(
    "lead_columns",
    "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS note FROM customer",
)
def lead_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns dropped if there, some put in front; a typed empty frame is united with the rows."""
    from ..schemas import empty, struct

    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    led = shape.drop_and_lead(rows.withColumn("X", F.lit(1)), ["X", "Unnamed"], ["c_mktsegment"])
    return shape.union_sources(led, empty(spark, struct(c_custkey="n", note="s")))
