import json
import random

import pyarrow as pa
import pytest
from .conftest import values
from pyspark.sql import functions as F

from jobtide.sources import boards, census, pages, rendered, reports
from jobtide.sources.outline import Outline, Pick, _Reader, selector_pattern


def page(spark, body, url="https://a.example/jobs/list"):
    body = body if isinstance(body, str) else json.dumps(body)
    return spark.createDataFrame([(1, url, body)], "seq long, url string, body string")


def got(df, *columns):
    return values(df, *(columns or ("Title", "Location", "Posted_Date", "Link")))


def test_empty_pages_give_no_rows_but_all_columns(spark):
    empty = page(spark, "")
    for df in (
        boards.schoolspring_postings(empty, "d"), boards.tyler_portico_postings(empty, "i", "b"), boards.paycom_postings(empty, "k"),
        boards.isolvedhire_postings(empty), boards.adp_postings(empty, "c", "cc"), boards.peopleadmin_postings(page(spark, "<feed/>")),
        *[rule(empty) for rule in pages.PAGE_RULES.values()], rendered.sectioned_postings(empty), rendered.listed_postings(empty),
        rendered.numbered_postings(empty),
    ):
        assert df.count() == 0 and {"seq", "item", "Title", "Location", "Posted_Date", "Link"} <= set(df.columns)


def test_json_boards(spark):
    jobs = [{"jobId": 7, "title": "Nurse", "location": "L", "displayDate": "2026-06-25T00:00:00"}, {"jobId": 8, "title": "SAMPLE Classified Position"}]
    assert got(boards.schoolspring_postings(page(spark, {"value": {"jobsList": jobs}}), "x.example")) == [("Nurse", "L", "2026-06-25", "https://x.example/jobs/7")]
    tyler = [{"id": "9", "title": "T", "locationDescription": None, "postingStartDate": "2026-07-01T06:00"}]
    assert got(boards.tyler_portico_postings(page(spark, tyler), "Owner", "https://t")) == [("T", "Owner", "2026-07-01", "https://t/jobs/job-list/9")]
    assert boards.isolvedhire_postings(page(spark, {"data": {"jobs": [{"title": " A ", "startDateRef": "soon"}]}})).first().Posted_Date is None


def test_adp_without_an_id(spark):
    jobs = {"jobRequisitions": [{"requisitionTitle": "A", "postDate": "2026-07-31T01", "customFieldGroup": {"stringFields": []}}]}
    row = boards.adp_postings(page(spark, jobs), "c", "cc").first()
    assert row.Link.endswith("&jobId=NA") and row.has_external_id is False and row.Location is None


def test_atom(spark):
    xml = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>All</title><entry><title>A &amp; B</title><link href="https://p/1"/>'
        "<published>2026-08-06T13:47:01-06:00</published><author><name/></author></entry></feed>"
    )
    assert got(boards.peopleadmin_postings(page(spark, xml), "Fallback")) == [("A & B", "Fallback", "2026-08-06", "https://p/1")]


def test_census_grid(spark):
    grid = [["NAME", "v", "county"], ["A County, State", "-666", "001"], ["B County, State", "x", "003"]]
    assert values(census.grid_columns(page(spark, grid), ["NAME"], ["v"]), "NAME", "v") == [("A County, State", -666.0), ("B County, State", None)]
    assert census.grid_rows(page(spark, grid[:1])).count() == 0


@pytest.mark.parametrize(
    ("selector", "path", "hit"),
    [
        ("ul.list > li a", "html:/ul.x.list:/li.y:/h3:/a:", True), ("ul.list > li a", "html:/ul.list:/div:/li:/a:", False),
        ("td:nth-child(1) a", "tr:1/td.c:1/a:1", True), ("td:nth-child(1) a", "tr:1/td:11/a:1", False), ("a:no-class", "div:/a:", True),
        ("a:no-class", "div:/a.x:", False), ("#main tr", "table#main.z:/tr:", True), ("#main tr", "table#mainly:/tr:", False),
        ("a[id*=Details]", "td:/a#ctlDetails_1:", True), (".tile.item", "div.item.tile:", True), ("h2.a", "h2.ab:", False),
    ],
)
def test_selectors(selector, path, hit):
    assert bool(selector_pattern(selector).search(path)) is hit


def test_outline_copes_with_open_tags_and_entities():
    found = Outline({"x": Pick("li")}).matches("<ul><li>A&amp;B<li>C<br>D<script>no</script></ul><p>x")
    assert [f[3] for f in found] == ["A&B", "C D"]
    with pytest.raises(ValueError, match="selector"):
        selector_pattern("a[href^=x]")


def test_label_value_list_with_two_valued_type(spark):
    html = (
        "<ul class='postingsList'><table class='title'><tr><td id='wrapword'>Cook's aide</td></tr></table>"
        "<li><span class='label'>Position Type:</span><span class='normal'>Support</span></li><li><span class='normal'>Kitchen</span></li>"
        "<li><span class='label'>Date Posted:</span><span class='normal'>8/1/2026</span></li>"
        "<li><span class='label'>Location:</span><span class='normal'>HS</span></li></ul>"
    )
    js = "x();document.write('" + html.replace("'", "\\'") + "');\ny();"
    row = pages.label_value_postings(page(spark, js)).first()
    assert (row.title, row.position, row.position2, row.date_posted, row.location, row.closing_date) == (
        "Cook's aide", "Support", "Kitchen", "8/1/2026", "HS", None,
    )


def test_here_links(spark):
    a = '<a href="/_files/ugd/%s">%s</a>'
    html = "".join(a % p for p in [("1", "here"), ("2", "Nurse"), ("3", "HERE."), ("4", "here"), ("5", "Dean"), ("6", "Policy")])
    assert got(pages.here_link_postings(page(spark, html)), "Title", "Link") == [("Nurse", "/_files/ugd/3")]


def test_running_headers_and_forms(spark):
    text = '<div class="page-block page-block-text"><p>%s</p></div>'
    pdf = '<div class="page-block page-block-files"><a class="attachment-type-pdf" href="%s">%s</a></div>'
    html = pdf % ("0", "Early") + text % "Certified" + pdf % ("1", "Teacher") + text % ("x" * 60) + pdf % ("2", "Coach") + pdf % ("3", "W-4 form")
    assert got(pages.file_section_postings(page(spark, html)), "Title", "Location") == [("Coach", "Certified"), ("Early", None), ("Teacher", "Certified")]


def test_openings_need_the_very_next_block(spark):
    link = '<div><span class="collection-item-label"><a href="/%s">%s</a></span></div>'
    html = "<h4>Openings</h4>" + link % ("a", "A") + link % ("b", "B") + "<h4>Openings</h4><p>x</p>" + link % ("c", "C") + "<h4>Other</h4>" + link % ("d", "D")
    assert got(pages.openings_list_postings(page(spark, html)), "Title", "Link") == [("A", "https://www.dawson.edu/a")]


def test_repeated_and_excluded_texts(spark):
    bold = "<strong>Cook:</strong><strong>Cook:</strong><strong>Required:</strong><strong>No</strong>"
    assert got(pages.bold_label_postings(page(spark, bold)), "Title") == [("Cook",)]
    buttons = '<a class="en-pe-btn"> Aide </a><a class="en-pe-btn">Aide</a><a class="en-pe-btn">Apply Now – Coach Application</a>'
    assert got(pages.button_postings(page(spark, buttons), "Coach"), "Title", "Location") == [("Aide", "Coach")]


def test_extract_runs_each_rule_on_its_own_platform(spark):
    rows = [("CDKC", "u1", 1, '<div class="wp-block-file"><a href="1">Nurse</a></div>'), ("SKC", "u2", 2, '<b class="uabb-adv-accordion-button-label">Dean</b>')]
    payloads = spark.createDataFrame(rows, "platform string, url string, seq long, body string")
    assert got(pages.extract_postings(payloads), "platform", "Title", "Link") == [("CDKC", "Nurse", "1"), ("SKC", "Dean", "u2")]
    with pytest.raises(ValueError, match="no rules"):
        pages.extract_postings(payloads, {})


def test_sectioned_text(spark):
    text = "Cook\nJOB OPENINGS\nlost line\nCERTIFIED:\n HS Teacher \nApply by mail.\nCURRENTLY FILLED JOBS:\nOld job\nClassified Jobs:\nCook\n1. numbered\nFind Us\nNot me"
    assert [r.Title for r in rendered.sectioned_postings(page(spark, text)).orderBy("item").collect()] == ["HS Teacher", "Cook"]
    assert rendered.sectioned_postings(page(spark, "CERTIFIED:\nTeacher")).count() == 0


def test_listed_text_needs_both_markers_in_order(spark):
    a, z = rendered.LIST_START, rendered.LIST_END
    assert got(rendered.listed_postings(page(spark, f"x\n{a}\n A \n\nB\n{z}")), "Title") == [("A",), ("B",)]
    for text in (f"{a}\nA", f"A\n{z}", f"{z}\nA\n{a}", f"{a}\n{z}"):
        assert rendered.listed_postings(page(spark, text)).count() == 0


def test_numbered_text(spark):
    text = "Classified Positions available as of July 13,  2026: 1. Cook  2.Bus Driver/Aide\nCertified Positions available: 1. Music\nOther 1. No"
    assert got(rendered.numbered_postings(page(spark, text)), "Title", "Posted_Date") == [
        ("Bus Driver/Aide", "2026-07-13"), ("Cook", "2026-07-13"), ("Music", None),
    ]


def test_report_lines_in_order(spark):
    body = "Head\nEast Helena Schools  30  40,100  50,200  60,300\nHelena Schools   <5   ND  1  2\nOdd Schools 5\n OPI GEMS 2022-23"
    crosswalk = spark.createDataFrame(
        [("EH", "r", "East Helena Schools"), ("H", "r", "\nHelena"), ("First", "r", "Helena Schools"), ("Odd", "r", "Odd Schools"), ("No", "zz", "x")],
        "entity string, region string, report_name string",
    )
    texts = spark.createDataFrame([("r", body)], "region string, body string")
    rows = {r.District: tuple(r)[1:] for r in reports.compensation_rows(crosswalk, texts).collect()}
    assert rows["EH"] == (30.0, 40100.0, 50200.0, 60300.0, "2022-23")
    assert rows["First"] == rows["EH"], "the first line that contains the name decides"
    assert rows["Odd"] == rows["No"] == rows["H"] == (None, None, None, None, "2022-23")


def test_unwrap_script(spark):
    df = spark.createDataFrame([("document.write('<a href=\\'x\\'>');\nz;document.write('b');",)], "js string")
    assert df.select(pages.unwrap_script("js").alias("h")).first().h == "<a href='x'>b"
    assert df.select(pages.unwrap_script(F.lit("none")).alias("h")).first().h == ""


def test_a_reader_gives_back_what_it_found_before_a_batch_ends(spark, monkeypatch):
    """A batch of many pages comes back in parts, none of a page's rows lost or apart."""
    taken = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, find, schema: taken.update(find=find))
    frame = spark.createDataFrame([(0, "")], "page long, body string")
    pages.read_pages(frame, Outline({"x": Pick("li")}, card="ul"))
    body = "<ul>" + "<li>a</li>" * 50 + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page": list(range(1000)), "body": [body * 2] * 999 + [None]})
    parts = list(taken["find"](iter([batch])))
    assert len(parts) > 1
    assert max(p.num_rows for p in parts) <= pages.GIVEN_BACK_AT // 50
    assert [x for p in parts for x in p.column("page").to_pylist()] == [n for n in range(999) for _ in range(2)]
    assert all(len(dict(f)["x"]) == 50 for p in parts for f in p.column("fields").to_pylist())


def test_plain_tags_are_read_as_the_standard_parser_reads_them():
    bits = """< > </ /> " ' = & &amp &amp; <!-- --> <!DOCTYPE_html> <?x> <script> </script> <title> </title> a b_c <a_href="x?a=1&amp;b=2">
        <a_class="c_d"_id=q_href='e'> </a> <p> </p> <li> </li> <ul> </ul> <td> <tr> <table> </table> <br> <br/> <DIV_CLASS="X"> </DIV_> </div>
        <div_data-x="a>b<c"> <h4> </h4> <b <b_x="1"y="2"> <_b> </_p> </> <a-b> <a:b> <p_CLASS="z"_class="w"> &#65 &notit; <noscript>"""
    bits = [bit.replace("_", " ") for bit in bits.split()] + ["\n", '<p\u00a0class="n">']
    picks = {"a": Pick("a"), "p": Pick("p.w"), "li": Pick("ul li"), "x": Pick("*"), "first": Pick("tr > td:nth-child(1)")}
    chosen = random.Random(3)
    for numbered in (False, True):
        outline = Outline({k: v for k, v in picks.items() if numbered or k != "first"}, lead="h4")
        outline.matches("")
        for _ in range(3000):
            html = "".join(chosen.choice(bits) for _ in range(chosen.randint(1, 20)))
            standard = _Reader(outline._plan[0], "h4")
            standard.feed(html)
            standard.close()
            standard.finish()
            assert outline.matches(html) == sorted(standard.found, key=lambda f: (f[1], f[2])), html


def test_a_reader_forgets_places_and_reads_on():
    outline = Outline({"x": Pick("td:nth-child(2)")}, card="tr")
    outline.matches("")
    outline._plan[0].REMEMBERED = 20
    page = "<table>" + "".join(f"<tr><td>a</td><td>{n}</td></tr>" for n in range(50)) + "</table>"
    for _ in range(2):
        assert [f[3] for f in outline.matches(page)] == [str(n) for n in range(50)]
