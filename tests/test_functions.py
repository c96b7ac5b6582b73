import datetime as dt

import pytest
from .conftest import values
from pyspark.sql import functions as F

from jobtide.functions import dates, numbers, rules, signals, text, urls

D = dt.date


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()["y"]


def raw(spark, data):
    """Bytes as a string column, the way a text scan delivers them."""
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(F.col("b").cast("string").alias("x"))


# -- text --------------------------------------------------------------------


def test_only_invalid_bytes_are_repaired(spark):
    legacy = raw(spark, b"Cook\x92s aide \x97 2 posts")
    assert legacy.select(text.normalize_posting_text("x")).first()[0] == "Cook’s aide — 2 posts"
    assert raw(spark, b"Chemistry \x93Teacher\x94").select(rules.k12_position("x")).first()[0] == "Teacher"
    assert raw(spark, b"a\x81b").select(text.normalize_posting_text("x")).first()[0] == "a<81>b"
    valid = "\tGärtner · Süd \r\n"
    assert one(spark, valid, text.normalize_posting_text("x")) == "Gärtner · Süd"


def test_normalising_is_idempotent_and_keeps_null(spark):
    df = spark.createDataFrame([("\t a\r\n\n b ",), (None,), ("",)], "x string")
    once = text.normalize_posting_text("x")
    assert values(df.select(once.alias("y"))) == [("",), ("a  b",), (None,)]
    assert df.filter(~(text.normalize_posting_text(once) == once)).count() == 0


def test_looking_for_a_pattern_first_changes_no_result(spark):
    lines = raw(spark, b"\r\n a\x92\r\nb\x85\n")
    assert lines.select(text.normalize_posting_text("x")).first()[0] == "a\u2019 b\u2026"
    odd = ["A  b", "A\tb", "A b", "a\x0bB \f c", " A\r\n\nb ", "\u00a0 \u00a0", "", None]
    plain = F.regexp_replace(F.lower("x"), r"\s{2,}|[^\S ]", " ")
    df = spark.createDataFrame([(v,) for v in odd], "x string")
    assert df.filter(~text.identity_component("x", normalised=True).eqNullSafe(plain)).count() == 0
    links = ["/jobs/1", "/job/", "/job-list/a", "ViewJob.aspx?JobID=", "?jobId=1", "a&id=", "x.pdf#a", "x.pdfx", "=", "", None]
    found = spark.createDataFrame([(v,) for v in links], "x string").select(urls.is_stable_posting_url("x", normalised=True))
    assert [r[0] for r in found.collect()] == [True, False, True, True, True, True, True, False, False, False, False]
    days = ["2024-02-29", "2024-02-30", "0000-01-01", "0999-12-31", "2024-13-01", " 2024-07-01", "2024-07-01 (open)", None]
    both = spark.createDataFrame([(v,) for v in days], "x string").select(
        *[c.cast("string") for c in (dates.standardize_date("x"), dates.parse_any_date(F.regexp_replace("x", r"\s*\(.*\)$", "")))]
    )
    assert all(a == b for a, b in both.collect()) and both.first()[0] == "2024-02-29"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("A\t\tB", "a b"), ("  A  b ", "a b"), ("x\r\ny", "x y"), ("É \n z", "é z"), (None, None), ("a b", "a b")],
)
def test_identity_component(spark, given, wanted):
    assert one(spark, given, text.identity_component("x")) == wanted


def test_squish_knows_unicode_spaces(spark):
    assert one(spark, " a  b ", text.squish("x")) == "a b"


@pytest.mark.parametrize("original", ["Koch – Küche", "crème", "naïve €5", "“quoted” text", "日本語"])
def test_mojibake_is_reversed_with_proof(spark, original):
    broken = original.encode("utf-8").decode("cp1252", "surrogateescape")
    if any(0xDC80 <= ord(c) <= 0xDCFF for c in broken):
        # A byte the code page does not define: no proof, no change.
        broken = "".join(chr(ord(c) - 0xDC00) if 0xDC80 <= ord(c) <= 0xDCFF else c for c in broken)
        assert one(spark, broken, text.repair_mojibake("x")) == broken
    else:
        assert one(spark, broken, text.repair_mojibake("x")) == original
    assert one(spark, original, text.repair_mojibake("x")) == original


def test_column_repair_reports_what_changed(spark):
    df = spark.createDataFrame([(1, "CafÃ©"), (2, "Café"), (3, None), (4, "")], "id int, title string")
    fixed, report = text.repair_column(df, "title")
    assert values(fixed) == [(1, "Café"), (2, "Café"), (3, None), (4, "")]
    assert values(report) == [(1, "CafÃ©", "Café")]
    with pytest.raises(ValueError, match="no column"):
        text.repair_column(df, "absent")


def test_match_key_keeps_the_space_of_final_punctuation(spark):
    assert one(spark, " Math T. ", text.match_key("x")) == "math t "
    assert one(spark, "Math-T", text.match_key("x")) == "math t"
    assert one(spark, "Élève/2", text.match_key("x")) == "élève 2"


def test_encoding_fault(spark):
    assert raw(spark, b"a\xff").select(text.has_encoding_fault("x")).first()[0] is True
    assert one(spark, "a�", text.has_encoding_fault("x")) is True
    assert one(spark, "aé", text.has_encoding_fault("x")) is False


# -- dates -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Jul 22, 2026 3:15 PM", D(2026, 7, 22)), ("July 4, 2026 11:05 AM", D(2026, 7, 4)), ("2026-08-01", D(2026, 8, 1)),
        ("8/1/2026", D(2026, 8, 1)), ("22/7/2026", D(2026, 7, 22)), ("3/4/2026", D(2026, 3, 4)), ("8/1/26", D(2026, 8, 1)),
        ("July 22, 2026", D(2026, 7, 22)), ("22 July 2026", D(2026, 7, 22)), ("2026-08-01 10:20:30", D(2026, 8, 1)),
        ("8/1/2026 (Open until filled)", D(2026, 8, 1)), ("Until filled", None), ("", None), (None, None), ("13/13/2026", None),
        ("20260801", D(2026, 8, 1)),
    ],
)
def test_standardize_date(spark, given, wanted):
    assert one(spark, given, dates.standardize_date("x")) == wanted


def test_archive_date(spark):
    for given, wanted in [("8/6/2026", D(2026, 8, 6)), ("2026-08-06", D(2026, 8, 6)), ("20260806", None), (None, None)]:
        assert one(spark, given, dates.archive_date("x")) == wanted


def test_old_dates_are_marked_and_kept(spark):
    as_of = D(2026, 8, 18)
    for given, wanted in [
        ("2020-01-01", "Listed since 2020-01-01"), ("2026-08-01", "2026-08-01"), ("Until filled", "Until filled"), (None, None),
        ("2026-02-18", "Listed since 2026-02-18"), ("2026-02-19", "2026-02-19"),
    ]:
        assert one(spark, given, dates.posted_or_listed("x", as_of)) == wanted


def test_timeline_window(spark):
    df = spark.createDataFrame([(D(2026, 8, 6),), (D(2026, 8, 18),)], "Archive_Date date")
    row = dates.timeline_window(df).first()
    assert (row.window_start, row.window_end, row.span_days) == (D(2026, 8, 6), D(2026, 8, 18), 12)
    assert row.history_note.startswith("Only 12 days")
    long = spark.createDataFrame([(D(2024, 1, 1),), (D(2026, 8, 18),)], "Archive_Date date")
    assert dates.timeline_window(long).first().window_start == D(2025, 8, 18)
    assert dates.timeline_window(long).first().history_note == ""


# -- rules -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("title", "wanted"),
    [
        ("Para II", "Paraprofessional"), ("Substitute", "Substitute"), ("Subject Teacher", "Substitute"),
        ("Speech Therapist", "Support Services"), ("Math Teacher - Part-Time", "Part-Time Teacher"),
        ("Math Teacher 0.5 FTE", "Part-Time Teacher"), ("Math Teacher .5 FTE", "Teacher"), ("Math Teacher", "Teacher"), ("Ski Instructor", "Teacher"),
        ("Head Golf Coach", "Athletics"), ("Night Custodian", "Custodial/Maintenance"), ("Bus Driver", "Transportation"),
        ("Business Manager", "Other"), ("Principal", "Administration"), ("Secretary", "Staff"), ("Head Cook", "Food Services"),
        ("Head Start", "Child Care"), (None, "Other"), ("MATH TEACHER", "Teacher"),
    ],
)
def test_position(spark, title, wanted):
    assert one(spark, title, rules.k12_position("x")) == wanted


@pytest.mark.parametrize(
    ("title", "wanted", "broad"),
    [
        ("Resource Teacher", "Special Education - Resource/Life Skills", "Special Education - Resource/Life Skills"),
        ("Special Education Math Teacher", "Special Education - General", "Special Education - General"),
        ("CTE Teacher", "Technical Education", "CTE - Trades, Ag & Technical"),
        ("Vo-Ag Teacher", "Agriculture Education", "CTE - Trades, Ag & Technical"),
        ("Technology Education Teacher", "Computer Science Education", "CTE - Business & Family Sciences"),
        ("Technology Education Teacher Assistant", "Uncategorized", "Other"),
        ("Pre-K Teacher", "Early Childhood Education", "Early Childhood"),
        ("Third Grade Teacher", "Elementary Education", "Elementary"),
        ("English Teacher", "English Language Arts Education", "English Language Arts Secondary"),
        ("English Learner Teacher", "Uncategorized", "Other"),
        ("ESL Teacher", "Language Education", "Language"), ("Band Teacher", "Music Education", "Music"),
        ("PE Teacher", "Physical Education", "Physical Education"), ("Guest Teacher", "Substitute Teaching", "Other"),
        ("JROTC Teacher", "CTE Teacher", "CTE - Trades, Ag & Technical"), ("Party Teacher", "Uncategorized", "Other"),
        ("Librarian", "Library Media", "Library Media"), (None, "Uncategorized", "Other"),
    ],
)
def test_subject_and_broad_category(spark, title, wanted, broad):
    assert one(spark, title, rules.k12_subject("x")) == wanted
    assert one(spark, wanted, rules.k12_broad_category("x")) == broad


@pytest.mark.parametrize(
    ("title", "job_type", "appointment"),
    [
        ("Adjunct Instructor", "Adjunct/Part-Time Faculty", "Adjunct/part-time faculty"),
        ("Part-Time Nursing Instructor", "Adjunct/Part-Time Faculty", "Adjunct/part-time faculty"),
        ("Custodian 1-Part-Time", "Support Services", "Adjunct/part-time faculty"),
        ("Professor of Law", "Instructor/Teacher/Faculty", "Faculty/instructor (non-adjunct)"),
        ("Sous Chef", "Culinary", "Other / not faculty"), ("Dean", "Administration", "Other / not faculty"),
        ("Finance Technician", "Professional", "Other / not faculty"), ("Director", "Management", "Other / not faculty"),
        (None, "Other", "Other / not faculty"),
    ],
)
def test_he_job_type_and_appointment_differ_on_part_time(spark, title, job_type, appointment):
    assert one(spark, title, rules.he_job_type("x")) == job_type
    assert one(spark, title, rules.he_appointment("x")) == appointment


def test_he_category(spark):
    for title, wanted in [
        ("Professor of Law", "Legal"), ("Agricultural Business", "CTE - Trades & Engineering"), ("Math", "Math"),
        ("Part-time Lecturer", "Uncategorized"), ("Art Lecturer", "The Arts"), ("Librarian", "Library"),
    ]:
        assert one(spark, title, rules.he_category("x")) == wanted


def test_rules_for_keeps_the_deciding_rules(spark):
    kept = rules.rules_for(rules.HE_JOB_TYPE_RULES, [rules.FACULTY_JOB_TYPE, rules.ADJUNCT_JOB_TYPE])
    assert [r[0] for r in kept] == [rules.ADJUNCT_JOB_TYPE, rules.ADJUNCT_JOB_TYPE, rules.FACULTY_JOB_TYPE]


def test_recode_and_location_rules(spark):
    assert one(spark, "Math", rules.recode("x", {"Math": "Core"})) == "Core"
    assert one(spark, "Else", rules.recode("x", {"Math": "Core"})) == "Else"
    assert one(spark, None, rules.k12_broad_category("x")) == "Other"
    assert one(spark, "5 St, Dillon, MT 59725", rules.location_institution("x", F.lit("Owner"))) == "University of Montana Western"
    assert one(spark, None, rules.location_institution("x", F.lit("Owner"))) == "Owner"


# -- links, numbers, signals -------------------------------------------------


@pytest.mark.parametrize(
    ("url", "stable"),
    [
        ("https://a.example/jobs/101", True), ("https://a.example/job/1", True), ("https://a.example/job-list/9", True),
        ("https://a.example/ViewJob.aspx?JobID=4", True), ("https://a.example/x?id=4", True), ("https://a.example/x?uREC_ID=4", False),
        ("https://a.example/x.pdf", True), ("https://a.example/x.PDF", False), ("https://a.example/jobs", False), (None, False),
    ],
)
def test_stable_urls(spark, url, stable):
    assert one(spark, url, urls.is_stable_posting_url("x")) is stable


def test_statewide_urls(spark):
    assert one(spark, "https://APPS.opi.mt.gov/mtjobsforteachers/x", urls.is_statewide_posting("x")) is True
    assert one(spark, None, urls.is_statewide_posting("x")) is False


@pytest.mark.parametrize(
    ("href", "wanted"),
    [
        ("/v/1", "https://a.example/v/1"), ("v/1", "https://a.example/list/v/1"), ("?q=1", "https://a.example/list/p?q=1"),
        ("//b.example/x", "https://b.example/x"), ("mailto:x@y.z", "mailto:x@y.z"), ("http://c.example", "http://c.example"),
    ],
)
def test_resolve_url(spark, href, wanted):
    assert one(spark, href, urls.resolve_url("x", F.lit("https://a.example/list/p?z=1#t"))) == wanted


def test_resolve_url_at_the_site_root(spark):
    assert one(spark, "v", urls.resolve_url("x", F.lit("https://a.example"))) == "https://a.example/v"


def test_numbers(spark):
    for given, wanted in [("1,234", 1234.0), ("ND", None), ("<5", None), ("", None), (None, None)]:
        assert one(spark, given, numbers.suppressed_number("x")) == wanted
    assert one(spark, -1.0, numbers.non_negative("x"), "double") is None
    assert one(spark, 0.0, numbers.non_negative("x"), "double") == 0.0
    assert one(spark, -2.0, numbers.first_clean("x", F.lit(3.0)), "double") == 3.0
    assert one(spark, 9.0, numbers.guarded_ratio(F.lit(1), "x", at_least=10), "double") is None
    assert one(spark, 0.0, numbers.change_ratio(F.lit(1), "x"), "double") is None
    assert one(spark, 4.0, numbers.change_ratio(F.lit(5), "x"), "double") == 0.25


def test_display_forms(spark):
    assert one(spark, 0.0655, numbers.percent("x"), "double") == "6.6%"
    assert one(spark, 0.05, numbers.percent("x", signed=True), "double") == "+5.0%"
    assert one(spark, -0.05, numbers.percent("x", signed=True), "double") == "-5.0%"
    assert one(spark, None, numbers.percent("x"), "double") is None
    assert one(spark, 1234567.0, numbers.dollars("x", "/mo"), "double") == "$1,234,567/mo"
    assert one(spark, 12.34, numbers.one_decimal("x"), "double") == "12.3"
    assert one(spark, 1000.0, numbers.marker_radius("x"), "double") == 24.0
    assert one(spark, 0.0, numbers.marker_radius("x"), "double") == 6.0


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("Apply now. View details. Closing date: soon", "likely_broken"),
        ("There are currently no openings", "looks_genuinely_empty"),
        ("No jobs. Apply Now View Details Job Title", "likely_broken"), ("Welcome", "inconclusive"), (None, "inconclusive"), ("  ", "inconclusive"),
    ],
)
def test_page_signal(spark, page, wanted):
    assert one(spark, page, signals.page_signal("x")) == wanted


def test_visible_text(spark):
    html = "<p>A<script>var x='<p>';</script><!-- no --><b>B</b>\n C</p>"
    assert one(spark, html, signals.visible_text("x")) == "A B C"


def test_title_lines(spark):
    for line, wanted in [("HS Teacher", True), ("Ends.", False), ("1. Numbered", False), ("* note", False), ("123", False), ("x" * 56, False)]:
        assert one(spark, line, signals.looks_like_title_line("x")) is wanted


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [
        (r"Caf\u00E9", "CAFÉ", True), (r"\p{Lu}b", "xÉB", True), (r"\QA.b\E", "xa.B", True), (r"(?U)\bÄ", "ä", True), (r"[A-C]\S", "bx", True),
        (r"\Bend", "BEND", True), (r"\Bend", "end", False), (r"(?<Name>a)b", "AB", True),
    ],
)
def test_patterns_keep_their_meaning_when_case_is_ignored(spark, pattern, value, hit):
    assert one(spark, value, rules.matches(F.col("x"), pattern), "string") is hit
