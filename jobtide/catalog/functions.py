"""Queries over the column functions: text, dates, rules, numbers, links, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates, numbers, rules, signals, text, urls
from ..operators import quality
from .base import (
    EVENTS_SQL,
    HE_EXPECTED,
    HE_SQL,
    K12_EXPECTED,
    K12_SQL,
    events,
    he_rows,
    k12_rows,
    query,
    signal_sql,
    sql_case,
    sql_expected,
    sql_map,
    table,
)

# -- text --------------------------------------------------------------------


@query(
    "text_normalise",
    r"""SELECT doc_id,
       md5(trim(regexp_replace(text, '[\r\n]+', ' ', 'g'), chr(32) || chr(9) || chr(13) || chr(10))) AS normalised,
       md5(regexp_replace(lower(trim(regexp_replace(text, '[\r\n]+', ' ', 'g'), chr(32) || chr(9) || chr(13) || chr(10))),
                          '\s+', ' ', 'g')) AS component,
       md5(trim(regexp_replace(text, '[\t\n\x0B\f\r\p{Z}]+', ' ', 'g'))) AS squished,
       TRUE AS idempotent
FROM documents""",
)
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    once = text.normalize_posting_text("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.md5(once).alias("normalised"),
        F.md5(text.identity_component("text")).alias("component"),
        F.md5(text.squish("text")).alias("squished"),
        (text.normalize_posting_text(once) == once).alias("idempotent"),
    )


_LATIN = "^[\\x{00}-\\x{7f}\\x{a0}-\\x{ff}]*$"
_LATIN_SQL = r"regexp_matches(text, '^[\x00-\x7f\x{a0}-\x{ff}]*$')"


def _landed_bytes(df: DataFrame) -> DataFrame:
    """Documents as legacy boards land them: in a single-byte encoding where it has all
    their characters, else in UTF-8."""
    single = F.col("text").rlike(_LATIN)
    return df.withColumn(
        "landed", F.when(single, F.encode("text", "iso-8859-1")).otherwise(F.encode("text", "utf-8")).cast("string")
    )


@query(
    "invalid_bytes_repair",
    rf"""SELECT doc_id, md5(text) AS repaired, {_LATIN_SQL} AND regexp_matches(text, '[^\x00-\x7f]') AS was_invalid FROM documents""",
)
def invalid_bytes_repair(spark: SparkSession, d: str) -> DataFrame:
    landed = _landed_bytes(table(spark, d, "documents"))
    return landed.select(
        "doc_id", F.md5(text.repair_invalid_bytes("landed")).alias("repaired"),
        (~F.is_valid_utf8("landed")).alias("was_invalid"),
    )


@query(
    "encoding_faults",
    rf"""SELECT lang, count(*) FILTER (WHERE {_LATIN_SQL} AND regexp_matches(text, '[^\x00-\x7f]')) AS faults, 0::BIGINT AS after_repair
FROM documents GROUP BY lang""",
)
def encoding_faults(spark: SparkSession, d: str) -> DataFrame:
    landed = _landed_bytes(table(spark, d, "documents"))
    return landed.groupBy("lang").agg(
        F.count_if(text.has_encoding_fault("landed")).alias("faults"),
        F.count_if(text.has_encoding_fault(text.repair_invalid_bytes("landed"))).alias("after_repair"),
    )


@query(
    "mojibake_repair",
    r"""WITH h AS (SELECT doc_id, text, regexp_matches(hex(encode(text)), '^(..)*(81|8D|8F|90|9D)') AS lost FROM documents)
SELECT doc_id, NOT lost AS restored, (NOT lost AND regexp_matches(text, '[^\x00-\x7f]')) AS changed,
       TRUE AS original_untouched
FROM h""",
)
def mojibake_repair(spark: SparkSession, d: str) -> DataFrame:
    """Corrupt every text the way a wrong decode does, then prove it back.  Texts
    using a byte that Windows-1252 does not define cannot be proven and stay."""
    corrupted = F.translate(
        F.decode(F.encode("text", "utf-8"), "iso-8859-1"), text.C1_CONTROLS, text.CP1252_CHARS
    )
    repaired = text.repair_mojibake("corrupted")
    return table(spark, d, "documents").withColumn("corrupted", corrupted).select(
        "doc_id",
        (repaired == F.col("text")).alias("restored"),
        (repaired != F.col("corrupted")).alias("changed"),
        (text.repair_mojibake("text") == F.col("text")).alias("original_untouched"),
    )


# -- dates -------------------------------------------------------------------

_RENDERED = """CASE o_orderkey % 9
  WHEN 0 THEN strftime(o_orderdate, '%b %-d, %Y 3:15 PM') WHEN 1 THEN strftime(o_orderdate, '%B %-d %Y 11:05 AM')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 4 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d 14:00:59')
  WHEN 6 THEN strftime(o_orderdate, '%b %-d, %Y') || ' (Open until filled)'
  WHEN 7 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'Until filled' END"""


def _rendered_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    style = F.col("o_orderkey") % 9
    return table(spark, d, "orders").select(
        "o_orderkey",
        day.cast("date").alias("day"),
        F.when(style == 0, F.date_format(day, "MMM d, yyyy '3:15 PM'"))
        .when(style == 1, F.date_format(day, "MMMM d yyyy '11:05 AM'"))
        .when(style == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(style == 3, F.date_format(day, "MM/dd/yyyy"))
        .when(style == 4, F.date_format(day, "d MMMM yyyy"))
        .when(style == 5, F.date_format(day, "yyyy-MM-dd '14:00:59'"))
        .when(style == 6, F.concat(F.date_format(day, "MMM d, yyyy"), F.lit(" (Open until filled)")))
        .when(style == 7, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.lit("Until filled"))
        .alias("shown"),
    )


@query(
    "date_parse",
    f"""SELECT o_orderkey, {_RENDERED} AS shown,
       CASE WHEN o_orderkey % 9 = 8 THEN NULL
            WHEN o_orderkey % 9 = 7 AND day(o_orderdate) <= 12
              THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
            ELSE CAST(o_orderdate AS DATE) END AS parsed
FROM orders""",
)
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Nine layouts; day-first dates that also read month-first are month-first."""
    return _rendered_dates(spark, d).select("o_orderkey", "shown", dates.standardize_date("shown").alias("parsed"))


@query(
    "archive_date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS archive_date
FROM orders""",
)
def archive_date_parse(spark: SparkSession, d: str) -> DataFrame:
    day, style = F.col("o_orderdate"), F.col("o_orderkey") % 3
    stamp = (
        F.when(style == 0, F.date_format(day, "M/d/yyyy"))
        .when(style == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return table(spark, d, "orders").select("o_orderkey", dates.archive_date(stamp).alias("archive_date"))


@query(
    "stale_marker",
    f"""WITH s AS (SELECT o_orderkey, {_RENDERED} AS shown,
       CASE WHEN o_orderkey % 9 IN (6, 8) THEN NULL
            WHEN o_orderkey % 9 = 7 AND day(o_orderdate) <= 12
              THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
            ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT o_orderkey, CASE WHEN day < DATE '2000-01-01' - 180 THEN 'Listed since ' || shown ELSE shown END AS listed
FROM s""",
)
def stale_marker(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2000-01-01").cast("date")
    return _rendered_dates(spark, d).select("o_orderkey", dates.posted_or_listed("shown", as_of).alias("listed"))


@query(
    "timeline_window",
    """WITH o AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)
SELECT greatest(a, b - 365) AS window_start, b AS window_end, CAST(b - a AS INTEGER) AS span_days,
       CASE WHEN b - a < 365 THEN 'Only ' || (b - a) || ' days of archived history are currently available.' ELSE '' END AS history_note FROM o""",
)
def timeline_window(spark: SparkSession, d: str) -> DataFrame:
    """The bounded slider window over years of orders."""
    orders = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return dates.timeline_window(orders, "day")


@query(
    "timeline_note",
    """SELECT greatest(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) - 365) AS window_start, max(CAST(ts AS DATE)) AS window_end,
       CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) AS INTEGER) AS span_days,
       CASE WHEN max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) < 365
            THEN 'Only ' || (max(CAST(ts AS DATE)) - min(CAST(ts AS DATE))) || ' days of archived history are currently available.'
            ELSE '' END AS history_note
FROM events""",
)
def timeline_note(spark: SparkSession, d: str) -> DataFrame:
    return dates.timeline_window(events(spark, d), "day")


# -- rules -------------------------------------------------------------------


@query(
    "classify_position",
    f"""WITH {K12_SQL}
SELECT seq, title, {sql_expected("title", K12_EXPECTED, 0)} AS position FROM k12""",
)
def classify_position(spark: SparkSession, d: str) -> DataFrame:
    return k12_rows(spark, d).select("seq", "title", rules.k12_position("title").alias("position"))


@query(
    "classify_subject",
    f"""WITH {K12_SQL}, b AS (
  SELECT seq, {sql_expected("title", K12_EXPECTED, 1)} AS subject, {sql_expected("title", K12_EXPECTED, 2)} AS broad FROM k12), s AS (
  SELECT *, {sql_map("broad", rules.K12_SHORT_LABELS, "broad")} AS short_label FROM b)
SELECT seq, subject, broad, short_label, {sql_map("short_label", rules.K12_COLLAPSED, "short_label")} AS collapsed FROM s""",
)
def classify_subject(spark: SparkSession, d: str) -> DataFrame:
    return (
        k12_rows(spark, d)
        .select("seq", rules.k12_subject("title").alias("subject"))
        .withColumn("broad", rules.k12_broad_category("subject"))
        .withColumn("short_label", rules.recode("broad", rules.K12_SHORT_LABELS))
        .withColumn("collapsed", rules.recode("short_label", rules.K12_COLLAPSED))
    )


@query(
    "classify_he",
    f"""WITH {HE_SQL}
SELECT Link, {sql_expected("Title", HE_EXPECTED, 0)} AS job_type, {sql_expected("Title", HE_EXPECTED, 1)} AS category,
       {sql_map(sql_expected("Title", HE_EXPECTED, 1), rules.HE_COLLAPSED, "'Uncategorized'")} AS collapsed,
       {sql_expected("Title", HE_EXPECTED, 2)} AS appointment
FROM he""",
)
def classify_he(spark: SparkSession, d: str) -> DataFrame:
    return he_rows(spark, d).select(
        "Link",
        rules.he_job_type("Title").alias("job_type"),
        rules.he_category("Title").alias("category"),
        rules.recode(rules.he_category("Title"), rules.HE_COLLAPSED).alias("collapsed"),
        rules.he_appointment("Title").alias("appointment"),
    )


_PART_RULES = [
    ("Small red", "small|tiny", "red|crimson"),
    ("Ring or bolt", r"\b(ring|bolt)\b"),
    ("Blue", "BLUE"),
    ("Widget", "widget$"),
]


@query(
    "classify_first_match",
    f"SELECT p_partkey, {sql_case('p_name', _PART_RULES, 'Other part')} AS kind FROM part",
)
def classify_first_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.classify("p_name", _PART_RULES, "Other part").alias("kind"))


@query(
    "classify_lookahead",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN\p{Mn}_]+|[^\pL\pN\p{Mn}_]+') AS p FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, p[i] AS word, coalesce(regexp_full_match(p[i + 1], '[ \t\n\r\f\v]+'), FALSE) AS spaced,
         len(regexp_extract(coalesce(p[i + 2], ''), '^[a-z0-9_]*')) AS ahead
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM w) WHERE p[i] IN ('the', 'le', 'der', 'el', 'and', 'et', 'und', 'y')),
k AS (SELECT doc_id, bool_or(word IN ('the', 'le', 'der', 'el') AND NOT (spaced AND ahead >= 9)) AS article,
        bool_or(word IN ('and', 'et', 'und', 'y') AND spaced AND ahead > 0) AS connective FROM n GROUP BY doc_id)
SELECT lang, CASE WHEN article THEN 'article' WHEN connective THEN 'connective' ELSE 'neither' END AS kind, count(*) AS n
FROM documents LEFT JOIN k USING (doc_id) GROUP BY ALL""",
)
def classify_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents against rules that use lookaheads; the SQL walks the words instead."""
    found = [("article", r"\b(the|le|der|el)\b(?!\s+\w{9,})"), ("connective", r"\b(and|et|und|y)\b(?=\s+\w)")]
    return (
        table(spark, d, "documents")
        .select("lang", rules.classify("text", found, "neither").alias("kind"))
        .groupBy("lang", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "location_rules",
    """SELECT c_custkey, CASE WHEN contains(c_name, '#00000000') THEN 'First ten'
       WHEN contains(c_name, '7') THEN 'Has a seven' ELSE c_mktsegment END AS institution,
       CASE WHEN c_mktsegment IN ('Highlands College') THEN c_mktsegment ELSE 'Owner' END AS owner
FROM customer""",
)
def location_rules(spark: SparkSession, d: str) -> DataFrame:
    fragments = [("#00000000", "First ten"), ("7", "Has a seven")]
    return table(spark, d, "customer").select(
        "c_custkey",
        rules.contains_first("c_name", fragments, "c_mktsegment").alias("institution"),
        rules.department_institution("c_mktsegment", F.lit("Owner")).alias("owner"),
    )


# -- links -------------------------------------------------------------------


@query(
    "url_predicates",
    rf"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url || '&id=' || page_id
  WHEN 2 THEN 'https://a.example/job/' || page_id WHEN 3 THEN 'https://a.example/x.pdf?v=1'
  WHEN 4 THEN 'https://APPS.opi.mt.gov/MTjobsforteachers/' || page_id ELSE NULL END AS link FROM pages)
SELECT page_id, coalesce(regexp_matches(link, '(?i){urls.STATEWIDE_FEED}'), FALSE) AS statewide,
       coalesce(regexp_matches(link, '{urls.STABLE_POSTING_URL}'), FALSE) AS stable,
       regexp_replace(link, '\?.*$', '') AS bare
FROM u""",
)
def url_predicates(spark: SparkSession, d: str) -> DataFrame:
    n, kind = F.col("page_id"), F.col("page_id") % 6
    link = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat("url", F.lit("&id="), n))
        .when(kind == 2, F.concat(F.lit("https://a.example/job/"), n))
        .when(kind == 3, F.lit("https://a.example/x.pdf?v=1"))
        .when(kind == 4, F.concat(F.lit("https://APPS.opi.mt.gov/MTjobsforteachers/"), n))
    )
    return table(spark, d, "pages").withColumn("link", link).select(
        "page_id",
        urls.is_statewide_posting("link").alias("statewide"),
        urls.is_stable_posting_url("link").alias("stable"),
        urls.without_query("link").alias("bare"),
    )


# -- numbers -----------------------------------------------------------------


@query(
    "sentinel_and_suppressed",
    """SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS cleaned,
       CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey * 1234567 AS DOUBLE) END AS parsed,
       coalesce(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, CAST(s_nationkey AS DOUBLE)) AS first_clean
FROM supplier""",
)
def sentinel_and_suppressed(spark: SparkSession, d: str) -> DataFrame:
    style = F.col("s_suppkey") % 4
    shown = (
        F.when(style < 2, F.format_number(F.col("s_suppkey") * 1234567, 0)).when(style == 2, F.lit("ND")).otherwise(F.lit("<5"))
    )
    return table(spark, d, "supplier").select(
        "s_suppkey",
        numbers.non_negative("s_acctbal").alias("cleaned"),
        numbers.suppressed_number(shown).alias("parsed"),
        numbers.first_clean("s_acctbal", F.col("s_nationkey").cast("double")).alias("first_clean"),
    )


@query(
    "guarded_ratio",
    """SELECT p_partkey, CASE WHEN p_size > 0 THEN p_retailprice / p_size END AS ratio,
       CASE WHEN p_size >= 10 THEN p_retailprice / p_size END AS ratio_from_ten,
       CASE WHEN p_size - 5 > 0 THEN (p_size - (p_size - 5.0)) / (p_size - 5.0) END AS change
FROM part""",
)
def guarded_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        numbers.guarded_ratio("p_retailprice", "p_size").alias("ratio"),
        numbers.guarded_ratio("p_retailprice", "p_size", at_least=10).alias("ratio_from_ten"),
        numbers.change_ratio("p_size", F.col("p_size") - 5).alias("change"),
    )


@query(
    "display_formats",
    """SELECT o_orderkey, printf('%.1f%%', round_even(o_totalprice / 1e6 * 1000, 0) / 10) AS share,
       (CASE WHEN o_totalprice - 250000 >= 0 THEN '+' ELSE '' END)
         || printf('%.1f%%', round_even((o_totalprice - 250000) / 1e6 * 1000, 0) / 10 + 0.0) AS change,
       '$' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) || '/mo' AS amount,
       printf('%.1f', round_even(o_totalprice / 1000 * 10, 0) / 10) AS thousands
FROM orders""",
)
def display_formats(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        numbers.percent(price / 1e6).alias("share"),
        numbers.percent((price - 250000) / 1e6, signed=True).alias("change"),
        numbers.dollars(price, suffix="/mo").alias("amount"),
        numbers.one_decimal(price / 1000).alias("thousands"),
    )


@query(
    "marker_radius",
    f"""WITH {EVENTS_SQL}
SELECT user_id, count(*) AS n, round(least(24.0, 6.0 + 1.2 * sqrt(count(*))), 9) AS radius FROM ev GROUP BY user_id""",
)
def marker_radius(spark: SparkSession, d: str) -> DataFrame:
    counted = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("radius", F.round(numbers.marker_radius("n"), 9))


# -- signals -----------------------------------------------------------------


@query(
    "page_signal",
    rf"""WITH v AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
    '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, md5(t) AS visible, {signal_sql("t")} AS signal
FROM v""",
)
def page_signal(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "pages").select("page_id", signals.visible_text("html").alias("t"))
    return seen.select("page_id", F.md5("t").alias("visible"), signals.page_signal("t").alias("signal"))


@query(
    "text_signal",
    rf"""WITH t AS (SELECT doc_id, 'There are currently no openings. ' || text AS empty_page,
         'Job Title ' || text || ' Apply now. Closing date: soon' AS live_page FROM documents), s AS (
SELECT doc_id, unnest([empty_page, live_page]) AS page FROM t)
SELECT doc_id, md5(page) AS page, {signal_sql("page")} AS signal
FROM s""",
)
def text_signal(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts framed as an empty and as a live board page."""
    body = F.col("text")
    pages = F.array(
        F.concat(F.lit("There are currently no openings. "), body),
        F.concat(F.lit("Job Title "), body, F.lit(" Apply now. Closing date: soon")),
    )
    framed = table(spark, d, "documents").select("doc_id", F.explode(pages).alias("page"))
    return framed.select("doc_id", F.md5("page").alias("page"), signals.page_signal("page").alias("signal"))


@query(
    "title_lines",
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(13) || chr(10)) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines,
       count(*) FILTER (WHERE line <> '' AND length(line) <= 55 AND NOT regexp_matches(line, '[.:]$')
         AND NOT regexp_matches(line, '^[0-9]+\.') AND regexp_matches(line, '[A-Za-z]') AND line NOT LIKE '*%') AS n_titles
FROM l GROUP BY doc_id""",
)
def title_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.rendered import clean_lines

    lines = table(spark, d, "documents").select("doc_id", clean_lines(F.col("text")).alias("lines"))
    return lines.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", signals.looks_like_title_line)).cast("long").alias("n_titles"),
    )


@query(
    "schema_padding",
    """SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS Latitude, CAST(NULL AS VARCHAR) AS County, 'County, Latitude' AS padded FROM supplier""",
)
def schema_padding(spark: SparkSession, d: str) -> DataFrame:
    """Absent columns are added as typed nulls, and reported."""
    from ..schemas import struct

    wanted = struct(s_suppkey="n", s_name="s", Latitude="x", County="s")
    padded, report = quality.pad_columns(table(spark, d, "supplier").select("s_suppkey", "s_name"), wanted, "supplier")
    names = report.agg(F.array_join(F.sort_array(F.collect_list("missing_column")), ", ")).scalar()
    return padded.withColumn("padded", names)


@query(
    "missing_columns",
    """SELECT 'orders' AS file, c AS missing_column, count(*) AS n_rows
FROM orders, (SELECT unnest(['District', 'Salary_Year']) AS c) GROUP BY ALL""",
)
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """What a data set lacks of what its reader needs; columns beyond that are fine."""
    orders = table(spark, d, "orders")
    needed = ["o_orderkey", "District", "o_custkey", "Salary_Year"]
    absent = quality.missing_columns(spark, "orders", orders.columns, needed)
    rows = orders.agg(F.count(F.lit(1)).alias("n_rows"))
    return absent.withColumn("n_rows", rows.scalar())
