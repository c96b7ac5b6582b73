"""Queries over the operators: identity, counts, trends, newness, joins, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import non_negative
from ..functions.rules import recode
from ..operators import asof, checks, counts, dedupe, gapfill, identity, joins, newness, ordering, quality, trends
from ..plans import k12
from ..schemas import empty, struct
from ..session import settled
from ..sinks import store
from .base import EVENTS_SQL, HE_SQL, IDENTITY_SQL, events, he_rows, k12_rows, query, scratch, table, whole_total


# -- identity and de-duplication ---------------------------------------------


@query(
    "identity_occurrence",
    f"""WITH {IDENTITY_SQL}
SELECT seq, Posting_Source, Posting_Identity_Method, Posting_ID FROM identified""",
)
def identity_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Equal rows of a snapshot are numbered; a link that names a posting needs no number."""
    named = identity.add_posting_identity(k12_rows(spark, d), "seq")
    return named.select("seq", "Posting_Source", "Posting_Identity_Method", "Posting_ID")


@query(
    "number_within",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events",
)
def number_within(spark: SparkSession, d: str) -> DataFrame:
    """Five groups hold all rows; each is numbered in slices, by many tasks once it is long."""
    rows = table(spark, d, "events").select("event_id", "event_type")
    return ordering.number_within(rows, ["event_type"], "event_id", "n").select("event_id", "n")


@query(
    "keep_first_distinct",
    """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1""",
)
def keep_first_distinct(spark: SparkSession, d: str) -> DataFrame:
    first = ordering.keep_first(
        table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), "event_id"]
    )
    return first.select("event_id", "user_id", "event_type", "value")


@query(
    "distinct_postings",
    f"""WITH {IDENTITY_SQL}
SELECT Archive_Date, Posting_ID, title, location, District, seq FROM kept""",
)
def distinct_postings(spark: SparkSession, d: str) -> DataFrame:
    return k12.identify(k12_rows(spark, d)).select("Archive_Date", "Posting_ID", "title", "location", "District", "seq")


_FEED_SQL = """feed AS (SELECT c_custkey AS seq, c_mktsegment || '!' AS title, CAST(DATE '2024-01-01' + CAST(c_custkey % 3 AS INTEGER) AS VARCHAR) AS day,
    CASE c_custkey % 4 WHEN 0 THEN 'East nation ' || c_nationkey WHEN 1 THEN 'Nation ' || c_nationkey || ' - Annex'
         WHEN 2 THEN 'Nation ' || c_nationkey || 'x' END AS place FROM customer),
direct AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment || ' ' AS title, CAST(DATE '2024-01-01' + CAST(c_custkey % 2 AS INTEGER) AS VARCHAR) AS day
    FROM customer WHERE c_mktsegment <> 'BUILDING'),
registry AS (SELECT n_nationkey AS n, 'nation ' || n_nationkey AS city FROM nation
    UNION ALL SELECT 100 + n_nationkey, 'east nation ' || n_nationkey FROM nation WHERE n_regionkey < 3)"""


@query(
    "cross_source_dedup",
    f"""WITH {_FEED_SQL}, f AS (
  SELECT seq, lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g')) AS tkey, day,
         ' ' || regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g') || ' ' AS padded FROM feed),
c AS (SELECT f.seq, f.tkey, f.day, r.n, rank() OVER (PARTITION BY f.seq ORDER BY length(r.city) DESC) AS rk
      FROM f JOIN registry r ON contains(f.padded, ' ' || r.city || ' ')),
dup AS (SELECT DISTINCT c.seq FROM c JOIN direct ON direct.n = c.n AND lower(direct.title) = c.tkey AND direct.day = c.day WHERE rk = 1)
SELECT seq, title, place FROM feed WHERE seq NOT IN (SELECT seq FROM dup)""",
)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A feed by city against boards by district; "East nation 4" is not "nation 4"."""
    customer = table(spark, d, "customer")
    key, number = F.col("c_custkey"), F.col("c_nationkey")
    feed = customer.select(
        key.alias("seq"),
        F.concat("c_mktsegment", F.lit("!")).alias("title"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (key % 3).cast("int")).alias("date_posted"),
        F.when(key % 4 == 0, F.concat(F.lit("East nation "), number))
        .when(key % 4 == 1, F.concat(F.lit("Nation "), number, F.lit(" - Annex")))
        .when(key % 4 == 2, F.concat(F.lit("Nation "), number, F.lit("x")))
        .alias("location"),
    )
    direct = customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.concat("c_mktsegment", F.lit("!!")).alias("title"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (key % 2).cast("int")).alias("date_posted"),
        number.alias("District"),
    )
    nation = table(spark, d, "nation")
    registry = nation.select(
        F.col("n_nationkey").alias("District"), F.concat(F.lit("Nation "), F.col("n_nationkey")).alias("City")
    ).unionByName(
        nation.filter("n_regionkey < 3").select(
            (F.col("n_nationkey") + 100).alias("District"), F.concat(F.lit("EAST Nation "), F.col("n_nationkey")).alias("City")
        )
    )
    return dedupe.remove_feed_duplicates(feed, direct, registry).select("seq", "title", F.col("location").alias("place"))


# -- counts ------------------------------------------------------------------


@query(
    "counts_with_total",
    f"""WITH {IDENTITY_SQL}, parts AS (
  SELECT title, Archive_Date, District, count(DISTINCT Posting_ID) AS sum FROM identified GROUP BY ALL)
SELECT title, Archive_Date, coalesce(District, 'Total') AS District, CAST(sum(sum) AS BIGINT) AS sum
FROM parts GROUP BY GROUPING SETS ((title, Archive_Date, District), (title, Archive_Date))""",
)
def counts_with_total(spark: SparkSession, d: str) -> DataFrame:
    identified = identity.add_posting_identity(k12_rows(spark, d))
    return counts.distinct_counts_with_total(identified, ["title", "Archive_Date"], "District")


@query(
    "row_counts_with_total",
    f"""WITH {HE_SQL}
SELECT Title, Archive_Date, CASE WHEN grouping(Institution) = 1 THEN 'Total' ELSE Institution END AS Institution, count(*) AS sum
FROM he GROUP BY GROUPING SETS ((Title, Archive_Date, Institution), (Title, Archive_Date))""",
)
def row_counts_with_total(spark: SparkSession, d: str) -> DataFrame:
    return counts.row_counts_with_total(he_rows(spark, d), ["Title", "Archive_Date"], "Institution")


@query(
    "weekly_totals",
    f"""WITH {IDENTITY_SQL}
SELECT District, Archive_Date, count(DISTINCT Posting_ID) AS n FROM identified GROUP BY ALL""",
)
def weekly_totals(spark: SparkSession, d: str) -> DataFrame:
    return counts.distinct_counts(identity.add_posting_identity(k12_rows(spark, d)), ["District", "Archive_Date"], out="n")


@query(
    "relabel_and_resum",
    """SELECT CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'Modest' ELSE p_type END AS p_type, p_brand,
       CAST(sum(p_size) AS BIGINT) AS p_size FROM part GROUP BY ALL""",
)
def relabel_and_resum(spark: SparkSession, d: str) -> DataFrame:
    labels = {"SMALL": "Modest", "MEDIUM": "Modest"}
    return counts.resum(
        table(spark, d, "part"), ["p_type", "p_brand"], "p_size", relabel={"p_type": recode("p_type", labels)}
    )


@query(
    "conditional_counts",
    """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_totalprice > 250000) AS large FROM orders""",
)
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.count_where(
        table(spark, d, "orders"), filled=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 250000
    )


@query(
    "summary_counts",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.summary_counts(table(spark, d, "lineitem"), "l_partkey")


@query("value_range", "SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def value_range(spark: SparkSession, d: str) -> DataFrame:
    return counts.value_range(table(spark, d, "customer"), "c_acctbal")


@query("distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return counts.distinct_values(table(spark, d, "customer"), "c_mktsegment")


@query(
    "single_value",
    "SELECT count(DISTINCT o_orderstatus) AS n_values, coalesce(min(o_orderstatus), 'none') AS value FROM orders",
)
def single_value(spark: SparkSession, d: str) -> DataFrame:
    return counts.single_value(table(spark, d, "orders"), "o_orderstatus", "none")


@query(
    "pivot_appointments",
    """SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS best_view,
       max(CASE WHEN event_type = 'purchase' THEN value END) AS best_purchase FROM events GROUP BY user_id""",
)
def pivot_appointments(spark: SparkSession, d: str) -> DataFrame:
    return counts.pivot_wide(
        table(spark, d, "events"), ["user_id"], "event_type", {"view": "best_view", "purchase": "best_purchase"}, "value"
    )


@query(
    "crosswalk_na_rules",
    """WITH x AS (SELECT r_name AS entity, n_nationkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Unmatched', -1),
c AS (SELECT c_nationkey, CASE WHEN c_acctbal >= 0 AND c_nationkey % 3 <> 1 THEN c_acctbal END AS v FROM customer)
SELECT entity, CASE WHEN count(c_nationkey) > 0 THEN round(coalesce(sum(v), 0), 2) END AS zero_if_matched,
       round(sum(v), 2) AS null_if_all_null, round(avg(v), 4) AS mean_of_present, count(c_nationkey) AS n
FROM x LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY entity""",
)
def crosswalk_na_rules(spark: SparkSession, d: str) -> DataFrame:
    """Entity sums through a crosswalk, each rule for missing values beside the other."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    crosswalk = region.join(nation, region.r_regionkey == nation.n_regionkey, "left").select(
        F.col("r_name").alias("entity"), F.col("n_nationkey").cast("int").alias("source_name")
    )
    crosswalk = crosswalk.unionByName(
        region.agg(F.lit("Unmatched").alias("entity"), F.lit(-1).alias("source_name"))
    )
    value = F.when(F.col("c_nationkey") % 3 != 1, non_negative("c_acctbal"))
    source = table(spark, d, "customer").select("c_nationkey", value.alias("v"))
    return joins.crosswalk_aggregate(
        crosswalk, source, "c_nationkey", "entity",
        zero_if_matched=counts.sum_zero_if_matched("v"),
        null_if_all_null=counts.sum_null_if_all_null("v"),
        mean_of_present=counts.mean_of_present("v"),
        n=counts.rows_matched("v"),
    ).select(
        "entity", F.round("zero_if_matched", 2).alias("zero_if_matched"), F.round("null_if_all_null", 2).alias("null_if_all_null"),
        F.round("mean_of_present", 4).alias("mean_of_present"), "n",
    )


# -- trends ------------------------------------------------------------------

_DAILY_SQL = f"""{EVENTS_SQL}, t AS (SELECT user_id AS entity, day, count(*) AS n FROM ev GROUP BY ALL)"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and snapshot date; only snapshots that really happened."""
    rows = events(spark, d).select(F.col("user_id").alias("entity"), "event_type", F.col("day").alias("Archive_Date"))
    return counts.row_counts(rows, ["entity", "Archive_Date"])


@query(
    "wow_delta",
    f"""WITH {_DAILY_SQL}, s AS (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY day),
m AS (SELECT max(day) AS latest, max(day) FILTER (WHERE day <= (SELECT max(day) FROM s) - 5) AS prior FROM s)
SELECT latest AS latest_date, prior AS prior_date, a.n AS latest_n, b.n AS prior_n, a.n - b.n AS delta
FROM m JOIN s a ON a.day = latest JOIN s b ON b.day = prior""",
)
def wow_delta(spark: SparkSession, d: str) -> DataFrame:
    return trends.week_over_week(_daily(spark, d))


@query(
    "entity_movers",
    f"""WITH {_DAILY_SQL}, m AS (SELECT max(day) AS latest, max(day) FILTER (WHERE day <= (SELECT max(day) FROM t) - 21) AS prior FROM t)
SELECT entity, CAST(sum(CASE WHEN day = prior THEN n ELSE 0 END) AS BIGINT) AS prior,
       CAST(sum(CASE WHEN day = latest THEN n ELSE 0 END) AS BIGINT) AS latest,
       CAST(sum(CASE WHEN day = latest THEN n ELSE -n END) AS BIGINT) AS delta
FROM t, m WHERE day IN (latest, prior) GROUP BY entity""",
)
def entity_movers(spark: SparkSession, d: str) -> DataFrame:
    return trends.movers(_daily(spark, d), "entity")


@query(
    "biggest_mover",
    f"""WITH {_DAILY_SQL}, m AS (SELECT max(day) AS latest, max(day) FILTER (WHERE day <= (SELECT max(day) FROM t) - 21) AS prior FROM t),
w AS (SELECT entity, CAST(sum(CASE WHEN day = prior THEN n ELSE 0 END) AS BIGINT) AS p,
       CAST(sum(CASE WHEN day = latest THEN n ELSE 0 END) AS BIGINT) AS l, any_value(prior) AS prior_date, any_value(latest) AS latest_date
FROM t, m WHERE day IN (latest, prior) GROUP BY entity)
SELECT entity, p AS prior, l AS latest, l - p AS delta, prior_date, latest_date FROM w ORDER BY abs(l - p) DESC, entity LIMIT 1""",
)
def biggest_mover(spark: SparkSession, d: str) -> DataFrame:
    return trends.biggest_mover(_daily(spark, d), "entity")


@query(
    "current_trends",
    f"""WITH {EVENTS_SQL}, t AS (SELECT event_type AS Category, day, count(*) AS n FROM ev GROUP BY ALL),
m AS (SELECT max(day) AS latest, max(day) FILTER (WHERE day <= (SELECT max(day) FROM t) - 3) AS d3,
             max(day) FILTER (WHERE day <= (SELECT max(day) FROM t) - 28) AS d28,
             max(day) FILTER (WHERE day <= (SELECT max(day) FROM t) - 90) AS d90 FROM t),
s AS (SELECT Category, list(n ORDER BY day) AS l FROM (
        SELECT *, row_number() OVER (PARTITION BY Category ORDER BY day DESC) AS r FROM t) WHERE r <= 12 GROUP BY Category),
w AS (SELECT Category, sum(n) FILTER (WHERE day = latest) AS c, coalesce(sum(n) FILTER (WHERE day = d3), 0) AS a,
             coalesce(sum(n) FILTER (WHERE day = d28), 0) AS b, any_value(d90) AS none FROM t, m GROUP BY Category)
SELECT Category, CAST(c AS BIGINT) AS current, CAST(c - a AS BIGINT) AS vs_days_ago, CAST(c - b AS BIGINT) AS vs_month_ago,
       CASE WHEN none IS NOT NULL THEN 0::BIGINT END AS vs_quarter_ago, array_to_string(l, ',') AS series
FROM w JOIN s USING (Category) WHERE c IS NOT NULL""",
)
def current_trends(spark: SparkSession, d: str) -> DataFrame:
    history = events(spark, d).select(F.col("event_type").alias("Category"), F.col("day").alias("Archive_Date"))
    by_day = counts.row_counts(history, ["Category", "Archive_Date"])
    table_ = trends.current_trends(by_day, offsets={"days": 3, "month": 28, "quarter": 90})
    return table_.withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


@query(
    "last_n_series",
    f"""WITH {_DAILY_SQL}
SELECT entity, array_to_string(list(n ORDER BY day), ',') AS series FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS r FROM t) WHERE r <= 12 GROUP BY entity""",
)
def last_n_series(spark: SparkSession, d: str) -> DataFrame:
    series = trends.last_n_series(_daily(spark, d), ["entity"])
    return series.withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


@query(
    "as_of_join",
    f"""WITH {EVENTS_SQL}, snap AS (SELECT user_id, day, round(sum(value), 2) AS total FROM ev WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, s.day AS snapshot_date, s.total FROM ev e ASOF LEFT JOIN snap s ON e.user_id = s.user_id AND e.day >= s.day""",
)
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its entity's newest snapshot on or before its day."""
    rows = events(spark, d)
    snapshots = (
        rows.filter("event_type = 'purchase'")
        .groupBy("user_id", F.col("day").alias("snapshot_date"))
        .agg(F.round(F.sum("value"), 2).alias("total"))
    )
    found = asof.as_of_join(rows, snapshots, ["user_id"], "day", "snapshot_date", ["total"])
    return found.select("event_id", "snapshot_date", "total")


@query(
    "top_k",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_custkey LIMIT 8",
)
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return trends.top_k(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 8, "c_custkey")


@query(
    "top_per_key",
    """SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def top_per_key(spark: SparkSession, d: str) -> DataFrame:
    best = ordering.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return best.select("o_custkey", "o_orderkey")


# -- newness and gaps --------------------------------------------------------


@query(
    "new_since_previous",
    f"""WITH {IDENTITY_SQL}, days AS (SELECT DISTINCT Archive_Date AS a FROM kept),
two AS (SELECT max(a) AS latest, max(a) FILTER (WHERE a < (SELECT max(a) FROM days)) AS previous FROM days)
SELECT seq, Posting_ID FROM kept, two WHERE Archive_Date = latest AND previous IS NOT NULL
  AND Posting_ID NOT IN (SELECT Posting_ID FROM kept, two WHERE Archive_Date = previous)""",
)
def new_since_previous(spark: SparkSession, d: str) -> DataFrame:
    return newness.new_since_previous(settled(k12.identify(k12_rows(spark, d)))).select("seq", "Posting_ID")


@query(
    "new_by_fields",
    f"""WITH {HE_SQL}, two AS (SELECT max(Archive_Date) AS latest,
    max(Archive_Date) FILTER (WHERE Archive_Date < (SELECT max(Archive_Date) FROM he)) AS previous FROM he),
old AS (SELECT DISTINCT Title, Location, Institution FROM he, two WHERE Archive_Date = previous)
SELECT n.Link, n.Title, n.Location FROM he n, two WHERE Archive_Date = latest AND NOT EXISTS (
  SELECT 1 FROM old WHERE old.Title IS NOT DISTINCT FROM n.Title AND old.Location IS NOT DISTINCT FROM n.Location
    AND old.Institution IS NOT DISTINCT FROM n.Institution)""",
)
def new_by_fields(spark: SparkSession, d: str) -> DataFrame:
    """No identity: three fields decide, and a missing location equals a missing one."""
    return newness.new_since_previous(he_rows(spark, d), ["Title", "Location", "Institution"]).select(
        "Link", "Title", "Location"
    )


@query(
    "gap_fill",
    f"""WITH {EVENTS_SQL}, t AS (SELECT user_id, day, event_type, count(*) AS n FROM ev GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM t), a AS (SELECT DISTINCT day FROM t), b AS (SELECT DISTINCT event_type FROM t)
SELECT user_id, day, event_type, coalesce(n, 0) AS n FROM u CROSS JOIN a CROSS JOIN b LEFT JOIN t USING (user_id, day, event_type)""",
)
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    keys = ["user_id", "day", "event_type"]
    return gapfill.gap_fill(counts.row_counts(events(spark, d), keys), keys, {"n": 0})


@query(
    "gap_fill_listed",
    f"""WITH {HE_SQL}, t AS (SELECT Institution, CASE WHEN Location IS NULL THEN 'none' ELSE Location END AS place, count(*) AS n FROM he GROUP BY ALL)
SELECT i.Institution, p.place, coalesce(n, 0) AS n FROM (SELECT DISTINCT Institution FROM t) i,
  (SELECT unnest(['Campus 1', 'Campus 2', 'none', 'Elsewhere']) AS place) p LEFT JOIN t ON t.Institution = i.Institution AND t.place = p.place""",
)
def gap_fill_listed(spark: SparkSession, d: str) -> DataFrame:
    """One key's values are given and not read off the data."""
    rows = he_rows(spark, d).withColumn("place", F.coalesce("Location", F.lit("none")))
    wanted = {"place": ["Campus 1", "Campus 2", "none", "Elsewhere"]}
    return gapfill.gap_fill(counts.row_counts(rows, ["Institution", "place"]), ["Institution", "place"], {"n": 0}, wanted)


# -- joins -------------------------------------------------------------------


@query(
    "null_safe_join",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS n FROM customer),
s AS (SELECT CASE WHEN s_nationkey % 4 <> 0 THEN s_nationkey END AS n, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT c_custkey, c.n, suppliers FROM c LEFT JOIN s ON c.n IS NOT DISTINCT FROM s.n""",
)
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.when(F.col(c) % 4 != 0, F.col(c)).alias("n")
    customers = table(spark, d, "customer").select("c_custkey", some("c_nationkey"))
    suppliers = table(spark, d, "supplier").select(some("s_nationkey")).groupBy("n").agg(F.count(F.lit(1)).alias("suppliers"))
    return joins.left_join_null_safe(customers, suppliers, ["n"])


@query(
    "onto_registry",
    """SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 2 THEN n_regionkey * 10 END AS score FROM nation""",
)
def onto_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry's columns win; entities it lacks disappear, new ones get nulls."""
    nation = table(spark, d, "nation")
    previous = nation.filter("n_regionkey <> 2").select(
        "n_nationkey", F.lit("stale").alias("n_name"), (F.col("n_regionkey") * 10).alias("score")
    )
    gone = previous.withColumn("n_nationkey", F.col("n_nationkey") + 1000)
    return joins.onto_registry(nation.select("n_nationkey", "n_name"), previous.unionByName(gone), "n_nationkey")


@query(
    "refresh_keep_last_good",
    """WITH f AS (SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance, count(*) AS n FROM supplier WHERE s_acctbal >= 0 GROUP BY 1)
SELECT c_custkey, c_name, balance, n, 'supplier book' AS source FROM customer LEFT JOIN f ON s_nationkey = c_nationkey""",
)
def refresh_keep_last_good(spark: SparkSession, d: str) -> DataFrame:
    """A landed group replaces the old columns; an empty one leaves them."""
    base = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("key"), F.lit(-1.0).alias("balance"))
    suppliers = table(spark, d, "supplier").filter("s_acctbal >= 0").groupBy(F.col("s_nationkey").alias("key")).agg(
        F.round(F.sum("s_acctbal"), 2).alias("balance"), F.count(F.lit(1)).alias("n")
    )
    fresh = joins.refresh_columns(base, suppliers, "key", ["balance", "n"], ("source", "supplier book"))
    kept = joins.refresh_columns(fresh, suppliers.filter(F.lit(False)), "key", ["balance", "n"], ("source", "lost"))
    return kept.drop("key")


@query(
    "vintage_change",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS t FROM orders GROUP BY ALL)
SELECT a.o_custkey, round((a.t - b.t) / b.t, 6) AS change FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.y = 2000 AND b.y = 1995""",
)
def vintage_change(spark: SparkSession, d: str) -> DataFrame:
    yearly = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("t"))
    changed = joins.change_between(yearly.filter("y = 2000"), yearly.filter("y = 1995"), "o_custkey", "t", "change")
    return changed.withColumn("change", F.round("change", 6))


@query(
    "canonical_names",
    """SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN 'Land ' || c_nationkey ELSE 'NATION_' || c_nationkey END AS place
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    aliases = table(spark, d, "nation").filter("n_regionkey < 3").select(
        F.col("n_name").alias("alias"), F.concat(F.lit("Land "), F.col("n_nationkey")).alias("canonical")
    )
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("place"))
    return joins.canonical_name(rows, "place", aliases)


@query(
    "pivot_years_ago",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY ALL),
m AS (SELECT max(y) AS latest FROM y)
SELECT o_custkey, max(t) FILTER (WHERE latest - y = 1) AS Spend_Y1Ago, max(t) FILTER (WHERE latest - y = 2) AS Spend_Y2Ago
FROM y, m WHERE y < latest GROUP BY o_custkey""",
)
def pivot_years_ago(spark: SparkSession, d: str) -> DataFrame:
    yearly = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("t")
    )
    return joins.years_ago_columns(yearly, "o_custkey", "y", "t", "Spend")


# -- quality -----------------------------------------------------------------


@query(
    "total_mismatches",
    f"""WITH {HE_SQL}, p AS (SELECT Title, Archive_Date, count(*) AS n FROM he GROUP BY ALL),
t AS (SELECT Title, Archive_Date, n + CASE WHEN day(Archive_Date) = 7 THEN 1 ELSE 0 END AS n FROM p WHERE day(Archive_Date) <> 9)
SELECT coalesce(t.Title, p.Title) AS Title, coalesce(t.Archive_Date, p.Archive_Date) AS Archive_Date, t.n AS total_value, p.n AS parts_sum
FROM t FULL JOIN p ON t.Title = p.Title AND t.Archive_Date = p.Archive_Date WHERE t.n IS DISTINCT FROM p.n""",
)
def total_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Totals made wrong on one day and dropped on another are the rows found."""
    keys = ["Title", "Archive_Date"]
    parts = counts.row_counts(he_rows(spark, d), [*keys, "Institution"], "sum")
    day = F.dayofmonth("Archive_Date")
    totals = counts.resum(parts, keys).filter(day != 9).withColumn("sum", F.col("sum") + F.when(day == 7, 1).otherwise(0))
    return quality.total_mismatches(totals, parts, keys)


@query(
    "drift_flags",
    f"""WITH {_DAILY_SQL}, m AS (SELECT max(day) AS latest FROM t),
b AS (SELECT entity, count(*) AS n_weeks, avg(n) AS mean_count FROM t, m WHERE day < latest GROUP BY entity),
c AS (SELECT entity, n FROM t, m WHERE day = latest)
SELECT CAST(b.entity AS VARCHAR) AS name, round(mean_count, 6) AS mean_count, n_weeks, coalesce(n, 0) AS count
FROM b LEFT JOIN c USING (entity) WHERE n_weeks >= 2 AND coalesce(n, 0) <= mean_count * 0.2""",
)
def drift_flags(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.health import source_drift

    snapshots = events(spark, d).select(F.col("user_id").cast("string").alias("source"), F.col("day").alias("Archive_Date"))
    flagged = source_drift(snapshots, "source", valid_from=None)
    return flagged.withColumn("mean_count", F.round("mean_count", 6))


@query(
    "historical_counts",
    f"""WITH {_DAILY_SQL}
SELECT entity AS name, count(*) AS n_weeks, round(avg(n), 6) AS mean_count FROM t WHERE day >= DATE '2024-01-11' GROUP BY entity""",
)
def historical_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumnRenamed("day", "Archive_Date")
    past = quality.historical_counts(rows, "user_id", valid_from=dt.date(2024, 1, 11))
    return past.withColumn("mean_count", F.round("mean_count", 6))


@query(
    "coverage_gaps",
    """SELECT 'cleaned' AS name, CAST((SELECT count(*) FROM customer) AS INTEGER) AS expected,
       count(*) FILTER (WHERE c_acctbal >= 0) AS actual FROM customer HAVING count(*) FILTER (WHERE c_acctbal >= 0) < count(*)""",
)
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    cleaned = customer.select(non_negative("c_acctbal").alias("cleaned"), "c_name")
    return quality.coverage_gaps(cleaned, ["cleaned", "c_name"], customer.count())


@query(
    "value_bounds",
    """SELECT 'balance' AS name, s_name AS entity, s_acctbal AS value, 0.0::DOUBLE AS min_ok, 9000.0::DOUBLE AS max_ok
FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000""",
)
def value_bounds(spark: SparkSession, d: str) -> DataFrame:
    return quality.out_of_bounds(table(spark, d, "supplier"), "s_name", "s_acctbal", 0.0, 9000.0, "balance")


_CHANGE_SQL = """y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(round(sum(o_totalprice)) AS DOUBLE) AS t FROM orders GROUP BY ALL),
p AS (SELECT a.o_custkey AS name, b.t AS prior, a.t AS current, (a.t - b.t) / b.t AS c
      FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.y = 2000 AND b.y = 1999 WHERE b.t <> 0)"""


def _yearly(spark: SparkSession, d: str, year: int) -> DataFrame:
    spent = table(spark, d, "orders").filter(F.year("o_orderdate") == year).groupBy(F.col("o_custkey").alias("name"))
    return spent.agg(whole_total("o_totalprice").alias("value"))


@query(
    "robust_spread",
    f"""WITH {_CHANGE_SQL}, m AS (SELECT median(c) AS center FROM p)
SELECT round(any_value(center), 9) AS center, round(1.4826 * median(abs(c - center)), 9) AS spread FROM p, m""",
)
def robust_spread(spark: SparkSession, d: str) -> DataFrame:
    now, before = _yearly(spark, d, 2000), _yearly(spark, d, 1999).withColumnRenamed("value", "prior")
    changes = now.join(before, "name").select(((F.col("value") - F.col("prior")) / F.col("prior")).alias("c"))
    center, spread = quality.robust_spread(changes, "c")
    rounded = [None if x is None else round(x, 9) for x in (center, spread)]
    return spark.range(1).select(*[F.lit(x).cast("double").alias(name) for x, name in zip(rounded, ("center", "spread"))])


@query(
    "mad_outlier",
    f"""WITH {_CHANGE_SQL}, m AS (SELECT median(c) AS center FROM p), s AS (SELECT 1.4826 * median(abs(c - center)) AS spread FROM p, m)
SELECT name, prior, current, round(c, 6) AS pct_change FROM p, m, s
WHERE (SELECT count(*) FROM p) >= 3 AND abs(c) > 0.25 AND (spread = 0 OR abs(c - center) > 3 * spread)""",
)
def mad_outlier(spark: SparkSession, d: str) -> DataFrame:
    found = quality.change_outliers(_yearly(spark, d, 2000), _yearly(spark, d, 1999), mads=3.0)
    return found.withColumn("pct_change", F.round("pct_change", 6))


@query(
    "exact_median",
    "SELECT median(l_extendedprice) AS median FROM lineitem",
)
def exact_median(spark: SparkSession, d: str) -> DataFrame:
    lineitem = table(spark, d, "lineitem")
    return spark.range(1).select(F.lit(ordering.exact_median(lineitem, "l_extendedprice")).cast("double").alias("median"))


@query(
    "halving_guard",
    f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, count(*) AS n FROM ev WHERE day < DATE '2024-01-21' GROUP BY 1),
b AS (SELECT user_id, count(*) AS n FROM ev WHERE day >= DATE '2024-01-21' GROUP BY 1)
SELECT a.user_id, a.n AS before_n, coalesce(b.n, 0) AS after_n FROM a LEFT JOIN b USING (user_id) WHERE coalesce(b.n, 0) < a.n * 0.5""",
)
def halving_guard(spark: SparkSession, d: str) -> DataFrame:
    """The last third of the days against the first two: some entities lose more than half, others do not."""
    rows, cut = events(spark, d), F.lit(dt.date(2024, 1, 21))
    before = counts.row_counts(rows.filter(F.col("day") < cut), ["user_id"])
    after = counts.row_counts(rows.filter(F.col("day") >= cut), ["user_id"])
    return quality.halved(before, after, "user_id")


@query(
    "crosswalk_gaps",
    """WITH m AS (SELECT DISTINCT l_suppkey * 3 AS e FROM lineitem), k AS (SELECT DISTINCT c_custkey AS e FROM customer WHERE c_nationkey <> 7)
SELECT e AS entity, 'not registered' AS problem FROM m WHERE e NOT IN (SELECT e FROM k)
UNION ALL SELECT e, 'not mapped' FROM k WHERE e NOT IN (SELECT e FROM m)""",
)
def crosswalk_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier is mapped to one customer; those of one nation are not registered, and most customers are not mapped."""
    mapped = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("entity"))
    registry = table(spark, d, "customer").filter("c_nationkey <> 7")
    return quality.crosswalk_gaps(mapped, registry, "entity", "c_custkey")


@query(
    "observed_checks",
    """SELECT 'coverage' AS "check", 'p_odd' AS name, count(*) FILTER (p_partkey % 2 = 1) AS actual, count(*) AS rows FROM part
UNION ALL SELECT 'bounds', 'p_size', count(*) FILTER (p_size < 5 OR p_size > 40), count(*) FROM part
UNION ALL SELECT 'encoding', 'p_text', count(*) FILTER (p_partkey % 5 = 0), count(*) FROM part""",
)
def observed_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks counted while the rows are written, so that the table is read once."""
    parts = table(spark, d, "part").select(
        "p_size", F.when(F.col("p_partkey") % 2 == 1, 1).alias("p_odd"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("\ufffd"))).otherwise(F.col("p_name")).alias("p_text"),
    )
    asked = [checks.coverage(["p_odd", "p_text"]), checks.bounds("p_size", 5, 40), checks.encoding("p_text")]
    watched, seen = checks.observed(parts, asked)
    written = scratch(spark, "observed")
    watched.write.parquet(written)
    found = [(f.check, f.name, f.actual) for f in checks.failures(asked, seen.get)]
    rows = spark.read.parquet(written).agg(F.count(F.lit(1)).alias("rows")).scalar()
    return spark.createDataFrame(found, "check string, name string, actual long").withColumn("rows", rows)


@query("typed_empty", "SELECT o_orderkey AS Posting_rank, o_orderpriority AS title, CAST(NULL AS VARCHAR) AS url FROM orders WHERE o_orderstatus = 'P'")
def typed_empty(spark: SparkSession, d: str) -> DataFrame:
    """A source without rows has its columns and types, so that it unites with the others."""
    schema = struct(Posting_rank="n", title="s", url="s")
    found = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("Posting_rank"), F.col("o_orderpriority").alias("title"))
    return empty(spark, schema).unionByName(found, allowMissingColumns=True)


# -- history -----------------------------------------------------------------


@query(
    "append_replaces_date",
    f"""WITH {EVENTS_SQL}, old AS (SELECT user_id, day, count(*) AS n FROM ev GROUP BY ALL),
new AS (SELECT user_id, day, n * 10 AS n FROM old WHERE day = DATE '2024-01-20')
SELECT user_id, day AS Archive_Date, n FROM old WHERE day <> DATE '2024-01-20' UNION ALL SELECT user_id, day, n FROM new""",
)
def append_replaces_date(spark: SparkSession, d: str) -> DataFrame:
    """A date delivered again replaces its rows, and only those."""
    history = counts.row_counts(events(spark, d).withColumnRenamed("day", "Archive_Date"), ["user_id", "Archive_Date"])
    again = history.filter(F.col("Archive_Date") == F.lit(dt.date(2024, 1, 20))).withColumn("n", F.col("n") * 10)
    return store.replaced(history, again)


@query(
    "missing_year_rows",
    """SELECT DISTINCT 'C' || o_custkey AS District, CAST(year(o_orderdate) AS VARCHAR) AS Salary_Year FROM orders a
WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND year(b.o_orderdate) = year(a.o_orderdate) AND b.o_orderstatus = 'F')""",
)
def missing_year_rows(spark: SparkSession, d: str) -> DataFrame:
    """Partly archived years are completed; what is there is not added twice."""
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("District"), F.year("o_orderdate").cast("string").alias("Salary_Year"), "o_orderstatus"
    )
    return store.missing_year_rows(rows.filter("o_orderstatus = 'F'"), rows.drop("o_orderstatus"))


@query(
    "append_refusals",
    """SELECT 'retyped' AS attempt, 'QualityError' AS outcome, count(DISTINCT ts::DATE) AS dates FROM events
UNION ALL SELECT 'renamed', 'QualityError', count(DISTINCT ts::DATE) FROM events
UNION ALL SELECT 'two dates', 'QualityError', count(DISTINCT ts::DATE) FROM events""",
)
def append_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Appends with another column, type or a second date are refused, and the table stays as it was."""
    path = scratch(spark, "refusals")
    history = counts.row_counts(events(spark, d).withColumnRenamed("day", "Archive_Date"), ["user_id", "Archive_Date"])
    store.replace_dates(history, path)
    day = history.filter(F.col("Archive_Date") == history.agg(F.max("Archive_Date")).scalar())
    attempts = {
        "retyped": day.withColumn("n", F.col("n").cast("string")),
        "renamed": day.withColumnRenamed("n", "m"),
        "two dates": history,
    }
    outcomes = []
    for name, frame in attempts.items():
        try:
            store.append_by_date(frame, path)
            outcomes.append((name, "written"))
        except quality.QualityError as refused:
            outcomes.append((name, type(refused).__name__))
    kept = store.read_history(spark, path).agg(F.countDistinct("Archive_Date").alias("dates"))
    return spark.createDataFrame(outcomes, "attempt string, outcome string").withColumn("dates", kept.scalar())
