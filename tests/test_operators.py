import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest
from .conftest import values
from pyspark.sql import functions as F

from jobtide.operators import asof, counts, dedupe, gapfill, identity, joins, newness, ordering, quality, trends
from jobtide.plans import k12

D = dt.date
DIRECT = "SchoolSpring (direct district board)"


def postings(spark, rows, extra=""):
    schema = "title string, location string, date_posted string, url string, District string, Posting_Source string, seq long" + extra
    return spark.createDataFrame(rows, schema)


# -- identity ----------------------------------------------------------------


def test_one_identity_per_posting_address(spark):
    links = ["https://board.example/careers?id=ab", "https://board.example/careers?id=AB", "https://board.example/notice.pdf", "https://board.example/careers?id=zz"]
    rows = [("Librarian", "North wing", "2025-02-03", link, "Lakeside", DIRECT, i) for i, link in enumerate(links)]
    out = [r.Posting_ID for r in identity.add_posting_identity(postings(spark, rows)).orderBy("seq").collect()]
    assert out[0] == out[1] == "url:https://board.example/careers?id=ab" and len(set(out)) == 3


def test_rows_without_an_address_of_their_own_are_counted(spark):
    feed = "https://apps.opi.mt.gov/mtjobsforteachers/search?page=2"
    rows = [("Groundskeeper", place, "2025-02-03", feed, place, identity.STATEWIDE_SOURCE, i) for i, place in enumerate(["Ash", "Elm", "Ash", "Ash"])]
    out = identity.add_posting_identity(postings(spark, rows)).orderBy("seq").collect()
    assert [r.Posting_ID.rsplit("#")[1] for r in out] == ["1", "1", "2", "3"]
    assert len({r.Posting_ID for r in out}) == 4 and {r.Posting_Identity_Method for r in out} == {identity.METHOD_STATEWIDE}


def test_missing_parts_are_spelled_out(spark):
    out = identity.add_posting_identity(postings(spark, [("T", None, None, None, "D", "", 1)])).first()
    assert out.Posting_Source == identity.DIRECT_SOURCE
    assert out.Posting_ID == "fallback:" + "\x1f".join(["source-fallback", "direct district board", "d", "t", "NA", "NA"]) + "#1"


def test_source_follows_from_the_link_when_not_given(spark):
    rows = [("T", "L", "2026-01-01", "https://apps.opi.mt.gov/mtjobsforteachers/x", "D", "", 1), ("T", "L", "2026-01-01", "x", "D", "", 2)]
    out = identity.add_posting_identity(postings(spark, rows).drop("Posting_Source")).orderBy("seq").collect()
    assert [r.Posting_Source for r in out] == [identity.STATEWIDE_SOURCE, identity.DIRECT_SOURCE]


def test_numbering_restarts_per_snapshot_and_needs_its_columns(spark):
    rows = [("T", "L", "x", "u", "D", "S", i, D(2026, 8, 6 + i % 2)) for i in range(4)]
    out = identity.add_posting_identity(postings(spark, rows, ", Archive_Date date"))
    assert Counter(r.Posting_ID[-2:] for r in out.collect()) == {"#1": 2, "#2": 2}
    with pytest.raises(ValueError, match="District"):
        identity.add_posting_identity(out.drop("District"))


def test_first_row_speaks_for_an_identity(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("b", 2, "only")], "Posting_ID string, seq long, title string")
    assert values(identity.distinct_postings(df, ["Posting_ID"])) == [("a", 1, "early"), ("b", 2, "only")]


def test_numbered_identities_are_not_compared_again(spark):
    shared = "https://board.example/careers?id=ab"
    rows = [("Cook", "Ash", "2025-02-03", link, "Lakeside", DIRECT, i) for i, link in enumerate([shared, None, shared, None, "https://a.example"])]
    df = postings(spark, rows).withColumn("Archive_Date", F.lit(D(2025, 2, 4)))
    got = identity.add_distinct_identity(df)
    plain = identity.distinct_postings(identity.add_posting_identity(df))
    names = ["Posting_ID", "seq", "Posting_Identity_Method"]
    assert values(got, *names) == values(plain, *names) and got.count() == 4
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_marking_postings_makes_no_method_that_stays_interpreted(spark, monkeypatch):
    """HotSpot compiles no method of more than 8,000 bytes."""
    rows = [(f"Cook {i}", "Ash", "2025-02-03", "https://a.example", "Lakeside", DIRECT, i) for i in range(9)]
    df = postings(spark, rows).withColumns({"position": F.lit("x"), "Archive_Date": F.lit(D(2025, 2, 4))}).localCheckpoint()
    marked = []
    monkeypatch.setattr(identity, "settled", lambda frame: marked.append(frame) or frame)
    k12.identify(df)
    stages = marked[0]._jdf.queryExecution().debug().codegenToSeq()
    assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(stages.size()))


# -- hot keys, against brute force -------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, the rest spread."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.34 else f"k{rng.randrange(400)}", s, rng.randrange(50)) for s in rng.sample(range(100_000), 6000)]
    return rows, spark.createDataFrame(rows, "k string, seq long, v long")


def counted(spark, df):
    """The frame, and a counter of the rows that were evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def look(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    return df.mapInPandas(look, df.schema), seen


@pytest.mark.parametrize("hot_rows", [50, ordering.HOT_ROWS])
@pytest.mark.parametrize("order", ["seq", "place"])
def test_number_within_equals_brute_force(spark, skewed, order, hot_rows):
    """Also by a struct, with a third of the rows under one key and every page a range of its own."""
    rows, df = skewed
    df = df.withColumn("place", F.struct(F.expr("seq div 3").alias("page"), F.expr("seq % 3").alias("item")))
    wanted, seen = {}, Counter()
    for k, s, _ in sorted(rows, key=lambda r: r[1]):
        seen[k] += 1
        wanted[k, s] = seen[k]
    once, evaluated = counted(spark, df.repartition(20))
    got = {(r.k, r.seq): r.n for r in ordering.number_within(once, ["k"], order, "n", hot_rows).collect()}
    assert got == wanted and evaluated.value == len(rows)


def test_keep_first_and_top_per_key_equal_brute_force(spark, skewed):
    rows, df = skewed
    groups = defaultdict(list)
    for k, s, v in rows:
        groups[k].append((-v, s))
    wanted = {(k, s) for k, g in groups.items() for _, s in sorted(g)[:3]}
    top = ordering.top_per_key(df, ["k"], [F.desc("v"), "seq"], 3)
    assert {(r.k, r.seq) for r in top.collect()} == wanted
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert ", Partial" in plan and "WindowGroupLimit" in plan, "groups must be pruned before the shuffle"


def test_numbering_missing_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, seq long")
    for hot_rows in (1, 2, 9):
        assert values(ordering.number_within(df, ["k"], "seq", "n", hot_rows), "seq", "n") == [(1, 1), (2, 2), (5, 1)]


def test_identity_evaluates_its_input_once_and_moves_no_stable_rows(spark):
    """Every third row has one title; every other one has a link of its own and counts among its equals."""
    rows = [(f"T{i % 3}", "L", D(2026, 1, 1), f"https://x.example/jobs/{i}" if i % 2 else None, "D", i) for i in range(90)]
    once, evaluated = counted(spark, spark.createDataFrame(rows, "title string, location string, date_posted date, url string, District string, seq long"))
    got = identity.add_posting_identity(once)
    numbers = {r.seq: int(r.Posting_ID.split("#")[1]) for r in got.filter("Posting_ID like 'fallback:%'").collect()}
    assert numbers == {i: i // 3 + 1 for i in range(0, 90, 2)} and evaluated.value == 90
    by_link = got.filter("Posting_Identity_Method like 'Stable%'")
    assert by_link.count() == 45 and "Exchange" not in by_link._jdf.queryExecution().executedPlan().toString().split("Union")[-1].split("Window")[0]


@pytest.mark.parametrize("extreme", [[], [float("inf")] * 3, [-1.7e308, 1.7e308], [5e-324, 1e-323]])
def test_exact_median_of_extreme_values(spark, extreme):
    data = extreme + [1.0, 2.0, float("-inf")]
    s, n = sorted(data), len(data)
    df = spark.createDataFrame([(x,) for x in [*data, float("nan"), None]], "x double")
    assert ordering.exact_median(df, "x") == (s[(n - 1) // 2] + s[n // 2]) / 2


@pytest.mark.parametrize(("n", "ranges"), [(0, 10), (1, 10), (2, 10), (1000, 10), (1001, 3), (1001, 1024)])
def test_exact_median(spark, n, ranges):
    rng = random.Random(n)
    data = [float(rng.choice([7, rng.randrange(1000)])) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double")
    once, evaluated = counted(spark, df)
    got = ordering.exact_median(once, "x", ranges)
    assert evaluated.value <= 2 * (n + 1)
    if not data:
        assert got is None
    else:
        s = sorted(data)
        assert got == (s[(n - 1) // 2] + s[n // 2]) / 2


@pytest.mark.parametrize("n", [40_000, 40_001])
def test_robust_spread_reads_its_input_four_times(spark, n):
    """Many ties, a wide range, equal and missing values and NaN."""
    rng = random.Random(n)
    data = [rng.choice([3.0, 3.0, rng.gauss(0, 10), rng.expovariate(0.001)]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in [*data, None, float("nan")]], "x double")
    once, evaluated = counted(spark, df)
    center, spread = quality.robust_spread(once, "x")
    assert evaluated.value == 4 * (n + 2)
    assert center == statistics.median(data) and spread == 1.4826 * statistics.median([abs(x - center) for x in data])


def test_an_unlucky_bracket_is_opened(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SKETCH", 10**9)  # an error the sketch cannot keep to
    data = [float(x % 977) for x in range(5000)]
    assert ordering.exact_median(spark.createDataFrame([(x,) for x in data], "x double"), "x") == statistics.median(data)


# -- cross-source duplicates -------------------------------------------------


def _kept(spark, feed, direct, registry):
    f = spark.createDataFrame(feed, "title string, date_posted date, location string")
    d = spark.createDataFrame(direct, "title string, date_posted date, District string")
    g = spark.createDataFrame(registry, "District string, City string")
    return values(dedupe.remove_feed_duplicates(f, d, g), "location", "title")


TOWNS = [("Ridge Unified", "Ridge"), ("Mill Unified", "Mill Creek"), ("Creek Unified", "Creek")]
MAY = D(2025, 5, 9)


def test_the_longest_town_decides_and_incomplete_rows_stay(spark):
    direct = [("Nurse", MAY, "Creek Unified")]
    feed = [("Nurse", MAY, "Mill Creek"), ("Nurse", MAY, "Creek"), ("Nurse", MAY, "Creekside"), ("Nurse", None, "Creek"), (None, MAY, "Creek "), ("Nurse", MAY, None)]
    assert _kept(spark, feed, direct, TOWNS) == [("Creek", "Nurse"), ("Creek ", None), ("Creekside", "Nurse"), ("Mill Creek", "Nurse"), (None, "Nurse")]


def test_districts_of_one_town_all_count_and_no_direct_rows_change_nothing(spark):
    registry = [("Upper", "Harbor"), ("Lower", "Harbor"), ("Blank", " ")]
    feed = [("Nurse", MAY, "Harbor"), ("Nurse", MAY, "Harbor")]
    assert _kept(spark, feed, [("Nurse", MAY, "Lower")], registry) == []
    assert _kept(spark, feed, [], registry) == [("Harbor", "Nurse")] * 2


def test_dedupe_names_missing_columns(spark):
    df = spark.createDataFrame([(1, "t")], "seq long, title string")
    with pytest.raises(ValueError, match="date_posted"):
        dedupe.remove_feed_duplicates(df, df, df)


# -- counts ------------------------------------------------------------------


def test_total_is_the_sum_of_distinct_counts_per_entity(spark):
    df = spark.createDataFrame([("c", "A", "1"), ("c", "A", "1"), ("c", "A", "2"), ("c", "B", "1")], "cat string, e string, Posting_ID string")
    got = values(counts.distinct_counts_with_total(df, ["cat"], "e"))
    assert got == [("c", "A", 2), ("c", "B", 1), ("c", "Total", 3)]
    assert values(counts.without_total_rows(counts.distinct_counts_with_total(df, ["cat"], "e"), "e"), "sum") == [(1,), (2,)]


def test_a_missing_entity_is_not_the_total(spark):
    df = spark.createDataFrame([("c", None), ("c", "A")], "cat string, e string")
    assert values(counts.row_counts_with_total(df, ["cat"], "e")) == [("c", "A", 1), ("c", "Total", 2), ("c", None, 1)]


def test_the_four_rules_for_missing_values(spark):
    walk = joins.crosswalk_table(spark, {"all null": ["n1"], "unmatched": ["zz"], "some": ["n2", "n3"], "neg": ["n4"]})
    source = spark.createDataFrame([("n1", None), ("n2", 3.0), ("n3", None), ("n3", 5.0), ("n4", -1.0)], "name string, v double")
    got = joins.crosswalk_aggregate(
        walk, source, "name", "e", zero=counts.sum_zero_if_matched("v"),
        null=counts.sum_null_if_all_null("v"), mean=counts.mean_of_present("v"), n=counts.rows_matched("v"),
    )
    assert values(got, "e", "zero", "null", "mean", "n") == [
        ("all null", 0.0, None, None, 1), ("neg", -1.0, -1.0, -1.0, 1), ("some", 8.0, 8.0, 4.0, 3), ("unmatched", None, None, None, 0),
    ]


def test_small_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0)], "k string, v double")
    assert counts.value_range(df, "v").first() == (1.0, 3.0)
    assert counts.value_range(df.filter("v is null"), "v").first() == (0.0, 1.0)
    assert counts.single_value(df, "k", "none").first() == (2, "a")
    assert counts.single_value(df.filter("false"), "k", "none").first() == (0, "none")
    assert counts.summary_counts(df, "k", 1).collect()[0] == ("a", 2)
    assert counts.count_where(df, big=F.col("v") > 2).first() == (1,)
    assert [r.k for r in counts.distinct_values(df, "k").collect()] == ["a", "b"]
    wide = counts.pivot_wide(df, [], "k", {"a": "A", "z": "Z"}, "v").first()
    assert (wide.A, wide.Z) == (3.0, None)


# -- dates and trends --------------------------------------------------------


def totals(spark, rows):
    return spark.createDataFrame(rows, "entity string, Archive_Date date, n long")


def test_week_over_week_skips_a_rerun(spark):
    df = totals(spark, [("a", D(2026, 7, 30), 100), ("a", D(2026, 8, 5), 108), ("a", D(2026, 8, 6), 111)])
    row = trends.week_over_week(df).first()
    assert (row.delta, row.prior_date) == (11, D(2026, 7, 30))
    young = trends.week_over_week(df.filter("Archive_Date > '2026-08-01'")).first()
    assert young.delta is None and young.prior_date is None


def test_golden_week_over_week(spark):
    k12 = [("a", D(2026, 8, 6), 840), ("a", D(2026, 8, 7), 941), ("a", D(2026, 8, 11), 1235), ("a", D(2026, 8, 18), 1215)]
    he = [("a", D(2026, 8, 6), 257), ("a", D(2026, 8, 7), 263), ("a", D(2026, 8, 11), 372), ("a", D(2026, 8, 18), 364)]
    assert trends.week_over_week(totals(spark, k12)).first().delta == -20
    assert trends.week_over_week(totals(spark, he)).first().delta == -8
    assert trends.biggest_mover(totals(spark, k12), "entity").count() == 0


def test_biggest_mover_counts_absence_as_zero(spark):
    old, new = D(2026, 7, 1), D(2026, 8, 1)
    df = totals(spark, [("gone", old, 9), ("grew", old, 1), ("grew", new, 8), ("same", old, 5), ("same", new, 5), ("new", new, 9)])
    row = trends.biggest_mover(df, "entity").first()
    assert (row.entity, row.prior, row.latest, row.delta, row.prior_date, row.latest_date) == ("gone", 9, 0, -9, old, new)


def test_current_trends(spark):
    df = spark.createDataFrame(
        [("x", D(2026, 7, 1), 4), ("x", D(2026, 8, 1), 7), ("y", D(2026, 8, 1), 2), ("old", D(2026, 7, 1), 3)],
        "Category string, Archive_Date date, n long",
    )
    rows = {r.Category: r for r in trends.current_trends(df).collect()}
    assert set(rows) == {"x", "y"}
    assert (rows["x"].current, rows["x"].vs_month_ago, rows["x"].vs_year_ago, rows["x"].series) == (7, 3, None, [4, 7])
    assert rows["y"].vs_month_ago == 2


def test_last_n_series(spark):
    df = totals(spark, [("a", D(2026, 1, d), d) for d in range(1, 21)])
    assert trends.last_n_series(df, ["entity"]).first().series == list(range(9, 21))


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "a", D(2026, 1, 5)), (2, "a", D(2025, 1, 1)), (3, "b", D(2026, 1, 1))], "id int, k string, d date")
    right = spark.createDataFrame([("a", D(2026, 1, 1), 10), ("a", D(2026, 1, 5), 20), ("a", D(2026, 2, 1), 30)], "k string, s date, v int")
    got = asof.as_of_join(left, right, ["k"], "d", "s", ["v"])
    assert values(got, "id", "s", "v") == [(1, D(2026, 1, 5), 20), (2, None, None), (3, None, None)]


@pytest.mark.parametrize("hot_rows", [20, ordering.HOT_ROWS])
def test_as_of_join_equals_brute_force(spark, hot_rows):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot", "hot", f"k{rng.randrange(30)}", None])
    day = lambda: rng.choice([None] + [D(2026, 1, 1) + dt.timedelta(rng.randrange(90)) for _ in range(20)])
    left = [(i, key(), day()) for i in range(1500)]
    right = [(key(), day(), rng.randrange(100)) for _ in range(900)]
    best = {}
    for k, d, v in right:
        if k is not None and d is not None:
            best[k, d] = max(best.get((k, d), 0), v)
    wanted = []
    for i, k, d in left:
        held = [x for kk, x in best if kk == k and d is not None and x <= d]
        wanted.append((i, max(held, default=None), best[k, max(held)] if held else None))
    a, seen_a = counted(spark, spark.createDataFrame(left, "id int, k string, d date"))
    b, seen_b = counted(spark, spark.createDataFrame(right, "k string, s date, v int"))
    got = asof.as_of_join(a, b, ["k"], "d", "s", ["v"], hot_rows)
    assert sorted(tuple(r) for r in got.select("id", "s", "v").collect()) == sorted(wanted)
    assert (seen_a.value, seen_b.value) == (1500, 900)


# -- newness and gaps --------------------------------------------------------


def test_new_against_the_previous_snapshot_only(spark):
    df = spark.createDataFrame(
        [("a", D(2026, 8, 1)), ("b", D(2026, 8, 8)), ("a", D(2026, 8, 15)), ("b", D(2026, 8, 15))], "Posting_ID string, Archive_Date date"
    )
    assert values(newness.new_since_previous(df), "Posting_ID") == [("a",)]
    assert newness.new_since_previous(df.filter("Archive_Date = '2026-08-15'")).count() == 0


def test_missing_keys_match_each_other(spark):
    df = spark.createDataFrame(
        [("T", None, D(2026, 8, 1)), ("T", None, D(2026, 8, 8)), ("U", None, D(2026, 8, 8))], "Title string, Location string, Archive_Date date"
    )
    assert values(newness.new_since_previous(df, ["Title", "Location"]), "Title") == [("U",)]


def test_gap_fill_makes_zeros_and_keeps_missing_keys(spark):
    df = spark.createDataFrame([("x", D(2026, 1, 1), 3), ("y", D(2026, 1, 2), 4), (None, D(2026, 1, 2), 5)], "c string, d date, n long")
    got = values(gapfill.gap_fill(df, ["c", "d"], {"n": 0}))
    assert len(got) == 6 and ("x", D(2026, 1, 2), 0) in got and (None, D(2026, 1, 1), 0) in got and (None, D(2026, 1, 2), 5) in got


def test_gap_fill_with_given_values_and_wide_keys(spark):
    df = spark.createDataFrame([(i, i % 37, "a", 1) for i in range(60)], "p int, q int, r string, n long")
    got = gapfill.gap_fill(df, ["p", "q", "r"], {"n": 0}, {"r": ["a", "b"]})
    assert got.count() == 60 * 37 * 2 and got.agg(F.sum("n")).first()[0] == 60
    assert got.select("p", "q", "r").distinct().count() == 60 * 37 * 2


def test_gap_fill_refuses_a_product_that_is_too_large(spark):
    df = spark.createDataFrame([(i if i else None, i, 1) for i in range(60)], "p int, q int, n long")
    assert gapfill.gap_fill(df, ["p", "q"], {"n": 0}, at_most=3600).count() == 3600
    with pytest.raises(ValueError, match="3,600 combinations of .'p': 60, 'q': 60. are more than 3,599"):
        gapfill.gap_fill(df, ["p", "q"], {"n": 0}, at_most=3599)
    with pytest.raises(ValueError, match="120"):
        gapfill.gap_fill(df, ["p", "q"], {"n": 0}, {"q": [1, 2]}, at_most=119)
    assert gapfill.gap_fill(df.limit(0), ["p", "q"], {"n": 0}).count() == 0


# -- joins -------------------------------------------------------------------


def test_refresh_is_all_or_nothing(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    fresh = spark.createDataFrame([("a", 9.0)], "k string, v double")
    assert values(joins.refresh_columns(base, fresh, "k", ["v"], ("src", "new"))) == [("a", 9.0, "new"), ("b", None, "new")]
    assert values(joins.refresh_columns(base, fresh.filter("false"), "k", ["v"])) == [("a", 1.0), ("b", 2.0)]


def test_registry_decides_the_rows(spark):
    registry = spark.createDataFrame([("a", "X"), ("n", "Y")], "k string, County string")
    previous = spark.createDataFrame([("a", "Old", 1), ("z", "Old", 2)], "k string, County string, v int")
    assert values(joins.onto_registry(registry, previous, "k"), "k", "County", "v") == [("a", "X", 1), ("n", "Y", None)]
    assert joins.onto_registry(registry, None, "k").columns == ["k", "County"]


def test_change_between_and_years_ago(spark):
    now = spark.createDataFrame([("a", 12.0), ("b", 1.0), ("c", 1.0)], "k string, v double")
    then = spark.createDataFrame([("a", 10.0), ("b", 0.0)], "k string, v double")
    assert values(joins.change_between(now, then, "k", "v", "pct")) == [("a", 0.2), ("b", None)]
    trend = spark.createDataFrame([("a", 2024, 5.0), ("a", 2023, 4.0), ("b", 2022, 1.0)], "k string, y int, v double")
    assert values(joins.years_ago_columns(trend, "k", "y", "v", "P"), "k", "P_Y1Ago", "P_Y2Ago") == [("a", 4.0, None), ("b", None, 1.0)]


def test_names_and_null_safe_keys(spark):
    df = spark.createDataFrame([("Bilings",), ("Butte",), (None,)], "District string")
    aliases = spark.createDataFrame([("Bilings", "Billings")], "alias string, canonical string")
    assert values(joins.canonical_name(df, "District", aliases)) == [("Billings",), ("Butte",), (None,)]
    counted = spark.createDataFrame([(None, 7)], "District string, n int")
    assert values(joins.left_join_null_safe(df, counted, ["District"]))[-1] == (None, 7)


def test_dedupe_equals_brute_force_when_one_city_holds_most_districts(spark):
    rng = random.Random(11)
    cities = ["Helena", "East Helena", "Butte", "St. Mary", "Big Sky"]
    registry = [(f"D{i}", "Helena" if i % 3 else rng.choice(cities)) for i in range(60)]
    titles, days = ["Math T.", "math t", "Art", "Cook!"], [D(2026, 8, d) for d in (1, 2)]
    direct = [(rng.choice(titles), rng.choice(days), f"D{rng.randrange(80)}") for _ in range(40)]
    places = [f"{c}, MT" for c in cities] + ["Old East Helena site", "Butte - Helena", "Nowhere", None]
    feed = [(rng.choice(titles), rng.choice([*days, None]), rng.choice(places)) for _ in range(300)]

    def key(s):
        out, gap = "", False
        for c in s.strip().lower():
            if c.isalnum():
                out, gap = out + c, False
            elif not gap:
                out, gap = out + " ", True
        return out

    known = {(e, key(t), d) for t, d, e in direct}
    wanted = []
    for t, d, place in feed:
        named = [(e, key(c)) for e, c in registry if place is not None and f" {key(c)} " in f" {key(place)} "]
        longest = max((len(c) for _, c in named), default=0)
        if d is None or not any((e, key(t), d) in known for e, c in named if len(c) == longest):
            wanted.append(place)
    assert 0 < len(wanted) < len(feed)
    assert [place for place, _ in _kept(spark, feed, direct, registry)] == sorted(wanted, key=lambda v: (v is None, str(v)))


def test_crosswalk_equals_brute_force_when_one_name_holds_most_rows(spark, skewed):
    rows, df = skewed
    names = {"E1": ["hot", "k1"], "E2": ["k2", "k3", "nope"], "E3": ["nope"]}
    got = joins.crosswalk_aggregate(joins.crosswalk_table(spark, names), df, "k", "e", s=counts.sum_null_if_all_null("v"), n=counts.rows_matched("v"))
    for e, s, n in values(got):
        mine = [v for k, _, v in rows if k in names[e]]
        assert (s, n) == ((sum(mine) if mine else None), len(mine))
