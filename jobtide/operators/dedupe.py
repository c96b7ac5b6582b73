"""Drop feed rows that a directly read board already shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import match_key, trim_blanks


def _word_runs(words: F.Column, longest: F.Column) -> F.Column:
    """Every run of 1..longest neighbouring words, joined by one space."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.least(longest, F.size(words))),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.size(words) - n + 1),
                    lambda start: F.array_join(F.slice(words, start, n), " "),
                ),
            )
        )
    )


def _words(x: F.Column) -> F.Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def _with_match_fields(df: DataFrame) -> DataFrame:
    """Rows that have a title and a date, with both in the form they are compared in.
    The conditions look at the given columns, so they are cheap to push down."""
    dated = isinstance(df.schema["date_posted"].dataType, T.DateType)
    day = F.col("date_posted").cast("string")
    present = F.col("date_posted").isNotNull() if dated else trim_blanks(day) != ""
    return (
        df.filter((trim_blanks("title") != "") & present)
        .withColumn("_title", match_key("title"))
        .withColumn("_day", day if dated else trim_blanks(day))
    )


def remove_feed_duplicates(feed: DataFrame, direct: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``feed`` not already present on a direct board.

    A feed row is a duplicate when its normalised title and its date equal
    those of a direct row of a district whose city is named, as whole words,
    in the feed row's location.  Only the longest such city counts ("East X" also
    contains "X"); districts sharing that city all count.  Rows without a
    title, a date or a recognisable city are kept.

    The verdict depends on a row's title, date and location alone, so it is reached
    once per distinct triple and no row needs an id.  Whole-word containment is
    turned into equality on word runs, so there is no theta join and the work
    does not depend on the size of the registry.  A blank registry city never matches.
    """
    for name, df, needed in (
        ("feed", feed, ("title", "date_posted", "location")),
        ("direct", direct, ("title", "date_posted", "District")),
        ("registry", registry, ("District", "City")),
    ):
        lacking = [c for c in needed if c not in df.columns]
        if lacking:
            raise ValueError(f"remove_feed_duplicates: {name} is missing {', '.join(lacking)}")

    places = (
        registry.select("District", match_key("City").alias("_city"))
        .withColumn("_run", F.array_join(_words(F.col("_city")), " "))
        .filter(F.col("_run") != "")
    )
    cities = places.select("_city", "_run").distinct()
    longest = cities.agg(F.coalesce(F.max(F.size(_words(F.col("_run")))), F.lit(1))).scalar()

    # Direct rows by city: however many districts share one, a feed row meets it once.
    known = (
        _with_match_fields(direct)
        .select("District", "_title", "_day")
        .distinct()
        .join(places.select("District", "_city").distinct(), "District")
        .select("_city", "_title", "_day")
        .distinct()
    )
    triple = ["title", "date_posted", "location"]
    named = (
        _with_match_fields(feed.select(*triple).filter(F.col("location").isNotNull()).distinct())
        .withColumn("_place", F.concat(F.lit(" "), match_key("location"), F.lit(" ")))
        .withColumn("_most", longest)
        .select(
            *triple, "_title", "_day", "_place",
            F.explode(_word_runs(_words(F.col("_place")), F.col("_most"))).alias("_run"),
        )
        .join(cities, "_run")
        .filter(F.col("_place").contains(F.concat(F.lit(" "), F.col("_city"), F.lit(" "))))
        .groupBy(*triple, "_title", "_day")
        .agg(F.collect_set("_city").alias("_cities"))
    )
    # Cities of the greatest length, ties included; a row names only a few.
    top = F.array_max(F.transform("_cities", lambda c: F.length(c)))
    best = named.withColumn("_top", top).select(
        *triple, "_title", "_day", F.explode(F.filter("_cities", lambda c: F.length(c) == F.col("_top"))).alias("_city")
    )
    duplicates = best.join(known, ["_city", "_title", "_day"], "left_semi").select(*triple).distinct()
    # A duplicate has all three, so plain equality finds it and rows that lack one stay.
    return feed.join(duplicates, triple, "left_anti").select(*feed.columns)
