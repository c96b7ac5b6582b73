"""Lines that recur across documents, by a log-template tree.

The tree has a fixed depth: a line's number of tokens, then its first tokens.  Tokens with digits are variable
fields from the start.  In a leaf whose lines differ, a position is constant if nearly all texts have one
token there and variable otherwise; the constants make the leaf's template, provided they are most of the
line.  Lines that are equal but for their variable fields, or that fit one template, recur if enough
different texts have them.  Every text but the first then loses them, so no content leaves the corpus.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .keys import text_keys
from .workspace import Workspace

FIELD = "<*>"


def _masked(line: Column) -> Column:
    """The line with its tokens with digits replaced.  Tokens are parted by single blanks."""
    # Each match starts where a token starts and runs to its first digit without a choice, so the search is linear.
    field = F.regexp_replace(line, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", FIELD)
    return F.when(line.rlike("[0-9]"), field).otherwise(line)


def _lines(docs: DataFrame, lead: int, *columns: Column) -> DataFrame:
    """A row for each line that is not blank: pos, the line without blanks at its ends, n (tokens) and leaf.

    The leaf is the path in the tree: the number of tokens, then the first tokens, masked.
    """
    exploded = docs.select(*columns, F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(" \t\r")).alias("line")
    kept = exploded.select(*[c for c in exploded.columns if c != "raw"], line).where(F.col("line") != "")
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return kept.withColumns({"n": n, "leaf": F.xxhash64(n, _masked(F.substring_index("line", " ", lead)))})


def drop_recurring(
    docs: DataFrame,
    *,
    least_texts: int = 8,
    lead: int = 3,
    least_tokens: int = 4,
    constant_share: float = 0.8,
    constant_tokens: float = 0.7,
) -> DataFrame:
    """The columns of ``docs`` with the recurring lines taken out of text, and n_lines, n_dropped.

    A line recurs if ``least_texts`` different texts have it, or a line of its template.  It stays in the
    text of the smallest doc_id among them (exact copies are one text, so all of them keep it) and goes from
    all others.  Templates are sought for lines of ``least_tokens`` tokens; a position is constant if
    ``constant_share`` of the leaf's texts agree there, and ``constant_tokens`` of a template's positions must
    be constant.  Blank lines are never counted or dropped.  Rows stay, also those that lose all lines (their
    text is then empty); a null text stays null, an empty one empty.  Texts without an id come last and
    keep their lines if no text with the line has one.  Columns named n_lines or n_dropped are replaced.
    """
    work = Workspace(docs.sparkSession, "lines")
    # One row for each text and masked line, with the positions it has there. text_id: the smallest doc_id of a text's copies.
    held = work.settle(
        _lines(docs, lead, *text_keys(), F.col("doc_id"))
        .select("hi", "lo", "doc_id", "pos", "n", "leaf", F.xxhash64(_masked(F.col("line"))).alias("mask"))
        .groupBy("hi", "lo", "n", "leaf", "mask")
        .agg(F.min("doc_id").alias("text_id"), F.collect_set("pos").alias("at")),
        "held",
    )
    equal = held.groupBy("mask").agg(F.count("*").alias("texts"), F.min("text_id").alias("first")).where(F.col("texts") >= least_texts)
    # Leaves with enough texts whose lines differ.
    leaves = work.settle(
        held.where(F.col("n") >= least_tokens)
        .groupBy("leaf")
        .agg(F.count("*").alias("texts"), F.min("mask").alias("low"), F.max("mask").alias("high"))
        .where((F.col("texts") >= least_texts) & (F.col("low") != F.col("high")))
        .select("leaf"),
        "leaves",
    )
    weights = held.where(F.col("n") >= least_tokens).join(leaves, "leaf").groupBy("leaf", "mask").agg(F.count("*").alias("texts"))
    words = (
        _lines(docs, lead).where(F.col("n") >= least_tokens).select("leaf", "line")
        .join(leaves, "leaf", "left_semi")
        .select("leaf", _masked(F.col("line")).alias("masked"))
        .groupBy("leaf", F.xxhash64("masked").alias("mask")).agg(F.first("masked").alias("masked"))
    )
    words = words.join(weights, ["leaf", "mask"]).withColumn("tokens", F.split("masked", " ", -1))
    words = work.settle(words.drop("masked"), "words")
    tokens = words.select("leaf", "texts", F.posexplode("tokens").alias("pos", "token"))
    per_token = tokens.groupBy("leaf", "pos", "token").agg(F.sum("texts").alias("texts"))
    per_place = per_token.groupBy("leaf", "pos").agg(
        F.sum("texts").alias("all"), F.max(F.struct("texts", "token")).alias("best")
    )
    fixed = F.when(F.col("best.texts") >= constant_share * F.col("all"), F.col("best.token"))
    # Settled sides let adaptive execution split a hot key of the join that follows.
    templates = (
        per_place.groupBy("leaf")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", fixed.alias("token")))).alias("places"),
            F.count(fixed).alias("constant"),
            F.count("*").alias("n"),
        )
        .where(F.col("constant") >= constant_tokens * F.col("n"))
        .select("leaf", F.transform("places", lambda p: p["token"]).alias("template"))
    )
    templates = work.settle(templates, "templates")
    fits = F.forall(F.zip_with("tokens", "template", lambda a, b: b.isNull() | (a == b)), lambda x: x)
    fitting = words.join(templates, "leaf").where(fits).select("leaf", "mask")
    by_template = held.join(fitting, ["leaf", "mask"]).groupBy("leaf", "hi", "lo").agg(F.min("text_id").alias("text_id"))
    by_template = by_template.groupBy("leaf").agg(F.count("*").alias("texts"), F.min("text_id").alias("first"))
    alike = fitting.join(by_template.where(F.col("texts") >= least_texts), "leaf").select("mask", "first")
    both = equal.select("mask", "first").unionByName(alike)
    recurring = work.settle(both.groupBy("mask").agg(F.min("first").alias("first")), "recurring")
    gone = work.settle(
        held.join(recurring, "mask").where(~F.col("text_id").eqNullSafe(F.col("first")))
        .groupBy("hi", "lo").agg(F.flatten(F.collect_list("at")).alias("gone")),
        "gone",
    )
    work.keep_only("gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], "text", *text_keys())
    lines = F.split(F.col("text"), "\n", -1)
    # The lambda binds the lines once; array_except keeps order and looks up by hash.
    def stays(own: Column) -> Column:
        positions = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone"))
        return F.array_join(F.transform(positions, lambda i: F.get(own, i)), "\n")

    left = F.transform(F.array(lines), stays)[0]
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    columns = [(text if c == "text" else F.col(f"in_{i}")).alias(c) for i, c in enumerate(names)]
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return keyed.join(gone, ["hi", "lo"], "left").select(
        *columns,
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def lines_sql(
    least_texts: int = 8,
    lead: int = 3,
    least_tokens: int = 4,
    constant_share: float = 0.8,
    constant_tokens: float = 0.7,
    table: str = "documents",
) -> str:
    """The same rows in DuckDB SQL: doc_id, text, n_lines, n_dropped."""
    return f"""WITH src AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}), raw AS (
  SELECT DISTINCT coalesce(text, '') AS t, i, string_split(trim(lines[i], ' ' || chr(9) || chr(13)), ' ') AS w
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM src)), ids AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS text_id FROM src GROUP BY 1), masked AS (
  SELECT t, i, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS m
  FROM raw WHERE len(w) > 1 OR w[1] <> ''), held AS (
  SELECT t, text_id, m, len(m) AS n, len(m) || ' ' || array_to_string(m[1:{lead}], ' ') AS leaf, list(i) AS spots
  FROM masked JOIN ids USING (t) GROUP BY t, text_id, m), equal AS (
  SELECT m, min(text_id) AS first FROM held GROUP BY m HAVING count(*) >= {least_texts}), leaves AS (
  SELECT leaf FROM held WHERE n >= {least_tokens} GROUP BY leaf
  HAVING count(*) >= {least_texts} AND count(DISTINCT m) > 1), words AS (
  SELECT leaf, m, n, count(*) AS texts FROM held JOIN leaves USING (leaf) GROUP BY leaf, m, n), tok AS (
  SELECT leaf, n, pos, m[pos] AS token, sum(texts) AS texts
  FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM words) GROUP BY leaf, n, pos, m[pos]), place AS (
  SELECT leaf, n, pos, sum(texts) AS total, max(texts) AS most, max(CASE WHEN texts = top THEN token END) AS token
  FROM (SELECT *, max(texts) OVER (PARTITION BY leaf, pos) AS top FROM tok) GROUP BY leaf, n, pos), tpl AS (
  SELECT leaf, list(CASE WHEN most >= {constant_share} * total THEN token END ORDER BY pos) AS template
  FROM place GROUP BY leaf, n HAVING count(*) FILTER (most >= {constant_share} * total) >= {constant_tokens} * n), fit AS (
  SELECT leaf, m FROM words JOIN tpl USING (leaf)
  WHERE list_bool_and(list_transform(range(1, n + 1), lambda p: template[p] IS NULL OR m[p] = template[p]))), grp AS (
  SELECT leaf, min(text_id) AS first FROM held JOIN fit USING (leaf, m) GROUP BY leaf HAVING count(DISTINCT t) >= {least_texts}), rec AS (
  SELECT m, min(first) AS first FROM (
    SELECT m, first FROM equal UNION ALL SELECT m, first FROM fit JOIN grp USING (leaf)) GROUP BY m), gone AS (
  SELECT t, flatten(list(spots)) AS gone FROM held JOIN rec USING (m) WHERE text_id IS DISTINCT FROM first GROUP BY t)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
       lambda p: NOT list_contains(gone, p)), lambda p: lines[p]), chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM src LEFT JOIN gone ON t = coalesce(text, '')"""
