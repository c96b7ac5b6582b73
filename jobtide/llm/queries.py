"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, interaction, langid, lines, neardup, packing, partcodes, quality, secrets, sharding, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op2_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))
    return fused.select("page_id", "host", "declared", "text_lang", "lang", "confidence", F.to_json("posterior").alias("posterior"))


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ["doc_id"])


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_norm_bucket_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


def op8_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_classes(_table(spark, sf_dir, "documents"))


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs, benchmark, ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "offending")


def op11_capture_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = partcodes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(partcodes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_linked_secrets": op1_linked_secrets,
    "op2_language_evidence": op2_language_evidence,
    "op3_quality_votes": op3_quality_votes,
    "op4_template_lines": op4_template_lines,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_norm_bucket_top5": op7_norm_bucket_top5,
    "op8_bagminhash_classes": op8_bagminhash_classes,
    "op9_benchmark_windows": op9_benchmark_windows,
    "op10_toxic_sentences": op10_toxic_sentences,
    "op11_capture_transactions": op11_capture_transactions,
    "op12_part_codes": op12_part_codes,
    "op13_filter_interactions": op13_filter_interactions,
}
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""



def _either_case(pattern: str) -> str:
    """A pattern for letters in either case, without a flag that would also fold non-ASCII letters."""
    pattern = pattern.removeprefix("(?i)")
    out, inside = [], False
    for i, c in enumerate(pattern):
        inside = (inside or c == "[") and c != "]"
        if c.isalpha() and not inside and pattern[i - 1] != "\\" and pattern[i - 2 : i] != "\\x":
            c = f"[{c.lower()}{c.upper()}]"
        out.append(c)
    return "".join(out).replace("[a-z]", "[a-zA-Z]").replace("[a-z0-9", "[a-zA-Z0-9").replace("'", "''")


def _parts_sql() -> str:
    patterns = {
        "assign": _either_case(secrets.ASSIGN), "access": secrets.ACCESS, "hex": secrets.HEX,
        "weak_id": _either_case(secrets.WEAK_ID), "weak_secret": _either_case(secrets.WEAK_SECRET), "endpoint": _either_case(secrets.ENDPOINT),
    }
    return " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, i, len(hits[i]) AS size, {"len(vals[i])" if kind == "assign" else "99"} AS value,
        list_sum(list_transform(gaps[:i], lambda x: len(x))) + list_sum(list_transform(hits[:i], lambda x: len(x))) AS e
        FROM (SELECT doc_id, hits, gaps, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps,
                 {f"regexp_extract_all(t, '{p}', 2)" if kind == "assign" else "NULL"} AS vals FROM texts))"""
        for kind, p in patterns.items()
    )


_NEAR = f"o.doc_id = p.doc_id AND o.s <= p.e + {secrets.SCOPE} AND p.s <= o.e + {secrets.SCOPE}"
_SECRET, _ACCOUNT = "o.kind IN ('assign', 'hex', 'weak_secret')", "o.kind IN ('access', 'weak_id')"

OP1_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({_parts_sql()}), part AS (
  SELECT doc_id, CASE WHEN kind = 'assign' AND value < {secrets.LEAST_ASSIGNED} THEN 'weak_secret' ELSE kind END AS kind,
         CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM raw), kept AS (
  SELECT DISTINCT * FROM part p WHERE kind IN ('assign', 'access', 'hex')
    OR kind = 'weak_secret' AND EXISTS (SELECT 1 FROM part o WHERE {_NEAR} AND ({_ACCOUNT} OR o.kind = 'endpoint'))
    OR kind = 'weak_id' AND EXISTS (SELECT 1 FROM part o WHERE {_NEAR} AND {_SECRET})
    OR kind = 'endpoint' AND EXISTS (SELECT 1 FROM part o WHERE {_NEAR} AND {_SECRET})
       AND EXISTS (SELECT 1 FROM part o WHERE {_NEAR} AND {_ACCOUNT})), listed AS (
  SELECT *, kind || ':' || s || ':' || e AS entry, list_position({secrets.KINDS}, kind) AS rank,
         kind IN ('assign', 'access', 'hex') AS strong FROM kept), sums AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(entry, ',' ORDER BY s, rank, e) FILTER (strong) AS base,
         string_agg(entry, ',' ORDER BY s, rank, e) AS spans FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN sums USING (doc_id)"""

OP7_SQL = """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP9_SQL = f"""WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark), p AS (
  SELECT DISTINCT item, least(13, len(w)) AS l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)), k AS (
  SELECT DISTINCT l FROM p), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents), g AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, k)), h AS (
  SELECT g.doc_id, g.l, g.i, p.item FROM g JOIN p USING (l, win)), n AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM (SELECT DISTINCT doc_id, l, i FROM h)) GROUP BY doc_id), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op1_linked_secrets": OP1_SQL,
    "op4_template_lines": lines.lines_sql(),
    "op7_norm_bucket_top5": OP7_SQL,
    "op9_benchmark_windows": OP9_SQL,
    "op11_capture_transactions": warc.ROUND_TRIP_SQL,
    "op12_part_codes": partcodes.codes_sql(),
    "op13_filter_interactions": interaction.audit_sql(),
}
