"""Secrets in documents, and weak credential parts that stand near their complements.

Strong parts are reported wherever they stand: assignments of 8 or more characters, access ids of 16 or more,
hexadecimal runs of 32 or more.  Weak parts (short or unusual secrets, account names, endpoints) are
common in ordinary text; they are reported only where the parts they need stand within one scope of them.
Spans are in code points, end exclusive.

Everything is DataFrame functions.  Positions come from the lengths of the pieces between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import Workspace

# The base patterns of the contract. The least lengths of access and hex are part of the
# pattern, which matches the same: a shorter run is a failing match and holds no longer one.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8

# Weak parts, by the role they play in a credential.
WEAK_ID = r"(?i)(user|user_?name|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}"
WEAK_SECRET = r"(?i)(pwd|pass|passphrase|private_?key|credentials?|auth)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,}"
ENDPOINT = r"(?i)[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}"
SCOPE = 200

#: Kinds in their order of report, and the role of each.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
SECRET, ACCOUNT, PLACE = "secret", "id", "endpoint"


def _lengths(text: Column, pattern: str, hint: Column) -> tuple[Column, Column]:
    """Code points of the pieces between matches and of the matches; ``hint`` is a cheap necessary condition."""
    none = F.lit(None).cast("array<int>")
    found = hint & text.rlike(pattern)
    gaps = F.when(found, F.transform(F.split(text, pattern, -1), F.length)).otherwise(none)
    hits = F.when(found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)).otherwise(none)
    return gaps, hits


def _parts(work: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' ids by row, and a row for each matched part with its span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sure, short = F.lit(True), F.col("text").contains("://")
    columns = []
    for kind, pattern, hint in (
        ("assign", ASSIGN, sure), ("access", ACCESS, F.col("text").contains("AKIA")), ("hex", HEX, sure),
        ("weak_id", WEAK_ID, sure), ("weak_secret", WEAK_SECRET, sure), ("endpoint", ENDPOINT, short),
    ):
        gaps, hits = _lengths(text, pattern, F.coalesce(hint, F.lit(False)))
        columns += [gaps.alias(f"{kind}_gaps"), hits.alias(f"{kind}_hits")]
    valued = F.when(
        text.rlike(ASSIGN), F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)
    ).otherwise(F.lit(None).cast("array<int>"))
    rows = work.settle(
        docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *columns, valued.alias("assign_values")), "rows"
    )
    found = None
    for kind in KINDS:
        value = F.col("assign_values") if kind == "assign" else F.col(f"{kind}_hits")
        part = rows.where(F.col(f"{kind}_hits").isNotNull()).select(
            "_row",
            F.lit(kind).alias("kind"),
            F.posexplode(F.arrays_zip(F.col(f"{kind}_gaps").alias("gap"), F.col(f"{kind}_hits").alias("size"), value.alias("value"))),
        )
        found = part if found is None else found.unionByName(part)
    # The last gap has no match after it.
    found = found.where(F.col("col.size").isNotNull())
    ahead = Window.partitionBy("_row", "kind").orderBy("pos")
    end = F.sum(F.col("col.gap").cast("long") + F.col("col.size")).over(ahead)
    strong = F.col("kind").isin("access", "hex") | ((F.col("kind") == "assign") & (F.col("col.value") >= LEAST_ASSIGNED))
    spans = found.select(
        "_row",
        F.when(strong | (F.col("kind") != "assign"), F.col("kind")).otherwise("weak_secret").alias("kind"),
        (end - F.col("col.size")).alias("start"),
        end.alias("end"),
        strong.alias("strong"),
    )
    return rows.select("_row", "doc_id"), work.settle(spans, "spans")


def _near(weak: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The weak parts that have one of ``others`` at most ``scope`` code points away in their row.

    Both sides are cut into cells of one scope; a part is in all cells its widened span touches and a
    complement in the cell of its start or end, so near parts share a cell and the join is by equality.
    A cell holds at most as many parts as code points, however many parts a document has.
    """
    cell = lambda c: F.floor(c / scope)
    left = weak.withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))))
    right = others.select(
        "_row", F.col("start").alias("_start"), F.col("end").alias("_end"),
        F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"),
    )
    left, right = left.alias("l"), right.alias("r")
    near = (
        (F.col("l._row") == F.col("r._row")) & (F.col("l.cell") == F.col("r.cell"))
        & (F.col("_start") <= F.col("end") + scope) & (F.col("start") <= F.col("_end") + scope)
    )
    return left.join(right, near, "left_semi").select("_row", "kind", "start", "end").distinct()


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    base_sha256 digests the strong spans, ``kind:start:end`` by start and then by kind, comma-joined; spans
    has all spans in that form.  A weak secret (an assignment of fewer than 8 characters included) is
    reported if an account name, access id or endpoint stands within ``scope`` code points of it; an account
    name if a secret of any kind does; an endpoint if both a secret and an account name or access id do.
    Null and empty texts have no parts.  Repeated rows and copies are scanned each for itself.  An empty table
    gives no rows.
    """
    work = Workspace(docs.sparkSession, "secrets")
    rows, parts = _parts(work, docs)
    secrets = parts.where(F.col("kind").isin("assign", "hex", "weak_secret"))
    accounts = parts.where(F.col("kind").isin("access", "weak_id"))
    places = parts.where(F.col("kind") == "endpoint")
    bare = lambda df, kind: df.where(F.col("kind") == kind).select("_row", "kind", "start", "end")
    linked = (
        _near(bare(parts, "weak_secret"), accounts.unionByName(places), scope)
        .unionByName(_near(bare(parts, "weak_id"), secrets, scope))
        .unionByName(_near(_near(bare(parts, "endpoint"), secrets, scope), accounts, scope))
        .withColumn("strong", F.lit(False))
    )
    spans = parts.where("strong").unionByName(linked)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), "end", "kind", "strong")
    listed = spans.groupBy("_row").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    write = lambda entries: F.array_join(
        F.transform(entries, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ","
    )
    everything = F.coalesce(F.col("all"), F.array().cast(listed.schema["all"].dataType))
    strong = F.filter(everything, lambda e: e["strong"])
    counted = lambda kind: F.size(F.filter(strong, lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    result = rows.join(listed, "_row", "left").select(
        "doc_id", counted("assign"), counted("access"), counted("hex"),
        F.sha2(write(strong).cast("binary"), 256).alias("base_sha256"),
        write(everything).alias("spans"),
    )
    return work.finish(result)
