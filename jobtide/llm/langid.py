"""The language of web pages by fusing four kinds of evidence under Bayes' rule.

* the text: multinomial likelihood of hashed byte trigrams, counted over all labelled documents;
* the language the markup declares: how often pages of each language declare it;
* the suffix of the address: how often pages of each language have it;
* the host: its share of each language, smoothed towards its domain, and that towards the whole.

No page's true language is known, so the last three are counted with the text's posteriors as soft labels, by
grouped aggregation; a page's own share is taken out of the counts it is judged by.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import IS_WORD, LOWER, batches, mix, text_bytes
from .workspace import Workspace, ship

BUCKETS = 1 << 13
_LETTER = np.where(IS_WORD, LOWER, 32).astype(np.uint64)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_HIDDEN = ("script", "style")


def page_text(page: str) -> str:
    """Text outside tags, comments, scripts and styles; what is not closed runs to the end."""
    out, at, lower = [], 0, page.lower()
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end, size = page.find("-->", start + 4), 3
        else:
            end, size = page.find(">", start), 1
            for name in _HIDDEN:
                if end >= 0 and lower.startswith(name, start + 1):
                    end = lower.find(f"</{name}", end)
                    end = page.find(">", end) if end >= 0 else -1
        if end < 0:
            return html.unescape(" ".join(out))
        at = end + size
    out.append(page[at:])
    return html.unescape(" ".join(out))


def declared_language(page: str) -> str:
    """The lang attribute of the first html tag that has one, in lower case; empty if none has."""
    at, lower = 0, page.lower() if page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    while (start := lower.find("<html", at)) >= 0:
        end = page.find(">", start)
        end = len(page) if end < 0 else end
        found = _LANG.search(page, start + 5, end) if not page[start + 5 : start + 6].isalnum() else None
        if found:
            return found[1].lower()
        at = end
    return ""


def trigrams(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams by row; case is folded and all that is no word character is a blank."""
    n = len(bounds) - 1
    counts = np.zeros((n, BUCKETS), np.float32)
    for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(lo, hi - 2, 1 << 20):
            part = _LETTER[flat[at : min(at + (1 << 20) + 2, hi)]]
            grams = mix(part[:-2] * np.uint64(65_536) + part[1:-1] * np.uint64(256) + part[2:]) % np.uint64(BUCKETS)
            counts[row] += np.bincount(grams.astype(np.int64), minlength=BUCKETS)
    return counts


def language_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The labelled languages, and the log-likelihood of each trigram bucket.

    Half a trigram is added to every bucket, so a language with few documents has a flat distribution.

    Each task counts its own documents; what is shuffled and collected is languages x BUCKETS numbers, which
    does not grow with the documents.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches(frames):
            flat, bounds = text_bytes(batch.column("text"))
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for at in range(0, len(names), 512):
                part = trigrams(flat, bounds[at : at + 513])
                for name in set(names[at : at + 512].tolist()):
                    mine = names[at : at + 512] == name
                    totals[name] = totals.get(name, 0) + part[mine].sum(axis=0, dtype=np.float64)
                    rows[name] = rows.get(name, 0) + int(mine.sum())
        for name, total in totals.items():
            some = np.flatnonzero(total)
            buckets, counts = np.append(some, -1).astype(np.int32), np.append(total[some], rows[name])
            columns = [pa.array([name] * len(buckets)), pa.array(buckets), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    partial = labelled.mapInArrow(run, "lang string, bucket int, n double")
    counted = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, buckets, n = (counted.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
    languages = sorted(str(x) for x in names[buckets < 0])
    table = np.full((len(languages), BUCKETS), 0.5)
    for i, name in enumerate(languages):
        mine = (names == name) & (buckets >= 0)
        table[i, buckets[mine]] += n[mine]
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _evidence(pages: DataFrame, table: np.ndarray, overlap: float) -> DataFrame:
    """page_id, url, declared, and the text's log-likelihood for each language.

    Trigrams overlap, so their log-likelihood is divided by ``overlap``.
    """
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [x or "" for x in part.column("text").to_pylist()]
                texts = pa.array([page_text(x) for x in raw], pa.large_string())
                likely = (trigrams(*text_bytes(texts)) @ shared.value.T / overlap).astype(float)
                declared = pa.array([declared_language(x) for x in raw], pa.string())
                columns = [part.column("page_id"), part.column("url"), declared, pa.array(likely.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "declared", "likely"])

    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", "url", F.col("html").alias("text"))
    return source.mapInArrow(run, f"page_id {kind}, url string, declared string, likely array<double>")


def _normal(logs: Column) -> Column:
    """Probabilities from an array of log weights."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shifted, lambda x: x / total)


def _sums(soft: Column, width: int) -> list[Column]:
    return [F.array(*[F.sum(soft[i]) for i in range(width)]).alias("soft"), F.sum("n").alias("n")]


def identify(
    pages: DataFrame, docs: DataFrame, *, strength: float = 5.0, overlap: float = 3.0
) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence and posterior (by language) for every page.

    Languages are those of ``docs.lang``.  text_lang is the text's choice alone, lang that of all evidence;
    ties go to the first language by name.  ``strength`` is the number of pages a prior counts for.  A page
    without text is judged by the rest; a page without address belongs to the host "" with all such pages;
    one that declares nothing has the declaration "".  With no labelled language every page has a null
    lang.  Repeated pages count as often as they stand.  An empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "langid")
    languages, table = language_model(docs)
    width = len(languages)
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    if not width:
        nothing = F.lit(None).cast("string")
        return work.finish(
            pages.select(
                "page_id", host.alias("host"), F.lit("").alias("declared"), nothing.alias("text_lang"), nothing.alias("lang"),
                F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,double>").alias("posterior"),
            )
        )
    seen = work.settle(
        _evidence(pages, table, overlap).select(
            "page_id", "declared", "likely",
            _normal(F.col("likely")).alias("soft"),
            F.lit(1.0).alias("n"),
            host.alias("host"),
            F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
            F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        ),
        "seen",
    )
    sums = _sums(F.col("soft"), width)
    hosts = work.settle(seen.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    domains, suffixes = hosts.groupBy("domain").agg(*sums), hosts.groupBy("suffix").agg(*sums)
    whole = hosts.agg(*sums).first()
    total, pages_seen = np.array(whole["soft"] if whole["n"] else [0.0] * width), whole["n"] or 0.0
    share = ((total + 1) / (pages_seen + width)).tolist()
    literal = lambda values: F.array(*map(F.lit, values))
    # Shares of each language, from the whole down to the host (whose own page is taken out later).
    domain_share = F.zip_with("soft", literal(share), lambda s, up: (s + strength * up) / (F.col("n") + strength))
    priors = hosts.join(domains.select("domain", domain_share.alias("domain_share")), "domain").select(
        "host", F.col("soft").alias("h_soft"), F.col("n").alias("h_n"), "domain_share"
    )
    declared = seen.groupBy("declared").agg(*sums).select("declared", F.col("soft").alias("d_soft"), F.col("n").alias("d_n"))
    suffixes = suffixes.select("suffix", F.col("soft").alias("s_soft"), F.col("n").alias("s_n"))
    every = seen.join(priors, "host").join(declared, "declared").join(suffixes, "suffix")
    own = F.col("soft")
    without = lambda sums: F.zip_with(sums, own, lambda s, p: s - p)
    others = F.col("h_n") - 1
    at_host = F.zip_with(without("h_soft"), "domain_share", lambda s, up: (s + strength * up) / (others + strength))

    def given_language(soft: str, n: str) -> Column:
        """P(mark | language) without the page itself, smoothed towards the mark's share of all pages."""
        mark = F.col(n) / F.lit(max(pages_seen, 1.0))
        positive = lambda x: F.greatest(x, F.lit(0.0))
        with_mark, pages_of = without(soft), without(literal(total.tolist()))
        return F.zip_with(with_mark, pages_of, lambda s, t: (positive(s) + strength * mark) / (positive(t) + strength))

    log = lambda values: F.transform(values, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    evidence = [F.col("likely"), log(at_host), log(given_language("d_soft", "d_n")), log(given_language("s_soft", "s_n"))]
    fused = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), evidence)
    names = literal(languages)
    best = lambda values: F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    judged = every.withColumn("fused", fused).withColumn("p", F.transform(_normal(F.col("fused")), lambda x: F.round(x, 6)))
    return work.finish(
        judged.select("page_id", "host", "declared", best(own).alias("text_lang"), best(F.col("p")).alias("lang"),
                      F.array_max("p").alias("confidence"), F.map_from_arrays(names, F.col("p")).alias("posterior"))
    )
