"""WARC archives: write pages as transactions, read records back, put transactions together again.

A capture is three records: the request, the response (or, where an earlier page has the same payload, a
revisit of that response) and metadata; the first and the last name the capture in WARC-Concurrent-To.
Archives are gzip files.  Every record ends with two line breaks, which is what Spark's text writer puts
behind every row, so the archive is written without Python.  Read back, a file is one stream of lines
from which records are cut by their Content-Length, whatever their blocks hold.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .spread import look_up
from .workspace import Workspace, ship

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit")
ATTACHED = ("request", "metadata")
BREAK = "\r\n"

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, declared_digest string, payload_digest string, payload_bytes long, block binary, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 160 bits are four times 40 bits, or eight digits."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(text: Column) -> Column:
    """A record id made from what identifies the record."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(text.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record but for the two line breaks at its end. A header without a value is left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), block)


def write_archives(pages: DataFrame, path: str, *, date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write page_id, url and html of every row as a transaction into gzipped archives below ``path``.

    Of pages whose payloads are equal and have at least ``least_bytes`` bytes, the one with the smallest
    page_id (then url) is a response; the others are revisits that refer to it.  All smaller payloads are
    responses.  A null html is an empty payload.  A missing page_id comes after all others.  Rows that are
    repeated whole are the same capture; it is written as often as the row is there, each time alike.
    A url may hold anything: line breaks in it are escaped in headers, and the metadata keep it as it was.
    Other columns are not read.
    """
    work = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    own = own.withColumn("bytes", F.octet_length("payload")).withColumn(
        "record_id", _urn(F.to_json(F.struct("page_id", "url", "digest", F.lit("capture").alias("record"))))
    )
    order = [F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url")]
    alike = own.where(F.col("bytes") >= least_bytes).groupBy("digest")
    alike = alike.agg(F.count("*").alias("n"), F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "record_id"))["record_id"].alias("original"))
    alike = work.settle(alike.where("n > 1"), "alike")
    placed = look_up(own, alike.select("digest", "original"), alike, "digest", pages.count(), F.col("record_id"))
    again = (F.col("bytes") >= least_bytes) & (F.col("original") != F.col("record_id"))
    placed = placed.withColumn("again", F.coalesce(again, F.lit(False)))

    written = F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    uri = F.replace(F.replace(written, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(BREAK * 2),
    )
    about = F.to_json(F.struct("page_id", "url"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(date))]
    beside = [("WARC-Concurrent-To", F.col("record_id"))]

    def other(kind: str) -> list[tuple[str, Column]]:
        return [("WARC-Record-ID", _urn(F.concat(F.col("record_id"), F.lit(kind)))), *common, *beside]

    capture = _record(
        F.when(F.col("again"), "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", F.col("record_id")), *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(F.col("again"), PROFILE)),
            ("WARC-Refers-To", F.when(F.col("again"), F.col("original"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(head, F.when(F.col("again"), "").otherwise(F.col("payload"))),
    )
    request = _record(
        F.lit("request"),
        [*other("request"), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(BREAK * 2)),
    )
    metadata = _record(F.lit("metadata"), [*other("metadata"), ("Content-Type", F.lit("application/json"))], about)
    rows = placed.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    rows.write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)
    work.drop()


class _Cutter:
    """Cuts one file's lines into records."""

    def __init__(self, name: str):
        self.name = name
        self.headers: list[bytes] | None = None
        self.block: list[bytes] | None = None
        self.length = self.size = 0  # of the block: as declared, and of what has come

    def feed(self, line: bytes) -> tuple[list[bytes], bytes] | None:
        """The record that this line completes: its header lines and its block."""
        if self.block is not None:
            self.size += len(line) + (len(BREAK) if self.block else 0)
            self.block.append(line)
            if self.size < self.length:
                return None
            if self.size > self.length:
                raise ValueError(f"{self.name}: a record is longer than its Content-Length")
            out = (self.headers or [], BREAK.encode().join(self.block))
            self.headers = self.block = None
            return out
        if self.headers is None:
            if line.startswith(b"WARC/"):
                self.headers = []
            elif line:
                raise ValueError(f"{self.name}: not the start of a record: {line[:40]!r}")
        elif line:
            self.headers.append(line)
        else:
            length = [h.partition(b":")[2] for h in self.headers if h.lower().startswith(b"content-length:")]
            if not length:
                raise ValueError(f"{self.name}: a record without Content-Length")
            self.block, self.length, self.size = [], int(length[0]), 0
        return None

    def close(self) -> None:
        if self.headers is not None:
            raise ValueError(f"{self.name}: the file ends inside a record")


def _parsed(headers: list[bytes], block: bytes, payloads: bool) -> dict:
    named: dict[str, list[str]] = {}
    for line in headers:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        named.setdefault(name.strip().lower(), []).append(value.strip())

    def one(name: str) -> str | None:
        return named.get(name, [None])[0]

    kind, content = one("warc-type"), one("content-type")
    row = {
        "record_id": one("warc-record-id"), "type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"),
        "concurrent_to": named.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "content_type": content,
        "declared_digest": one("warc-payload-digest"), "payload_digest": None, "payload_bytes": None, "block": block, "payload": None,
    }
    if kind in CAPTURES:
        head, payload = block, b""
        if (content or "").startswith("application/http"):
            head, _, payload = block.partition(BREAK.encode() * 2)
        else:
            head, payload = b"", block
        row["block"] = head
        if kind == "response":
            row["payload_bytes"] = len(payload)
            row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row["payload"] = payload if payloads else None
    return row


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of the gzipped archives below ``path``, one row each.

    A response's payload is what follows its HTTP head; its digest (bare base 32) and length are taken from the
    bytes read, and ``declared_digest`` is what the record claims.  The block of a capture is its HTTP head
    alone, that of other records the whole block.  Without ``payloads`` the payload itself is left out.  A
    file that is cut off, or whose lengths do not fit, raises ValueError.  No files, or empty ones, give no rows.

    A gzip file is read by one task, in order, so it should be of the usual size of an archive (1 GB or less);
    memory holds one record and one batch of lines.
    """
    schema = pa.schema(
        [(f.split(" ")[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[f.split(" ")[1]]) for f in RECORD.split(", ")]
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, rows, held = _Cutter(""), [], 0
        for batch in frames:
            lines, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for line, name in zip(lines, names, strict=True):
                if name != cutter.name:
                    cutter.close()
                    cutter = _Cutter(name)
                record = cutter.feed(line)
                if record:
                    rows.append(_parsed(*record, payloads))
                    held += len(record[1])
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        cutter.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    ship(spark)
    lines = spark.read.option("lineSep", BREAK).text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_name").alias("file")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its own fields, ``request`` (a struct, or null) and ``metadata`` (an array of structs).

    A request or metadata record belongs to the captures it names in WARC-Concurrent-To and to those that name
    it; a link to a record that is not there is left out.  Of several requests the one with the smallest id is
    taken.  Records that are there more than once, under one id and alike, are attached once.  A capture
    without companions has a null request and no metadata.  Companions are bounded by what a capture
    names, so a capture's row is as long as its transaction.
    """
    described = F.struct("type", "record_id", "content_type", "block")
    captures = records.where(F.col("type").isin(*CAPTURES))
    others = records.where(F.col("type").isin(*ATTACHED))
    named = others.select(F.explode("concurrent_to").alias("capture_id"), described.alias("other"))
    naming = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    found = naming.distinct().join(others, "record_id").select("capture_id", described.alias("other"))
    attached = named.unionByName(found).groupBy("capture_id").agg(F.sort_array(F.collect_set("other")).alias("others"))
    parts = F.coalesce(F.col("others"), F.array().cast("array<struct<type:string,record_id:string,content_type:string,block:binary>>"))
    own = ["record_id", "type", "target_uri", "date", "refers_to", "declared_digest", "payload_digest", "payload_bytes", "block", "payload"]
    return captures.join(attached, F.col("record_id") == F.col("capture_id"), "left").select(
        *own,
        F.get(F.filter(parts, lambda r: r["type"] == "request"), F.lit(0)).alias("request"),
        F.filter(parts, lambda r: r["type"] == "metadata").alias("metadata"),
    )


def captured_pages(captures: DataFrame, page_id: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of captures that ``write_archives`` wrote.

    ``page_id`` is the type of the ids.  A revisit has the digest and length of the response that it refers to,
    and that response's page.
    """
    work = Workspace(captures.sparkSession, "captures")
    rows = captures.select(
        F.from_json(F.get("metadata", F.lit(0))["block"].cast("string"), f"page_id {page_id}")["page_id"].alias("page_id"),
        "record_id", F.col("type").alias("record_type"), F.col("refers_to").alias("referred"), "payload_bytes", "payload_digest",
    )
    rows = work.settle(rows, "rows")
    again = rows.where("record_type = 'revisit'")
    counts = work.settle(again.groupBy("referred").agg(F.count("*").alias("n")), "counts")
    # Only what is referred to; a response that stands in the archive more than once is one value.
    named = [F.col("record_id").alias("referred"), F.col("page_id").alias("refers_to")]
    named += [F.col("payload_bytes").alias("own_bytes"), F.col("payload_digest").alias("own_digest")]
    values = rows.where("record_type = 'response'").select(*named).join(counts, "referred", "left_semi")
    values = values.groupBy("referred").agg(*[F.first(c).alias(c) for c in ("refers_to", "own_bytes", "own_digest")])
    revisits = look_up(again, values, counts, "referred", again.count(), F.col("record_id")).select(
        "page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    responses = rows.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(page_id).alias("refers_to")
    )
    return work.finish(responses.unionByName(revisits))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives on shared storage, read the archives back and put the captures together."""
    work = Workspace(pages.sparkSession, "archives")
    path = f"{work.folder}/warc"
    write_archives(pages, path)
    records = work.settle(read_records(pages.sparkSession, path, payloads=False), "records")
    result = captured_pages(assemble(records), pages.schema["page_id"].dataType.simpleString())
    work.drop()
    return result


ROUND_TRIP_SQL = """WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), r AS (
  SELECT *, first_value(page_id) OVER w AS original, first_value(url) OVER w AS original_url FROM p
  WINDOW w AS (PARTITION BY t ORDER BY page_id NULLS LAST, url NULLS LAST)), d AS (
  SELECT *, page_id IS NOT DISTINCT FROM original AND url IS NOT DISTINCT FROM original_url AS first,
         list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM r)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN original END AS refers_to
FROM d"""
