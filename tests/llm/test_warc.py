import base64
import gzip
import hashlib

import pytest

from . import helpers as H
from jobtide.llm import queries, warc

PAGES = "page_id long, url string, html string, record_id string, digest int"
NASTY = [
    "", None, "plain", "a\r\nb", "ends with a break\r\n", "\r\n\r\n", "\r", "x\r\r\n\r\n\r", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n",
    "é  ü\n\n", "\x00\x01", "long " * 400_000,
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def brute(rows):
    first = {}
    for page_id, url, html in rows:
        key = (page_id is None, page_id or 0, url is None, url or "")
        first[html or ""] = min(first.get(html or "", key), key)
    out = []
    for page_id, url, html in rows:
        raw, key = (html or "").encode(), (page_id is None, page_id or 0, url is None, url or "")
        top = first[html or ""]
        again = key != top
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if again else "response", (None if top[0] else top[1]) if again else None))
    return sorted(out, key=str)


def back(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_equals_brute_force(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", t) for i, t in enumerate(NASTY)]
    rows += [(100 + i, f"u{i}", "hot") for i in range(2500)] + [(50 - i, "v", NASTY[i]) for i in range(len(NASTY))]
    rows += [(None, "n", "plain"), (None, None, "alone"), (None, "z", "alone"), (7, "twice\r\nInjected: 1", "same"), (7, "twice\r\nInjected: 1", "same"), (7, None, "same")]
    assert back(warc.round_trip(pages(spark, rows))) == brute(rows)


def test_payloads_and_addresses_come_back(spark, tmp_path):
    rows = [(i, f"http://h.example/\r\n{i}", t) for i, t in enumerate(NASTY)]
    warc.write_archives(pages(spark, rows), f"{tmp_path}/w")
    got = warc.assemble(warc.read_records(spark, f"{tmp_path}/w"))
    got = got.selectExpr("*", "from_json(cast(metadata[0].block as string), 'page_id long, url string') as about").collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.metadata) == 1 and r.request.block.startswith(b"GET http://h.example/%0D%0A")
        assert r.about.url == rows[r.about.page_id][1]
        if r.type == "response":
            assert r.payload == (rows[r.about.page_id][2] or "").encode() and r.declared_digest == f"sha1:{r.payload_digest}"


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz")]
    warc.write_archives(pages(spark, rows), f"{tmp_path}/w", least_bytes=3)
    got = back(warc.captured_pages(warc.assemble(warc.read_records(spark, f"{tmp_path}/w")), "bigint"))
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def raw(kind, name, block=b"", **headers):
    lines = [b"WARC/1.0", f"WARC-Type: {kind}".encode(), f"warc-record-id: {name}".encode()]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, values in headers.items() for v in values]
    return b"\r\n".join([*lines, f"Content-Length: {len(block)}".encode()]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """One gzip member per record, links in either direction, several companions, dangling links, other records."""
    records = [
        raw("warcinfo", "w", b"software: x\r\n"),
        raw("response", "r1", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe body", WARC_Concurrent_To=["q1", "gone"], Content_Type=["application/http"]),
        raw("request", "q1", b"GET /"),
        raw("metadata", "m1", b"one", WARC_Concurrent_To=["r1", "r2"]),
        raw("metadata", "m2", b"two", WARC_Concurrent_To=["r1"]),
        raw("metadata", "m2", b"two", WARC_Concurrent_To=["r1"]),
        raw("response", "r2", b"not http", Content_Type=["text/plain"]),
        raw("revisit", "v", b"", WARC_Refers_To=["r1"]),
    ]
    for half, part in enumerate((records[:3], records[3:])):
        (tmp_path / f"{half}.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in part))
    got = {r.record_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["r1", "r2", "v"]
    assert got["r1"].request.record_id == "q1" and [m.record_id for m in got["r1"].metadata] == ["m1", "m2"]
    assert got["r1"].payload == b"\xff\xfe body" and got["r2"].payload == b"not http" and got["r2"].request is None
    assert [m.record_id for m in got["r2"].metadata] == ["m1"] and got["v"].metadata == [] and got["v"].refers_to == "r1"


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n", b"junk\r\n", b"WARC/1.1\r\nA: b\r\n\r\n\r\n"])
def test_broken_archives_raise(spark, tmp_path, data):
    (tmp_path / "x.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="x.gz: "):
        warc.read_records(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


@pytest.mark.parametrize("sf", [H.SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, sf):
    got, want = H.against_sql(spark, queries.op11_capture_transactions(spark, sf), warc.ROUND_TRIP_SQL, pages=spark.read.parquet(f"{sf}/pages.parquet"))
    assert got == want and got
