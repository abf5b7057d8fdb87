import gzip
import hashlib

import pytest

from pharmalith.llm import warc
from pharmalith.llm.shared import fresh_path


def brute(rows):
    first = {}
    for page_id, html in rows:
        p = (html or "").encode()
        first[p] = min(first.get(p, page_id), page_id)
    out = []
    for page_id, html in rows:
        p = (html or "").encode()
        again = len(p) >= 100 and first[p] != page_id
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def result(spark, df):
    return sorted(map(tuple, warc.op9(spark, df).collect()), key=str)


def test_whole_table(spark, table):
    pages = table("pages")
    assert result(spark, pages) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_revisits_and_odd_rows(spark):
    big, odd = "é" * 60, "\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(9, "http://a/x", big), (4, None, big), (6, "http://b\r\nX: y", big), (5, "u", "small"), (2, "u", "small"), (1, "", None), (3, "u", ""), (7, "u", odd), (8, "v", odd), (10, "w", "q" * 1_500_000), (-1, "n", big + "!")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    assert result(spark, df) == brute([(a, c) for a, _, c in rows])
    assert result(spark, df.limit(0)) == []


def test_repeated_rows_and_null_ids(spark):
    big = "x" * 200
    df = spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "u", big), (None, "u", big), (None, "u", "tiny")], "page_id long, url string, html string")
    want = [(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (None, "response", None)]
    assert sorted(((r[0], r[3], r[4]) for r in result(spark, df)), key=str) == sorted(want, key=str)


def test_round_trip_and_nested_rows(spark, table):
    pages = table("pages").limit(20)
    uris = warc.write_archives(pages, fresh_path(spark, "warc"))
    html = {r.url: r.html for r in pages.collect()}
    rows = warc.assemble(warc.read_archives(spark, uris)).collect()
    assert len(rows) == 20
    for r in rows:
        assert r.request.block.startswith("GET ") and "payload-bytes" in r.metadata.block and r.request.record_id.startswith(r.capture_id)
        if r.response.type == "response":
            assert bytes(r.response.payload).decode() == html[r.response.target_uri] and r.response.http_head.startswith("HTTP/1.1 200")


def test_archives_are_plain_warc(spark, table):
    uri = warc.write_archives(table("pages").limit(3), fresh_path(spark, "warc"))[0]
    data = gzip.open(uri.removeprefix("file://")).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.count(b"WARC-Type: request") == data.count(b"WARC-Type: metadata")


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort")


def test_archives_roll_over_and_carry_dates(spark):
    import datetime

    rows = [(k, f"http://a/{k}", f"page {k} " * 40, datetime.datetime(2020, 5, 1 + k % 9, 3, 4, 5) if k % 4 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, seen timestamp").coalesce(1)
    out = fresh_path(spark, "warc")
    uris = warc.write_archives(df, out, date_col="seen", archive_bytes=4000)
    assert len(uris) > 5 and uris == warc.write_archives(df, out, date_col="seen", archive_bytes=4000)  # a task that runs again replaces its archives
    got = {r.response.target_uri: r.response.date for r in warc.assemble(warc.read_archives(spark, uris)).collect()}
    assert got == {u: d.strftime("%Y-%m-%dT%H:%M:%SZ") if d else warc.DATE for _, u, _, d in rows}
