"""The content-addressed archive: records, payloads stored once, WARC files and their round trip."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import pytest

from ledgermill.llm import warc_archive as A

PAGES = [
    (5, "http://a.example/", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (9, None, "<p>one</p>"),
    (3, "http://c.example/\r\nWARC-Type: resource", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (4, "http://d.example/", ""), (6, "http://e.example/", None), (7, "http://f.example/", "é ✓ \x00 \n"),
    (8, "http://g.example/", "word " * 200_000), (11, "http://h.example/", "twice"), (11, "http://h.example/", "twice"),
    (None, "http://i.example/", "no id"), (None, "http://j.example/", "<p>one</p>"), (12, "x", "Line\r\n"),
]


def pages(spark, rows, partitions=4):
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    return table.selectExpr("*", "1 AS payload", "2 AS sha256", "3 AS copy", "4 AS header", "5 AS copies", "6 AS n_bytes")


def stated(rows):
    first = {}
    for page, _, html in rows:
        first.setdefault(html or "", []).append(page)
    out = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        least = min((p for p in first[html or ""] if p is not None), default=None)
        kind = "response" if page == least else "revisit"
        out[(page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, least if kind == "revisit" else None)] += 1
    return out


def written(spark, rows, name):
    folder = A.new_archive(spark, name)
    A.write_archive(pages(spark, rows), folder)
    return folder


def test_records_read_back(spark):
    folder = written(spark, PAGES, "warc-a")
    got = A.parsed(A.read_archive(spark, folder))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == stated(PAGES)
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == len({html or "" for _, _, html in PAGES})


def test_hot_payload_is_spread(spark, monkeypatch):
    monkeypatch.setattr(A, "RECORDS_A_COPY", 10)
    rows = [(i, f"http://x.example/{i}", "hot" if i % 3 else f"page {i}") for i in range(300)]
    folder = written(spark, rows, "warc-hot")
    assert spark.read.parquet(f"{folder}/records").select("copy").distinct().count() == 20
    assert Counter(tuple(r) for r in A.parsed(A.read_archive(spark, folder)).collect()) == stated(rows)


def test_files_hold_the_exact_records(spark, tmp_path):
    folder = written(spark, PAGES, "warc-b")
    records = A.read_archive(spark, folder)
    A.write_warc(records, f"{tmp_path}/warc", records_a_file=2)
    want = Counter((bytes(r.header), bytes(r.payload) if r.has_payload else b"") for r in records.collect())
    got = Counter((bytes(r.header), bytes(r.payload)) for r in A.read_warc(spark, f"{tmp_path}/warc").collect())
    assert got == want
    for header, payload in got:
        lines = header.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        length = next(int(x.split(": ")[1]) for x in lines if x.startswith("Content-Length"))
        block = header.split(b"\r\n\r\n", 1)[1] + payload
        assert length == len(block)


def test_a_changed_payload_ends_the_job(spark):
    folder = written(spark, PAGES, "warc-c")
    changed = spark.read.parquet(f"{folder}/payloads").selectExpr(
        "sha256", "cast(concat(cast(payload AS string), '!') AS binary) AS payload", "n_bytes", "sha1", "first_page", "copies")
    changed.write.parquet(f"{folder}-changed/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{folder}-changed/records")
    with pytest.raises(Exception, match="payload lost its SHA-256"):
        A.parsed(A.read_archive(spark, f"{folder}-changed")).collect()


def test_empty_table(spark):
    assert A.parsed(A.read_archive(spark, written(spark, [], "warc-d"))).collect() == []
