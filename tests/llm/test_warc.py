"""WARC archives: what is written is what is read, record by record."""

import gzip
import hashlib
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import warc

BODY = "<p>" + "same text " * 20 + "</p>"
ROWS = [
    (5, "http://a.example/1", BODY),
    (3, "http://b.example/ü?x=1 2", BODY),
    (9, None, BODY),
    (9, None, BODY),
    (None, "http://a.example/null", BODY),
    (None, "http://a.example/null", "z" * 300),
    (1, "http://a.example/x\r\nWARC-Type: revisit", "short"),
    (2, "", "short"),
    (4, "http://a.example/4", None),
    (6, "http://a.example/6", ""),
    (7, "http://a.example/7", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9 + "日本 😀 \x00"),
    (8, "http://a.example/8", "long text. " * 300_000),
    (10, "http://a.example/10", "x" * 99),
    (11, "http://a.example/11", "x" * 99),
    (12, "http://a.example/12", "é" * 50),
    (13, "http://a.example/13", "é" * 50),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "x", 1, "y") for r in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset int, digest string")


def wanted():
    out = []
    for key, url, body in ROWS:
        data = (body or "").encode()
        ids = [k for k, _, b in ROWS if (b or "") == (body or "") and k is not None]
        first = min(ids, default=None)
        revisit = len(data) >= 100 and key != first
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_everything_comes_back(spark, pages):
    index = warc.write(pages)
    found = warc.read(index)
    rows = found.collect()
    ours = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(ours, key=str) == wanted()
    bodies = {b or "" for _, _, b in ROWS}
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == bodies
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    assert {r.page_id: r.url for r in rows}[1] == "http://a.example/x%0D%0AWARC-Type:%20revisit"
    assert sorted(map(str, (r.url for r in index.collect()))) == sorted(str(u) for _, u, _ in ROWS)


def test_archives_are_whole_gzip_members_without_gaps(spark, pages):
    index = warc.write(pages.coalesce(1)).orderBy("offset").collect()
    (name,) = {r.file for r in index}
    data = open(urlsplit(name).path, "rb").read()
    at = 0
    for r in index:
        assert r.offset == at and gzip.decompress(data[at : at + r.length]).startswith(b"WARC/1.1\r\nWARC-Type: ")
        at += r.length
    assert at == len(data)


def test_selected_records_in_few_reads(spark, pages):
    index = warc.write(pages.coalesce(1))
    chosen = index.where(F.col("url").like("http://a.example/1%"))
    assert {r.page_id for r in warc.read(chosen).collect()} == {5, 10, 11, 12, 13}
    spots = [{"file": "f", "offset": o, "length": n} for o, n in [(0, 10), (10, 10), (30, 10), (10**6, 5), (10**6 + 5, warc.RUN_BYTES), (10**8, 9)]]
    spots.append({"file": "g", "offset": 10**8 + 9, "length": 1})
    assert [len(r) for r in warc.runs(spots)] == [3, 1, 1, 1, 1]


def test_archives_close_at_their_bound(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    index = warc.write(pages.coalesce(1))
    assert index.select("file").distinct().count() > 3
    rows = warc.read(index, payloads=False).collect()
    assert len(rows) == len(ROWS) and "payload" not in rows[0]


def test_an_index_that_does_not_fit_is_refused(spark, pages):
    index = warc.write(pages)
    with pytest.raises(Exception, match="WarcError"):
        warc.read(index.withColumn("digest", F.sha2("digest", 256))).collect()
    with pytest.raises(warc.WarcError):
        warc.parsed(warc.record("response", "1", None, b"x" * 9, "", None)[:-3])


def test_empty_table(spark, pages):
    index = warc.write(pages.limit(0))
    assert index.count() == 0 and warc.read(index).count() == 0
