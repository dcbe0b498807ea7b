"""The WARC reader on whole, compressed and damaged files."""

import gzip
import io

import pytest

from tesserae.llm import warc

BODY = b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nhello"


def record(body=BODY, kind=b"response", length=None, date=b"2020-01-01T00:00:00Z", url=b"http://a.org/"):
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: %s\r\nWARC-Date: %s\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (kind, url, date, length or b"%d" % len(body), body)


def kinds(raw, chunk):
    return [(r["kind"], r["payload"]) for r in warc.parse(io.BytesIO(raw), chunk)]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_parse(chunk):
    good = ("response", "hello")
    one = record()
    assert kinds(one * 3, chunk) == [good] * 3
    assert kinds(gzip.compress(one) * 3, chunk) == kinds(gzip.compress(one * 3), chunk) == [good] * 3
    assert kinds(b"", chunk) == [] and kinds(b"no warc at all", chunk) == []
    assert kinds(one + record(length=b"many") + one, chunk)[0] == good
    assert [k for k, _ in kinds(one + record(length=b"many") + one, chunk)] == ["response", "broken", "response"]
    assert [k for k, _ in kinds(one + one[:-20], chunk)] == ["response", "broken"]
    whole = gzip.compress(one)
    assert [k for k, _ in kinds(whole + whole[: len(whole) // 2], chunk)] == ["response", "broken"]
    hurt = bytearray(whole)
    hurt[20:30] = b"\xff" * 10
    got = [k for k, _ in kinds(whole + bytes(hurt) + whole, chunk)]
    assert got[0] == got[-1] == "response" and "broken" in got
    odd = list(warc.parse(io.BytesIO(record(date=b"yesterday") + record(b"HTTP/1.1 fine\r\n\r\nx") + record(b"GIF89a", b"resource")), chunk))
    assert odd[0]["captured_at"] is None and odd[1]["status"] is None and odd[2]["payload"] == "GIF89a"


def test_read(spark, tmp_path):
    (tmp_path / "a b.warc.gz").write_bytes(gzip.compress(record()) + gzip.compress(record(url=b"http://b.org/")))
    (tmp_path / "cut.warc").write_bytes(record() + record()[:-30])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.url) for r in rows) == [("broken", "http://a.org/"), ("response", "http://a.org/"), ("response", "http://a.org/"), ("response", "http://b.org/")]
    assert len({r.record_id for r in rows}) == 4 and all(r.captured_at == 1577836800 for r in rows if r.kind == "response")
    assert warc.resolve(warc.read(spark, str(tmp_path))).count() == 0


def test_ties_repeats_and_clashing_columns(spark):
    rows = [
        (1, "http://a.org/", 10, "response", 200, {"etag": "1"}, "low", "x"),
        (2, "http://a.org/", 10, "response", 200, {"etag": "1"}, "high", "x"),
        (3, "http://a.org/", 11, "response", 404, {"etag": "1"}, "lost", "x"),
        (4, "http://a.org/", 20, "revisit", 304, {"etag": "1"}, None, "x"),
        (4, "http://a.org/", 20, "revisit", 304, {"etag": "1"}, None, "x"),
        (5, "http://a.org/", 20, "broken", None, {"error": "e"}, None, "x"),
        (None, None, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, warc.RECORDS + ", outcome string").withColumn("refers_to", warc.F.lit(1)).withColumn("canonical_url", warc.F.lit("u"))
    got = warc.resolve(docs).collect()
    assert [(r.record_id, r.refers_to, r.outcome, r.payload) for r in got] == [(4, 2, "resolved", "high")] * 2
