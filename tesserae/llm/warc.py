"""WARC records: reading them, and resolving not-modified revisits against the latest earlier full response."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = "record_id long, url string, captured_at long, kind string, status int, headers map<string,string>, payload string"
#: Bytes read at once, of a record's head at most, and of the payloads of a batch of rows.
CHUNK, MOST_HEAD, BATCH = 1 << 16, 1 << 20, 1 << 24
#: Headers that describe the stored body or one connection; a 304 may not change them.
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization")


def canonical(url: Column) -> Column:
    """Host in lower case without www., m. and usual ports; no scheme, fragment, utm_ and ref parameters, nor closing slash."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    rest = F.regexp_replace(u, "^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^(www|m)\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z_]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), r"\?&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, captured_at, refers_to, outcome, status, headers, payload.

    refers_to is the latest full response (kind 'response', status 200) of the same canonical URL captured before the
    revisit; of several captured at once the one of largest record_id. outcome: 'no_response' if there is none,
    'no_validator' if the revisit has neither etag nor last-modified, 'mismatch' if the etags differ (W/ aside; without
    etags on both sides, if last-modified differs or is missing on one side), else 'resolved'. Resolved rows have the
    stored status and payload, and the stored headers with those of the revisit put over them, but for the ones of KEPT;
    the others have null there. Header names are in lower case.

    A null url or time resolves to 'no_response', and such responses answer nothing. Responses of one record_id count
    once, the smallest url and time first. Repeated revisit rows are answered each. Other columns are ignored.

    Only ids, times and canonical URLs go through the window; payloads are joined to the revisits that are resolved.
    """
    named = _named(records)
    keys = named.select("record_id", "canonical_url", "captured_at", "kind", "status", F.when(F.col("kind") == "revisit", F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    before = Window.partitionBy("canonical_url").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    placed = keys.filter("(kind = 'revisit' or kind = 'response') and canonical_url is not null and captured_at is not null")
    found = placed.withColumn("ref", F.max(F.when(full, F.struct("captured_at", "record_id"))).over(before)).filter("kind = 'revisit'")
    lost = keys.filter("kind = 'revisit' and (canonical_url is null or captured_at is null)").withColumn("ref", F.lit(None).cast("struct<captured_at:bigint,record_id:bigint>"))
    asked = found.unionByName(lost).select("record_id", "canonical_url", "captured_at", F.col("headers").alias("new"), F.col("ref.record_id").alias("refers_to"))
    stored = named.filter(full & F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()).groupBy("record_id").agg(F.min_by(F.struct("status", "headers", "payload"), F.struct("canonical_url", "captured_at")).alias("s"))
    both = asked.join(stored.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    new, old = F.col("new"), F.col("s.headers")
    outcome = (
        F.when(F.col("refers_to").isNull(), "no_response")
        .when(new["etag"].isNull() & new["last-modified"].isNull() | new.isNull(), "no_validator")
        .when(new["etag"].isNotNull() & old["etag"].isNotNull(), F.when(tag(new) == tag(old), "resolved").otherwise("mismatch"))
        .when(new["last-modified"] == old["last-modified"], "resolved")
        .otherwise("mismatch")
    )
    over = F.map_filter(new, lambda k, v: ~k.isin(*KEPT))
    rest = F.map_filter(old, lambda k, v: F.coalesce(~F.map_contains_key(over, k), F.lit(True)))
    ok = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "captured_at", "refers_to", "outcome",
        F.when(ok, F.col("s.status")).alias("status"), F.when(ok, F.map_concat(rest, over)).alias("headers"), F.when(ok, F.col("s.payload")).alias("payload"),
    )


def _named(records: DataFrame) -> DataFrame:
    """Header names in lower case; of names that then are equal, the last value in order of the original names stays."""
    entries = F.array_sort(F.map_entries("headers"))
    lower = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))
    return records.select(F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("long").alias("captured_at"), "kind", "status", lower.alias("headers"), "payload")


def from_pages(pages: DataFrame) -> DataFrame:
    """The records of two crawls of `pages`: every page in full, page_id seconds into the first crawl, and then as a
    not-modified revisit in the second, a day after each page's first capture. ETags are digests of the page."""
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured_at"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), etag, F.lit("date"), F.col("page_id").cast("string"), F.lit("server"), F.lit("first")).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 86400).alias("captured_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("date"), (F.col("page_id") + 86400).cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


class _Source:
    """Bytes of a stream, gzip members unpacked, of which never more than asked for and a chunk are held. `broken` says what couldn't be unpacked."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream, self.chunk, self.held, self.broken = stream, chunk, bytearray(), ""
        first = stream.read(2)
        self.gz = first == b"\x1f\x8b"
        self.raw = first
        self.unpack = zlib.decompressobj(31) if self.gz else None

    def _more(self) -> bool:
        """Hold at least one more byte; False at the end."""
        if not self.gz:
            got = self.raw or self.stream.read(self.chunk)
            self.raw = b""
            self.held += got
            return bool(got)
        while True:
            self.raw = self.raw or self.stream.read(self.chunk)
            if not self.raw:
                if not self.unpack.eof and self.unpack.unconsumed_tail == b"" and self.started:
                    self.broken, self.started = "cut-off gzip member", False
                return False
            if self.unpack.eof:
                self.unpack, self.started = zlib.decompressobj(31), False
            try:
                self.started = True
                got = self.unpack.decompress(self.raw, self.chunk)
                self.raw = self.unpack.unconsumed_tail or self.unpack.unused_data
            except zlib.error as e:  # go on at what looks like the next member
                self.broken, got = str(e), b""
                self.unpack, self.started = zlib.decompressobj(31), False
                at = self.raw.find(b"\x1f\x8b\x08", 1)
                while at < 0 and (more := self.stream.read(self.chunk)):
                    self.raw = self.raw[-2:] + more
                    at = self.raw.find(b"\x1f\x8b\x08")
                self.raw = self.raw[at:] if at >= 0 else b""
            if self.unpack.eof:
                self.started = False
            if got or self.broken:
                self.held += got
                return True

    started = False

    def until(self, mark: bytes, most: int) -> bytes | None:
        """All bytes up to mark, which is passed over too; None if it isn't within `most` bytes or the stream breaks or ends first."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most or self.broken or not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size and not self.broken and self._more():
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        return out

    def skip_to(self, mark: bytes) -> bool:
        """Drop all bytes before mark; False if it doesn't come."""
        while (at := self.held.find(mark)) < 0:
            del self.held[: max(0, len(self.held) - len(mark) + 1)]
            if self.broken or not self._more():
                return False
        del self.held[:at]
        return True


def parse(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[dict]:
    """Records of one WARC file, gzip members or plain, one at a time. HTTP responses and revisits are split into status, headers and body.

    What can't be read comes as a record of kind 'broken', which resolves nothing: its header 'error' says what is wrong, and
    reading goes on with the next record. A record date or status that is no date or number is null.
    """
    source = _Source(stream, chunk)
    wrong = lambda why, head=None: {"url": (head or {}).get("warc-target-uri", "").strip("<>") or None, "captured_at": None, "kind": "broken", "status": None, "headers": {"error": why}, "payload": None}
    while True:
        found = source.skip_to(b"WARC/")
        if source.broken:
            yield wrong(source.broken)
            source.broken = ""
            source.held.clear()
            continue
        if not found:
            return
        raw = source.until(b"\r\n\r\n", MOST_HEAD)
        if raw is None:
            if not source.broken:
                yield wrong("record head without end")
                del source.held[:5]
            continue
        head = _headers(raw.split(b"\r\n")[1:])
        length = head.get("content-length", "0")
        if not length.isascii() or not length.isdigit():
            yield wrong(f"content-length {length!r}", head)
            continue
        block = source.take(int(length))
        if len(block) < int(length):
            yield wrong(source.broken or "cut-off record", head)
            source.broken = ""
            continue
        http, _, body = block.partition(b"\r\n\r\n")
        lines = http.split(b"\r\n")
        is_http = lines[0].startswith(b"HTTP/")
        status = lines[0].split()[1:2] if is_http else []
        yield {
            "url": head.get("warc-target-uri", "").strip("<>") or None,
            "captured_at": _seconds(head.get("warc-date")),
            "kind": head.get("warc-type"),
            "status": int(status[0]) if status and status[0].isdigit() and len(status[0]) < 10 else None,
            "headers": _headers(lines[1:]) if is_http else {},
            "payload": (body if is_http else block).decode("utf-8", "replace"),
        }


def _seconds(stamp: str | None) -> int | None:
    try:
        at = datetime.fromisoformat((stamp or "").replace("Z", "+00:00"))
        return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())
    except ValueError:
        return None


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def opened(path: str) -> BinaryIO:
    """A stream of the file at a path as Spark lists it: local, or of any file system that Arrow knows."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    files, at = pa.fs.FileSystem.from_uri(quote(path, safe=":/@?=&+,;%"))
    return files.open_input_stream(at, compression=None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under path; record_id is a hash of file and place in it.

    Spark only lists the files. A task streams each of its files, a chunk and a record at a time, and gives rows in batches of
    about BATCH bytes, so that memory doesn't follow file sizes. parse() says what becomes of damaged files.
    """
    kinds = {"captured_at": "Int64", "status": "Int32"}
    names = ["place", "url", "captured_at", "kind", "status", "headers", "payload"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for name in batch["path"]:
                with opened(name) as stream:
                    for k, r in enumerate(parse(stream)):
                        rows.append((f"{name}#{k}", *(r[c] for c in names[1:])))
                        size += len(r["payload"] or "")
                        if size > BATCH:
                            yield pd.DataFrame(rows, columns=names).astype(kinds)
                            rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names).astype(kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = files.mapInPandas(run, RECORDS.replace("record_id long", "place string"))
    return found.select(F.xxhash64("place").alias("record_id"), *names[1:])
