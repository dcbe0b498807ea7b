"""Text of files: directory scans, recognition by content, office and e-book containers, and retrieval benchmarks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.errors import EngineError, ParseError, Unavailable
from tesserae.sources.markup import html_text, rtf_text

EXTENSIONS = "md markdown txt rst html htm xhtml rtf docx xlsx pptx odt ods odp epub json yaml yml toml py c h cpp hpp rs go java js ts".split()
EXCLUDED = r"/(\.git|\.hg|\.svn|node_modules|__pycache__|build|target|dist)/"
MOST_BYTES = 4 << 20
FORMATS = [("html", "markup", True, "tag scan"), ("rtf", "rich text", True, "group scan"), ("docx xlsx pptx", "office", True, "zip and xml"), ("odt ods odp", "office", True, "zip and xml"), ("epub", "book", True, "spine order"), ("pdf", "page layout", False, "give an extractor for .pdf"), ("doc xls ppt", "old office", False, "give an extractor")]


def decode(raw: bytes) -> str:
    """By byte order mark, else as UTF-8; NUL characters go."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace").replace("\0", "")
    if b"\0" in raw[:1024]:
        raise ParseError("binary content")
    return raw.decode("utf-8", "replace").replace("\0", "")


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _runs(xml: bytes, texts: set[str], breaks: set[str], tabs: frozenset[str] = frozenset(("tab",))) -> str:
    out: list[str] = []

    def walk(e) -> None:
        if _local(e) in texts and e.text:
            out.append(e.text)
        if _local(e) in tabs:
            out.append("\t")
        for child in e:
            walk(child)
            if texts == breaks and child.tail:
                out.append(child.tail)
        if _local(e) in breaks:
            out.append("\n")

    walk(ElementTree.fromstring(xml))
    return "".join(out)


def _numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def _sheets(z: zipfile.ZipFile, names: list[str]) -> str:
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s) == "si"]
    lines = []
    for name in _numbered(names, r"xl/worksheets/sheet\d+\.xml"):
        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e) == "row"):
            cells = []
            for c in (e for e in row if _local(e) == "c"):
                value = "".join(t.text or "" for t in c.iter() if _local(t) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            lines.append("\t".join(cells))
    return "\n".join(lines)


def _book(z: zipfile.ZipFile) -> str:
    root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
    opf = ElementTree.fromstring(z.read(root))
    items = {e.get("id"): e.get("href") for e in opf.iter() if _local(e) == "item"}
    spine = [items[e.get("idref")] for e in opf.iter() if _local(e) == "itemref" and e.get("idref") in items]
    return "\n".join(html_text(decode(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), h))))) for h in spine)


def container(raw: bytes) -> tuple[str, str]:
    """(text, kind) of a ZIP container of a known office or e-book format."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        names = z.namelist()
        if "word/document.xml" in names:
            parts = ["word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/(header\d+|footnotes|endnotes)\.xml", n))]
            return "".join(_runs(z.read(n), {"t"}, {"p", "br"}) for n in parts), "docx"
        if "xl/workbook.xml" in names:
            return _sheets(z, names), "xlsx"
        if "ppt/presentation.xml" in names:
            parts = _numbered(names, r"ppt/slides/slide\d+\.xml") + _numbered(names, r"ppt/notesSlides/notesSlide\d+\.xml")
            return "".join(_runs(z.read(n), {"t"}, {"p"}) for n in parts), "pptx"
        if "META-INF/container.xml" in names:
            return _book(z), "epub"
        if "content.xml" in names:
            return _runs(z.read("content.xml"), {"p", "h", "span"}, {"p", "h", "span"}).replace("\n\n", "\n"), "odf"
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError) as e:
        raise ParseError(f"damaged container: {e}") from e
    raise ParseError("a ZIP archive of no known document format")


def extract(path: str, raw: bytes, registry: dict[str, Callable[[bytes], str]] | None = None) -> tuple[str, str]:
    """(text, kind). An extractor given for the extension comes first, then signs in the content, then plain text."""
    ext = posixpath.splitext(path)[1].lower()
    if registry and ext in registry:
        return registry[ext](raw), "custom"
    if raw[:4] == b"PK\x03\x04":
        return container(raw)
    if ext in (".html", ".htm", ".xhtml"):
        return html_text(decode(raw)), "html"
    if ext == ".rtf" or raw[:5] == b"{\\rtf":
        return rtf_text(raw), "rtf"
    if raw[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        raise Unavailable("old office formats need an extractor of their own")
    if raw[:5] == b"%PDF-":
        raise Unavailable("PDF needs an extractor of its own")
    return decode(raw), "text"


def read_directory(spark: SparkSession, path: str, extensions: list[str] | None = None, excluded: str = EXCLUDED, most_bytes: int = MOST_BYTES, registry: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(uri, title, text, meta, error) of the files under path: by extension, outside excluded folders, up to most_bytes.
    A file that can't be read has an error and null text; a file without text has the error 'no text'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"]):
                stem, ext = posixpath.splitext(posixpath.basename(name))
                try:
                    text, kind = extract(name, bytes(raw), registry)
                    rows.append((name, stem, text, {"ext": ext, "kind": kind}, None) if text.strip() else (name, stem, None, {"ext": ext}, "no text"))
                except EngineError as e:
                    rows.append((name, stem, None, {"ext": ext}, f"{e.code}: {e}"))
            yield pd.DataFrame(rows, columns=["uri", "title", "text", "meta", "error"])

    wanted = "|".join(map(re.escape, extensions or EXTENSIONS))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter((F.col("length") <= most_bytes) & F.lower("path").rlike(rf"\.({wanted})$") & ~F.col("path").rlike(excluded))
    return files.select("path", "content").mapInPandas(run, "uri string, title string, text string, meta map<string,string>, error string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, kind, ok, note) for names, kind, ok, note in FORMATS for e in names.split()], "extension string, kind string, available boolean, note string")


def read_benchmark(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (doc_id, title, text), queries (query_id, text) and judgements (query_id, doc_id, grade) of a retrieval benchmark's folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").withColumnRenamed("_id", "query_id")
    lines = spark.read.option("sep", "\t").schema("query_id string, doc_id string, grade string").csv(f"{path}/qrels/{split}.tsv")
    judged = lines.filter(F.col("grade").try_cast("int").isNotNull()).select("query_id", "doc_id", F.col("grade").try_cast("int").alias("grade"))
    return corpus, queries, judged
