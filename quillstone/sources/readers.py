"""Readers: directory scans, document units, JSON lines, manifests, snapshots."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillstone.functions.text import book_rank

FILE_SCHEMA = "path string, filename string, ext string, mtime timestamp, size long, rank int, sha256 string"
UNIT_SCHEMA = "doc_name string, source_type string, loc_kind string, loc_page int, loc_anchor string, seq int, text string"
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """FILE_SCHEMA rows of a folder's files. The content is read once, for the digest, and goes no further."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    made = files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), book_rank(name).alias("rank"), F.sha2("content", 256).alias("sha256"))
    return made.orderBy(F.desc("rank"), F.lower("filename"), "filename")


def discovered(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """(path) of the folder's files of these kinds, whatever the case of their endings, in order. Contents are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*kinds)).orderBy("path")


MANIFEST_FIELDS = ["filename string", "path string", "ext string", "mtime long", "size long", "rank int", "sha256 string"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST_FIELDS rows of a JSON manifest ({"version": …, "files": {filename: {…}}}). A missing or broken file has no rows."""
    entry = ", ".join(f.replace(" ", ": ") for f in MANIFEST_FIELDS)
    reader = spark.read.schema(f"version long, files map<string, struct<{entry}>>").option("multiLine", True)
    try:
        whole = reader.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(MANIFEST_FIELDS))
    return whole.select(F.explode(F.map_values("files")).alias("f")).select("f.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def docx_paragraphs(path: str) -> list[tuple[str, str]]:
    """(style, text) of the non-empty paragraphs of a .docx file."""
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{WORD_NS}p"):
        text = "".join(t.text or "" for t in p.iter(f"{WORD_NS}t")).strip()
        style = p.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
        if text:
            out.append((style.get(f"{WORD_NS}val", "") if style is not None else "", text))
    return out


def section_units(paragraphs: list[tuple[str, str]], most: int = 6000) -> Iterator[tuple[str, str]]:
    """(anchor, text): paragraphs under one heading, in pieces that end once they reach ``most`` characters."""
    groups: dict[str, list[tuple[int, str]]] = {}
    heading = "Untitled"
    headed = any(style.lower().startswith("heading") for style, _ in paragraphs)
    for i, (style, text) in enumerate(paragraphs, 1):
        if style.strip().lower().startswith("heading"):
            heading = text
        else:
            groups.setdefault(heading, []).append((i, text))
    for name, members in groups.items():
        held, size = [], 0
        for n, (i, text) in enumerate(members):
            held.append((i, text))
            size += len(text) + 1
            if size >= most or n + 1 == len(members):
                span = f"Paragraphs {held[0][0]}–{held[-1][0]}"
                yield (f'Section: "{name}" ({span})' if headed else span), "\n".join(t for _, t in held)
                held, size = [], 0


def text_pages(path: str) -> list[str]:
    """Pages of a plain-text file, divided by form feeds."""
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read().split("\f")


#: Extension -> function from path to pages. A PDF parser is registered by the user.
PAGE_PARSERS: dict[str, Callable[[str], list[str]]] = {".txt": text_pages}


#: Bytes of a splittable file that a task reads; pages belong to the task in whose range they begin.
SPLIT_BYTES = 1 << 20
#: Lines at the top and the bottom of a page that can be headers or footers.
EDGE_LINES = 2


def text_range(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(number, text) of the pages of a plain-text file that begin in [start, end); pages are counted from the file's first byte, which is quick."""
    with open(path, "rb") as f:
        before, at = 0, 0
        while at < start:
            chunk = f.read(min(SPLIT_BYTES, start - at))
            if not chunk:
                return
            before, at, last = before + chunk.count(b"\f"), at + len(chunk), chunk[-1:]
        number, held = before + 1, b""
        if start and last != b"\f":  # the page at the border began in the range before
            skipped = b""
            while b"\f" not in skipped:
                skipped = f.read(SPLIT_BYTES)
                if not skipped:
                    return
                at += len(skipped)
            at -= len(skipped) - skipped.index(b"\f") - 1
            f.seek(at)
            number += 1
        while at < end:
            chunk = f.read(SPLIT_BYTES)
            pages = (held + chunk).split(b"\f")
            held = pages.pop() if chunk else b""
            for page in pages:
                if at >= end:
                    return
                yield number, page.decode("utf-8", "replace")
                number, at = number + 1, at + len(page) + 1
            if not chunk:
                return


#: Extension -> function from path, first and last byte to numbered pages, for files that several tasks can share.
RANGE_PARSERS: dict[str, Callable[[str, int, int], Iterator[tuple[int, str]]]] = {".txt": text_range}


def edges(text: str) -> str:
    """The lines of a page that can be headers or footers."""
    kept = [x for x in text.split("\n") if x.strip()]
    return "\n".join(kept if len(kept) <= 2 * EDGE_LINES else kept[:EDGE_LINES] + kept[-EDGE_LINES:])


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int | None = None):
        self.path, self.start, self.end = path, start, end


class _UnitReader(DataSourceReader):
    def __init__(self, options: dict, parsers: dict, ranges: dict):
        self.folder, self.parsers, self.ranges = options["path"], parsers, ranges
        self.edges = options.get("edges", "false").lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files that a filter on doc_name leaves out are not opened. Other filters are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("doc_name",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self):
        known = {*self.parsers, *self.ranges, ".docx"}
        names = sorted(n for n in os.listdir(self.folder) if os.path.splitext(n)[1].lower() in known and (self.wanted is None or n in self.wanted))
        out = []
        for path in (os.path.join(self.folder, n) for n in names):
            size = os.path.getsize(path) if os.path.splitext(path)[1].lower() in self.ranges else 0
            out += [_File(path, a, min(a + SPLIT_BYTES, size)) for a in range(0, size, SPLIT_BYTES)] or [_File(path)]
        return out or [_File("")]

    def pages(self, partition: _File, ext: str) -> Iterator[tuple[int, str]]:
        if ext in self.ranges and partition.end is not None:
            return self.ranges[ext](partition.path, partition.start, partition.end)
        return iter(enumerate(self.parsers[ext](partition.path) if ext in self.parsers else [], 1))

    def read(self, partition):
        if not partition.path:
            return
        name = os.path.basename(partition.path)
        ext = os.path.splitext(name)[1].lower()
        try:
            if ext == ".docx":
                for i, (anchor, text) in enumerate(section_units(docx_paragraphs(partition.path))):
                    yield name, "docx", "section" if anchor.startswith("Section") else "paragraphs", None, anchor, i, text
            else:
                for i, text in self.pages(partition, ext):
                    if text.strip():
                        yield name, ext[1:], "page", i, None, i, edges(text) if self.edges else text
        except (OSError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return  # an unreadable file has no units


class DocumentUnits(DataSource):
    """``spark.read.format("document_units").load(folder)``: a partition for each file, or for each range of a large file that can be split. Option ``edges``: only the lines that can be headers or footers."""

    @classmethod
    def name(cls):
        return "document_units"

    def schema(self):
        return UNIT_SCHEMA

    def reader(self, schema):
        return _UnitReader(self.options, PAGE_PARSERS, RANGE_PARSERS)


def read_units(spark: SparkSession, folder: str, edges: bool = False) -> DataFrame:
    """UNIT_SCHEMA rows of a folder's files. Filters on doc_name reach the source (Spark passes them to Python sources by a setting, which is set here)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentUnits)
    return spark.read.format("document_units").option("edges", str(edges)).load(folder)
