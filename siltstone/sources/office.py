"""Files of all kinds as segments: each is routed by its suffix, office files are unpacked with the standard library, and what can't be read becomes
a row with its reason instead of an exception.

Unpacking (zip and XML) is one vectorised function that lists a file's blocks; sections, table texts and offsets are columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .files import markdown_segments
from .html import page_segments
from .tables import row_texts

# Fixed values.
TEXT, MARKDOWN, PAGES, TABLES, OFFICE, SCANS = (".txt",), (".md", ".markdown"), (".html", ".htm"), (".csv",), (".docx", ".xlsx", ".pptx"), (".pdf", ".png", ".jpg", ".jpeg", ".xls")
HEADER_WORDS = "类型|场景|审批|审批人|职责|责任|时限|周期|材料|备注|等级|条件|方式|对象|要求|字段|问题|回答|依据|是否|负责人|完成|证据|影响|角色"
DATA_LIKE = "[0-9]|万元|工作日|小时|天|年|L[1-4]|P[1-4]|是|否"
PLACEHOLDER = r"(?i)^(unnamed(:\s*\d+)?|nan|none|null)$"
NUMBER = r"^[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?$"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: kind: heading, text or table; part: sheet or slide.
BLOCKS = "array<struct<kind:string,part:int,part_name:string,text:string,rows:array<array<string>>>>"
SEGMENT = "path string, paragraph_index int, text string, section_title string"


def _word(z: zipfile.ZipFile) -> Iterator[tuple]:
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            names[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "") or ""
    text = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            own = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
            yield "heading" if own.lower().startswith("heading") else "text", 0, None, text(e), None
        elif e.tag == f"{_W}tbl":
            yield "table", 0, None, "", [["\n".join(text(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
        rows = []
        for r in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/"))).iter(f"{_S}row"):
            cells: list[str] = []
            for c in r.findall(f"{_S}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                column = 0
                for ch in letters:
                    column = 26 * column + ord(ch) - 64
                cells += [""] * max(0, column - 1 - len(cells))
                value, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                raw = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (value.text or "" if value is not None else "")
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
            rows.append(cells)
        yield "heading", n, sheet.get("name"), sheet.get("name") or "", None
        yield "table", n, sheet.get("name"), "", rows


def _slides(z: zipfile.ZipFile) -> Iterator[tuple]:
    slides = sorted((int(m[1]), name) for name in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))
    for n, name in slides:
        root, titled = ElementTree.fromstring(z.read(name)), False
        tables = [[["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in t.findall(f"{_A}tr")] for t in root.iter(f"{_A}tbl")]
        inside = {id(p) for t in root.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
        for p in root.iter(f"{_A}p"):
            text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
            if text and id(p) not in inside:
                yield "text" if titled else "heading", n, None, text, None
                titled = True
        for rows in tables:
            yield "table", n, None, "", rows


_UNPACK = {".docx": _word, ".xlsx": _sheets, ".pptx": _slides}


def office_blocks(files: DataFrame) -> DataFrame:
    """files(path, suffix, content) of .docx, .xlsx and .pptx files with the columns blocks (as BLOCKS, in order) and error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, suffix, content in zip(f["path"], f["suffix"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out.append((path, suffix, list(_UNPACK[suffix](z)), None))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    out.append((path, suffix, [], f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "suffix", "blocks", "error"])

    return files.select("path", "suffix", "content").mapInPandas(run, f"path string, suffix string, blocks {BLOCKS}, error string")


def is_title_row(first: Column, second: Column) -> Column:
    """Whether a sheet's first row is a title over the header: one cell that says something, before a row of two or more of which few are numbers."""
    says = lambda r: F.filter(r, lambda c: (c != "") & ~c.rlike(PLACEHOLDER))
    numbers = F.size(F.filter(says(second), lambda c: c.rlike(NUMBER)))
    return (F.size(says(first)) == 1) & (F.size(first) - 1 >= F.greatest(F.lit(1), F.size(first) - 1)) & (F.size(says(second)) >= 2) & (numbers <= F.floor(F.size(says(second)) / 3))


def is_header_row(row: Column, following: Column | None = None) -> Column:
    """Whether a table row reads like a header: header words in a third of its cells, or short cells above a row with more data, or only short cells without data."""
    cells = F.filter(row, lambda c: F.coalesce(c, F.lit("")) != "")
    n = F.size(cells)
    words = F.size(F.filter(cells, lambda c: c.rlike(HEADER_WORDS)))
    short, data = F.size(F.filter(cells, lambda c: F.length(c) <= 18)), F.size(F.filter(cells, lambda c: c.rlike(DATA_LIKE)))
    below = F.size(F.filter(following, lambda c: F.coalesce(c, F.lit("")).rlike(DATA_LIKE))) if following is not None else F.lit(0)
    contrast = (short >= F.greatest(F.lit(2), n - 1)) & (F.coalesce(below, F.lit(0)) > data)
    return (n >= 2) & ((words >= F.greatest(F.lit(1), F.floor(n / 3))) | contrast | ((short == n) & (data == 0)))


def joined_lines(value: Column | str) -> Column:
    """Lines of a page joined to paragraphs: a blank line or a heading ends one; CJK text is joined without a blank. Paragraphs are parted by two line ends."""
    lines = F.transform(F.split(F.regexp_replace(T.text(value), "\r\n|\r", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    heading = rf"^(?:#{{1,6}}\s+\S.*|第[一二三四五六七八九十百千0-9]+[章节条].{{0,40}}|[一二三四五六七八九十]+、.{{1,40}}|[0-9]+(?:\.[0-9]+)*[、.]\s*\S.{{0,40}})$"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, line):
        close = (line == "") | line.rlike(heading)
        glue = F.when(s.now.rlike("[一-鿿，、；：（《]$") & line.rlike("^[一-鿿，。、；：）》]"), F.lit("")).otherwise(F.lit(" "))
        grown = F.when(s.now == "", line).otherwise(F.concat(s.now, glue, line))
        kept = F.when(close & (s.now != ""), F.concat(s.done, F.array(s.now))).otherwise(s.done)
        return F.struct(F.when(close & (line != ""), F.concat(kept, F.array(line))).otherwise(kept).alias("done"), F.when(close, F.lit("")).otherwise(grown).alias("now"))

    return F.aggregate(lines, start, step, lambda s: F.array_join(F.when(s.now != "", F.concat(s.done, F.array(s.now))).otherwise(s.done), "\n\n"))


def office_segments(files: DataFrame) -> DataFrame:
    """files(path, suffix, content) as SEGMENT rows: headings begin sections ("Sheet: name", "Slide n: title"), tables give one text for each data row under their section, and a title row
    over a sheet's table becomes part of the caption."""
    made = office_blocks(files)
    rows = made.select("path", "suffix", F.posexplode("blocks").alias("pos", "b"))
    text = T.squeeze("b.text")
    name = F.when(F.col("suffix") == ".xlsx", F.when(F.lower(text).startswith("sheet:"), text).otherwise(F.concat(F.lit("Sheet: "), text))).when((F.col("suffix") == ".pptx") & ~text.rlike(r"(?i)^slide\s+\d+\s*:"), F.concat(F.lit("Slide "), F.col("b.part").cast("string"), F.lit(": "), text)).otherwise(text)
    w = W.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("section_title", F.last(F.when((F.col("b.kind") == "heading") & (text != ""), name), ignorenulls=True).over(w))
    cells = F.filter(F.transform(F.col("b.rows"), lambda r: F.transform(r, T.squeeze)), lambda r: F.exists(r, lambda c: c != ""))
    titled = (F.col("suffix") == ".xlsx") & (F.size(cells) >= 2) & is_title_row(F.get(cells, F.lit(0)), F.get(cells, F.lit(1)))
    title = F.get(F.filter(F.get(cells, F.lit(0)), lambda c: (c != "") & ~c.rlike(PLACEHOLDER)), F.lit(0))
    caption = F.when(titled & ~F.contains(F.lower(T.text("section_title")), F.lower(title)), F.concat_ws(" / ", "section_title", title)).otherwise(F.col("section_title"))
    table = row_texts(F.when(titled, F.slice(cells, 2, 1_000_000)).otherwise(cells), caption)
    parts = F.when(F.col("b.kind") == "table", table).otherwise(F.array(F.when((F.col("suffix") == ".docx") | (F.col("b.kind") == "text"), text).otherwise(name)))
    out = rows.select("path", "section_title", "pos", F.posexplode(parts).alias("k", "text")).where("text <> ''")
    return out.select("path", F.row_number().over(W.partitionBy("path").orderBy("pos", "k")).alias("paragraph_index"), "text", "section_title")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 (a byte order mark is dropped), else Latin-1. GB18030, which no built-in decoder reads, is for gb18030()."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), "^﻿", "")


@F.pandas_udf(StringType())
def gb18030(content: pd.Series) -> pd.Series:
    """Bytes as text, where they are valid GB18030."""

    def one(raw: bytes | None) -> str | None:
        try:
            return raw.decode("gb18030") if raw is not None else None
        except UnicodeDecodeError:
            return None

    return content.map(one)


def read_text_content(content: Column) -> Column:
    valid = F.try_validate_utf8(content.cast("string")).isNotNull()
    return F.when(valid, decoded(content)).otherwise(F.coalesce(gb18030(content), decoded(content)))


def with_offsets(segments: DataFrame, key: str = "path") -> DataFrame:
    """Segments with char_start and char_end, as if a file's segments were joined by two line ends."""
    before = F.coalesce(F.sum(F.length("text") + 2).over(W.partitionBy(key).orderBy("paragraph_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return segments.withColumn("char_start", before).withColumn("char_end", F.col("char_start") + F.length("text"))


def parse_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, errors) of a folder's files. segments: SEGMENT with char_start and char_end; errors(path, error): unknown suffixes, files that need an OCR or PDF engine, and
    files that are broken or empty."""
    files = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content")
    own = lambda kinds: files.where(F.col("suffix").isin(*kinds))
    text = lambda kinds: own(kinds).select("path", read_text_content(F.col("content")).alias("content"))
    blank = F.filter(F.transform(F.split(F.regexp_replace("content", "\r\n|\r", "\n"), r"\n\s*\n+"), T.plain), lambda p: p != "")
    plain = text(TEXT).select("path", F.posexplode(blank).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("paragraph_index"), "text", F.lit(None).cast("string").alias("section_title"))
    marked = markdown_segments(text(MARKDOWN).withColumnRenamed("path", "document_id")).withColumnRenamed("document_id", "path")
    pages = page_segments(text(PAGES), "path", "content").drop("tag")
    from .tables import csv_cells

    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    sheets = text(TABLES).select("path", F.posexplode(row_texts(csv_cells(F.col("content")), stem)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("paragraph_index"), "text", F.lit(None).cast("string").alias("section_title"))
    names = ["path", "paragraph_index", "text", "section_title"]
    parts = office_segments(own(OFFICE))
    for df in (plain, marked, pages, sheets):
        parts = parts.unionByName(df.select(*names))
    known = (*TEXT, *MARKDOWN, *PAGES, *TABLES, *OFFICE)
    reason = F.when(F.col("suffix").isin(*SCANS), F.concat(F.lit("no engine for "), "suffix")).when(~F.col("suffix").isin(*known), F.concat(F.lit("unsupported file type "), "suffix"))
    broken = office_blocks(own(OFFICE)).where("error is not null").select("path", "error")
    empty = files.where(F.col("suffix").isin(*known)).select("path").join(parts.select("path").distinct(), "path", "left_anti").join(broken, "path", "left_anti").select("path", F.lit("no text").alias("error"))
    errors = files.select("path", reason.alias("error")).where("error is not null").unionByName(broken).unionByName(empty)
    return with_offsets(parts), errors


def inline_image(src: Column) -> Column:
    """Struct (kind, bytes, path) of an image source: the bytes of a data URL, or a relative path that does not leave its folder; null for anything else."""
    data = F.regexp_extract(src, r"(?is)^data:image/[a-z0-9.+-]+;base64,(.+)$", 1)
    local = ~src.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~F.startswith(src, F.lit("/")) & ~src.rlike(r"(^|/)\.\.(/|$)")
    return F.when(data != "", F.struct(F.lit("data").alias("kind"), F.expr("null").cast("string").alias("path"), F.try_to_binary(F.regexp_replace(data, r"\s+", ""), F.lit("base64")).alias("bytes"))).when(local & (src != ""), F.struct(F.lit("file").alias("kind"), src.alias("path"), F.lit(None).cast("binary").alias("bytes")))


def visible_lines(pages: DataFrame, noise: str, starts: str, footer: str) -> DataFrame:
    """pages(page_id, title, content) as (page_id, pos, line): trimmed lines without noise, the title and repeats (the first stays), from the first that matches ``starts`` to before
    the first after it that matches ``footer``; all of them where none matches."""
    lines = pages.select("page_id", "title", F.posexplode(F.split(T.text("content"), "\r\n|\r|\n")).alias("pos", "raw")).withColumn("line", T.squeeze("raw"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(noise) & (F.col("line") != F.coalesce("title", F.lit(""))))
    first = F.row_number().over(W.partitionBy("page_id", "line").orderBy("pos"))
    lines = lines.withColumn("n", first).where("n = 1")
    w = W.partitionBy("page_id")
    begin = F.coalesce(F.min(F.when(F.col("line").rlike(starts), F.col("pos"))).over(w), F.lit(0))
    lines = lines.withColumn("begin", begin).withColumn("end", F.min(F.when(F.col("line").rlike(footer) & (F.col("pos") > F.col("begin")), F.col("pos"))).over(w))
    return lines.where("pos >= begin and (end is null or pos < end)").select("page_id", "pos", "line")
