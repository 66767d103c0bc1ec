"""Web pages as text segments.

A parser reads a page once, without making a tree: it lists the page's lines of text, and blocks and likely content
roots as intervals of that list. What counts as noise, which root is the content, and which lines a block keeps are column
expressions over those lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import row_texts

# Fixed values.
SKIPPED = ("script", "style", "noscript", "template", "svg")
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table")
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside")
BOILERPLATE_WORDS = ("nav", "navbar", "breadcrumb", "footer", "header", "sidebar", "menu", "toolbar", "pagination", "copyright")
CONTENT_SELECTORS = (
    ".UCAP-CONTENT", ".pages_content", ".TRS_UEDITOR", ".trs_editor_view", ".BodyLabel", ".main-content", ".policyLibraryOverview_content",
    ".my_doccontent", ".TRS_Editor", "main", "article", "[role=main]", ".article", ".content", "#content",
)
NOISE_PATTERNS = (
    "(首页|登录|注册|退出|个人中心|邮箱|无障碍|EN|简|繁|默认|大|超大|关闭|返回|回到顶部)",
    "(打印|收藏|留言|分享|分享到微信朋友圈|扫一扫|纠错|客户端|微博|微信|二维码|热门检索)[:：]?.*",
    "当前位置[:：]?.*",
    "您现在的位置[:：]?.*",
    "字号[:：]?.*",
    r"【\s*(大|中|小|打印此页|关闭窗口)\s*】",
    "网站标识码.*",
    "京ICP备.*",
    "京公网安备.*",
    "版权所有.*",
)
NOISE_TERMS = ("登录", "注册", "热门检索", "分享", "扫一扫", "打印", "首页", "当前位置", "个人中心", "无障碍", "客户端", "网站标识码")
METADATA_LABELS = ("索引号", "主题分类", "发文机关", "成文日期", "标题", "发文字号", "发布日期", "来源", "来 源")
LEAST_CJK, LONG_LINE, LONG_WORTH, LINK_COST, NOISE_COST = 40, 20, 40, 2, 120
LEAST_LABELS, METADATA_CHARS = 3, 1200
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_BOILERPLATE = re.compile(rf"\b({'|'.join(BOILERPLATE_WORDS)})\b")
_GAPS = re.compile(r"\s+")
_BODY = len(CONTENT_SELECTORS)

#: line: key is the text folded and without white space, prev the line before with the same key. block and root: lines
#: [first, last); a root also covers blocks [low, high).
PAGE = (
    "lines array<struct<text:string,key:string,prev:int,link:boolean>>, "
    "blocks array<struct<tag:string,first:int,last:int,shut:boolean,caption:string,cells:array<array<string>>>>, "
    "roots array<struct<pick:int,first:int,last:int,low:int,high:int>>"
)
PARTS = ("lines", "blocks", "roots")
#: Pages, and bytes of pages, whose lists a task holds at once.
PAGES, STRETCH = 256, 1 << 20


class _Lister(HTMLParser):
    """Lines, blocks and roots of one page, collected while its tags go by."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, int, bool]] = []
        self.seen: dict[str, int] = {}
        self.blocks: list[list] = []
        self.roots: list[list[int]] = []
        # (tag, shut off as boilerplate, block, roots, cell) of every open element.
        self.open: list[tuple[str, bool, list | None, list[list[int]], list[str] | None]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.hidden += 1
        if tag in SKIPPED or tag in VOID or self.hidden:
            return
        own = {k: v or "" for k, v in attrs}
        marks = " ".join(own.get(k, "") for k in ("class", "id", "role", "aria-label")).casefold()
        shut = bool(self.open and self.open[-1][1]) or tag in BOILERPLATE_TAGS or bool(_BOILERPLATE.search(marks))
        known = {tag, "#" + own.get("id", ""), f"[role={own.get('role', '')}]", *("." + c for c in own.get("class", "").split())}
        picks = [i for i, s in enumerate(CONTENT_SELECTORS) if s in known] or ([_BODY] if tag == "body" else [])
        roots = [[i, len(self.lines), 0, len(self.blocks), 0] for i in picks[:1]]
        self.roots += roots
        block, cell = None, None
        if tag in BLOCKS:
            block = [tag, len(self.lines), 0, shut, None, []]
            self.blocks.append(block)
        elif tag == "tr":
            for table in self._tables():
                table[5].append([])
        elif tag in ("th", "td"):
            cell = []
        elif tag == "caption":
            cell = []
        self.open.append((tag, shut, block, roots, cell))

    def _tables(self) -> list[list]:
        return [b for t, _, b, _, _ in self.open if t == "table" and b is not None]

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif any(e[0] == tag for e in self.open):
            while self.close_one() != tag:
                pass

    def close_one(self) -> str:
        tag, _, block, roots, cell = self.open.pop()
        if block is not None:
            block[2] = len(self.lines)
        for r in roots:
            r[2], r[4] = len(self.lines), len(self.blocks)
        if cell is not None:
            text = _GAPS.sub(" ", " ".join(cell)).strip()
            for table in self._tables():
                if tag == "caption":
                    table[4] = table[4] or text
                elif table[5]:
                    table[5][-1].append(text)
        return tag

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        link = any(e[0] == "a" for e in self.open)
        for part in re.split(r"\r\n|\r|\n", data):
            text = re.sub(r"[ \t\xa0]+", " ", part.replace("\0", "")).strip()
            if text:
                key = _GAPS.sub("", text).casefold()
                self.lines.append((text, key, self.seen.get(key, -1), link))
                self.seen[key] = len(self.lines) - 1
                for *_, cell in self.open:
                    if cell is not None:
                        cell.append(text)


def listed(html: str) -> tuple[list, list, list]:
    """lines, blocks and roots of a page, roots by selector and place; the last one is all of the page."""
    page = _Lister()
    page.feed(html)
    page.close()
    while page.open:
        page.close_one()
    roots = sorted(page.roots, key=lambda r: r[0])
    return page.lines, page.blocks, [*roots, [_BODY + 1, 0, len(page.lines), 0, len(page.blocks)]]


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """pages(key, html) with the columns PAGE; null pages are left out, nothing is shuffled. A task holds the lists of one stretch of at most PAGES pages, or of one page over STRETCH bytes, at a time."""
    made = pages.select(key, F.col(html).alias("_html")).where("_html <> ''")
    kinds = [to_arrow_type(made.sparkSession.createDataFrame([], PAGE).schema[c].dataType) for c in PARTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch["_html"]).to_numpy())
            low = 0
            while low < len(batch):
                high = min(low + PAGES, max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STRETCH, "right"))))
                part = batch.slice(low, high - low)
                columns = list(zip(*(listed(h.as_py()) for h in part["_html"]), strict=True))
                yield pa.RecordBatch.from_arrays([part[key], *[pa.array([[tuple(x) for x in rows] for rows in c], t) for c, t in zip(columns, kinds, strict=True)]], [key, *PARTS])
                low = high

    return made.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, {PAGE}")


def is_noise(key: Column) -> Column:
    """Whether a line, given folded and without white space, says nothing: very short, a noise pattern, or short with a noise term."""
    short = (F.length(key) <= 2) & ~key.rlike("[一-鿿]{2}")
    pattern = key.rlike(f"(?i)^({'|'.join(NOISE_PATTERNS)})$")
    return (key == "") | short | pattern | ((F.length(key) <= 12) & key.rlike("|".join(NOISE_TERMS)))


def _own(lines: Column, part: Column) -> Column:
    """The lines of a block or root that it keeps: no noise, the first of equal ones."""
    return F.filter(F.slice(lines, part.first + 1, part.last - part.first), lambda x: ~x.noise & (x.prev < part.first))


def root_score(lines: Column, root: Column) -> Column:
    """CJK characters, 40 for each long line, less 2 for each character of a link and 120 for each noise term; 0 under 40 CJK characters."""
    add = lambda field, rows: F.aggregate(rows, F.lit(0), lambda a, x: a + x[field])
    own = _own(lines, root)
    links = add("linked", F.slice(lines, root.first + 1, root.last - root.first))
    return F.when(add("cjk", own) < LEAST_CJK, 0).otherwise(add("cjk", own) + LONG_WORTH * add("long", own) - LINK_COST * links - NOISE_COST * add("hits", own))


def is_metadata(text: Column) -> Column:
    flat = F.replace(text, F.lit(" "), F.lit(""))
    hits = sum((F.contains(flat, F.lit(m)).cast("int") for m in METADATA_LABELS[1:]), F.contains(flat, F.lit(METADATA_LABELS[0])).cast("int"))
    return (hits >= LEAST_LABELS) & (F.length(text) < METADATA_CHARS)


def page_segments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages(key, html) as (key, paragraph_index, tag, text, section_title): the blocks of the content root that are not
    boilerplate; a table gives one row text for each data row, captioned by its caption or section. A page without a block gives its text."""
    rows = page_parts(pages, key, html)
    count = lambda text, pattern: F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))
    hits = lambda text: sum(((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t) for t in NOISE_TERMS[1:]), (F.length(text) - F.length(F.replace(text, F.lit(NOISE_TERMS[0]), F.lit("")))) / len(NOISE_TERMS[0])).cast("int")
    marked = F.transform("lines", lambda x: F.struct(
        x.text.alias("text"), x.prev.alias("prev"), is_noise(x.key).alias("noise"), count(x.text, "一-鿿").alias("cjk"), (F.length(x.text) >= LONG_LINE).cast("int").alias("long"),
        F.when(x.link, count(x.text, "一-鿿A-Za-z0-9")).otherwise(0).alias("linked"), hits(x.text).alias("hits"),
    ))
    rows = rows.withColumn("lines", marked)
    scored = F.transform(F.filter("roots", lambda r: r.pick < _BODY), lambda r, i: F.struct(root_score(F.col("lines"), r).alias("score"), (-i).alias("early"), r.alias("root")))
    best = F.array_max(F.filter(scored, lambda s: s.score > 0)).root
    rows = rows.withColumn("root", F.coalesce(best, F.get(F.filter("roots", lambda r: r.pick >= _BODY), F.lit(0))))
    inside = F.filter(F.slice("blocks", F.col("root.low") + 1, F.col("root.high") - F.col("root.low")), lambda b: ~b.shut)
    texts = F.transform(inside, lambda b: F.struct(b.tag.alias("tag"), b.caption.alias("caption"), b.cells.alias("cells"), F.array_join(F.transform(_own(F.col("lines"), b), lambda x: x.text), "\n").alias("text"), b.first.alias("first")))
    kept = F.filter(texts, lambda b: F.when(b.tag == "table", ~is_metadata(b.text)).otherwise(b.text != ""))
    rows = rows.withColumn("kept", kept).withColumn("heads", F.filter("kept", lambda b: F.startswith(b.tag, F.lit("h"))))
    # Headings are few; a block's section is the last one that begins no later.
    section = lambda b: F.get(F.filter("heads", lambda h: h.first <= b.first), F.size(F.filter("heads", lambda h: h.first <= b.first)) - 1).text
    parts = F.flatten(F.transform("kept", lambda b: F.transform(
        F.when(b.tag == "table", row_texts(b.cells, F.coalesce(F.nullif(b.caption, F.lit("")), section(b)))).otherwise(F.array(b.text)),
        lambda t: F.struct(b.tag.alias("tag"), t.alias("text"), section(b).alias("section_title")),
    )))
    whole = F.array_join(F.transform("lines", lambda x: x.text), "\n")
    nothing = F.when(whole != "", F.array(F.struct(F.lit("body").alias("tag"), whole.alias("text"), F.lit(None).cast("string").alias("section_title"))))
    rows = rows.select(key, F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(nothing)).alias("pos", "s"))
    return rows.select(key, (F.col("pos") + 1).alias("paragraph_index"), "s.tag", "s.text", "s.section_title")
