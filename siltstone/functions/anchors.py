"""Anchors, references and labels that rules read off questions and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed values.
MARKER_PUNCTUATION = "，。；：、,.!?！？;:()（）[]【】\"' "
WEAK_ANCHORS = (
    ("date_only", r"^(?:截至)?\d{4}年\d{1,2}月\d{1,2}日$"),
    ("period_only", r"^(?:截至)?\d{4}年(?:年)?(?:末|底|初|度|上半年|下半年|半年度|[一二三四1-4]季度)$"),
    ("row_number_only", r"^序号为\d+$"),
    ("numeric_only", r"^\d+(?:\.\d+)?(?:万?元|亿元|%|％|倍|条)?$"),
    ("article_fragment", r"^\d+(?:\.\d+)?条$"),
    ("pdf_extraction_fragment", "说明书人作为"),
)
LATEST, PREVIOUS = "最新|latest|newest|current", "上一版|前一版|previous|prior"
COMPARE, VERSION_NOUN = "比较|对比|差异|改了什么|compare|diff|changed", "版本|version"


def marker_key(value: Column | str) -> Column:
    return F.translate(F.regexp_replace(T.fold(value), r"(?U)\s+", " "), MARKER_PUNCTUATION, "")


def quoted(value: Column | str, low: int = 2, high: int = 240) -> Column:
    """Spans in curly, then in straight quotes, distinct, first order kept."""
    v = T.text(value)
    spans = [F.regexp_extract_all(v, F.lit(f"{a}([^{b}]{{{low},{high}}}){b}"), 1) for a, b in (("“", "”"), ('"', '"'))]
    return F.array_distinct(F.filter(F.transform(F.concat(*spans), T.squeeze), lambda s: s != ""))


def weak_anchor_reasons(anchor: Column | str) -> Column:
    flat = F.regexp_replace(T.text(anchor), r"(?U)\s+", "")
    short = F.when(F.length(F.regexp_replace(flat, f"[^{T.CJK}A-Za-z0-9.%％]+", "")) < 6, "too_short")
    return F.array_compact(F.array(short, *[F.when(flat.rlike(p), name) for name, p in WEAK_ANCHORS]))


def version_reference(question: Column | str, side: str) -> Column:
    """ "v2", "previous" or "latest" for the from or the to side of a comparison; null if the question names none."""
    found = F.regexp_extract_all(T.text(question), F.lit(r"(?i)v\s*(\d+)"), 1)
    named = lambda i: F.concat(F.lit("v"), F.get(found, F.lit(i)))
    low = F.lower(T.text(question))
    if side == "from":
        return F.when(F.size(found) >= 1, named(0)).when(low.rlike(PREVIOUS), "previous")
    return F.when(F.size(found) >= 2, named(1)).when(F.size(found) == 1, "latest").when(low.rlike(LATEST), "latest")


def is_version_comparison(question: Column | str) -> Column:
    low = F.lower(F.trim(T.text(question)))
    direct = low.rlike(rf"v\s*\d+|{PREVIOUS}|{LATEST}") & low.rlike(COMPARE)
    near = low.rlike(rf"({VERSION_NOUN}).{{0,16}}({COMPARE})") | low.rlike(rf"({COMPARE}).{{0,16}}({VERSION_NOUN})")
    return direct | near


def resolve_version(reference: Column, versions: Column) -> Column:
    """The version number that a reference means among descending version numbers."""
    low = F.lower(F.trim(reference))
    number = F.nullif(F.regexp_extract(low, r"^v?\s*(\d+)$", 1), F.lit("")).cast("int")
    return (
        F.when(low.isin("latest", "newest", "current", "最新", "当前"), F.get(versions, F.lit(0)))
        .when(low.isin("previous", "prior", "上一版", "前一版"), F.get(versions, F.lit(1)))
        .otherwise(F.get(F.filter(versions, lambda v: v == number), F.lit(0)))
    )


def location_label(page: Column, paragraph: Column, index: Column) -> Column:
    return (
        F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页")))
        .when(F.coalesce(paragraph, F.lit(0)) > 0, F.concat(F.lit("第 "), paragraph.cast("string"), F.lit(" 段")))
        .when(index.isNotNull(), F.concat(F.lit("分块 "), index.cast("string")))
    )


def citation_identity(chunk_id: Column, *rest: Column) -> Column:
    """chunk:id, else the other parts joined."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in rest])
    return F.when(F.coalesce(chunk_id.cast("string"), F.lit("")) != "", F.concat(F.lit("chunk:"), chunk_id.cast("string"))).otherwise(joined)


def law_and_article(name: Column | str) -> Column:
    """Struct (law_name, article_name) of a clause's full name, cut at its article number."""
    flat = T.squeeze(name)
    article = F.regexp_extract(flat, f"({T.ARTICLE_PATTERN})", 1)
    law = F.trim(F.get(F.split(flat, T.ARTICLE_PATTERN, 2), F.lit(0)))
    none = article == ""
    return F.struct(F.when(none | (law == ""), flat).otherwise(law).alias("law_name"), F.when(none, flat).otherwise(article).alias("article_name"))
