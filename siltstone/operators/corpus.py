"""From documents to segments and chunks: the tables that retrieval reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

TARGET_CHARS, MAX_CHARS, OVERLAP = 900, 1200, 1


def segments(documents: DataFrame, separator: str = r"\n\s*\n+") -> DataFrame:
    """documents(document_id, content) as paragraphs: paragraph_index from 1, char_start and char_end as if joined by
    two line ends. Blank paragraphs are dropped; null content has none."""
    parts = F.filter(F.transform(F.split(T.text("content"), separator), lambda p: F.trim(p)), lambda p: p != "")
    rows = documents.select("document_id", F.posexplode(parts).alias("pos", "text"))
    before = F.sum(F.length("text") + 2).over(W.partitionBy("document_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    return rows.select("document_id", (F.col("pos") + 1).alias("paragraph_index"), "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"))


def split_large(parts: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Segments (document_id, paragraph_index, text, char_start, ...) of at most ``limit`` characters: longer ones as runs of whole sentences, greedily packed; one sentence
    that is longer stays whole. Pieces keep the segment's columns and get their own char_start and char_end."""
    # Ends of sentences as places in the text; a piece ends before the sentence that would make it too long.
    sentences = F.filter(F.split("text", r"(?<=[。！？.!?])\s+"), lambda s: F.trim(s) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state, s):
        longer = F.when(state.now == "", s).otherwise(F.concat(state.now, F.lit(" "), s))
        full = (state.now != "") & (F.length(longer) > limit)
        return F.struct(F.when(full, F.concat(state.done, F.array(state.now))).otherwise(state.done).alias("done"), F.when(full, s).otherwise(longer).alias("now"))

    packed = F.aggregate(sentences, start, step, lambda s: F.when(s.now != "", F.concat(s.done, F.array(s.now))).otherwise(s.done))
    pieces = F.when(F.length("text") > limit, packed).otherwise(F.array("text"))
    rest = [c for c in parts.columns if c not in ("text", "char_start", "char_end")]
    rows = parts.select(*rest, "text", "char_start", pieces.alias("pieces")).select(*rest, F.col("char_start").alias("_start"), F.posexplode("pieces").alias("piece", "text"), "pieces")
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("piece")), F.lit(0), lambda a, p: a + F.length(p) + 1)
    return rows.withColumn("char_start", F.col("_start") + before).withColumn("char_end", F.col("char_start") + F.length("text")).drop("_start", "pieces")


def dominant_section(own: Column) -> Column:
    """Of the segments (text, section_title) of a chunk, the section with most characters, the later one of equal ones; null without any."""
    named = F.filter(own, lambda s: F.coalesce(s.section_title, F.lit("")) != "")
    weight = lambda t: F.aggregate(F.filter(named, lambda s: s.section_title == t), F.lit(0), lambda a, s: a + F.length(s.text))
    titles = F.transform(named, lambda s, i: F.struct(weight(s.section_title).alias("w"), i.alias("i"), s.section_title.alias("t")))
    return F.array_max(titles).t


#: Metadata of segments that a chunk merges; fixed names.
SCALARS = {"parser_backend": "parser_backends", "source_format": "source_formats", "section_kind": "section_kinds", "sheet_name": "sheet_names", "slide_title": "slide_titles", "table_caption": "table_captions"}
RANGES, LISTS = ("slide_number", "table_row_index"), ("segment_kind",)


def merged_metadata(metas: Column) -> Column:
    """Citation metadata of a chunk from the maps of its segments: one value under its name, several as a JSON list under the plural; numbers as one or as _start and _end; kinds as a
    list; the first table headers."""
    values = lambda k: F.array_distinct(F.filter(F.transform(metas, lambda m: F.trim(F.element_at(m, k))), lambda v: v.isNotNull() & (v != "")))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    out = []
    for k, plural in SCALARS.items():
        v = values(k)
        out.append(F.when(F.size(v) == 1, entry(k, F.get(v, F.lit(0)))).when(F.size(v) > 1, entry(plural, F.to_json(v))))
    for k in RANGES:
        n = F.filter(F.transform(values(k), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
        low, high = F.array_min(n), F.array_max(n)
        out += [F.when(low == high, entry(k, low)), F.when(low != high, entry(f"{k}_start", low)), F.when(low != high, entry(f"{k}_end", high))]
    for k in LISTS:
        out.append(F.when(F.size(values(k)) > 0, entry(f"{k}s", F.to_json(values(k)))))
    heads = values("table_headers")
    out.append(F.when(F.size(heads) > 0, entry("table_headers", F.get(heads, F.lit(0)))))
    return F.map_from_entries(F.array_compact(F.array(*out)))


def _strong_block(t):
    article = rf"^(?:#{{1,6}}\s*)?第[一二三四五六七八九十百千万零〇0-9]+条$"
    return ~t.startswith("Table row:") & (t.rlike(article) | t.startswith("条款全称：") | t.rlike(r"^#{1,6}\s+\S") | t.rlike(r"^(?:[一二三四五六七八九十]+、|[0-9]+[.、])\S{2,40}$"))


def chunk_documents(parts: DataFrame, target: int = TARGET_CHARS, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Segments (document_id, paragraph_index, text, section_title) folded into chunks.

    A chunk ends before a table row that follows other text, a new section that the segment names, a strong
    structural block (unless it continues an article heading), and before ``target`` characters are exceeded; it
    also ends once ``limit`` is reached. Only the last two keep the last ``overlap`` segments for the next chunk. The
    state depends on the order, so it is one fold over a document's ordered segments, in the JVM.
    """
    has = lambda c, kind: (F.col(c) if c in parts.columns else F.lit(None)).cast(kind).alias(c)
    item = F.struct("paragraph_index", has("piece", "int"), F.col("text"), has("section_title", "string"), has("page_number", "int"), has("char_start", "int"), has("char_end", "int"), has("citation_metadata", "string"))
    folded = parts.groupBy("document_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    seg = "struct<paragraph_index:int,piece:int,text:string,section_title:string,page_number:int,char_start:int,char_end:int,citation_metadata:string>"
    zero = F.struct(F.array().cast(f"array<array<{seg}>>").alias("done"), F.array().cast(f"array<{seg}>").alias("buf"))
    size = lambda buf: F.aggregate(buf, F.lit(0), lambda a, x: a + F.length(x.text))
    row = lambda x: F.startswith(x.text, F.lit("Table row:"))

    def keep(buf):
        return F.slice(buf, F.greatest(F.lit(1), F.size(buf) - overlap + 1), F.lit(overlap)) if overlap else F.array().cast(f"array<{seg}>")

    def step(state, x):
        buf, body = state.buf, F.trim(x.text)
        some = F.size(buf) > 0
        table = row(x) & ~F.forall(buf, row)
        named = F.filter(buf, lambda b: F.coalesce(b.section_title, F.lit("")) != "")
        previous = F.when(F.size(named) > 0, F.element_at(named, -1).section_title)
        fresh = (F.coalesce(x.section_title, F.lit("")) != "") & (previous != x.section_title) & (F.regexp_replace(body, r"^#{1,6}\s*", "") == F.trim(x.section_title))
        heading = F.trim(F.get(buf, F.size(buf) - 1).text).rlike(r"^(?:#{1,6}\s*)?第[一二三四五六七八九十百千万零〇0-9]+条$")
        strong = _strong_block(body) & ~(F.startswith(body, F.lit("条款全称：")) & F.coalesce(heading, F.lit(False)))
        hard = some & (table | F.coalesce(fresh, F.lit(False)) | strong)
        soft = ~hard & some & (size(buf) + F.length(x.text) > target)
        done = F.when(hard | soft, F.concat(state.done, F.array(buf))).otherwise(state.done)
        left = F.when(hard, F.array().cast(f"array<{seg}>")).when(soft, keep(buf)).otherwise(buf)
        grown = F.concat(left, F.array(x))
        full = size(grown) >= limit
        return F.struct(F.when(full, F.concat(done, F.array(grown))).otherwise(done).alias("done"), F.when(full, keep(grown)).otherwise(grown).alias("buf"))

    def finish(state):
        return F.when(F.size(state.buf) > 0, F.concat(state.done, F.array(state.buf))).otherwise(state.done)

    chunks = folded.select("document_id", F.posexplode(F.aggregate(F.col("items").cast(f"array<{seg}>"), zero, step, finish)).alias("chunk_index", "own"))
    content = F.array_join(F.transform("own", lambda s: s.text), "\n\n")
    low = lambda c: F.array_min(F.transform("own", lambda s: s[c]))
    high = lambda c: F.array_max(F.transform("own", lambda s: s[c]))
    metas = F.transform("own", lambda s: F.from_json(s.citation_metadata, "map<string,string>"))
    return chunks.select(
        "document_id", "chunk_index", content.alias("content"), T.token_estimate(content).alias("token_count"), low("paragraph_index").alias("paragraph_start"), high("paragraph_index").alias("paragraph_end"),
        low("page_number").alias("page_number_start"), high("page_number").alias("page_number_end"), low("char_start").alias("char_start"), high("char_end").alias("char_end"),
        dominant_section(F.col("own")).alias("section_title"), merged_metadata(F.filter(metas, lambda m: m.isNotNull())).alias("citation_metadata"),
    )


def with_structure(chunks: DataFrame, section: str = "section_title") -> DataFrame:
    """Adds clause_full_name, article_number, chunk_type, heading_path and structural_search_text."""
    if section not in chunks.columns:
        chunks = chunks.withColumn(section, F.lit(None).cast("string"))
    title = T.cut(F.regexp_replace(T.text(section), r"^#{1,6}\s*", ""), 255)
    out = chunks.withColumn("clause_full_name", T.clause_name("content")).withColumn("_title", title)
    out = out.withColumn("article_number", T.article_number(F.col("_title"), F.col("clause_full_name"), F.col("content")))
    out = out.withColumn("chunk_type", T.chunk_type(F.col("content"), F.col("_title"), F.col("clause_full_name"), F.col("article_number")))
    same = T.structural_key("_title") == T.structural_key("clause_full_name")
    path = F.when(same, F.col("_title")).otherwise(F.nullif(F.concat_ws(" / ", "_title", "clause_full_name"), F.lit("")))
    out = out.withColumn("heading_path", T.cut(path, 1024))
    whole = F.concat_ws(" ", "_title", "clause_full_name", "article_number", "heading_path", "chunk_type", "content")
    return out.withColumn("structural_search_text", F.coalesce(T.cut(whole, 4000), F.lit(""))).drop("_title")
