"""Structured segments of converted files: Markdown with nested section titles and typed citation columns.

A line's kind comes from itself and its neighbours; section titles nest, each on the one before, so they are one fold over a file's headings in the JVM; all else is windows over a file's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .files import strip_markdown
from .office import PLACEHOLDER, is_title_row
from .tables import row_texts

SHEETS, SLIDES = (".xlsx", ".xls"), (".pptx",)
_RULE = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"
_COMMENT = r"^<!--.*-->$"
_SLIDE = r"(?i)^<!--\s*slide\s+number:?\s*([0-9]+)\s*-->$"


def _section(before, heading, level, slide, suffix):
    """A heading's section title after the one before it."""
    clean = T.squeeze(heading)
    sheet = F.when((level <= 2) | (before == ""), F.when(F.lower(clean).startswith("sheet:"), clean).otherwise(F.concat(F.lit("Sheet: "), clean))).otherwise(F.concat(F.split_part(before, F.lit(" / "), F.lit(1)), F.lit(" / "), clean))
    title = F.when(clean.rlike(r"(?i)^slide\s+[0-9]+\s*:"), clean).otherwise(F.concat(F.lit("Slide "), F.greatest(slide, F.lit(1)).cast("string"), F.lit(": "), clean))
    deck = F.when(level == 1, title).when(before != "", F.concat(before, F.lit(" / "), clean)).otherwise(clean)
    none = F.when(before == "", F.lit("Untitled section")).otherwise(before)
    return F.when(clean == "", none).when(suffix.isin(*SHEETS), sheet).when(suffix.isin(*SLIDES), deck).otherwise(clean)


def structured_segments(files: DataFrame, max_rows: int = 0) -> DataFrame:
    """files(path, suffix, content: Markdown text) as (path, paragraph_index, text, section_title, segment_kind, sheet_name, slide_number, slide_title, table_caption, table_headers, table_row_index).

    Headings are segments and begin sections: in sheets "Sheet: name", deeper ones "Sheet: name / heading"; in slides "Slide n: title", deeper ones after the title they stand under; elsewhere the heading alone. Lines between headings, tables,
    comments and blank lines are one paragraph. A pipe table gives a segment for each data row with its headers and number; in sheets a title row above the header joins the caption. A comment <!-- Slide number: n --> counts the slides. segment_kind is heading,
    paragraph or table_row. max_rows: tables with more data rows raise an error, 0 lets all pass. Null content gives no rows. A file's headings are one bounded group."""
    lines = files.select("path", F.lower("suffix").alias("suffix"), F.posexplode(F.split(F.regexp_replace("content", r"\r\n|\r", "\n"), "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    w = W.partitionBy("path").orderBy("pos")
    pipe, rule = F.contains("line", F.lit("|")), F.col("line").rlike(_RULE) & F.contains("line", F.lit("|"))
    rows = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+", 1))).withColumn("slide", F.nullif(F.regexp_extract("line", _SLIDE, 1), F.lit("")).cast("int"))
    kind = F.when(F.col("level") > 0, "heading").when(F.col("line").rlike(_COMMENT), "comment").when(F.col("line") == "", "blank").when(rule, "rule").when(pipe, "pipe").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("tabular", F.col("kind").isin("pipe", "rule"))
    rows = rows.withColumn("run", F.sum((~(F.col("tabular") & F.coalesce(F.lag("tabular").over(w), F.lit(False)))).cast("int")).over(w))
    # A run of pipe lines is a table if its second line is a rule.
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("path", "run").orderBy("pos")))
    rows = rows.withColumn("is_table", F.col("tabular") & (F.max(((F.col("nth") == 2) & (F.col("kind") == "rule")).cast("int")).over(W.partitionBy("path", "run")) == 1))

    # Section titles: one fold over the headings and slide marks of a file.
    marks = rows.where("kind = 'heading' or slide is not null").groupBy("path", "suffix").agg(F.sort_array(F.collect_list(F.struct("pos", "level", strip_markdown(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("heading"), "slide"))).alias("marks"))
    item = "struct<pos:int,section:string,slide:int,sheet_name:string,slide_number:int,slide_title:string>"
    start = F.struct(F.lit("").alias("section"), F.lit(0).alias("slide"), F.lit(None).cast("string").alias("sheet_name"), F.lit(None).cast("int").alias("slide_number"), F.lit(None).cast("string").alias("slide_title"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s, m):
        deck = F.col("suffix").isin(*SLIDES)
        slide = F.when(m.slide.isNotNull(), F.greatest(s.slide, m.slide - 1)).when(deck & (m.level == 1), s.slide + 1).otherwise(s.slide)
        section = F.when(m.slide.isNotNull(), s.section).otherwise(_section(s.section, m.heading, m.level, slide, F.col("suffix")))
        named = F.col("suffix").isin(*SHEETS) & m.slide.isNull()
        sheet = F.when(named, F.trim(F.regexp_replace(F.split_part(section, F.lit(" / "), F.lit(1)), "(?i)^sheet:", ""))).otherwise(s.sheet_name)
        begins = deck & m.slide.isNull() & (m.level == 1)
        number = F.when(begins, F.coalesce(F.nullif(F.regexp_extract(section, r"(?i)^slide\s+([0-9]+)", 1), F.lit("")).cast("int"), F.greatest(slide, F.lit(1)))).otherwise(s.slide_number)
        title = F.when(begins, F.trim(F.regexp_replace(section, r"(?i)^slide\s+[0-9]+\s*:", ""))).otherwise(s.slide_title)
        one = F.struct(m.pos.alias("pos"), section.alias("section"), slide.cast("int").alias("slide"), sheet.alias("sheet_name"), number.cast("int").alias("slide_number"), title.alias("slide_title"))
        out = F.when(m.slide.isNotNull(), s.out).otherwise(F.concat(s.out, F.array(one).cast(f"array<{item}>")))
        return F.struct(section.alias("section"), slide.cast("int").alias("slide"), sheet.alias("sheet_name"), number.cast("int").alias("slide_number"), title.alias("slide_title"), out.alias("out"))

    titles = marks.select("path", F.explode(F.aggregate("marks", start, step, lambda s: s.out)).alias("m")).select("path", "m.pos", F.struct("m.section", "m.sheet_name", "m.slide_number", "m.slide_title").alias("at"))
    rows = rows.join(titles, ["path", "pos"], "left").withColumn("at", F.last("at", ignorenulls=True).over(w))

    body = rows.where("kind in ('heading', 'text', 'pipe', 'rule')")
    shape = F.when(F.col("kind") == "heading", "heading").when(F.col("is_table"), "table_row").otherwise("paragraph")
    body = body.withColumn("shape", shape)
    same = (F.col("shape") == F.lag("shape").over(w)) & (F.col("shape") != "heading") & (F.col("pos") == F.lag("pos").over(w) + 1)
    body = body.withColumn("block", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w))
    blocks = body.groupBy("path", "suffix", "block", "shape").agg(F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line).alias("lines"))
    cells = F.transform(F.filter("lines", lambda x: ~x.rlike(_RULE)), lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: T.squeeze(c)))
    blocks = blocks.withColumn("cells", F.when(F.col("shape") == "table_row", F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))))
    titled = F.col("suffix").isin(*SHEETS) & (F.size("cells") >= 2) & is_title_row(F.get("cells", F.lit(0)), F.get("cells", F.lit(1)))
    title = F.get(F.filter(F.get("cells", F.lit(0)), lambda c: (c != "") & ~c.rlike(PLACEHOLDER)), F.lit(0))
    blocks = blocks.withColumn("titled", F.coalesce(titled, F.lit(False)))
    caption = F.when(F.col("titled") & ~F.contains(F.lower(T.text("at.section")), F.lower(title)), F.concat_ws(" / ", "at.section", title)).otherwise(F.col("at.section"))
    blocks = blocks.withColumn("caption", caption).withColumn("cells", F.when(F.col("titled"), F.slice("cells", 2, 1_000_000)).otherwise(F.col("cells")))
    if max_rows:
        many = F.concat(F.lit(f"a table has more than {max_rows} data rows: "), "path")
        blocks = blocks.withColumn("cells", F.when(F.size("cells") - 1 > max_rows, F.raise_error(many).cast("array<array<string>>")).otherwise(F.col("cells")))
    paragraph = T.squeeze(F.array_join(F.transform("lines", strip_markdown), " "))
    texts = F.when(F.col("shape") == "table_row", row_texts("cells", F.col("caption"))).otherwise(F.array(F.when(F.col("shape") == "heading", F.col("at.section")).otherwise(paragraph)))
    out = blocks.select("path", "block", "shape", "at", "caption", "cells", F.posexplode(texts).alias("k", "text")).where("text <> ''")
    table = F.col("shape") == "table_row"
    return out.select(
        "path", F.row_number().over(W.partitionBy("path").orderBy("block", "k")).alias("paragraph_index"), "text", F.when(table, F.coalesce("caption", "at.section")).otherwise(F.col("at.section")).alias("section_title"), F.col("shape").alias("segment_kind"),
        "at.sheet_name", "at.slide_number", "at.slide_title", F.when(table, F.col("caption")).alias("table_caption"), F.when(table, F.get("cells", F.lit(0))).alias("table_headers"), F.when(table, F.col("k") + 1).alias("table_row_index"),
    )
