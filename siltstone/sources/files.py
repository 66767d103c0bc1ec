"""File readers and sinks: uploads, text and Markdown, manifests, relevance judgements, versioned chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import row_texts

# Fixed values.
SUFFIXES = (".txt", ".md", ".html", ".htm", ".csv", ".pdf", ".docx", ".xlsx", ".xls", ".pptx", ".png", ".jpg", ".jpeg")


def inspect_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, suffix, size, checksum, supported): what a folder's files are, without parsing them."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select("path", F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_").alias("name"), suffix.alias("suffix"), F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), suffix.isin(*SUFFIXES).alias("supported"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.format("binaryFile").load(path).select("path", F.replace(F.decode("content", "UTF-8"), F.lit("﻿"), F.lit("")).alias("content"))


def strip_markdown(value):
    """Without images, link targets, emphasis, bullets and numbering."""
    out = F.regexp_replace(value, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[`*_~>#]", "")
    return T.plain(F.regexp_replace(F.regexp_replace(out, r"^\s*[-*+]\s+", ""), r"^\s*\d+\.\s+", ""))


def markdown_segments(documents: DataFrame) -> DataFrame:
    """documents(document_id, content) as (document_id, paragraph_index, text, section_title).

    Headings start sections; pipe tables become row texts; other lines join to paragraphs up to a blank line, heading or
    table. The state of the lines is window functions over a document's lines.
    """
    lines = documents.select("document_id", F.posexplode(F.split(F.regexp_replace(T.text("content"), r"\r\n|\r", "\n"), "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    w = W.partitionBy("document_id").orderBy("pos")
    rule = F.col("line").rlike(r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$") & F.contains("line", F.lit("|"))
    pipe = F.contains("line", F.lit("|"))
    heading = F.col("line").rlike(r"^#{1,6}\s+")
    rows = lines.withColumn("kind", F.when(heading, "heading").when(F.col("line") == "", "blank").when(rule & F.coalesce(F.lag(pipe).over(w), F.lit(False)), "rule").when(pipe, "pipe").otherwise("text"))
    # Pipe lines are a table only together with a rule: runs of pipe and rule lines that hold a rule in second place.
    table = F.col("kind").isin("pipe", "rule")
    new_run = (~(table & F.coalesce(F.lag(table).over(w), F.lit(False)))).cast("int")
    rows = rows.withColumn("run", F.sum(new_run).over(w))
    rows = rows.withColumn("is_table", table & F.coalesce(F.max((F.col("kind") == "rule").cast("int")).over(W.partitionBy("document_id", "run")) == 1, F.lit(False)))
    rows = rows.withColumn("section_title", F.last(F.when(heading, strip_markdown(F.regexp_replace("line", r"^#{1,6}\s+", ""))), ignorenulls=True).over(w))
    rows = rows.where("kind <> 'blank' or is_table").withColumn("body", F.when(F.col("is_table"), F.col("line")).when(heading, F.col("section_title")).otherwise(strip_markdown(F.col("line"))))
    gap = (F.col("pos") - F.lag("pos").over(w)) > 1
    begin = heading | F.coalesce(F.lag(heading).over(w), F.lit(True)) | gap | (F.col("is_table") != F.lag("is_table").over(w))
    rows = rows.withColumn("block", F.sum(F.coalesce(begin, F.lit(True)).cast("int")).over(w))
    blocks = rows.groupBy("document_id", "block", "section_title", "is_table").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]).alias("lines"))
    cells = F.transform(F.filter("lines", lambda x: ~x.rlike(r"^[|:\-\s]+$")), lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    texts = F.when(F.col("is_table"), row_texts(cells, F.col("section_title"))).otherwise(F.array(T.squeeze(F.array_join("lines", " "))))
    parts = blocks.select("document_id", "section_title", "block", F.posexplode(texts).alias("k", "text")).where("text <> ''")
    order = W.partitionBy("document_id").orderBy("block", "k")
    return parts.select("document_id", F.row_number().over(order).alias("paragraph_index"), "text", "section_title")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines, or of the first of data, rows, examples, questions that a JSON document holds."""
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    whole = spark.read.option("multiLine", True).json(path)
    for key in ("data", "rows", "examples", "questions"):
        if key in whole.columns:
            return whole.select(F.explode(key).alias("r")).select("r.*")
    return whole


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, document_id, relevance) of tab-separated judgements of three or four columns, positive ones only."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    four = F.size("c") >= 4
    out = rows.select(F.get("c", F.lit(0)).alias("query_id"), F.when(four, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1))).alias("document_id"), F.expr("try_cast(c[size(c) - 1] AS int)").alias("relevance"))
    return out.where("relevance > 0")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and cases of a manifest; the cases' document ids are resolved to titles."""
    whole = spark.read.option("multiLine", True).json(path)
    documents = whole.select(F.explode("documents").alias("d")).select("d.*")
    cases = whole.select(F.explode("cases").alias("c")).select("c.*")
    if "expected_document_ids" in cases.columns:
        titles = cases.select("case_name", F.explode("expected_document_ids").alias("id")).join(documents.select("id", "title"), "id")
        cases = cases.join(titles.groupBy("case_name").agg(F.sort_array(F.collect_set("title")).alias("expected_titles")), "case_name", "left")
    return documents, cases


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the chunks of the versions in hand, and no others: one partition for each version."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those rows of old whose keys new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
