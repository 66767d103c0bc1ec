"""Page layout: words outside tables, headers carried over pages, aligned runs of rows, kinds of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def words_outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words(page_id, left, top, right, bottom) that no box of their page overlaps: an anti-join on the page with four comparisons."""
    b = boxes.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("left", "top", "right", "bottom")])
    hit = (words.page_id == b.page_id) & (words.left < b.b_right) & (b.b_left < words.right) & (words.top < b.b_bottom) & (b.b_top < words.bottom)
    return words.join(b, hit, "left_anti")


def carried_headers(tables: DataFrame) -> DataFrame:
    """tables(document_id, page, table_no, width, header, has_header) with the header that applies: its own, else the last one of the
    same width if at most one page back."""
    w = W.partitionBy("document_id", "width").orderBy("page", "table_no").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("has_header"), F.struct("header", "page")), ignorenulls=True).over(w)
    rows = tables.withColumn("_last", last)
    near = F.coalesce(F.col("page") - F.col("_last.page") <= 1, F.lit(False))
    return rows.withColumn("effective_header", F.when(F.col("has_header"), F.col("header")).when(near, F.col("_last.header"))).drop("_last")


def best_run(rows: DataFrame) -> DataFrame:
    """Of rows(image_id, row_no, n_cells), the longest run of two or more neighbouring rows with equally many cells, ties to the wider,
    then the earlier: (image_id, first_row, n_rows, n_cells)."""
    w = W.partitionBy("image_id").orderBy("row_no")
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy("image_id", "n_cells").orderBy("row_no"))
    runs = rows.withColumn("island", island)
    runs = runs.where("n_cells >= 2").groupBy("image_id", "n_cells", "island").agg(F.min("row_no").alias("first_row"), F.count("*").alias("n_rows")).where("n_rows >= 2")
    best = runs.groupBy("image_id").agg(F.max(F.struct("n_rows", "n_cells", (-F.col("first_row")).alias("early"))).alias("b"))
    return best.select("image_id", (-F.col("b.early")).alias("first_row"), "b.n_rows", "b.n_cells")


def needs_ocr(enabled: Column, page: Column, limit: Column, n_segments: Column, n_chars: Column, has_table: Column, least_chars: int) -> Column:
    """Whether a page is read by OCR: enabled, within the page limit, and without segments or with thin text and no table."""
    return enabled & (page <= limit) & ((n_segments == 0) | ((n_chars < least_chars) & ~has_table))
