"""Table rows as text segments, and the table file readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_NONE = "array<string>"


def headers(row: Column) -> Column:
    """Blank headers as "Column i", repeated ones numbered "name 2", "name 3"."""
    named = F.transform(row, lambda h, i: F.when(h == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(h))

    def number(h, i):
        before = F.size(F.filter(F.slice(named, 1, i), lambda x: x == h))
        return F.when(before > 0, F.concat(h, F.lit(" "), (before + 1).cast("string"))).otherwise(h)

    return F.transform(named, number)


def row_texts(rows: Column, caption: Column | None = None) -> Column:
    """An array of rows of cells as "Table row: caption. h=v; h=v." for every data row; empty cells and rows are left out,
    cells beyond the header get "Column i"."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: T.squeeze(c))), lambda r: F.exists(r, lambda c: c != ""))
    head = headers(F.coalesce(F.get(clean, F.lit(0)), F.array().cast(_NONE)))
    title = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("Table row: "), caption)).otherwise(F.lit("Table row")) if caption is not None else F.lit("Table row")

    def one(row):
        cells = F.transform(row, lambda c, i: F.when(c != "", F.concat(F.coalesce(F.get(head, i), F.concat(F.lit("Column "), (i + 1).cast("string"))), F.lit("="), c)))
        return F.concat(title, F.lit(". "), F.array_join(F.array_compact(cells), "; "), F.lit("."))

    return F.when(F.size(clean) > 1, F.transform(F.slice(clean, 2, 1_000_000), one)).otherwise(F.array().cast(_NONE))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text): row texts of CSV files; the caption is the file's stem."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("body"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    return lines.select("path", F.posexplode(row_texts(csv_cells(F.col("body")), stem)).alias("pos", "text"))


def csv_cells(body: Column) -> Column:
    """The records of a CSV text as an array of cells each."""
    quoted = r'"[^"]*(?:""[^"]*)*"'
    # A record ends at a line end outside quotes; a quote that closes nothing is a character.
    raw = F.filter(F.regexp_extract_all(body, F.lit(rf'((?:{quoted}(?=[,\r\n]|$)|[^"\r\n]+|")+)'), 1), lambda x: x != "")
    plain = lambda c: F.when(c.rlike(r'(?s)^".*"$'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf'(?:^|,)({quoted}|[^,]*)'), 1), plain))


def word_rows(boxes: DataFrame) -> DataFrame:
    """Word boxes (image_id, text, left, top, right, bottom) with row_no: words from the top down, as long as they lie near the mean centre of the row so far.

    A new row begins where a word is over max(8, .8 times the image's median height) away from that mean. The mean depends on the order, so this is a
    fold over an image's ordered words."""
    box = "struct<center:double,left:double,top:double,right:double,bottom:double,text:string>"
    item = F.struct(((F.col("top") + F.col("bottom")) / 2).cast("double").alias("center"), *[F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")], "text")
    images = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).cast(f"array<{box}>").alias("words"), F.percentile(F.col("bottom") - F.col("top"), F.lit(0.5)).alias("height"))
    limit = F.greatest(F.lit(8.0), 0.8 * F.col("height"))
    start = F.struct(F.array().cast("array<int>").alias("rows"), F.lit(-1).alias("row"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(s, w):
        fresh = (s.n == 0) | (F.abs(w.center - s.total / F.greatest(s.n, F.lit(1))) > limit)
        row = F.when(fresh, s.row + 1).otherwise(s.row)
        return F.struct(F.concat(s.rows, F.array(row)).alias("rows"), row.alias("row"), F.when(fresh, w.center).otherwise(s.total + w.center).alias("total"), F.when(fresh, 1).otherwise(s.n + 1).alias("n"))

    rows = images.select("image_id", F.explode(F.arrays_zip("words", F.aggregate("words", start, step, lambda s: s.rows).alias("rows"))).alias("z"))
    return rows.select("image_id", "z.words.text", "z.words.left", "z.words.top", "z.words.right", "z.words.bottom", "z.words.center", F.col("z.rows").alias("row_no"))


def word_boxes(data: DataFrame, least: float = 0.0) -> DataFrame:
    """Parallel arrays of an OCR engine (image_id, text, conf, left, top, width, height) as word boxes of enough confidence; blank words are left out."""
    z = F.explode(F.arrays_zip("text", "conf", "left", "top", "width", "height")).alias("z")
    rows = data.select("image_id", z).where((F.trim(F.coalesce("z.text", F.lit(""))) != "") & (F.expr("try_cast(z.conf as double)") >= least))
    return rows.select("image_id", F.trim("z.text").alias("text"), "z.left", "z.top", (F.col("z.left") + F.col("z.width")).alias("right"), (F.col("z.top") + F.col("z.height")).alias("bottom"))


def columns_aligned(cells: DataFrame) -> DataFrame:
    """(image_id, aligned): whether in every column of cells(image_id, row_no, cell_no, left, right) all centres lie near the column's median: within max(24, .8 of its median
    width, .08 of the span of all centres); not with fewer than two rows or columns."""
    centre, width = (F.col("left") + F.col("right")) / 2, F.col("right") - F.col("left")
    rows = cells.withColumn("c", centre).withColumn("w", width)
    mid = rows.groupBy("image_id", "cell_no").agg(F.percentile("c", F.lit(0.5)).alias("mid"), F.percentile("w", F.lit(0.5)).alias("wide"))
    all_of = rows.groupBy("image_id").agg((F.max("c") - F.min("c")).alias("span"), F.countDistinct("row_no").alias("n"), F.countDistinct("cell_no").alias("m"))
    near = F.abs(F.col("c") - F.col("mid")) <= F.greatest(F.lit(24.0), 0.8 * F.col("wide"), 0.08 * F.col("span"))
    return rows.join(mid, ["image_id", "cell_no"]).join(all_of, "image_id").groupBy("image_id").agg((F.bool_and(near) & (F.first("n") >= 2) & (F.first("m") >= 2)).alias("aligned"))


def image_kind(has_table: Column, signals: Column, words: Column, lines: Column, short_lines: Column) -> Column:
    """table_like, text_dense, diagram_like or low_signal, from what OCR found on an image: signal units (CJK characters and Latin words) and words, its lines and those of up to three words."""
    n = F.greatest(lines, F.lit(1))
    dense = (signals >= 24) | (words >= 24) | ((lines >= 4) & (words / n >= 4))
    return F.when(has_table, "table_like").when(dense, "text_dense").when((signals >= 6) & ((lines >= 2) | (short_lines / n >= 0.6)), "diagram_like").otherwise("low_signal")


def row_cells(rows: DataFrame) -> DataFrame:
    """(image_id, row_no, cell_no, text): a cell ends where the gap exceeds max(18, 1.4 median heights, .75 median widths)."""
    from pyspark.sql import Window as W

    part = W.partitionBy("image_id", "row_no")
    w = part.orderBy("left")
    gap = F.coalesce(F.col("left") - F.lag("right").over(w), F.lit(0))
    limit = F.greatest(F.lit(18.0), 1.4 * F.percentile(F.col("bottom") - F.col("top"), F.lit(0.5)).over(part), 0.75 * F.percentile(F.col("right") - F.col("left"), F.lit(0.5)).over(part))
    rows = rows.withColumn("cut", (gap > limit).cast("int")).withColumn("cell_no", F.sum("cut").over(w))
    words = F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"])
    return rows.groupBy("image_id", "row_no", "cell_no").agg(F.array_join(words, " ").alias("text"))
