"""A store of uploaded files with versions: each import is one batch that is there as a whole or not at all.

A batch's rows are one partition, written by dynamic overwrite, so a task or a whole import that runs twice leaves what one run leaves. Its commit, a small file with the batch's counters, comes last and in one step; readers
see committed batches only. Versions and ids follow from the committed batches and the uploads alone, never from the clock or the order of tasks.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import SUFFIXES

SCHEMA = "document_id string, title string, version int, file_name string, relative_path string, mime_type string, file_size long, checksum string, content binary"
#: By suffix; others are application/octet-stream.
MIME_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}
#: Bytes of content that one written file may hold.
FILE_ROWS = 10_000


def safe_name(name):
    """The last part of a path, other characters as underscores, at most 200; "document" for nothing."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
    cut = F.substring(F.regexp_replace(last, "[^A-Za-z0-9._-]", "_"), 1, 200)
    return F.when(cut == "", "document").otherwise(cut)


class UploadStore:
    """folder/files has the rows by batch, folder/commits one JSON file for each committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files, self.commits = spark, f"{folder}/files", f"{folder}/commits"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> list[str]:
        """Names of the committed batches, in order; a list as long as there were imports."""
        path, fs = self._fs(self.commits)
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName()[: -len(".json")] for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))

    def counters(self, batch: str) -> dict[str, int]:
        text = self.spark.read.option("wholetext", True).text(f"{self.commits}/{batch}.json").first()[0]
        return json.loads(text)

    def rows(self, without: str | None = None) -> DataFrame:
        """All versions of committed batches, with batch. Others' partitions are not read."""
        batches = [b for b in self.committed() if b != without]
        if not batches:
            return self.spark.createDataFrame([], f"{SCHEMA}, batch string")
        return self.spark.read.schema(f"{SCHEMA}, batch string").parquet(self.files).where(F.col("batch").isin(batches))

    def current(self, without: str | None = None) -> DataFrame:
        """The newest version of each document."""
        rows = self.rows(without)
        newest = rows.groupBy("document_id").agg(F.max("version").alias("version"))
        return rows.join(newest, ["document_id", "version"])

    def planned(self, batch: str, uploads: DataFrame, refresh: bool = True) -> DataFrame:
        """uploads(title, file_name, content, and optionally position) with action: insert, refresh (a new version of a known document), reuse (its content is known, or ``refresh`` is off) or skip (no title, no content or an unsupported
        suffix), and the columns of a version. Several uploads of one title in a batch are versions of one document in order of position, then checksum."""
        rows = uploads if "position" in uploads.columns else uploads.withColumn("position", F.lit(0))
        suffix = F.lower(F.regexp_extract(F.coalesce("file_name", F.lit("")), r"(\.[^.]+)$", 1))
        rows = rows.select("title", "file_name", "content", "position", suffix.alias("suffix"), F.sha2("content", 256).alias("checksum"))
        fits = F.col("suffix").isin(*SUFFIXES) & (F.trim(F.coalesce("title", F.lit(""))) != "") & F.col("content").isNotNull()
        known = self.rows(without=batch).groupBy("title").agg(F.max("version").alias("last"), F.max_by("checksum", "version").alias("had"))
        rows = rows.join(known, "title", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
        w = W.partitionBy("title").orderBy(F.desc("fits"), "position", "checksum", "file_name")
        before = F.coalesce(F.when(F.lag("fits").over(w), F.lag("checksum").over(w)), F.col("had"))
        first = F.col("last").isNull() & (F.row_number().over(w) == 1)
        action = F.when(~F.col("fits"), "skip").when(first, "insert").when((F.col("checksum") == before) | F.lit(not refresh), "reuse").otherwise("refresh")
        rows = rows.withColumn("action", action)
        number = F.coalesce("last", F.lit(0)) + F.sum(F.col("action").isin("insert", "refresh").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
        name = safe_name(F.col("file_name"))
        mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair]), F.col("suffix")), F.lit("application/octet-stream"))
        rows = rows.withColumn("document_id", F.substring(F.sha2("title", 256), 1, 32)).withColumn("version", number.cast("int"))
        path = F.concat(F.lit("documents/"), "document_id", F.lit("/v"), F.col("version").cast("string"), F.lit("/"), name)
        return rows.select("document_id", "title", "version", name.alias("file_name"), path.alias("relative_path"), mime.alias("mime_type"), F.octet_length("content").cast("long").alias("file_size"), "checksum", "content", "action")

    def save(self, batch: str, uploads: DataFrame, refresh: bool = True) -> dict[str, int]:
        """Imports a batch and returns its counters: inserted, refreshed, reused, skipped, versions and bytes. A batch that is committed already is left as it is, so a repeated call returns what the first did; one that broke off is written anew."""
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", batch):
            raise ValueError(f"not a batch name: {batch}")
        if batch in self.committed():
            return self.counters(batch)
        plan = self.planned(batch, uploads, refresh)
        new = plan.where(F.col("action").isin("insert", "refresh"))
        new.drop("action").withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy("batch").parquet(self.files)
        # What was written counts, not what a second evaluation of the uploads would give; the other actions leave no rows.
        written = self.spark.read.schema(f"{SCHEMA}, batch string").parquet(self.files).where(F.col("batch") == batch).agg(F.count_if(F.col("version") == 1).alias("inserted"), F.count_if(F.col("version") > 1).alias("refreshed"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).first()
        rest = {r.action: r["n"] for r in plan.where(F.col("action").isin("reuse", "skip")).groupBy("action").agg(F.count("*").alias("n")).collect()}
        made = {"inserted": written.inserted, "refreshed": written.refreshed, "reused": rest.get("reuse", 0), "skipped": rest.get("skip", 0), "versions": written.inserted + written.refreshed, "bytes": written.bytes}
        self._commit(batch, made)
        return made

    def _commit(self, batch: str, made: dict[str, int]) -> None:
        """The commit appears by one rename."""
        self.spark.sparkContext.setJobDescription(None)
        temporary, fs = self._fs(f"{self.commits}/_{batch}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not fs.rename(temporary, self._fs(f"{self.commits}/{batch}.json")[0]):
            raise RuntimeError(f"could not commit {batch}")
