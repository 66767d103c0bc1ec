"""Tables in the folder that the whole cluster shares, and joins whose broadcast side is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows fit in this many bytes; larger ones are shuffled.
BROADCAST_BYTES = 48 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs on this machine (tests), a temporary folder, made once."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _own[app]


#: Rows of an Arrow batch where the session has Spark's default of 10,000: rows here hold whole texts or sets.
BATCH_ROWS = "2000"
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers a session's Arrow batch size from Spark's default, so that a batch of texts takes a few MB on either side. The
    registered queries call this; an operator never changes its session."""
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_roots: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what the operators of this application have written so far. Results that were not read yet can't be after it."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        delete_folder(spark, root)


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_folder(self.spark, f"{self.root}/{name}")


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table, so that counting it is cheap), marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def with_text(docs: DataFrame, per_doc: DataFrame, payload_bytes: int, how: str) -> DataFrame:
    """docs joined on doc_id with one row per document of a written table; the text is shuffled only
    if the table has over BROADCAST_BYTES."""
    small = per_doc.count() * 24 + payload_bytes <= BROADCAST_BYTES
    return docs.join(F.broadcast(per_doc) if small else per_doc, "doc_id", how)
