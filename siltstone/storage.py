"""Tables written once and read many times, in the folder that the cluster shares."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and everything runs on this machine, a temporary folder of this application."""
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if path:
        return path
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))


_written: dict[str, list[str]] = {}
_tables: dict[tuple[str, str, str], DataFrame] = {}


def files_state(spark: SparkSession, folder: str) -> str:
    """A folder's files by name, size and time of change, hashed: another state is another input. A folder that isn't there has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    if system.exists(path):
        listed = system.listFiles(path, True)
        while listed.hasNext():
            f = listed.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:16]


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """The table that make() describes, written once for each application, name (folder/table) and state of the folder's files, and read from then on."""
    folder, table = name.rsplit("/", 1)
    key = (spark.sparkContext.applicationId, name, files_state(spark, folder))
    if key not in _tables:
        _tables[key] = written(make(), table)
    return _tables[key]


_drops: dict[str, int] = {}


def state_key(spark: SparkSession, folder: str) -> tuple[str, int, str, str]:
    """What results that an application keeps about a folder depend on: the application, how often it has dropped its tables, and the folder's files."""
    app = spark.sparkContext.applicationId
    return app, _drops.get(app, 0), folder, files_state(spark, folder)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this application has written. Results that were not read yet can't be after it."""
    app = spark.sparkContext.applicationId
    _drops[app] = _drops.get(app, 0) + 1
    for folder in _written.pop(app, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    for key in [k for k in _tables if k[0] == app]:
        del _tables[key]


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df, computed once and read back: its lineage is cut, and later reads prune columns and push filters. by: columns that get a folder for each value, which reads can skip."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
