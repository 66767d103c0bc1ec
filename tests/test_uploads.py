"""The upload store: versions, counters, and batches that break off, run twice or come again."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.sources.uploads import UploadStore

SCHEMA = "title string, file_name string, content binary, position int"


def versions(store):
    return sorted((r.title, r.version, bytes(r.content).decode(), r.batch) for r in store.rows().collect())


def batch(spark, rows):
    return spark.createDataFrame([(t, f, c if c is None else bytearray(c.encode()), k) for k, (t, f, c) in enumerate(rows)], SCHEMA).repartition(3)


FIRST = [("A", "x/a b.txt", "one"), ("B", "b.md", "b"), ("B", "b.md", "b2"), ("C", "c.exe", "no"), (None, "d.txt", "d"), ("E", "e.txt", None), ("", "f.txt", "f"), ("G", None, "g")]
SECOND = [("A", "a.txt", "one"), ("B", "b.md", "b3"), ("H", "h.TXT", ""), ("B", "b.md", "b3")]


def test_versions_and_counters(spark, tmp_path):
    store = UploadStore(spark, str(tmp_path))
    assert store.rows().collect() == [] and store.current().collect() == []
    assert store.save("one", batch(spark, FIRST)) == {"inserted": 2, "refreshed": 1, "reused": 0, "skipped": 5, "versions": 3, "bytes": 6}
    assert store.save("two", batch(spark, SECOND)) == {"inserted": 1, "refreshed": 1, "reused": 2, "skipped": 0, "versions": 2, "bytes": 2}
    assert versions(store) == [("A", 1, "one", "one"), ("B", 1, "b", "one"), ("B", 2, "b2", "one"), ("B", 3, "b3", "two"), ("H", 1, "", "two")]
    assert sorted((r.title, r.version) for r in store.current().collect()) == [("A", 1), ("B", 3), ("H", 1)]
    a = store.rows().where("title = 'A'").first()
    assert (a.file_name, a.mime_type, a.file_size, a.checksum) == ("a_b.txt", "text/plain", 3, hashlib.sha256(b"one").hexdigest())
    assert a.relative_path == f"documents/{hashlib.sha256(b'A').hexdigest()[:32]}/v1/a_b.txt"
    assert store.save("three", batch(spark, [("B", "b.md", "b9")]), refresh=False)["reused"] == 1
    assert len(versions(store)) == 5 and store.committed() == ["one", "three", "two"]


def test_a_batch_that_breaks_off_is_not_there(spark, tmp_path, monkeypatch):
    store = UploadStore(spark, str(tmp_path))
    store.save("one", batch(spark, FIRST))
    before = versions(store)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(UploadStore, "_commit", killed)
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            store.save("two", batch(spark, SECOND))
    assert versions(store) == before
    monkeypatch.undo()
    # Another batch goes on from what is committed; the broken one comes again after it and is written anew.
    store.save("other", batch(spark, [("B", "b.md", "b3"), ("Z", "z.txt", "z")]))
    assert store.save("two", batch(spark, SECOND)) == {"inserted": 1, "refreshed": 0, "reused": 3, "skipped": 0, "versions": 1, "bytes": 0}
    assert versions(store) == sorted([*before, ("B", 3, "b3", "other"), ("Z", 1, "z", "other"), ("H", 1, "", "two")])


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    store = UploadStore(spark, str(tmp_path))
    store.save("one", batch(spark, FIRST))
    before = versions(store)
    broken = batch(spark, SECOND).withColumn("content", F.when(F.col("title") == "H", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        store.save("two", broken)
    assert versions(store) == before and "two" not in store.committed()


def test_repeating_a_committed_batch_changes_nothing(spark, tmp_path):
    store = UploadStore(spark, str(tmp_path))
    made = store.save("one", batch(spark, FIRST))
    assert store.save("one", batch(spark, SECOND)) == made and len(versions(store)) == 3
    with pytest.raises(ValueError):
        store.save("../x", batch(spark, FIRST))
