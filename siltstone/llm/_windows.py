"""Windows that occur more than once, found from minimiser anchors.

A window of fixed length is represented by its anchor: the q-gram of least hash in it. Equal windows
have equal anchors at equal offsets, so only neighbourhoods of anchors that occur more than once can
hold a repeated window, and each window belongs to exactly one anchor. A neighbourhood ("context") is
all windows of a maximal run that share an anchor. Contexts of one anchor hash are one bucket; within
it, equal contexts are one class. Classes are combined before the shuffle, so a passage that a third of
all documents share costs one row for each task that sees it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: h: anchor hash, c: context hash, lo and n: first window start and number of window starts.
ANCHOR = "doc_id long, h long, c long, lo long, n long"


@dataclass
class Buckets:
    """anchors: every context. info: of each class of a bucket with several contexts, h, c, copies, width (the
    bucket's classes) and least (the class's least doc_id). classes: one context of each class of a bucket
    with several classes."""

    anchors: DataFrame
    info: DataFrame
    classes: DataFrame


def shared_buckets(anchors: DataFrame, scratch: Scratch, hot: int) -> Buckets:
    """Buckets of anchors (columns ANCHOR, and w if a row stands for several). hot: classes beyond which a bucket is marked so."""
    anchors = scratch.save(anchors, "anchors")
    copies = F.sum("w") if "w" in anchors.columns else F.count("*")
    classes = anchors.groupBy("h", "c").agg(copies.alias("copies"), F.min(F.struct("doc_id", "lo", "n")).alias("rep"))
    classes = scratch.save(classes, "classes")
    sizes = classes.groupBy("h").agg(F.count("*").alias("width"), F.sum("copies").alias("total")).where("total > 1")
    classes = classes.join(sizes, "h").select("h", "c", "copies", "rep.doc_id", "rep.lo", "rep.n", "width")
    classes = scratch.save(classes.withColumn("hot", F.col("width") > hot), "shared")
    scratch.drop("classes")
    info = classes.select("h", "c", "copies", F.col("doc_id").alias("least"), "width")
    return Buckets(anchors, info, classes.where("width > 1"))


def merged(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts as maximal runs: sorted, touching and overlapping ones joined."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate((lo + n)[order])
    head = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return lo[head], np.append(end[head[1:] - 1], end[-1:]) - lo[head]


def per_document(ranges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """ranges(doc_id, lo, n) as one row per document, doc_id and marks (array of lo, n: maximal runs), written; and
    the bytes of the marks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, ns, size = [], [], []
            for marks in batch.column(1):
                f = marks.values
                lo, n = merged(f.field(0).to_numpy(), f.field(1).to_numpy())
                los.append(lo), ns.append(n), size.append(len(lo))
            if size:
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(los)), pa.array(np.concatenate(ns))], ["lo", "n"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat)], ["doc_id", "marks"])

    rows = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    table = scratch.save(rows.mapInArrow(merge, "doc_id long, marks array<struct<lo:long,n:long>>"), name)
    size = table.agg(F.sum(F.size("marks"))).first()[0]
    return table, 16 * (size or 0)
