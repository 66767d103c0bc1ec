"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order of nearness. The index is cut into blocks
of vectors; each block has one inverted file for each pivot, in which the vectors that have the pivot in their list
are posted with its place there. A query reads the files of its own pivots only and sums up the footrule distance of
the two lists, induced on the pivots that either holds; a stated share of each block with the least distances
is reranked by exact cosine in double precision.

Equal vectors are one entry that keeps its k + 1 smallest ids, so a group of copies of any size costs one
posting and still gives every member its neighbours. Queries are taken in blocks that bound what is broadcast;
each pass reads the index once and sends k + 1 rows for each query and index block to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; equal ones in pivot order."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def spread_pivots(sample: np.ndarray, count: int, alike: float = 0.9) -> np.ndarray:
    """The first ``count`` of the sample, as unit vectors, of which no two are alike: many near copies of one vector
    in a list would weigh its direction many times."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    kept: list[int] = []
    for i in range(len(unit)):
        if len(kept) < count and (not kept or (unit[kept] @ unit[i]).max() < alike):
            kept.append(i)
    return unit[kept]


class Block:
    """Inverted pivot files of one block of vectors: for each pivot, the vectors that have it in their list and the place it
    has there, nearest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.ids, self.vectors, self.prefix = ids, vectors, min(prefix, len(pivots))
        self.norms = np.linalg.norm(vectors, axis=1)
        lists = permutations(vectors, pivots, self.prefix)
        pivot, place = lists.ravel(), np.tile(np.arange(self.prefix, dtype=np.int16), len(ids))
        order = np.lexsort((place, pivot))
        self.posted, self.place = (order // max(self.prefix, 1)).astype(np.int32), place[order]
        self.file = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))

    def agreement(self, pivots: np.ndarray) -> np.ndarray:
        """For each vector, how far the footrule distance of its list to a query's falls below that of two lists without a
        common pivot (an absent pivot's place is prefix). Only the files of the query's pivots are read."""
        # |a - b| summed over both lists = const - 2 * sum over the common pivots of (prefix - max(a, b)).
        out = np.zeros(len(self.ids), np.int32)
        for place, p in enumerate(pivots):
            a, b = self.file[p], self.file[p + 1]
            out[self.posted[a:b]] += self.prefix - np.maximum(self.place[a:b], place)
        return out

    def search(self, query: np.ndarray, pivots: np.ndarray, share: float, least: int, close: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best of the share of the block with the least footrule distances, and of all
        vectors whose list is so close to the query's that the order among them says nothing."""
        many = min(len(self.ids), least + int(share * len(self.ids)))
        common = self.agreement(pivots)
        n = len(pivots)
        near = close * (n * self.prefix - n * (n - 1) / 2)
        limit = min(near, np.partition(common, len(common) - many)[len(common) - many])
        some = np.flatnonzero(common >= limit)
        score = (self.vectors[some] * query).sum(1) / (self.norms[some] * np.linalg.norm(query))
        best = np.lexsort((self.ids[some], -score))[:k]
        return self.ids[some[best]], score[best]


def sound(vector: str) -> Column:
    """Whether a vector takes part: no null, non-finite or only zero components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 256, prefix: int = 80, share: float = 0.06, least: int = 64, close: float = 0.6, block_rows: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """The k nearest vectors found, by largest cosine, of each query among embeddings(vec_id, embedding).

    is_query: condition on vec_id; queries are searched against every row but their own id. Returns query_id, rank
    (from 1), vec_id, score, nearest first, ties to the smaller vec_id; fewer than k only where there are fewer
    candidates. pivots: how many are taken from a sample of four times as many (by hash of the vectors); every row is
    indexed. share and least: how many of a block's vectors are reranked; close: what part of the best possible footrule
    agreement gets a vector reranked anyway, so that a cluster larger than the share is searched whole. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do those whose length isn't the most common one, nor rows with a null
    vec_id. Rows repeated under one vec_id with one vector count once. Other columns are ignored; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "permutations")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & sound("embedding"))
    size = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    good = good.where(F.size("embedding") == size.d).dropDuplicates(["vec_id", "embedding"])

    # The k + 1 smallest ids of each different vector; each task passes on no more than that.
    few = good.withColumn("n", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = scratch.save(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("entry", F.element_at("members", 1)), "entries")
    asked = good.where(is_query).withColumnRenamed("vec_id", "query_id")
    asked = scratch.save(asked.join(entries.select("embedding", "entry"), "embedding").select("query_id", "entry"), "queries")

    sample = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(4 * pivots).collect()
    if not sample:
        return empty
    base = spread_pivots(np.array([r.embedding for r in sample], np.float64), pivots)
    rerank = k + 1  # the query's own entry is among them
    schema = "query long, entry long, score double"

    def search(queries):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vecs = queries.value
            lists = permutations(vecs, base, prefix)
            held: list[pa.RecordBatch] = []
            rows = 0

            def flush() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                block = Block(table.column(0).to_numpy(), vectors_of(table.column(1).combine_chunks()), base, prefix)
                found = [block.search(v, p, share, least, close, rerank) for v, p in zip(vecs, lists, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query", "entry", "score"])

            for batch in batches:
                held.append(batch)
                rows += len(batch)
                if rows >= block_rows:
                    yield flush()
                    held, rows = [], 0
            if held:
                yield flush()

        return run

    query_entries = asked.select("entry").distinct().join(entries, "entry").select("entry", "embedding")
    query_entries = scratch.save(query_entries, "query_entries")
    passes = max(1, -(-query_entries.count() // query_block))
    found = None
    for part in range(passes):
        rows = query_entries.where(F.pmod(F.xxhash64("entry"), F.lit(passes)) == part).collect()
        if not rows:
            continue
        handle = spark.sparkContext.broadcast((np.array([r.entry for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64)))
        one = entries.select("entry", "embedding").mapInArrow(search(handle), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return empty
    by = [F.desc("score"), "entry"]
    top = found.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*by))).where(F.col("n") <= rerank).drop("n")
    top = top.join(entries.select("entry", "members"), "entry").select("query", "score", F.explode("members").alias("vec_id"))
    top = top.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= rerank).drop("n")
    pairs = asked.join(top, asked.entry == top.query).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
