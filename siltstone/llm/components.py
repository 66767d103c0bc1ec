"""Connected components of an edge table, as DataFrame rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any order, repeats and loops allowed; null ends are dropped.

    Returns (node, root): root is the least node of the component; nodes without an edge to another
    node don't appear. Each round is written to the shared folder, so that no plan grows; the number
    of rounds is about the logarithm of the longest path. Minima are combined before the shuffle and
    the star joins are plain equi-joins whose hot centres adaptive execution can split.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(now, "r0")
    before = _state(now)
    for k in range(1, max_rounds + 1):
        # Large star: every larger neighbour of u gets u's least neighbour (or u).
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours get the least of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.union(floor.select("u", F.col("m").alias("v"))).distinct(), f"r{k}")
        scratch.drop(f"r{k - 1}")
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
