"""Fusion of ranked sources and selection of the final results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
LEXICAL_WEIGHT, VECTOR_WEIGHT = 0.45, 0.55
#: Share of a source's score that counts as lexical evidence.
SOURCE_WEIGHTS = {"lexical": 1.0, "structural": 1.0, "indexed_sparse": 0.48, "document_expansion": 0.42, "document_sweep": 0.36, "subquery_document": 0.42, "subquery_neighbor": 0.55, "document_first": 0.34, "document_neighbor": 0.28,
                  "subquery_document_evidence": 0.42, "subquery_neighbor_context": 0.55, "document_first_evidence": 0.34, "document_neighbor_context": 0.28}
RRF_WEIGHTS = {"structural": 1.35, "lexical": 1.0, "indexed_sparse": 0.92, "vector": 0.85, "document_expansion": 0.65, "document_sweep": 0.58, "subquery_document": 0.58, "subquery_neighbor": 0.65, "document_first": 0.58, "document_neighbor": 0.65,
               "subquery_document_evidence": 0.58, "subquery_neighbor_context": 0.65, "document_first_evidence": 0.58, "document_neighbor_context": 0.65}
RRF_K = 60


def _by_source(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))


def rank_fuse(hits: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score): sum of weight / (k + rank) over the sources of hits(query_id, chunk_id, source, rank)."""
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(_by_source(weights) / (k + F.col("rank"))).alias("score"))


def min_max(column: str, by: str = "query_id") -> Column:
    """Min-max within a query; raw scores of 0 or less stay 0, equal scores are 1 if positive."""
    w = W.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(F.col(column) <= 0, 0.0).when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low))


def fuse(hits: DataFrame, strategy: str = "weighted", k: int = RRF_K) -> DataFrame:
    """One row for each (query_id, chunk_id) of hits(query_id, chunk_id, source, rank, score): raw and normalised lexical and
    vector scores, sources, fused. A full outer merge of all sources is one aggregation over their union."""
    lexical = F.max(F.when(F.col("source") != "vector", F.col("score") * F.coalesce(_by_source(SOURCE_WEIGHTS), F.lit(1.0))))
    vector = F.max(F.when(F.col("source") == "vector", F.col("score")))
    rrf = F.sum(_by_source(RRF_WEIGHTS) / (k + F.col("rank")))
    rows = hits.groupBy("query_id", "chunk_id").agg(F.coalesce(lexical, F.lit(0.0)).alias("lexical_raw"), F.coalesce(vector, F.lit(0.0)).alias("vector_raw"), F.sort_array(F.collect_set("source")).alias("sources"), rrf.alias("rrf"))
    rows = rows.withColumn("lexical_norm", min_max("lexical_raw")).withColumn("vector_norm", min_max("vector_raw"))
    has = lambda s: F.array_contains("sources", s)
    if strategy == "weighted":
        both = LEXICAL_WEIGHT * F.col("lexical_norm") + VECTOR_WEIGHT * F.col("vector_norm")
        fused = F.when(has("structural"), F.greatest(both, F.least(F.lit(1.0), F.col("lexical_norm") * 0.72))).otherwise(both)
    elif strategy == "rrf":
        top = F.max("rrf").over(W.partitionBy("query_id"))
        floor = F.greatest(
            F.when(has("structural"), F.least(F.lit(1.0), F.col("lexical_norm") * 0.9)).otherwise(0.0),
            F.when(has("lexical"), F.col("lexical_norm") * LEXICAL_WEIGHT).otherwise(0.0),
            F.when(has("vector"), F.col("vector_norm") * VECTOR_WEIGHT).otherwise(0.0),
        )
        fused = F.greatest(F.when(top > 0, F.col("rrf") / top).otherwise(0.0), floor)
    else:
        raise ValueError(strategy)
    return rows.withColumn("fused", fused).drop("rrf")


def rank_without_rerank(fused: DataFrame, k: int) -> DataFrame:
    """By fused, lexical and vector score, then the smaller chunk index."""
    order = W.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("lexical_norm"), F.desc("vector_norm"), "chunk_index", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def diverse_top_k(ranked: DataFrame, k: int) -> DataFrame:
    """At most min(5, max(2, k / 2)) chunks a document while others are left, then the rest in order: rows with a final rank.

    A chunk's place among its document's, against the cap, decides its class; a window per query does the rest.
    """
    cap = min(5, max(2, k // 2))
    place = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("rank"))
    rows = ranked.withColumn("late", (place > cap).cast("int"))
    final = F.row_number().over(W.partitionBy("query_id").orderBy("late", "rank"))
    return rows.withColumn("final_rank", final).where(F.col("final_rank") <= k).drop("late")


def merge_best(hits: DataFrame, k: int) -> DataFrame:
    """Best score of each chunk over several query variants, best k a query."""
    best = hits.groupBy("query_id", "chunk_id", "chunk_index").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: When a weak candidate waits: its fused score, that of the best one put off, and by how much that one leads; fixed values.
WEAK_FUSED, STRONG_DEFERRED, LEAD = 0.08, 0.18, 0.20


def diverse_with_deferral(ranked: DataFrame, k: int, protected: int = 0) -> DataFrame:
    """As diverse_top_k, but a weak candidate (fused .08 or less) also waits while one that its document's cap put off is strong (fused .18 or more) and leads by .20; and of the first
    k, up to ``protected`` that were dropped come back in place of lower-ranked ones.

    ranked(query_id, chunk_id, document_id, rank, fused, rerank_score): a bounded pool for each query. The decisions follow the order, so they are one fold over a query's pool, in
    the JVM."""
    cap = min(5, max(2, k // 2))
    item = "struct<rank:int,chunk_id:string,document_id:string,fused:double,quality:double>"
    quality = F.when(F.col("rerank_score") > 0, F.col("rerank_score")).otherwise(F.col("fused"))
    own = F.struct(F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), F.col("fused").cast("double").alias("fused"), quality.cast("double").alias("quality"))
    pools = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(own)).cast(f"array<{item}>").alias("pool"))
    none = F.array().cast(f"array<{item}>")
    start = F.struct(none.alias("kept"), none.alias("capped"), none.alias("weak"))

    def step(s, x):
        full = F.size(s.kept) >= k
        room = F.size(F.filter(s.kept, lambda y: y.document_id == x.document_id)) < cap
        best = F.array_max(F.transform(s.capped, lambda y: F.struct(y.quality.alias("quality"), y.fused.alias("fused"))))
        waits = room & (x.fused <= WEAK_FUSED) & F.coalesce((best.fused >= STRONG_DEFERRED) & (best.quality >= x.quality + LEAD), F.lit(False))
        add = lambda where, to: F.when(~full & where, F.concat(to, F.array(x))).otherwise(to)
        return F.struct(add(room & ~waits, s.kept).alias("kept"), add(~room, s.capped).alias("capped"), add(waits, s.weak).alias("weak"))

    picked = F.aggregate("pool", start, step, lambda s: F.slice(F.concat(s.kept, s.capped, s.weak), 1, k))
    rows = pools.withColumn("picked", picked)
    ids = F.transform("picked", lambda x: x["rank"])
    missing = F.slice(F.filter("pool", lambda x: (x["rank"] <= k) & ~F.array_contains(ids, x["rank"])), 1, max(protected, 1))
    rows = rows.withColumn("missing", F.when((F.lit(protected) > 0) & (F.size("picked") == k), missing).otherwise(none))
    n = F.size("missing")
    cut = F.array_max(F.transform("missing", lambda x: x["rank"]))
    lower = F.filter("picked", lambda x: x["rank"] > cut)
    # The last ones that rank below those that come back; where there are too few of them, the first of the list.
    out = F.when(F.size(lower) >= n, F.slice(lower, F.size(lower) - n + 1, n)).otherwise(F.slice("picked", F.lit(1), n))
    final = F.when(n > 0, F.array_sort(F.concat(F.array_except("picked", out), F.col("missing")))).otherwise(F.col("picked"))
    return rows.select("query_id", F.posexplode(F.slice(final, 1, k)).alias("pos", "x")).select("query_id", "x.chunk_id", "x.document_id", (F.col("pos") + 1).alias("final_rank"))
