"""An evaluation run: what every stage of a search had, kept as one table that all audits read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from . import audits, retrieval
from .search import Run, fused, only

#: Names of the audits' stages for the search's sources.
STAGE_OF = {"document_expansion": "expansion"}


def stages(run: Run) -> DataFrame:
    """(case_id, stage, rank, chunk_id, document_id), a written table with a folder for each stage: every source's list, what was fused, what went to the ranking, its result and the final list. An audit
    of one stage reads that stage only. A stage's rows are bounded by the search's limits for each question."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STAGE_OF.items() for x in pair]), F.col("source")), F.col("source"))
    sources = run.hits.select(F.col("query_id").alias("case_id"), name.alias("stage"), F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id")
    one = lambda rows, stage, rank: rows.select(F.col("query_id").alias("case_id"), F.lit(stage).alias("stage"), F.col(rank).cast("long").alias("rank"), "chunk_id", "document_id")
    every = fused(run.hits)
    out = sources.unionByName(one(every, "fused", "position")).unionByName(one(every, "pre_rerank", "position"))
    return written(out.unionByName(one(run.candidates, "reranked", "position")).unionByName(one(run.final, "final", "final_rank")), "stages", by=("stage",))


def truth(passages: DataFrame, chunks: DataFrame, scope_of: DataFrame, members: DataFrame) -> DataFrame:
    """(case_id, document_id, title, visible): the documents that hold each case's passage(query_id, query_text), and whether the asking user may see them. One pass over the chunks."""
    hits = written(retrieval.exact_hits(passages, chunks, keep=("document_title",)).select("query_id", "document_id", F.col("document_title").alias("title")).distinct(), "passage_hits")
    # The hits go to the members: a scope's documents are neither shuffled nor made again for each question.
    asked = hits.select("query_id", "document_id").distinct().join(F.broadcast(scope_of), "query_id")
    seen = members.join(F.broadcast(asked), ["scope_id", "document_id"]).select("query_id", "document_id", F.lit(True).alias("visible"))
    rows = hits.join(seen, ["query_id", "document_id"], "left")
    return rows.select(F.col("query_id").alias("case_id"), "document_id", "title", F.coalesce("visible", F.lit(False)).alias("visible"))


@dataclass
class Evaluation:
    """stages: of stages(), with content; scores: of audits.stage_scores; hits, causes: of the markers; cases: of audits.case_scores, with case_root_cause."""

    stages: DataFrame
    scores: DataFrame
    hits: DataFrame
    causes: DataFrame
    cases: DataFrame


def evaluate(run: Run, cases: DataFrame, markers: DataFrame, known: DataFrame, chunks: DataFrame) -> Evaluation:
    """Scores of a search run. cases(case_id); markers(case_id, marker_id, document_title, aliases): what evidence has to say; known: of truth(): titles that the user may see are expected, others
    forbidden. The expected documents' chunks are one more stage, so that a marker that no expected document holds is told from one that a stage lost."""
    made = stages(run)
    expected = known.where("visible").select("case_id", "title").distinct()
    texts = ("document_title", "content")
    own = chunks.select("chunk_id", "document_id", "chunk_index", *texts).join(F.broadcast(known.where("visible").select("case_id", "document_id")), "document_id")
    place = F.row_number().over(W.partitionBy("case_id").orderBy("document_id", "chunk_index"))
    own = own.select("case_id", F.lit("expected_document_chunks").alias("stage"), place.cast("long").alias("rank"), "chunk_id", "document_id", *texts)
    held = made.join(only(chunks, made).select("chunk_id", *texts), "chunk_id")
    full = written(held.unionByName(own, allowMissingColumns=True), "stage_texts", by=("stage",))
    hits = written(audits.marker_hits(markers, full), "marker_hits")
    causes = written(audits.marker_causes(markers, hits), "causes")
    scores = written(audits.stage_scores(cases, markers, full.where("stage <> 'expected_document_chunks'"), expected, hits.where("stage <> 'expected_document_chunks'")), "scores")
    final = full.where("stage = 'final'")
    titles = final.groupBy("case_id", F.col("document_title").alias("title")).agg(F.min("rank").alias("r"))
    ranked = titles.select("case_id", "title", F.row_number().over(W.partitionBy("case_id").orderBy("r")).alias("rank"))
    evidence = scores.where("stage = 'final'").select("case_id", "evidence_recall")
    result = audits.case_scores(cases, ranked, expected, known.where("not visible").select("case_id", "title").distinct(), evidence)
    return Evaluation(full, scores, hits, causes, result.join(audits.case_causes(cases, causes), "case_id"))


def lost_in(stage_hits: DataFrame, before: str, after: str) -> DataFrame:
    """(case_id, marker_id, rank): markers that one stage has and a later one lacks."""
    had = stage_hits.where(F.col("stage") == before).select("case_id", "marker_id", "rank")
    return had.join(stage_hits.where(F.col("stage") == after).select("case_id", "marker_id"), ["case_id", "marker_id"], "left_anti")


def recall_curve(scores: DataFrame, order: tuple[str, ...] = ("lexical", "indexed_sparse", "expansion", "fused", "pre_rerank", "reranked", "final")) -> DataFrame:
    """(stage, place, cases, title_recall, evidence_recall, full_evidence): means of stage_scores by stage in pipeline order, and how many cases have all evidence there."""
    names = F.array(*[F.lit(s) for s in order])
    mean: Column = lambda c: F.round(F.avg(c), 6).alias(c)
    rows = scores.where(F.col("stage").isin(*order)).groupBy("stage").agg(F.count("*").alias("cases"), mean("title_recall"), mean("evidence_recall"), F.count_if(F.col("evidence_recall") >= 1).alias("full_evidence"))
    return rows.withColumn("place", F.array_position(names, F.col("stage")).cast("int"))
