"""Reports over cases, runs, chunks and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dataset_report(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Per dataset: cases, completed and failed runs, and the latest run. Datasets come from either table."""
    c = cases.groupBy("dataset").agg(F.count("*").alias("n_cases"))
    done = lambda s: F.count(F.when(F.col("status") == s, 1))
    r = runs.groupBy("dataset").agg(done("completed").alias("n_completed"), done("failed").alias("n_failed"), F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest_run"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return c.join(r, "dataset", "full_outer").select("dataset", zero("n_cases"), zero("n_completed"), zero("n_failed"), "latest_run")


def run_trend(runs: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` completed runs of each dataset, numbered oldest first."""
    last = runs.where("status = 'completed'").withColumn("n", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("created_at"), F.desc("run_id"))))
    last = last.where(F.col("n") <= limit)
    return last.withColumn("point", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("n")))).drop("n")


def ingestion_quality(chunks: DataFrame, noise: Column, max_noisy_share: float = 0.1) -> DataFrame:
    """Per document: chunks, chunks with noise, their share, chunks of each kind, whether positions are gapless, and whether it passes."""
    made = chunks.groupBy("document_id").agg(
        F.count("*").alias("n_chunks"),
        F.count(F.when(noise, 1)).alias("n_noisy"),
        F.count(F.when(F.col("chunk_type") == "table", 1)).alias("n_tables"),
        (F.max("chunk_index") - F.min("chunk_index") + 1 == F.countDistinct("chunk_index")).alias("gapless"),
    )
    share = F.col("n_noisy") / F.col("n_chunks")
    return made.withColumn("noisy_share", share).withColumn("passed", share <= max_noisy_share)


def corpus_totals(quality: DataFrame) -> DataFrame:
    """One row over all documents: counts, pass rate, documents with tables, average chunks."""
    return quality.agg(F.count("*").alias("n_documents"), F.sum("n_chunks").alias("n_chunks"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count(F.when(F.col("n_tables") > 0, 1)).alias("n_with_tables"), F.avg("n_chunks").alias("avg_chunks"))


def overlap_summary(cases: DataFrame, threshold: float) -> DataFrame:
    """Overlap figures of cases(case_type, overlap) by type and over all: count, mean, median, quartiles, share under the threshold."""
    p = lambda q: F.percentile("overlap", F.lit(q))
    made = cases.rollup("case_type").agg(F.count("overlap").alias("n"), F.avg("overlap").alias("avg"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.avg((F.col("overlap") < threshold).cast("double")).alias("low_rate"))
    return made.withColumn("case_type", F.coalesce(F.col("case_type").cast("string"), F.lit("all")))


def case_errors(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_name, error): missing or repeated names, no question, unknown outcome, no expected or an unknown document."""
    n = F.count("*").over(W.partitionBy("case_name"))
    rows = cases.withColumn("n", n)
    bare = F.array_compact(
        F.array(
            F.when(F.coalesce("case_name", F.lit("")) == "", "missing_case_name"),
            F.when((F.coalesce("case_name", F.lit("")) != "") & (F.col("n") > 1), "duplicate_case_name"),
            F.when(F.coalesce("question", F.lit("")) == "", "missing_question"),
            F.when(~F.coalesce("expected_outcome", F.lit("")).isin("answer", "refuse"), "invalid_expected_outcome"),
            F.when((F.col("expected_outcome") == "answer") & (F.coalesce(F.size("expected_document_ids"), F.lit(0)) <= 0), "answer_without_expected_document"),
        )
    )
    known = documents.select(F.col("id").alias("document")).distinct()
    unknown = cases.select("case_name", F.explode("expected_document_ids").alias("document")).join(known, "document", "left_anti")
    return rows.select("case_name", F.explode(bare).alias("error")).unionByName(unknown.select("case_name", F.concat(F.lit("unknown_expected_document:"), "document").alias("error")))


def nearest_candidate(markers: DataFrame, candidates: DataFrame, windows: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Per marker(marker_id, document_id, chunk_index): the nearest candidate(document_id, chunk_index, rank) of its document, ties
    to the better rank, its distance, and whether that is within each window."""
    rows = markers.join(candidates.select("document_id", F.col("chunk_index").alias("at"), "rank"), "document_id")
    best = rows.groupBy("marker_id").agg(F.min(F.struct(F.abs(F.col("at") - F.col("chunk_index")).alias("distance"), "rank", "at")).alias("b"))
    return best.select("marker_id", "b.distance", "b.rank", F.col("b.at").alias("nearest"), *[(F.col("b.distance") <= w).alias(f"within_{w}") for w in windows])


def move_subtree(departments: DataFrame, old: str, new: str) -> DataFrame:
    """departments with the id_path prefix of a moved subtree rewritten; a move below itself is refused."""
    if new == old or new.startswith(old + "/"):
        raise ValueError("a department can't be moved below itself")
    inside = (F.col("id_path") == old) | F.startswith(F.col("id_path"), F.lit(old + "/"))
    moved = F.concat(F.lit(new), F.expr(f"substring(id_path, {len(old) + 1})"))
    return departments.withColumn("id_path", F.when(inside, moved).otherwise(F.col("id_path")))


def acl_operation(view: Column, manage: Column, old_view: Column, old_manage: Column) -> Column:
    """create, noop, revoke, unchanged or update; the old columns are null without an existing row."""
    grants, exists = view | manage, old_view.isNotNull()
    return F.when(~exists, F.when(grants, "create").otherwise("noop")).when(~grants, "revoke").when((view == old_view) & (manage == old_manage), "unchanged").otherwise("update")
