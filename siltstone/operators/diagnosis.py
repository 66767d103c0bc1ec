"""Where an answer went wrong, from stored traces and from evaluation results: nested debug documents are read as VARIANT, once a row, with the keys of several generations by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
STAGE_LABELS = {"passed": "通过", "permission_filter": "权限过滤", "candidate_recall": "候选召回", "candidate_selection": "候选选择", "citation_coverage": "引用覆盖", "answer_generation": "答案生成"}
REASON_LABELS = {
    "passed": "未发现明显问题",
    "unauthorized_content_leaked": "出现越权内容泄漏",
    "expected_documents_not_accessible": "期望文档不在当前用户可见范围",
    "permission_probe_blocked_target": "权限探测判定目标文档不可见",
    "no_candidates_recalled": "没有召回到候选内容",
    "expected_documents_not_recalled": "期望文档未进入召回结果",
    "expected_facts_not_recalled": "期望事实未进入召回结果",
    "expected_evidence_not_selected": "召回到了相关候选，但最终没有选中期望证据",
    "selected_citations_missing_required_facts": "已选引用未覆盖所需事实",
    "selected_citations_do_not_support_answer": "已选引用不足以支撑答案",
    "answered_instead_of_refusing": "应该拒答但模型仍给出回答",
    "refused_despite_available_evidence": "已有足够证据但模型仍拒答",
    "unsupported_answer_claims": "答案包含未被证据支撑的事实",
    "answer_did_not_follow_evidence": "答案没有按证据作答",
    "overall_score_below_threshold": "综合评分未达到阈值",
    "generation_failed": "生成阶段报错",
    "no_citations_selected": "生成前未选出引用证据",
    "insufficient_evidence_after_selection": "已选引用后仍证据不足",
}
#: For each field of a trace's debug document, its places, newest first, and its type.
DEBUG_PATHS = {
    "accessible_document_count": (("$.retrieval_debug.accessible_document_count", "$.debug.counts.accessible", "$.accessible_document_count"), "int"),
    "pre_rerank_count": (("$.retrieval_debug.pre_rerank_count", "$.debug.counts.pre_rerank", "$.pre_rerank_count"), "int"),
    "post_rerank_count": (("$.retrieval_debug.post_rerank_count", "$.debug.counts.post_rerank", "$.post_rerank_count"), "int"),
    "probe_stopped": (("$.retrieval_debug.permission_probe_early_stop_applied", "$.debug.probe.stopped", "$.permission_probe_early_stop_applied"), "boolean"),
    "probe_target": (("$.retrieval_debug.permission_probe_target_hint", "$.debug.probe.target", "$.permission_probe_target_hint"), "string"),
    "selected_citation_count": (("$.selected_citation_count", "$.answer.citation_count"), "int"),
    "unsupported_count": (("$.evidence_audit.unsupported_count", "$.answer.audit.unsupported", "$.unsupported_count"), "int"),
    "audit_status": (("$.evidence_audit.status", "$.answer.audit.status", "$.audit_status"), "string"),
    "insufficient_evidence": (("$.insufficient_evidence", "$.answer.insufficient_evidence"), "boolean"),
    "error_text": (("$.error_text", "$.answer.error", "$.error"), "string"),
}
#: Places of the list of citations, which is counted where no count is stored.
CITATION_PATHS = ("$.citations", "$.answer.citations")


def first_of(document: Column, paths: tuple[str, ...], kind: str) -> Column:
    """The first place of a VARIANT that holds a value of the type (numbers in strings count); null where none does."""
    return F.coalesce(*[F.try_variant_get(document, p, kind) for p in paths])


def debug_fields(traces: DataFrame, column: str = "debug", paths: dict[str, tuple[tuple[str, ...], str]] = DEBUG_PATHS) -> DataFrame:
    """traces with one typed column for each field of paths, out of their JSON text. A text that is no JSON, or null, gives nulls; a column of such a name that is there already is replaced."""
    rows = traces.withColumn("_v", F.try_parse_json(F.col(column)))
    rows = rows.withColumns({name: first_of(F.col("_v"), places, kind) for name, (places, kind) in paths.items()})
    if "selected_citation_count" in paths:
        listed = F.coalesce(*[F.size(F.try_variant_get(F.col("_v"), p, "array<variant>")) for p in CITATION_PATHS])
        rows = rows.withColumn("selected_citation_count", F.coalesce("selected_citation_count", listed))
    return rows.drop("_v")


def _named(rows: DataFrame, found: Column) -> DataFrame:
    """status, stage and reason_code of 'status:stage:reason', and their labels."""
    label = lambda labels, c: F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col(c))
    rows = rows.withColumn("_f", F.split(found, ":")).withColumns({"status": F.col("_f")[0], "stage": F.col("_f")[1], "reason_code": F.col("_f")[2]}).drop("_f")
    return rows.withColumns({"stage_label": label(STAGE_LABELS, "stage"), "reason_label": label(REASON_LABELS, "reason_code")})


def trace_diagnosis(traces: DataFrame, column: str = "debug") -> DataFrame:
    """traces(..., debug) with the fields of debug_fields and status, stage, reason_code and their labels: an error; nothing accessible, or a stopped probe; no candidates; no citations; claims that nothing supports; evidence that does not
    suffice; else passed. Counts that are missing are 0."""
    rows = debug_fields(traces, column)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    stopped = F.coalesce("probe_stopped", F.lit(False))
    found = (
        F.when(T.text("error_text") != "", "failed:answer_generation:generation_failed").when(stopped, "warning:permission_filter:permission_probe_blocked_target")
        .when(n("accessible_document_count") <= 0, "warning:permission_filter:expected_documents_not_accessible").when((n("pre_rerank_count") <= 0) & (n("post_rerank_count") <= 0), "warning:candidate_recall:no_candidates_recalled")
        .when(n("selected_citation_count") <= 0, "warning:candidate_selection:no_citations_selected").when(n("unsupported_count") > 0, "warning:answer_generation:unsupported_answer_claims")
        .when(F.coalesce("insufficient_evidence", F.lit(False)), "warning:citation_coverage:insufficient_evidence_after_selection").otherwise("passed:passed:passed")
    )
    return _named(rows, found)


def evaluation_diagnosis(cases: DataFrame) -> DataFrame:
    """cases with status, stage, reason_code and their labels: the first thing that went wrong with an evaluated case.

    Columns: passed, leaked, refuse (a refusal is expected), insufficient (the answer says that evidence does not suffice), probe_stopped, n_probe_inaccessible, n_accessible and n_inaccessible (expected titles by access), retrieval, citation and
    faithfulness (scores), n_matched and n_missing (expected titles retrieved), pre_rerank_count, post_rerank_count, retrieved_fact_recall, n_cited (expected titles cited), evidence_fact_recall, n_unsupported_claims, n_unsupported_facts. Nulls
    are 0 or false."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    lost = (n("retrieval") < 0.5) | ((n("n_missing") > 0) & (n("n_matched") == 0))
    empty = (n("pre_rerank_count") <= 0) & (n("post_rerank_count") <= 0)
    found = (
        F.when(b("passed"), "passed:passed:passed").when(b("leaked"), "failed:permission_filter:unauthorized_content_leaked").when(b("refuse") & ~b("insufficient"), "failed:answer_generation:answered_instead_of_refusing")
        .when(b("refuse"), "failed:answer_generation:overall_score_below_threshold").when(b("probe_stopped") & (n("n_probe_inaccessible") > 0), "failed:permission_filter:permission_probe_blocked_target")
        .when((n("n_inaccessible") > 0) & (n("n_accessible") == 0), "failed:permission_filter:expected_documents_not_accessible")
        .when(lost & empty, "failed:candidate_recall:no_candidates_recalled").when(lost & (n("retrieved_fact_recall") <= 0), "failed:candidate_recall:expected_facts_not_recalled").when(lost, "failed:candidate_recall:expected_documents_not_recalled")
        .when((n("citation") < 0.5) & ((n("n_cited") > 0) | (n("evidence_fact_recall") > 0)), "failed:citation_coverage:selected_citations_missing_required_facts").when(n("citation") < 0.5, "failed:candidate_selection:expected_evidence_not_selected")
        .when((n("faithfulness") < 0.7) & (n("n_unsupported_claims") > 0), "failed:answer_generation:unsupported_answer_claims").when((n("faithfulness") < 0.7) & b("insufficient"), "failed:answer_generation:refused_despite_available_evidence")
        .when((n("faithfulness") < 0.7) & ((n("n_unsupported_facts") > 0) | (n("evidence_fact_recall") < 1)), "failed:citation_coverage:selected_citations_do_not_support_answer")
        .when(n("faithfulness") < 0.7, "failed:answer_generation:answer_did_not_follow_evidence").otherwise("failed:answer_generation:overall_score_below_threshold")
    )
    return _named(cases, found)


def stage_counts(diagnosed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, stage, reason_code, n, share) of diagnosed rows: the share is of all rows with the same ``by``."""
    from pyspark.sql import Window as W

    made = diagnosed.groupBy(*by, "status", "stage", "reason_code").agg(F.count("*").alias("n"))
    return made.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*by)), 6))
