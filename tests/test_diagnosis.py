"""Diagnoses from traces with keys of several generations, and of evaluated cases."""

import json

import pytest

from siltstone.operators import diagnosis

GOOD = {"accessible_document_count": 3, "pre_rerank_count": 5, "post_rerank_count": 2}


@pytest.mark.parametrize(
    ("document", "stage", "reason"),
    [
        (None, "permission_filter", "expected_documents_not_accessible"),
        ("{broken", "permission_filter", "expected_documents_not_accessible"),
        ("[]", "permission_filter", "expected_documents_not_accessible"),
        ({"retrieval_debug": GOOD, "citations": [{"id": 1}]}, "passed", "passed"),
        ({"debug": {"counts": {"accessible": 3, "pre_rerank": 1}}, "answer": {"citation_count": 2}}, "passed", "passed"),
        ({**{k: str(v) for k, v in GOOD.items()}, "selected_citation_count": "2"}, "passed", "passed"),
        ({"retrieval_debug": GOOD, "accessible_document_count": 0, "citations": [1]}, "passed", "passed"),  # the newest place counts
        ({"retrieval_debug": {**GOOD, "accessible_document_count": "many"}, "accessible_document_count": 4, "citations": [1]}, "passed", "passed"),  # one that is no number does not
        ({"retrieval_debug": GOOD}, "candidate_selection", "no_citations_selected"),
        ({"retrieval_debug": GOOD, "selected_citation_count": 0, "citations": [1, 2]}, "candidate_selection", "no_citations_selected"),
        ({"retrieval_debug": {"accessible_document_count": 3}}, "candidate_recall", "no_candidates_recalled"),
        ({"retrieval_debug": {**GOOD, "permission_probe_early_stop_applied": True}, "citations": [1]}, "permission_filter", "permission_probe_blocked_target"),
        ({"retrieval_debug": GOOD, "citations": [1], "evidence_audit": {"unsupported_count": 2}}, "answer_generation", "unsupported_answer_claims"),
        ({"retrieval_debug": GOOD, "citations": [1], "insufficient_evidence": True}, "citation_coverage", "insufficient_evidence_after_selection"),
        ({"retrieval_debug": GOOD, "citations": [1], "answer": {"error": "timeout"}}, "answer_generation", "generation_failed"),
    ],
)
def test_trace_diagnosis(spark, document, stage, reason):
    text = document if document is None or isinstance(document, str) else json.dumps(document)
    row = diagnosis.trace_diagnosis(spark.createDataFrame([(1, text, "old")], "trace_id int, debug string, stage string")).first()
    assert (row.stage, row.reason_code, row.stage_label) == (stage, reason, diagnosis.STAGE_LABELS[stage])
    assert row.status == ("passed" if stage == "passed" else "failed" if reason == "generation_failed" else "warning")


NAMES = "passed leaked refuse insufficient probe_stopped n_probe_inaccessible n_accessible n_inaccessible retrieval citation faithfulness n_matched n_missing pre_rerank_count post_rerank_count retrieved_fact_recall n_cited evidence_fact_recall n_unsupported_claims n_unsupported_facts".split()
FINE = {"passed": False, "leaked": False, "refuse": False, "insufficient": False, "probe_stopped": False, "retrieval": 1.0, "citation": 1.0, "faithfulness": 1.0, "n_accessible": 1, "n_matched": 1, "pre_rerank_count": 3, "evidence_fact_recall": 1.0, "retrieved_fact_recall": 1.0}


@pytest.mark.parametrize(
    ("change", "stage", "reason"),
    [
        ({"passed": True, "leaked": True}, "passed", "passed"), ({"leaked": True, "refuse": True}, "permission_filter", "unauthorized_content_leaked"), ({"refuse": True}, "answer_generation", "answered_instead_of_refusing"),
        ({"refuse": True, "insufficient": True}, "answer_generation", "overall_score_below_threshold"), ({"probe_stopped": True, "n_probe_inaccessible": 1}, "permission_filter", "permission_probe_blocked_target"),
        ({"probe_stopped": True}, "answer_generation", "overall_score_below_threshold"), ({"n_accessible": 0, "n_inaccessible": 2}, "permission_filter", "expected_documents_not_accessible"),
        ({"n_inaccessible": 2, "retrieval": 0.4, "pre_rerank_count": 0}, "candidate_recall", "no_candidates_recalled"), ({"n_matched": 0, "n_missing": 1, "retrieved_fact_recall": 0.0}, "candidate_recall", "expected_facts_not_recalled"),
        ({"retrieval": 0.4}, "candidate_recall", "expected_documents_not_recalled"), ({"citation": 0.4, "n_cited": 1}, "citation_coverage", "selected_citations_missing_required_facts"),
        ({"citation": 0.4, "evidence_fact_recall": 0.0}, "candidate_selection", "expected_evidence_not_selected"), ({"faithfulness": 0.6, "n_unsupported_claims": 1, "insufficient": True}, "answer_generation", "unsupported_answer_claims"),
        ({"faithfulness": 0.6, "insufficient": True}, "answer_generation", "refused_despite_available_evidence"), ({"faithfulness": 0.6, "evidence_fact_recall": 0.9}, "citation_coverage", "selected_citations_do_not_support_answer"),
        ({"faithfulness": 0.6}, "answer_generation", "answer_did_not_follow_evidence"), ({}, "answer_generation", "overall_score_below_threshold"),
        ({k: None for k in FINE}, "candidate_recall", "no_candidates_recalled"),
    ],
)
def test_evaluation_diagnosis(spark, change, stage, reason):
    row = {**dict.fromkeys(NAMES), **FINE, **change}
    kinds = ", ".join(f"{n} {'boolean' if n in ('passed', 'leaked', 'refuse', 'insufficient', 'probe_stopped') else 'double'}" for n in NAMES)
    values = tuple(float(row[n]) if row[n] is not None and not isinstance(row[n], bool) else row[n] for n in NAMES)
    got = diagnosis.evaluation_diagnosis(spark.createDataFrame([values], kinds)).first()
    assert (got.stage, got.reason_code, got.reason_label) == (stage, reason, diagnosis.REASON_LABELS[reason])
