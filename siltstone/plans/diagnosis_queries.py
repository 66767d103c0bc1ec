"""Registered queries of diagnoses, on traces whose debug documents come in three generations of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis
from . import tables as D
from .registry import query

#: The debug document of an event by the k of its props: nested, by groups, and flat with numbers in strings; some are no JSON.
_DOCUMENTS = (
    '{{"retrieval_debug": {{"accessible_document_count": {a}, "pre_rerank_count": {p}, "post_rerank_count": {q}, "permission_probe_early_stop_applied": {s}}}, "citations": {c}, "evidence_audit": {{"unsupported_count": {u}}}, "insufficient_evidence": {i}}}',
    '{{"debug": {{"counts": {{"accessible": {a}, "pre_rerank": {p}, "post_rerank": {q}}}, "probe": {{"stopped": {s}}}}}, "answer": {{"citation_count": {n}, "audit": {{"unsupported": {u}}}, "insufficient_evidence": {i}, "error": {e}}}}}',
    '{{"accessible_document_count": "{a}", "pre_rerank_count": "{p}", "post_rerank_count": {q}, "selected_citation_count": "{n}", "unsupported_count": {u}, "pre_rerank_count_old": 9}}',
)


def _debug(k, concat, text, when) -> list:
    """The three documents as expressions of one engine or the other. k: the expression of k."""
    parts = {"a": f"{k} % 5", "p": f"{k} % 7 - 2", "q": f"{k} % 3", "n": f"{k} % 4", "u": f"greatest({k} % 9 - 7, 0)", "s": when(f"{k} % 23 = 0", "'true'", "'false'"), "i": when(f"{k} % 13 = 0", "'true'", "'false'"), "e": when(f"{k} % 19 = 0", "'\"boom\"'", "'null'"), "c": when(f"{k} % 4 = 0", "'[]'", "'[{\"id\": 1}, {\"id\": 2}]'")}
    made = []
    for document in _DOCUMENTS:
        pieces = document.format(**{name: f"\x01{name}\x01" for name in parts}).split("\x01")
        made.append(concat([f"'{p}'" if i % 2 == 0 else (parts[p] if p in "siec" else text(parts[p])) for i, p in enumerate(pieces)]))
    return made


_SQL = _debug("k", lambda p: " || ".join(p), lambda x: f"({x})::VARCHAR", lambda c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)")
_INT = "coalesce({}, 0)"


def _get(paths: tuple[str, ...], kind: str) -> str:
    return "coalesce(" + ", ".join(f"try_cast(json_extract_string(j, '{p}') AS {kind})" for p in paths) + ")"


def _field(name: str, kind: str) -> str:
    return _get(diagnosis.DEBUG_PATHS[name][0], kind)


TRACES = f"""WITH t AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
d AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN '{{broken' WHEN event_id % 3 = 0 THEN {_SQL[0]} WHEN event_id % 3 = 1 THEN {_SQL[1]} ELSE {_SQL[2]} END AS debug FROM t), v AS (SELECT *, CASE WHEN json_valid(debug) THEN debug::JSON END AS j FROM d),
f AS (SELECT event_id, event_type, {_field('error_text', 'VARCHAR')} AS err, {_field('probe_stopped', 'BOOLEAN')} AS stopped, {_field('accessible_document_count', 'INT')} AS a, {_field('pre_rerank_count', 'INT')} AS p, {_field('post_rerank_count', 'INT')} AS q, coalesce({_field('selected_citation_count', 'INT')}, json_array_length(j, '$.citations')) AS n, {_field('unsupported_count', 'INT')} AS u, {_field('insufficient_evidence', 'BOOLEAN')} AS i FROM v),
g AS (SELECT *, CASE WHEN coalesce(err, '') <> '' THEN 'answer_generation:generation_failed' WHEN coalesce(stopped, false) THEN 'permission_filter:permission_probe_blocked_target' WHEN coalesce(a, 0) <= 0 THEN 'permission_filter:expected_documents_not_accessible' WHEN coalesce(p, 0) <= 0 AND coalesce(q, 0) <= 0 THEN 'candidate_recall:no_candidates_recalled'
  WHEN coalesce(n, 0) <= 0 THEN 'candidate_selection:no_citations_selected' WHEN coalesce(u, 0) > 0 THEN 'answer_generation:unsupported_answer_claims' WHEN coalesce(i, false) THEN 'citation_coverage:insufficient_evidence_after_selection' ELSE 'passed:passed' END AS found FROM f)"""


def _traces(spark, d):
    e = D.table(spark, d, "events").select("event_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    documents = [F.expr(x) for x in _debug("k", lambda p: f"concat({', '.join(p)})", lambda x: f"cast({x} as string)", lambda c, a, b: f"if({c}, {a}, {b})")]
    i = F.col("event_id")
    return diagnosis.trace_diagnosis(e.withColumn("debug", F.when(i % 17 == 0, "{broken").when(i % 3 == 0, documents[0]).when(i % 3 == 1, documents[1]).otherwise(documents[2])))


@query(f"{TRACES} SELECT event_id, split_part(found, ':', 1) AS stage, split_part(found, ':', 2) AS reason_code, a AS accessible_document_count, p AS pre_rerank_count, n AS selected_citation_count FROM g", views=False)
def trace_diagnosis(spark, d):
    """Where each trace went wrong, out of its debug document."""
    made = _traces(spark, d)
    return made.select("event_id", "stage", "reason_code", "accessible_document_count", "pre_rerank_count", F.col("selected_citation_count").cast("long").alias("selected_citation_count"))


@query(f"{TRACES}, c AS (SELECT event_type, found, count(*) AS n FROM g GROUP BY ALL) SELECT event_type, split_part(found, ':', 1) AS stage, split_part(found, ':', 2) AS reason_code, n, round(n / sum(n) OVER (PARTITION BY event_type), 6)::DOUBLE AS share FROM c", views=False)
def trace_diagnosis_counts(spark, d):
    """How often traces of each kind went wrong where."""
    return diagnosis.stage_counts(_traces(spark, d), ("event_type",)).drop("status")
