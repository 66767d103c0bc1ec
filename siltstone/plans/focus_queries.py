"""Registered queries of what answers are made from, over the results of the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import focus, retrieval
from . import search_queries as S
from . import tables as D
from .registry import query
from .sqltext import low


def _terms(sql: str) -> str:
    stop = ", ".join(f"'{w}'" for w in focus.FOCUS_STOP)
    grams = "flatten([" + ", ".join(f"list_transform(range(1, length(t) - {n - 2}), lambda i: t[i:i + {n - 1}])" for n in (4, 5, 6)) + "])"
    return f"list_distinct(list_filter(flatten(list_transform(regexp_extract_all({sql}, '[一-鿿]{{2,}}|[a-z0-9]{{2,}}'), lambda t: CASE WHEN t IN ({stop}) THEN [] WHEN length(t) > 8 THEN {grams} ELSE [t] END)), lambda t: t NOT IN ({stop})))"


def _flat(sql: str) -> str:
    return f"regexp_replace({low(sql)}, '\\s+', '', 'g')"


def _results(spark, d):
    """The first eight candidates of every question of the search, with what focus_score reads."""
    rows = S.the_run(spark, d).candidates.where("position <= 8")
    return rows.select("query_id", "query_text", "position", "chunk_id", "document_id", "document_title", "content", F.lit(None).cast("double").alias("rerank"), "fused", "lexical_norm")


_MATCH = "length(h) >= 4 AND (contains(e, h) OR (len(ht) > 0 AND len(list_filter(ht, lambda t: contains(e, t))) >= greatest(2, len(ht) - 1)))"
FOCUSED = rf"""{S.CANDIDATES},
fc AS (SELECT cd.query_id, position, chunk_id, document_id, fused, lexical_norm, asked, {_terms(_flat('asked'))} AS terms, {_flat("coalesce(document_title || ' ', '') || content")} AS e FROM cd JOIN qs USING (query_id) WHERE position <= 8),
fo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused DESC, position) AS n FROM (SELECT *, round(fused + lexical_norm * 0.06 + len(list_filter(terms, lambda t: contains(e, t) AND length(t) >= 4)) * 0.08 + len(list_filter(terms, lambda t: contains(e, t) AND length(t) < 4)) * 0.04, 9) AS score FROM fc)),
hn AS (SELECT query_id, sub_id, {_flat('wanted')} AS h, list_filter({_terms(_flat('wanted'))}, lambda t: length(t) >= 3) AS ht FROM sb WHERE shape IN ({S.CROSS}, {S.SAME})),
p1 AS (SELECT query_id, min(n) AS n FROM fo JOIN hn USING (query_id) WHERE sub_id = 0 AND {_MATCH} GROUP BY 1),
p2 AS (SELECT query_id, min(fo.n) AS n FROM fo JOIN hn USING (query_id) LEFT JOIN p1 USING (query_id) WHERE sub_id = 1 AND {_MATCH} AND fo.n IS DISTINCT FROM p1.n GROUP BY 1),
pk AS (SELECT fo.*, CASE WHEN fo.n = p1.n THEN 0 WHEN fo.n = p2.n THEN 1 ELSE 2 END AS tier FROM fo LEFT JOIN p1 USING (query_id) LEFT JOIN p2 USING (query_id)),
pd2 AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY tier, n) <= 2)"""


@query(f", {FOCUSED} SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, n) AS place FROM pd2) WHERE place <= 5")
def focused_chunks(spark, d):
    """What each question's answer is made from: a chunk for each quoted span first, then the best, two a document."""
    return focus.focused_chunks(_results(spark, d)).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


# Tables: each candidate's chunk with its words also as three rows, for questions that ask for two fields.
_ROWS = "'Table row: 审批链路=' || array_to_string(w[1:4], ' ') || chr(10) || 'Table row: 时限=' || array_to_string(w[5:8], ' ') || chr(10) || 'Table row: 时限=' || array_to_string(w[9:12], ' ')"
TABLED = rf"""{S.CANDIDATES},
tq AS (SELECT cd.query_id, chunk_id, '审批 时限 的表格 ' || query_text AS asked, content AS line, string_split(content, ' ') AS w, position FROM cd JOIN queries USING (query_id) WHERE position <= 5),
tf AS (SELECT *, {_terms(_flat('asked'))} AS terms, ['Table row: 审批链路=' || array_to_string(w[1:4], ' '), 'Table row: 时限=' || array_to_string(w[5:8], ' '), 'Table row: 时限=' || array_to_string(w[9:12], ' ')] AS raw FROM tq),
tr1 AS (SELECT query_id, chunk_id, terms, unnest(list_transform(raw, lambda r: trim(r))) AS r, generate_subscripts(raw, 1) AS i FROM tf),
tr2 AS (SELECT *, len(list_filter(terms, lambda t: contains({_flat('r')}, t) AND length(t) >= 4)) * 4 + len(list_filter(terms, lambda t: contains({_flat('r')}, t) AND length(t) < 4)) * 2 + CASE WHEN contains(r, '审批链路=') THEN 16 ELSE 0 END AS s FROM tr1),
tr3 AS (SELECT *, row_number() OVER w AS k, first(s) OVER w AS best, first(r) OVER w AS top FROM tr2 WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY s DESC, i)),
tr4 AS (SELECT query_id, chunk_id, max(r) FILTER (k = 1) AS one, arg_min(r, k) FILTER (k > 1 AND s > 0 AND s >= best * 0.75 AND r <> top) AS two FROM tr3 GROUP BY ALL),
tl4 AS (SELECT query_id, chunk_id, trim(line) AS line, len(list_filter(terms, lambda t: contains({_flat('line')}, t))) > 0 AS hit FROM tf)"""


@query(f", {TABLED} SELECT query_id, chunk_id, concat_ws(chr(10), CASE WHEN hit AND line <> '' THEN line END, one, two) AS focused FROM tr4 JOIN tl4 USING (query_id, chunk_id)")
def focused_rows(spark, d):
    """The rows and lines of each candidate's table that a question about its fields needs."""
    rows = S.the_run(spark, d).candidates.where("position <= 5").drop("query_text").join(D.queries(spark, d), "query_id")
    words = F.split("content", " ")
    row = lambda name, k: F.concat(F.lit(f"Table row: {name}="), F.array_join(F.slice(words, k, 4), " "))
    table = F.concat_ws("\n", "content", row("审批链路", 1), row("时限", 5), row("时限", 9))
    made = focus.focused_rows(rows.select("query_id", "chunk_id", F.concat(F.lit("审批 时限 的表格 "), "query_text").alias("query_text"), table.alias("content")))
    return made.select("query_id", "chunk_id", "focused")


_STOP = ", ".join(f"'{w}'" for w in focus.SUMMARY_STOP)
_SQUEEZED = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
_ENDED = "CASE WHEN regexp_matches(x, '[。！？…]$') THEN x ELSE rtrim(regexp_replace(x, '[；;：:，,]$', '')) || '。' END"
SUMMED = rf"""{S.FINAL},
su AS (SELECT query_id, chunk_id, final.document_id, final_rank, document_title, chunk_index, {_SQUEEZED} AS flat, list_filter(list_distinct(regexp_extract_all(lower(asked), '[a-z0-9]{{3,}}')), lambda t: t NOT IN ({_STOP})) AS terms FROM final JOIN qs USING (query_id) JOIN chunks USING (chunk_id) WHERE final_rank <= 3),
s1 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(flat, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(regexp_replace(p, '^[ ，；;。]+', ''), '[ ，；;。]+$', '')), lambda p: p <> '') AS parts FROM su),
s2 AS (SELECT *, list_filter(CASE WHEN len(parts) > 1 AND NOT regexp_matches(flat, '[。！？!?；;]$') THEN parts[:-2] ELSE parts END, lambda p: NOT (length(p) < 12 OR regexp_matches(p, '(例如|比如|另外|还有|只有这|以及|并|和)$') OR (regexp_matches(p, '[A-Za-z0-9一-鿿]$') AND length(p) <= 16))) AS whole FROM s1),
s3 AS (SELECT query_id, chunk_id, terms, unnest(whole) AS p, generate_subscripts(whole, 1) AS i FROM s2),
s4 AS (SELECT query_id, chunk_id, i, list_sum(list_transform(terms, lambda t: CASE WHEN contains({low('p')}, t) THEN CASE WHEN length(t) >= 4 THEN 2 ELSE 1 END ELSE 0 END)) AS s, regexp_replace(regexp_replace(p, '^[ ：:；;，,]+', ''), '[ ：:；;，,]+$', '') AS c FROM s3),
s5 AS (SELECT query_id, chunk_id, i, coalesce(s, 0) AS s, CASE WHEN length(c) <= 520 THEN c ELSE rtrim(c[1:517]) || '...' END AS x FROM s4), s6 AS (SELECT *, {_ENDED} AS t FROM s5 WHERE x <> ''),
s7 AS (SELECT *, row_number() OVER w AS k, first(t) OVER w AS top FROM s6 WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY s DESC, i)),
s8 AS (SELECT query_id, chunk_id, max(t) FILTER (k = 1) AS one, arg_min(t, k) FILTER (k > 1 AND s > 0 AND t <> top AND length(top) + length(t) <= 520) AS two FROM s7 GROUP BY ALL),
sm AS (SELECT su.*, concat_ws(' ', one, two) AS summary FROM su LEFT JOIN s8 USING (query_id, chunk_id))"""


def _summaries(spark, d):
    run = S.the_run(spark, d)
    rows = run.final.where("final_rank <= 3").join(run.candidates.select("query_id", "chunk_id", "query_text", "document_title", "content", "chunk_index"), ["query_id", "chunk_id"])
    return focus.chunk_summaries(rows)


@query(f", {SUMMED} SELECT query_id, chunk_id, summary FROM sm")
def chunk_summaries(spark, d):
    """The best sentences of each of a question's first three results, within 520 characters."""
    return _summaries(spark, d).select("query_id", "chunk_id", "summary")


@query(
    f""", {SUMMED}, cl2 AS (SELECT *, trim(regexp_replace(trim(summary), '[。！？!?；;，,：:]$', '')) AS clause FROM sm),
    ag AS (SELECT query_id, list(clause ORDER BY final_rank) FILTER (clause <> '') AS said, list(coalesce(document_title, '') || '（分块 ' || chunk_index || '）提到：' || clause ORDER BY final_rank) FILTER (clause <> '') AS each, arg_min(coalesce(document_title, ''), final_rank) AS title, count(DISTINCT coalesce(document_title, '')) AS n FROM cl2 GROUP BY 1)
    SELECT query_id, CASE WHEN n > 1 THEN CASE WHEN len(each) > 0 THEN '根据当前可访问文档中的证据，' || array_to_string(each, '；') || '。' ELSE '根据当前可访问文档中的证据。' END WHEN len(said) >= 3 THEN '根据当前可访问文档中的证据，' || title || '主要有三点：第一，' || said[1] || '；第二，' || said[2] || '；第三，' || said[3] || '。'
      WHEN len(said) = 2 THEN '根据当前可访问文档中的证据，' || title || '主要有两点：第一，' || said[1] || '；第二，' || said[2] || '。' WHEN len(said) = 1 THEN '根据当前可访问文档中的证据，' || title || '主要说明：' || said[1] || '。' ELSE '根据当前可访问文档中的证据，' || title || '包含与该问题相关的说明，建议结合引用片段进一步确认。' END AS answer FROM ag"""
)
def composed_answers(spark, d):
    """An answer to every question from the summaries of its first three results."""
    rows = _summaries(spark, d).withColumn("place", F.col("final_rank")).withColumn("location", F.concat(F.lit("分块 "), F.col("chunk_index").cast("string")))
    return focus.composed_answers(rows)


@query(
    f""", qx AS (SELECT query_id, {S.compact('query_text')} AS nd, (SELECT string_agg(x, '' ORDER BY i) FROM (SELECT replace(lower(query_text[j]), 'ß', 'ss') AS x, j AS i FROM (SELECT unnest(range(1, length(query_text) + 1)) AS j)) WHERE regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS q FROM queries),
    qh AS (SELECT query_id, q, chunk_id, content FROM qx JOIN chunks ON length(nd) >= 10 AND contains({S.compact("document_title || ' ' || content")}, nd)),
    qc AS (SELECT query_id, chunk_id, q, j - 1 AS raw, replace(lower(content[j]), 'ß', 'ss') AS c FROM (SELECT *, unnest(range(1, length(content) + 1)) AS j FROM qh)),
    qf AS (SELECT query_id, chunk_id, any_value(q) AS q, string_agg(c, '' ORDER BY raw) AS f, flatten(list(list_transform(range(length(c)), lambda k: raw) ORDER BY raw)) AS spots FROM qc WHERE regexp_matches(c, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL),
    qs2 AS (SELECT *, unnest(range(1, length(f) - length(q) + 2)) AS i FROM qf)
    SELECT query_id, chunk_id, spots[i] AS start, spots[i + length(q) - 1] + 1 AS stop FROM qs2 WHERE substr(f, i::INT, length(q)::INT) = q"""
)
def quote_spans(spark, d):
    """The raw span of every place where a chunk has a benchmark passage, whatever the case, spaces and marks between."""
    hits = retrieval.exact_hits(D.queries(spark, d), D.chunks(spark, d), keep=("content",))  # a hit brings its text along, chunks are not read again
    rows = hits.join(D.queries(spark, d), "query_id")
    made = focus.quote_spans(rows.select("query_id", "chunk_id", F.col("query_text").alias("quote"), "content"))
    return made.select("query_id", "chunk_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
