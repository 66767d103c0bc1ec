"""Registered queries of question forms, sub-queries, coverage, final lists and the support of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage, fusion, rerank, retrieval, support, variants
from . import queries as Q
from . import tables as D
from .registry import query
from .sqltext import flat, low, normal


# Forms of a question. The tables' questions get brackets, a filler phrase and, for some, a title.
_ASKED = "CASE query_id % 3 WHEN 0 THEN 'What is ' || query_text WHEN 1 THEN '[' || query_text || ']' ELSE query_text END"
FORMS = f"""a AS (SELECT query_id, {_ASKED} AS o, CASE WHEN query_id % 4 = 0 THEN 'Doc ' || query_id END AS title FROM queries), n AS (SELECT *, {normal('o')} AS n FROM a),
f AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(replace({low('n')}, 'what is', ' '), '[，。！？、,:;；]+', ' ', 'g')), '\\s+', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM n)"""


def _asked(spark, d):
    i = F.col("query_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("What is "), "query_text")).when(i % 3 == 1, F.concat(F.lit("["), "query_text", F.lit("]"))).otherwise(F.col("query_text"))
    return D.queries(spark, d).select("query_id", text.alias("query_text"), F.when(i % 4 == 0, F.concat(F.lit("Doc "), i.cast("string"))).alias("title"))


@query(f", {FORMS} SELECT query_id, n AS normalized, f AS focused, {normal('f')} AS refocused, length(n) <= 80 AND false AS precise FROM f")
def question_forms(spark, d):
    f = variants.focused(variants.normalized("query_text"))
    return _asked(spark, d).select("query_id", variants.normalized("query_text").alias("normalized"), f.alias("focused"), variants.normalized(f).alias("refocused"), variants.is_precise_lookup("query_text").alias("precise"))


def _signature(sql: str) -> str:
    return f"regexp_replace({low(sql)}, '\\s+', '', 'g')"


@query(
    f""", {FORMS}, w AS (SELECT query_id, 0 AS pos, 'baseline' AS key, n AS retrieval_query FROM f UNION ALL SELECT query_id, 1, 'focused', {normal('f')} FROM f WHERE {_signature(normal('f'))} <> {_signature('n')}
      UNION ALL SELECT query_id, 4, 'title_anchor', CASE WHEN contains({normal('f')}, title) THEN {normal('f')} ELSE title || ' ' || {normal('f')} END FROM f WHERE title IS NOT NULL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, key, retrieval_query FROM w"""
)
def query_variants(spark, d):
    made = variants.query_variants(_asked(spark, d))
    return made.select("query_id", F.col("pos").cast("long").alias("pos"), "key", "retrieval_query")


PROBES = """p AS (SELECT event_id % 400 AS query_id, 'k' || (event_id % 3) AS key, min(event_id) % 5 AS hit_count, round(avg(value), 3) AS top_score, round(min(value), 3) AS average_score, (min(event_id) % 3) / 3 AS concentration, min(event_id) % 2 AS title_match, event_id % 3 AS pos FROM events GROUP BY 1, 2, 8)"""


@query(
    f"""WITH {PROBES}, r AS (SELECT *, CASE WHEN max(top_score) OVER w = min(top_score) OVER w THEN (top_score > 0)::INT ELSE (top_score - min(top_score) OVER w) / (max(top_score) OVER w - min(top_score) OVER w) END AS a, CASE WHEN max(average_score) OVER w = min(average_score) OVER w THEN (average_score > 0)::INT ELSE (average_score - min(average_score) OVER w) / (max(average_score) OVER w - min(average_score) OVER w) END AS b,
      CASE WHEN max(hit_count) OVER w = min(hit_count) OVER w THEN (hit_count > 0)::INT ELSE (hit_count - min(hit_count) OVER w) / (max(hit_count) OVER w - min(hit_count) OVER w) END AS c FROM p WINDOW w AS (PARTITION BY query_id)),
    s AS (SELECT *, round(0.35 * a + 0.2 * b + 0.2 * c + 0.15 * concentration + 0.1 * title_match + CASE WHEN key = 'k1' AND hit_count > 0 THEN 0.08 ELSE 0 END, 9) AS final_score FROM r)
    SELECT query_id, key, round(final_score, 6)::DOUBLE AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, title_match DESC, hit_count DESC, average_score DESC, top_score DESC, pos) AS n FROM s) WHERE n = 1""",
    views=False,
)
def selected_plans(spark, d):
    e = D.table(spark, d, "events")
    rows = e.groupBy((F.col("event_id") % 400).alias("query_id"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("key"), (F.col("event_id") % 3).alias("pos")).agg(F.min("event_id").alias("m"), F.round(F.avg("value"), 3).alias("top_score"), F.round(F.min("value"), 3).alias("average_score"))
    probes = rows.select("query_id", "key", (F.col("m") % 5).alias("hit_count"), "top_score", "average_score", (F.col("m") % 3 / 3).alias("concentration"), (F.col("m") % 2).alias("title_match"))
    own = rows.select("query_id", "key", "pos", F.when(F.col("key") == "k1", F.array(F.lit("title_anchor"))).otherwise(F.array().cast("array<string>")).alias("strategies"))
    return variants.select_plans(own, probes).select("query_id", "key", F.round("final_score", 6).alias("final_score"))


# Sub-queries: questions of the four shapes around the tables' texts.
SUBS = f"""e AS (SELECT query_id, trim(regexp_replace(regexp_replace(query_text, '[^A-Za-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM queries), h AS (SELECT query_id, t[1:30] AS a, t[20:60] AS b FROM e),
subs AS (SELECT query_id, 0 AS sub_id, 'Org ' || query_id || ' 报告 ' || trim(a) AS query_text, 'Org ' || query_id AS org_hint, trim(a) AS evidence_hint, 'cross_document_comparison' AS case_shape FROM h WHERE query_id % 4 = 0 UNION ALL SELECT query_id, 1, 'Firm ' || query_id || ' 报告 ' || trim(b), 'Firm ' || query_id, trim(b), 'cross_document_comparison' FROM h WHERE query_id % 4 = 0
  UNION ALL SELECT query_id, 0, 'Org ' || query_id || ' 年报 ' || trim(a), 'Org ' || query_id, trim(a), 'same_document_two_matters' FROM h WHERE query_id % 4 = 1 UNION ALL SELECT query_id, 1, 'Org ' || query_id || ' 年报 ' || trim(b), 'Org ' || query_id, trim(b), 'same_document_two_matters' FROM h WHERE query_id % 4 = 1
  UNION ALL SELECT query_id, 0, 'Org ' || query_id || ' 表格 清单 ' || trim(a), 'Org ' || query_id, trim(a), 'table_structured_lookup' FROM h WHERE query_id % 4 = 2)"""


def _subs(spark, d):
    i = F.col("query_id")
    text = T.squeeze(F.regexp_replace("query_text", "[^A-Za-z0-9 ]", ""))
    n = i.cast("string")
    a, b = F.substring(text, 1, 30), F.substring(text, 20, 41)
    two = F.concat(F.lit("“"), a, F.lit("”和“"), b, F.lit("”"))
    asked = (
        F.when(i % 4 == 0, F.concat(F.lit("请比较Org "), n, F.lit("和Firm "), n, F.lit("两份报告，它们分别关注"), two)).when(i % 4 == 1, F.concat(F.lit("同时核对Org "), n, F.lit("这份年报中的两个事项："), two))
        .when(i % 4 == 2, F.concat(F.lit("核对Org "), n, F.lit("文件中的表格或清单信息“"), a, F.lit("”"))).otherwise(F.col("query_text"))
    )
    return variants.subqueries(D.queries(spark, d).select("query_id", asked.alias("query_text")))


@query(f", {SUBS} SELECT * FROM subs")
def subqueries(spark, d):
    return _subs(spark, d)


@query(f", {SUBS} SELECT query_id, sub_id, CASE WHEN case_shape = 'cross_document_comparison' THEN (SELECT coalesce(array_to_string(list(t ORDER BY regexp_matches(t, '[0-9]') DESC, length(t) DESC, t DESC)[1:4], ' '), '') FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(evidence_hint), '[a-z0-9]+')) AS t) WHERE NOT regexp_full_match(t, '[0-9]{{1,2}}')) ELSE evidence_hint END AS query_text FROM subs")
def subquery_source_texts(spark, d):
    return _subs(spark, d).select("query_id", "sub_id", variants.source_query(_subs(spark, d), "lexical").alias("query_text"))


@query(
    f""", {SUBS} SELECT query_id, sub_id, CASE case_shape WHEN 'cross_document_comparison' THEN 16 WHEN 'table_structured_lookup' THEN CASE WHEN length(regexp_replace(evidence_hint, '[^A-Za-z0-9]', '', 'g')) >= 0 THEN 24 END ELSE 60 END AS source_limit FROM subs"""
)
def subquery_source_limits(spark, d):
    limit = variants.source_limit("indexed_sparse", 60, {"cross_document_comparison": 16, "table_structured_lookup": 24, "single_anchor": 12})
    return _subs(spark, d).select("query_id", "sub_id", limit.cast("int").alias("source_limit"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]*[0-9][A-Za-z0-9_.\\-]*'), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: length(x) >= 2))), ' ') AS terms FROM documents""",
    views=False,
)
def discriminator_terms(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.array_join(variants.discriminators("text"), " ").alias("terms"))


MERGE = """hh AS (SELECT document_id % 25 AS query_id, document_id % 3 AS sub_id, chunk_id, document_id, chunk_index, (length(content) * 7 % 101) / 10 AS score FROM chunks WHERE chunk_index < 6),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY score DESC, chunk_id) AS rank FROM hh),
t0 AS (SELECT query_id, chunk_id, 0 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY late, rank, chunk_id) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank, chunk_id) > 1)::INT AS late FROM rk WHERE sub_id = 0) QUALIFY n <= 4),
t1 AS (SELECT query_id, chunk_id, 1 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY late, rank, chunk_id) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank, chunk_id) > 1)::INT AS late FROM rk WHERE sub_id = 1) QUALIFY n <= 4),
t2 AS (SELECT query_id, chunk_id, 2 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY late, rank, chunk_id) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank, chunk_id) > 1)::INT AS late FROM rk WHERE sub_id = 2) QUALIFY n <= 4),
tk AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""


@query(f", {MERGE} SELECT query_id, chunk_id, rank FROM (SELECT rk.query_id, rk.chunk_id, row_number() OVER (PARTITION BY rk.query_id ORDER BY coalesce(tier, 3), coalesce(n, 0), score DESC, chunk_index, rk.chunk_id) AS rank FROM rk LEFT JOIN tk USING (query_id, chunk_id)) WHERE rank <= 20")
def merged_subquery_hits(spark, d):
    from pyspark.sql import Window as W

    rows = D.chunks(spark, d).where("chunk_index < 6").select((F.col("document_id") % 25).alias("query_id"), (F.col("document_id") % 3).alias("sub_id"), "chunk_id", "document_id", "chunk_index", (F.length("content") * 7 % 101 / 10).alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "sub_id").orderBy(F.desc("score"), "chunk_id")))
    return coverage.merge_subquery_hits(rows, 20, 4, 3).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


# Permission probes: questions of a plain user about a restricted document.
@query(
    """, q AS (SELECT query_id, (query_id * 31) % 140 + 1 AS user_id, 'src' || (query_id % 20) || '-' || query_id * 3 AS target FROM queries WHERE query_id % 2 = 0), h AS (SELECT query_id, user_id, target, document_id FROM q JOIN docs ON contains(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), regexp_replace(target, '[^a-z0-9]+', '', 'g')) OR contains(regexp_replace(target, '[^a-z0-9]+', '', 'g'), regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')))
    SELECT query_id, target, count(*) AS inaccessible_count FROM h LEFT JOIN decisions d USING (user_id, document_id) GROUP BY 1, 2 HAVING count(d.reason) = 0"""
)
def stopped_probes(spark, d):
    from ..operators import access

    i = F.col("query_id")
    target = F.concat(F.lit("src"), (i % 20).cast("string"), F.lit("-"), (i * 3).cast("string"))
    asked = F.when(i % 2 == 0, F.concat(F.lit("作为普通查看用户，能否直接查看"), target, F.lit("这份受限材料？"))).otherwise(F.col("query_text"))
    q = D.queries(spark, d).select("query_id", (i * 31 % 140 + 1).alias("user_id"), asked.alias("query_text"))
    docs = D.documents(spark, d).drop("content")
    people = D.users(spark, d).join(F.broadcast(q.select("user_id").distinct()), "user_id", "left_semi")  # only those who ask
    seen = access.decisions(docs, D.acl(spark, d), people, D.departments(spark, d))
    return coverage.stopped_probes(q, docs, seen)


# Final list: candidates of the fused search with made-up rerank scores.
KEEP = f"""{Q.HITS}, cand AS (SELECT n.*, document_id, chunk_index, round(0.45 * lexical_norm + 0.55 * vector_norm, 9) AS fused FROM norm n JOIN chunks USING (chunk_id)),
kp AS (SELECT *, round(fused * 0.46 + round(lexical_norm, 9) * 0.42 + least(round(lexical_raw, 9), 1) * 0.12, 9) AS keep_score FROM cand WHERE is_lex)"""


@query(f", {KEEP} SELECT query_id, chunk_id, place, round(keep_score, 6)::DOUBLE AS keep_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keep_score DESC, fused DESC, round(lexical_norm, 9) DESC, round(lexical_raw, 9) DESC, chunk_index, chunk_id) AS place FROM kp) WHERE place <= 8")
def kept_candidates(spark, d):
    rows = D.chunks(spark, d).select("chunk_id", "document_id", "chunk_index").join(F.broadcast(fusion.fuse(Q._hits(spark, d))), "chunk_id")  # at most 40 a query
    for c in ("fused", "lexical_norm", "lexical_raw"):
        rows = rows.withColumn(c, retrieval.tie(F.col(c)))
    return coverage.kept_candidates(rows, 8).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"), F.round("keep_score", 6).alias("keep_score"))


POOL = """cd AS (SELECT document_id % 30 AS query_id, chunk_id, chunk_index, (length(content) * 17 % 1009) / 1009 AS fused, (length(content) * 29 % 997) / 997 AS lexical_raw, (length(content) * 5 % 991) / 991 AS vector_raw, CASE chunk_index % 4 WHEN 0 THEN 'document_sweep' WHEN 1 THEN 'document_expansion' ELSE 'lexical' END AS source FROM chunks WHERE chunk_index < 8),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, lexical_raw DESC, vector_raw DESC, chunk_index, chunk_id) AS n, count(*) OVER (PARTITION BY query_id) AS size FROM cd),
b AS (SELECT *, n <= 10 OR size <= 20 AS first, CASE WHEN NOT (n <= 10 OR size <= 20) AND source <> 'lexical' THEN source END AS src FROM a),
c AS (SELECT *, count(DISTINCT src) OVER (PARTITION BY query_id) AS act, row_number() OVER (PARTITION BY query_id, src ORDER BY lexical_raw DESC, fused DESC, vector_raw DESC, chunk_index, chunk_id) AS turn FROM b),
t AS (SELECT *, CASE WHEN first THEN 0 WHEN src IS NOT NULL AND turn <= ceil(10 / greatest(act, 1)) THEN 1 WHEN src IS NOT NULL THEN 2 ELSE 3 END AS tier FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 1 THEN CASE src WHEN 'document_expansion' THEN 1 ELSE 4 END END, CASE WHEN tier IN (1, 2) THEN -lexical_raw END, CASE WHEN tier IN (1, 2) THEN -fused END, fused DESC, lexical_raw DESC, vector_raw DESC, chunk_index, chunk_id) AS place FROM t)"""


@query(f", {POOL} SELECT query_id, chunk_id, place FROM o WHERE place <= 20")
def rerank_pool(spark, d):
    n = F.length("content")
    source = F.when(F.col("chunk_index") % 4 == 0, "document_sweep").when(F.col("chunk_index") % 4 == 1, "document_expansion").otherwise("lexical")
    rows = D.chunks(spark, d).where("chunk_index < 8").select((F.col("document_id") % 30).alias("query_id"), "chunk_id", "chunk_index", (n * 17 % 1009 / 1009).alias("fused"), (n * 29 % 997 / 997).alias("lexical_raw"), (n * 5 % 991 / 991).alias("vector_raw"), F.array(source).alias("sources"))
    return rerank.rerank_pool(rows, 20).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query(f", {Q.SEEDS}, {Q.EXACT.replace('72 +', '64 +')}, sd AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), document_id) AS place FROM seeds GROUP BY query_id, document_id), own AS (SELECT ex.* FROM ex JOIN sd USING (query_id, document_id) WHERE place <= 2) SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_id) AS n FROM own) WHERE n <= 5")
def exact_text_in_seeds(spark, d):
    return retrieval.exact_text_within(D.queries(spark, d), Q._bm25_top(spark, d, 3), D.chunks(spark, d), 2, 5, 5).select("query_id", "chunk_id", "score")


@query(
    f""", {Q.SEEDS}, sd AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), document_id) - 1 AS place FROM seeds GROUP BY query_id, document_id), s2 AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS found FROM sd WHERE place < 2),
    own AS (SELECT s2.*, c.chunk_id, c.chunk_index FROM s2 JOIN chunks c USING (document_id)), st AS (SELECT own.query_id, t.* FROM own JOIN terms t USING (chunk_id)), sdf AS (SELECT query_id, term, count(*) AS df FROM st GROUP BY ALL), sl AS (SELECT query_id, chunk_id, sum(tf) AS doc_len FROM st GROUP BY ALL), ss AS (SELECT query_id, count(*) AS n_chunks, avg(doc_len) AS avg_len FROM sl GROUP BY 1),
    lx AS (SELECT q.query_id, st.chunk_id, sum(ln(1 + (n_chunks - sdf.df + 0.5) / (sdf.df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (greatest(sl.doc_len, 1) / greatest(avg_len, 1.0))))) + 0.18 * count(*) / max(n_terms) AS lexical FROM qterms q JOIN st ON st.query_id = q.query_id AND st.term = q.term JOIN sdf ON sdf.query_id = q.query_id AND sdf.term = q.term JOIN sl ON sl.query_id = q.query_id AND sl.chunk_id = st.chunk_id JOIN ss ON ss.query_id = q.query_id GROUP BY 1, 2),
    sq AS (SELECT s.query_id, s.document_id, term, sum(tf) AS qtf FROM seeds s JOIN s2 USING (query_id, document_id) JOIN terms t ON t.chunk_id = s.chunk_id GROUP BY ALL), ql AS (SELECT query_id, document_id, sum(qtf) AS q_len, count(*) AS nt FROM sq GROUP BY ALL),
    fo AS (SELECT own.query_id, own.chunk_id, least(sum(least(qtf, tf)) / any_value(q_len) + 0.35 * count(*) / any_value(nt), 3) * 0.08 AS focus FROM own JOIN terms t USING (chunk_id) JOIN sq USING (query_id, document_id, term) JOIN ql USING (query_id, document_id) GROUP BY 1, 2),
    sc AS (SELECT own.query_id, document_id, own.chunk_id, chunk_index, round(coalesce(lexical, 0) + coalesce(focus, 0) + 0.12 * (1 - place / found), 9) AS score FROM own LEFT JOIN lx USING (query_id, chunk_id) LEFT JOIN fo USING (query_id, chunk_id) WHERE (coalesce(lexical, 0) > 0 OR coalesce(focus, 0) > 0) AND NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = own.query_id AND x.chunk_id = own.chunk_id)),
    pd AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_index, chunk_id) AS n FROM sc) SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_id) AS m FROM pd WHERE n <= 4) WHERE m <= 10"""
)
def document_first_evidence(spark, d):
    from ..operators import index

    made = retrieval.document_first_evidence(index.query_terms(D.queries(spark, d)), Q._bm25_top(spark, d, 3), D.chunks(spark, d), Q._terms(spark, d), 2, 4, 10)
    return made.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# Support of answers: every assistant turn against the user turns of its session.
CLAIMS = f"""an AS (SELECT session_id, turn, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM messages WHERE role = 'assistant'),
pt AS (SELECT session_id, turn, unnest(string_split_regex(t, '[。！？!?；;]+')) AS raw, generate_subscripts(string_split_regex(t, '[。！？!?；;]+'), 1) AS pos FROM an),
cl AS (SELECT session_id, turn, pos, regexp_replace(regexp_replace(raw, '^[ ，,。；;：:]+', ''), '[ ，,。；;：:]+$', '') AS claim FROM pt), cn AS (SELECT *, {flat('claim')} AS c FROM cl),
cf AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn, c ORDER BY pos) AS again FROM cn WHERE claim <> '' AND length(c) >= 14),
claims AS (SELECT session_id, turn, pos, claim, c, row_number() OVER (PARTITION BY session_id, turn ORDER BY pos) - 1 AS claim_no FROM cf WHERE again = 1),
ev AS (SELECT session_id, turn AS chunk_id, content AS e, {flat('content')} AS en FROM messages WHERE role = 'user'),
pr AS (SELECT k.*, chunk_id, e, en FROM claims k JOIN ev USING (session_id)),
ch AS (SELECT session_id, turn, claim_no, i, c[i::INT] AS x FROM (SELECT *, unnest(range(1, length(c) + 1)) AS i FROM claims)), eh AS (SELECT session_id, chunk_id, j, en[j::INT] AS x FROM (SELECT *, unnest(range(1, length(en) + 1)) AS j FROM ev)),
dg AS (SELECT session_id, turn, claim_no, chunk_id, i, j - i AS diag, i - row_number() OVER (PARTITION BY session_id, turn, claim_no, chunk_id, j - i ORDER BY i) AS island FROM ch JOIN eh USING (session_id, x)),
lc AS (SELECT session_id, turn, claim_no, chunk_id, max(n) AS n FROM (SELECT session_id, turn, claim_no, chunk_id, diag, island, count(*) AS n FROM dg GROUP BY ALL) GROUP BY ALL),
tk AS (SELECT *, list_distinct(regexp_extract_all({low('claim')}, '[a-z0-9]{{2,}}')) AS ct, list_distinct(regexp_extract_all({low('e')}, '[a-z0-9]{{2,}}')) AS et,
  list_filter(list_transform(string_split_regex({low('claim')}, '，|。|；|;|：|:|、|\\(|\\)|（|）'), lambda p: regexp_replace(p, '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')), lambda p: length(p) >= 4) AS parts FROM pr),
sc AS (SELECT t.*, CASE WHEN len(ct) > 0 THEN len(list_intersect(ct, et)) / len(ct) ELSE 0 END AS rec, coalesce(n, 0) / length(c) AS lng, CASE WHEN len(parts) > 0 THEN list_reduce(list_prepend({{'at': 1::BIGINT, 'hits': 0::BIGINT, 'p': ''}}, list_transform(parts, lambda p: {{'at': 0::BIGINT, 'hits': 0::BIGINT, 'p': p}})),
    lambda a, x: {{'at': CASE WHEN instr(substr(en, a.at), x.p) > 0 THEN a.at + instr(substr(en, a.at), x.p) - 1 + length(x.p) ELSE a.at END, 'hits': a.hits + (instr(substr(en, a.at), x.p) > 0)::BIGINT, 'p': ''}}).hits / len(parts) ELSE 0 END AS ord FROM tk t LEFT JOIN lc USING (session_id, turn, claim_no, chunk_id)),
fs AS (SELECT *, CASE WHEN en = '' THEN 0 WHEN contains(en, c) THEN 1 ELSE round(CASE WHEN rec < 0.28 AND ord < 0.34 THEN least(0.55 * rec + 0.25 * ord + 0.2 * lng, 0.35) ELSE 0.55 * rec + 0.25 * ord + 0.2 * lng END, 4) END AS score FROM sc)"""


def _support(spark, d):
    m = D.messages(spark, d)
    key = F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn").cast("string"))
    answers = m.where("role = 'assistant'").select(key.alias("answer_id"), "session_id", F.col("content").alias("answer"))
    seen = m.where("role = 'user'").select("session_id", F.col("turn").alias("chunk_id"), "content")
    return answers, support.answer_claim_support(answers, answers.select("answer_id", "session_id").join(seen, "session_id"))


@query(f", {CLAIMS}, b AS (SELECT session_id, turn, claim_no, max(score) AS best FROM fs GROUP BY ALL) SELECT session_id || '-' || turn AS answer_id, claim_no::INT AS claim_no, coalesce(best, 0)::DOUBLE AS best, CASE WHEN best >= 0.75 THEN 'supported' WHEN best >= 0.5 THEN 'partial' ELSE 'unsupported' END AS status FROM claims LEFT JOIN b USING (session_id, turn, claim_no)")
def claim_support(spark, d):
    """Support of every claim of every answer by what the user said in the session."""
    return _support(spark, d)[1].select("answer_id", "claim_no", "best", "status")


@query(f", {CLAIMS} SELECT session_id || '-' || turn AS answer_id, count(c.claim) AS claim_count FROM an LEFT JOIN claims c USING (session_id, turn) GROUP BY session_id, turn")
def answer_claim_counts(spark, d):
    answers, made = _support(spark, d)
    return support.claim_support_metrics(made, answers).select("answer_id", "claim_count")


FACTS = f"""w AS (SELECT query_id AS case_id, query_text[1:100] AS answer, query_text[60:180] AS evidence, list_sort(list_distinct(regexp_extract_all({low('query_text')}, '[a-z0-9]{{4,}}')))[1:3] AS facts FROM queries),
fc AS (SELECT case_id, answer, evidence, unnest(facts) AS fact FROM w), fm AS (SELECT case_id, fact, length(fact)::DOUBLE AS weight, contains({low('answer')}, fact) OR contains({flat('answer')}, fact) AS a, contains({low('evidence')}, fact) OR contains({flat('evidence')}, fact) AS e FROM fc),
fg AS (SELECT case_id, sum(weight) AS total, coalesce(sum(weight) FILTER (a), 0) AS said, coalesce(sum(weight) FILTER (a AND e), 0) AS bth, coalesce(sum(weight) FILTER (e), 0) AS known FROM fm GROUP BY 1)"""


@query(
    f""", {FACTS} SELECT case_id, CASE WHEN total IS NULL THEN 1 WHEN said = 0 THEN 0 ELSE round(bth / said, 4) END::DOUBLE AS support_precision, CASE WHEN total IS NULL THEN 1 ELSE round(bth / total, 4) END::DOUBLE AS support_recall, CASE WHEN total IS NULL THEN 1 WHEN bth = 0 THEN 0 ELSE round(2 * (bth / said) * (bth / total) / (bth / said + bth / total), 4) END::DOUBLE AS support_f1,
    coalesce(round(said / total, 4), 0)::DOUBLE AS answer_fact_recall, coalesce(round(known / total, 4), 0)::DOUBLE AS evidence_fact_recall FROM w LEFT JOIN fg USING (case_id)"""
)
def fact_support(spark, d):
    facts = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(T.fold("query_text"), F.lit("([a-z0-9]{4,})"), 1))), 1, 3)
    specs = F.transform(facts, lambda f: F.struct(f.alias("label"), F.array(f).alias("aliases"), F.length(f).cast("double").alias("weight")))
    rows = D.queries(spark, d).select(F.col("query_id").alias("case_id"), specs.alias("specs"), F.substring("query_text", 1, 100).alias("answer"), F.substring("query_text", 60, 121).alias("evidence"))
    return support.fact_support(rows).select("case_id", "support_precision", "support_recall", "support_f1", "answer_fact_recall", "evidence_fact_recall")


@query(f", {CLAIMS}, u AS (SELECT k.session_id, k.turn, k.claim_no, v.turn AS et, unnest(string_split_regex(content, '[。！？!?；;\\n]+')) AS unit, generate_subscripts(string_split_regex(content, '[。！？!?；;\\n]+'), 1) AS pos, k.claim FROM claims k JOIN messages v ON v.session_id = k.session_id AND v.role = 'user' AND v.turn = k.turn - 1), s AS (SELECT *, list_distinct(regexp_extract_all({low('claim')}, '[a-z0-9]{{2,}}')) AS ct, list_distinct(regexp_extract_all({low('unit')}, '[a-z0-9]{{2,}}')) AS ut FROM u WHERE trim(unit) <> ''), r AS (SELECT *, CASE WHEN len(ct) > 0 THEN round(len(list_intersect(ct, ut)) / len(ct), 9) ELSE 0 END AS share FROM s) SELECT session_id || '-' || turn || '-' || claim_no AS claim_id, round(max(share), 6)::DOUBLE AS share FROM r WHERE share > 0 GROUP BY session_id, turn, claim_no")
def excerpt_shares(spark, d):
    """How much of a claim its best excerpt of the user's last turn holds."""
    m = D.messages(spark, d)
    key = F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn").cast("string"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    made = support.answer_claims(m.where("role = 'assistant'").select(key.alias("answer_id"), F.col("content").alias("answer")).repartition(tasks, "answer_id"))
    part = lambda i: F.split_part("answer_id", F.lit("-"), F.lit(i)).cast("long")
    claims = made.select(F.concat_ws("-", "answer_id", F.col("claim_no").cast("string")).alias("claim_id"), part(1).alias("session_id"), (part(2) - 1).alias("turn"), "claim")
    before = m.where("role = 'user'").select("session_id", "turn", "content")
    own = claims.join(before, ["session_id", "turn"])
    best = support.support_excerpt(claims.select("claim_id", "claim"), own.select("claim_id", "content"), 100_000).join(claims, "claim_id")
    from ..operators.evidence import share_found

    return best.select("claim_id", F.round(share_found(support.support_tokens("claim"), support.support_tokens("excerpt")), 6).alias("share"))


# Answers: the fused candidates as results.
_ANSWER_STOP = "['what','does','the','say','about','tell','me','is','in','a','an','of','for','and','to','should','require','requires','document','documents','doc','file','handbook','guide','register','runbook','playbook','manual','policy']"


def _answer_features(sql: str) -> str:
    own = f"list_distinct(list_filter(regexp_extract_all({sql}, '[a-z0-9]+'), lambda t: NOT list_contains({_ANSWER_STOP}, t)))"
    return f"list_distinct(list_concat({own}, {Q.EXTRA.format(f"regexp_replace({sql}, '\\s+', '', 'g')")}))"


RESULTS = f"""{Q.HITS}, rs AS (SELECT n.query_id, n.chunk_id, document_id, round(lexical_raw, 9) AS lexical_raw, round(0.45 * lexical_norm + 0.55 * vector_norm, 9) AS fused, {low('query_text')} AS qt, {low('document_title')} AS tt, {low("document_title || ' ' || content")} AS wt, chunk_index FROM norm n JOIN chunks USING (chunk_id) JOIN queries USING (query_id)),
rp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_index, chunk_id) AS position FROM rs), rf AS (SELECT *, {_answer_features('qt')} AS q, {_answer_features('wt')} AS w, {_answer_features('tt')} AS t FROM rp WHERE position <= 10),
ro AS (SELECT *, CASE WHEN least(len(q), len(w)) > 0 THEN len(list_intersect(q, w)) / least(len(q), len(w)) ELSE 0 END AS overlap, CASE WHEN least(len(q), len(t)) > 0 THEN len(list_intersect(q, t)) / least(len(q), len(t)) ELSE 0 END AS tov FROM rf),
rr AS (SELECT *, round(fused + overlap * 0.18 + tov * 0.08, 9) AS relevance, greatest(fused, round(fused + overlap * 0.18 + tov * 0.08, 9)) AS effective FROM ro),
r6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, fused DESC, position) AS rk FROM rr WHERE position <= 6),
rt AS (SELECT *, first(fused) OVER k AS tf, first(document_id) OVER k AS td, first(relevance) OVER k AS tr FROM r6 WINDOW k AS (PARTITION BY query_id ORDER BY rk)),
rk AS (SELECT * FROM rt WHERE NOT ((overlap < 0.12 AND lexical_raw <= 0 AND effective < 0.9) OR (fused < greatest(0.16, tf * 0.45) AND overlap < 0.18 AND lexical_raw <= 0 AND effective < 0.95) OR (document_id <> td AND (relevance + 0.08 < tr OR (fused < tf * 0.85 AND overlap < 0.22))))),
relevant AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS place FROM rk) WHERE place <= 3)"""


def _relevant(spark, d):
    from pyspark.sql import Window as W

    from ..operators import answers

    rows = D.chunks(spark, d).join(F.broadcast(fusion.fuse(Q._hits(spark, d)).join(D.queries(spark, d), "query_id")), "chunk_id")  # at most 40 a query
    for c in ("fused", "lexical_raw"):
        rows = rows.withColumn(c, retrieval.tie(F.col(c)))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_index", "chunk_id"))
    rows = rows.withColumn("position", place).where("position <= 10").withColumn("section_title", F.lit("")).withColumn("rerank", F.lit(None).cast("double"))
    return answers.relevant_results(answers.with_relevance(rows))


@query(f", {RESULTS} SELECT query_id, chunk_id, place, round(relevance, 6)::DOUBLE AS relevance FROM relevant")
def relevant_results(spark, d):
    return _relevant(spark, d).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"), F.round("relevance", 6).alias("relevance"))


@query(
    f""", {RESULTS}, one AS (SELECT query_id, max(overlap) FILTER (place = 1) AS o, max(effective) FILTER (place = 1) AS e, max(lexical_raw) FILTER (place = 1) AS x, avg(effective) AS mean, max(effective) FILTER (place = 2) AS e2, max(document_id) FILTER (place = 1) AS d1, max(document_id) FILTER (place = 2) AS d2, count(*) AS n FROM relevant GROUP BY 1),
    dc AS (SELECT query_id, CASE WHEN n IS NULL THEN 'no_retrieval_hits' WHEN e < 0.28 OR (o < 0.12 AND x <= 0 AND e < 0.9) OR (o < 0.18 AND e < 0.6) OR mean < 0.22 THEN 'insufficient_relevant_evidence' WHEN n >= 2 AND abs(e - e2) <= 0.08 AND d1 <> d2 AND o < 0.24 THEN 'conflicting_or_ambiguous_evidence' ELSE 'relevant_evidence_found' END AS reason FROM queries LEFT JOIN one USING (query_id))
    SELECT query_id, reason <> 'relevant_evidence_found' AS abstain, reason FROM dc"""
)
def answer_decisions(spark, d):
    from ..operators import answers

    return answers.decisions(D.queries(spark, d), _relevant(spark, d))


@query(
    """, f AS (SELECT document_id % 150 AS query_id, document_id AS doc, chunk_index % 6 AS facet, (length(content) % 40) / 40 AS score FROM chunks), b AS (SELECT query_id, doc, count(DISTINCT facet) AS n, max(score) AS score, count(*) AS size FROM f GROUP BY query_id, doc),
    r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS n2, lead(score) OVER w AS s2 FROM b WINDOW w AS (PARTITION BY query_id ORDER BY n DESC, score DESC, size DESC, doc)) SELECT query_id, doc AS document_id FROM r WHERE r = 1 AND n2 IS NOT NULL AND ((n >= 4 AND n >= n2 + 2) OR (n >= 4 AND n > n2 AND score >= s2 + 0.03))"""
)
def dominant_documents(spark, d):
    from ..operators import answers

    rows = D.chunks(spark, d).select((F.col("document_id") % 150).alias("query_id"), "document_id", F.array(F.col("chunk_index") % 6).alias("facets"), (F.length("content") % 40 / 40).alias("score"), F.lit(4).alias("n_asked"))
    return answers.dominant_documents(rows)
