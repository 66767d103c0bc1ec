"""Registered queries of the whole search and of the evaluation that reads its stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, audits, coverage, evaluation_run, fusion, search, variants
from ..storage import kept, state_key, written
from . import queries as Q
from . import tables as D
from .registry import query
from .sqltext import flat, low, normal


def _questions(spark, d):
    """A question for each benchmark item, in one of four shapes around parts of its text: two documents compared, two matters of one, a table lookup, and the text
    as it is. Organisations are the sources of the documents. Half of the questions come from an admin (scope 0), half from other users."""
    i = F.col("query_id")
    text = T.squeeze(F.regexp_replace("query_text", "[^A-Za-z0-9 ]", ""))
    a, b, words = F.substring(text, 1, 40), F.substring(text, 31, 40), F.split(text, " ")
    two = F.concat(F.lit("“"), a, F.lit("”和“"), b, F.lit("”"))
    pair = F.concat(F.array_join(F.slice(words, 2, 2), " "), F.lit("为"), F.array_join(F.slice(words, 4, 2), " "))
    org = lambda k: F.concat(F.lit("src"), ((i + k) % 20).cast("string"))
    asked = (
        F.when(i % 4 == 0, F.concat(F.lit("请比较"), org(0), F.lit("和"), org(1), F.lit("两份报告，它们分别关注"), two)).when(i % 4 == 1, F.concat(F.lit("同时核对"), org(0), F.lit("这份年报中的两个事项："), two))
        .when(i % 4 == 2, F.concat(F.lit("核对"), org(0), F.lit("文件中的表格或清单信息“"), pair, F.lit("”"))).otherwise(F.col("query_text"))
    )
    return D.queries(spark, d).select("query_id", F.when(F.floor(i / 4) % 2 == 0, 0).otherwise(i * 31 % 140 + 1).alias("scope_id"), asked.alias("query_text"))


def _index(spark, d):
    """The index, a row for each chunk, and the sizes of documents: tables that are written once for a folder."""
    return Q._index(spark, d), kept(spark, f"{d}/doc_sizes", lambda: Q._index(spark, d).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("doc_len").alias("sum_len")))


_runs: dict[tuple, tuple[search.Run, evaluation_run.Evaluation | None]] = {}


def _scopes(spark, d, asked):
    docs = D.documents(spark, d).drop("content")
    people = D.users(spark, d).join(asked.select(F.col("scope_id").alias("user_id")).distinct(), "user_id", "left_semi")
    seen = access.decisions(docs, D.acl(spark, d), people, D.departments(spark, d)).select(F.col("user_id").alias("scope_id"), "document_id")
    return seen.unionByName(docs.select(F.lit(0).cast("long").alias("scope_id"), "document_id"))


def the_run(spark, d) -> search.Run:
    """The search of all questions, made once for a folder's files and application: its stages are written tables."""
    key = state_key(spark, d)
    if key not in _runs:
        asked = _questions(spark, d)
        _runs[key] = search.search(asked.select("query_id", "query_text"), _scopes(spark, d, asked), asked.select("query_id", "scope_id"), D.chunks(spark, d), *_index(spark, d)), None
    return _runs[key][0]


def the_evaluation(spark, d) -> evaluation_run.Evaluation:
    """The evaluation of that search: a case for each question, two passages of its text as markers, and the documents that hold the whole text as truth."""
    run = the_run(spark, d)
    key = state_key(spark, d)
    if not _runs[key][1]:
        asked, chunks = _questions(spark, d), D.chunks(spark, d)
        text = T.squeeze(F.regexp_replace("query_text", "[^A-Za-z0-9 ]", ""))
        parts = F.explode(F.array(F.struct(F.lit("a").alias("m"), F.trim(F.substring(text, 1, 40)).alias("t")), F.struct(F.lit("b").alias("m"), F.trim(F.substring(text, 31, 40)).alias("t"))))
        markers = D.queries(spark, d).select(F.col("query_id").alias("case_id"), parts.alias("p")).select("case_id", F.concat_ws("-", "case_id", "p.m").alias("marker_id"), F.lit(None).cast("string").alias("document_title"), F.array("p.t").alias("aliases"))
        known = evaluation_run.truth(D.queries(spark, d), chunks, asked.select("query_id", "scope_id"), run.members)
        made = evaluation_run.evaluate(run, asked.select(F.col("query_id").alias("case_id")), markers, written(known, "truth"), chunks)
        _runs[key] = run, made
    return _runs[key][1]


# The SQL side, stage by stage.


def compact(sql: str) -> str:
    return f"regexp_replace({low(sql)}, '[^a-z0-9一-鿿]+', '', 'g')"


def tokens(sql: str) -> str:
    """Latin words, and of each CJK run itself up to 4 characters and its 2-, 3- and 4-grams."""
    grams = ", ".join(f"list_transform(range(1, length(r) - {n - 2}), lambda i: r[i:i + {n - 1}])" for n in (2, 3, 4))
    runs = f"flatten(list_transform(regexp_extract_all({sql}, '[一-鿿]+'), lambda r: list_concat(CASE WHEN length(r) <= 4 THEN [r] ELSE [] END, {grams})))"
    return f"list_concat(regexp_extract_all({low(sql)}, '[a-z0-9]+'), {runs})"


def cover_terms(sql: str) -> str:
    stop = ", ".join(f"'{w}'" for w in variants.LOW_SIGNAL)
    return f"list_filter(list_distinct({tokens(sql)}), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0 END"


def merge(src: str, out: str, total: int, key: str = "query_id") -> str:
    """Turns of two sub-queries, four each, then the best scores."""
    same = " AND ".join(f"z.{k} = h.{k}" for k in [*key.split(", "), "chunk_id"])
    turn = f"row_number() OVER (PARTITION BY {key} ORDER BY late, rank, chunk_id) AS n"
    one = lambda k, rest: f"{out}_{k} AS (SELECT {key}, chunk_id, {k} AS tier, {turn} FROM (SELECT *, (row_number() OVER (PARTITION BY {key}, document_id ORDER BY rank, chunk_id) > 1)::INT AS late FROM {src} h WHERE sub_id = {k} {rest}) QUALIFY n <= 4)"
    return f"""{one(0, '')}, {one(1, f'AND NOT EXISTS (SELECT 1 FROM {out}_0 z WHERE {same})')},
{out} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(tier, 2), coalesce(n, 0), score DESC, chunk_index, chunk_id) AS rank FROM (SELECT {key}, chunk_id, document_id, chunk_index, max(score) AS score FROM {src} GROUP BY ALL)
  LEFT JOIN (FROM {out}_0 UNION ALL FROM {out}_1) USING ({key}, chunk_id) QUALIFY rank <= {total})"""


def fuse(hits: str, out: str) -> str:
    weights = " ".join(f"WHEN '{s}' THEN {w}" for s, w in fusion.SOURCE_WEIGHTS.items())
    return f"""{out}_r AS (SELECT query_id, chunk_id, any_value(document_id) AS document_id, any_value(chunk_index) AS chunk_index, max(score * CASE source {weights} END) AS raw, list_sort(list_distinct(list(source))) AS sources FROM {hits} GROUP BY query_id, chunk_id),
{out}_n AS (SELECT *, CASE WHEN raw <= 0 THEN 0 WHEN max(raw) OVER w = min(raw) OVER w THEN 1 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM {out}_r WINDOW w AS (PARTITION BY query_id)),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, lexical_raw DESC, chunk_index, chunk_id) AS position FROM (SELECT query_id, chunk_id, document_id, chunk_index, sources, round(raw, 9) AS lexical_raw, round(norm, 9) AS lexical_norm, round(0.45 * norm, 9) AS fused FROM {out}_n))"""


BM = "sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (greatest(doc_len, 1) / greatest(avg_len, 1.0))))) + 0.18 * count(*) / max(n_terms)"
STRONGEST = r"(SELECT array_to_string(list(t ORDER BY regexp_matches(t, '[0-9]') DESC, length(t) DESC, t DESC)[1:4], ' ') FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(wanted), '[a-z0-9]+')) AS t) WHERE NOT regexp_full_match(t, '[0-9]{1,2}'))"
PLACES = "ORDER BY score DESC, chunk_index, chunk_id"
DIGITS_FIRST = "ORDER BY regexp_matches(term, '[0-9]') DESC, length(term) DESC, term DESC"
CROSS, SAME, TABLE = "'cross_document_comparison'", "'same_document_two_matters'", "'table_structured_lookup'"

ASKS = rf"""t0 AS (SELECT query_id, query_text, trim(regexp_replace(regexp_replace(query_text, '[^A-Za-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) AS t FROM queries),
t1 AS (SELECT *, CASE WHEN query_id // 4 % 2 = 0 THEN 0 ELSE query_id * 31 % 140 + 1 END AS scope_id, t[1:40] AS a, t[31:70] AS b, 'src' || query_id % 20 AS o1, 'src' || (query_id + 1) % 20 AS o2,
  array_to_string(string_split(t, ' ')[2:3], ' ') || '为' || array_to_string(string_split(t, ' ')[4:5], ' ') AS p FROM t0),
qs AS (SELECT *, CASE query_id % 4 WHEN 0 THEN '请比较' || o1 || '和' || o2 || '两份报告，它们分别关注“' || a || '”和“' || b || '”' WHEN 1 THEN '同时核对' || o1 || '这份年报中的两个事项：“' || a || '”和“' || b || '”' WHEN 2 THEN '核对' || o1 || '文件中的表格或清单信息“' || p || '”' ELSE query_text END AS asked FROM t1),
sb AS (SELECT query_id, 0 AS sub_id, o1 AS org, trim(a) AS wanted, {CROSS} AS shape FROM t1 WHERE query_id % 4 = 0 UNION ALL SELECT query_id, 1, o2, trim(b), {CROSS} FROM t1 WHERE query_id % 4 = 0
  UNION ALL SELECT query_id, 0, o1, trim(a), {SAME} FROM t1 WHERE query_id % 4 = 1 UNION ALL SELECT query_id, 1, o1, trim(b), {SAME} FROM t1 WHERE query_id % 4 = 1 UNION ALL SELECT query_id, 0, o1, trim(p), {TABLE} FROM t1 WHERE query_id % 4 = 2),
ak AS (SELECT query_id, 0 AS sub_id, s AS source, {normal('query_text')} AS txt, '' AS wanted, '' AS org, '' AS shape, 80 AS most FROM t1, (VALUES ('lexical'), ('indexed_sparse')) v(s) WHERE query_id % 4 = 3
  UNION ALL SELECT query_id, sub_id, 'indexed_sparse', CASE WHEN shape = {CROSS} THEN {STRONGEST} ELSE wanted END, wanted, org, shape, CASE WHEN shape = {SAME} THEN 40 ELSE 24 END FROM sb
  UNION ALL SELECT query_id, sub_id, 'lexical', wanted, wanted, org, shape, 80 FROM sb WHERE shape = {TABLE}),
mem AS (SELECT user_id AS scope_id, document_id FROM decisions WHERE user_id IN (SELECT scope_id FROM t1) UNION ALL SELECT 0, document_id FROM docs),
hs AS (SELECT DISTINCT scope_id, org AS hint FROM ak JOIN t1 USING (query_id) WHERE org <> ''),
ti AS (SELECT scope_id, hint, document_id, CASE WHEN contains(lower(title), hint) THEN 0 WHEN contains({compact('title')}, hint) THEN 1 END AS tier FROM hs JOIN mem USING (scope_id) JOIN docs USING (document_id)),
nar AS (SELECT scope_id, hint, document_id FROM (SELECT *, min(tier) OVER (PARTITION BY scope_id, hint) AS best FROM ti WHERE tier IS NOT NULL) WHERE tier = best),
am AS (SELECT scope_id, '' AS hint, document_id FROM mem UNION ALL FROM nar),
az AS (SELECT query_id || '/' || sub_id || '/' || source AS ask, ak.*, t1.scope_id, coalesce(n.hint, '') AS hint FROM ak JOIN t1 USING (query_id) LEFT JOIN (SELECT DISTINCT scope_id, hint FROM nar) n ON n.scope_id = t1.scope_id AND n.hint = ak.org)"""

FOUND = rf"""{ASKS},
aw AS (SELECT *, count(*) OVER (PARTITION BY ask) AS n_terms FROM (SELECT *, row_number() OVER (PARTITION BY ask {DIGITS_FIRST}) AS n FROM (SELECT ask, source, scope_id, hint, unnest(list_distinct({tokens('txt')})) AS term FROM az) WHERE NOT regexp_full_match(term, '[0-9]{{1,2}}|[一-鿿]')) WHERE n <= CASE source WHEN 'lexical' THEN 64 ELSE 10 END),
pl AS (SELECT t.*, document_id, chunk_index, doc_len FROM terms t JOIN chunks USING (chunk_id) JOIN doc_len USING (chunk_id)),
mt AS (SELECT scope_id, hint, term, document_id, chunk_id, chunk_index, tf, doc_len FROM (SELECT DISTINCT scope_id, hint, term FROM aw) JOIN pl USING (term) JOIN am USING (scope_id, hint, document_id)),
mdf AS (SELECT scope_id, hint, term, count(*) AS df FROM mt GROUP BY ALL),
msz AS (SELECT scope_id, hint, count(*) AS n_chunks, sum(doc_len) / count(*) AS avg_len FROM am JOIN (SELECT DISTINCT document_id, chunk_id, doc_len FROM pl) USING (document_id) GROUP BY ALL),
bmk AS (SELECT ask, document_id, chunk_id, chunk_index, round({BM}, 9) AS score FROM aw JOIN mt USING (scope_id, hint, term) JOIN mdf USING (scope_id, hint, term) JOIN msz USING (scope_id, hint) GROUP BY ALL),
hy AS (SELECT chunk_id, document_id, chunk_index, {compact("document_title || ' ' || content")} AS hay FROM chunks),
exk AS (SELECT ask, document_id, chunk_id, chunk_index, 72 + least((length(hay) - instr(hay, nd) + 1 - length(nd)) / 40.0, 4.0) AS score FROM (SELECT *, {compact('wanted')} AS nd FROM az WHERE shape IN ({CROSS}, {SAME})) JOIN hy ON length(nd) >= 10 AND contains(hay, nd) JOIN am USING (scope_id, hint, document_id)),
prk AS (SELECT ask, document_id, chunk_id, chunk_index, 96 - least(abs(instr(hay, v) - instr(hay, f)) / 8, 24) + CASE WHEN contains(hay, 'tablerow') THEN 12 ELSE 0 END AS score FROM (SELECT *, {compact("split_part(wanted, '为', 1)")} AS f, {compact("split_part(wanted, '为', 2)")} AS v FROM az WHERE shape = {TABLE} AND source = 'indexed_sparse') JOIN hy ON contains(hay, f) AND contains(hay, v) JOIN am USING (scope_id, hint, document_id)),
wy AS (SELECT *, min(way) OVER (PARTITION BY ask) AS fw FROM (SELECT *, 2 AS way FROM bmk UNION ALL SELECT *, 1 FROM exk UNION ALL SELECT *, 0 FROM prk)),
fd AS (SELECT w.*, query_id, sub_id, source, shape, row_number() OVER (PARTITION BY ask ORDER BY w.score DESC, w.chunk_index, w.chunk_id) AS rank FROM wy w JOIN az USING (ask) WHERE way = fw QUALIFY rank <= most)"""

MERGED = f"""{FOUND}, fs AS (SELECT * FROM fd WHERE shape <> ''), {merge('fs', 'fm', 80, 'query_id, source')},
ff AS (SELECT *, row_number() OVER (PARTITION BY query_id, source {PLACES}) AS rank FROM (SELECT query_id, source, chunk_id, document_id, chunk_index, max(score) AS score FROM fd WHERE shape = '' GROUP BY ALL) QUALIFY rank <= 80),
h1 AS (SELECT query_id, source, document_id, chunk_id, chunk_index, score, rank FROM fm UNION ALL SELECT query_id, source, document_id, chunk_id, chunk_index, score, rank FROM ff)"""


@query(f", {ASKS} SELECT ask, query_id, sub_id, source, txt AS query_text, shape AS case_shape, scope_id, hint, most FROM az")
def search_asks(spark, d):
    """What each source is searched with, and in which scope, for every question."""
    return the_run(spark, d).asks.select("ask", "query_id", "sub_id", "source", "query_text", "case_shape", "scope_id", "hint", "most")


@query(f", {FOUND} SELECT ask, way, chunk_id, rank, round(score, 6)::DOUBLE AS score FROM fd")
def search_source_hits(spark, d):
    """The hits of every ask, by the first way that found some: field and value, exact text, terms."""
    return the_run(spark, d).found.select("ask", "way", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


CANDIDATES = f"""{MERGED}, {fuse('h1', 'f1')},
rt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens(normal('asked'))}) AS term FROM qs) GROUP BY ALL), rl AS (SELECT query_id, sum(qtf) AS q_len, count(*) AS nt FROM rt GROUP BY 1),
sd AS (SELECT query_id, document_id, list(chunk_index) AS around FROM f1 WHERE position <= 10 GROUP BY ALL),
xw AS (SELECT query_id, chunk_id, round(sum(least(qtf, tf)) / any_value(q_len) + 0.35 * count(*) / any_value(nt), 9) AS lex FROM sd JOIN pl USING (document_id) JOIN rt USING (query_id, term) JOIN rl USING (query_id) GROUP BY 1, 2),
xc AS (SELECT query_id, c.document_id, c.chunk_id, c.chunk_index, list_min(list_transform(around, lambda a: abs(a - c.chunk_index))) AS d, coalesce(lex, 0) AS lex FROM sd JOIN chunks c USING (document_id) LEFT JOIN xw USING (query_id, chunk_id) WHERE NOT list_contains(around, c.chunk_index)),
xs AS (SELECT *, lex + CASE WHEN d = 1 THEN 0.22 WHEN d = 2 THEN 0.12 WHEN d <= 4 THEN 0.05 ELSE 0 END AS score FROM xc WHERE lex > 0 OR d <= 2),
xd AS (SELECT * FROM xs QUALIFY row_number() OVER (PARTITION BY query_id, document_id {PLACES}) <= 5),
h2 AS (FROM h1 UNION ALL SELECT query_id, 'document_expansion', document_id, chunk_id, chunk_index, round(score, 9), row_number() OVER (PARTITION BY query_id {PLACES}) AS rank FROM xd QUALIFY rank <= 32), {fuse('h2', 'f2')},
e0 AS (SELECT query_id, sub_id, document_id, min(position) AS pos, arg_min(chunk_id, position) AS seed FROM f2 JOIN docs USING (document_id) JOIN sb USING (query_id) WHERE contains({compact('title')}, org) GROUP BY ALL),
es AS (SELECT *, count(*) OVER (PARTITION BY query_id, sub_id) AS n_found FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY pos) AS place FROM e0 QUALIFY place <= 3)),
ex0 AS (SELECT query_id, sub_id, document_id, chunk_id, chunk_index, 64 + least((length(hay) - instr(hay, nd) + 1 - length(nd)) / 40.0, 4.0) AS score FROM es JOIN (SELECT query_id, sub_id, {compact('wanted')} AS nd FROM sb) USING (query_id, sub_id) JOIN hy USING (document_id) WHERE length(nd) >= 10 AND contains(hay, nd)),
ex1 AS (SELECT * FROM ex0 QUALIFY row_number() OVER (PARTITION BY query_id, sub_id, document_id {PLACES}) <= 4), ex2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id {PLACES}) AS rank FROM ex1 QUALIFY rank <= 4),
sw AS (SELECT query_id, sub_id, term, count(*) OVER (PARTITION BY query_id, sub_id) AS n_terms FROM (SELECT query_id, sub_id, unnest(list_distinct({tokens('wanted')})) AS term FROM sb) WHERE NOT regexp_full_match(term, '[0-9]{{1,2}}|[一-鿿]')),
sp AS (SELECT query_id, sub_id, document_id, place - 1 AS p0, n_found, seed, chunk_id, chunk_index, term, tf, doc_len FROM es JOIN pl USING (document_id)),
spd AS (SELECT query_id, sub_id, term, count(*) AS df FROM sp GROUP BY ALL), spz AS (SELECT query_id, sub_id, count(*) AS n_chunks, avg(doc_len) AS avg_len FROM (SELECT DISTINCT query_id, sub_id, chunk_id, doc_len FROM sp) GROUP BY ALL),
sw0 AS (SELECT query_id, sub_id, document_id, chunk_id, chunk_index, round({BM} + 0.08 * (1 - any_value(p0) / any_value(n_found)), 9) AS score FROM sw JOIN sp USING (query_id, sub_id, term) JOIN spd USING (query_id, sub_id, term) JOIN spz USING (query_id, sub_id) WHERE chunk_id <> seed GROUP BY ALL),
sw1 AS (SELECT * FROM sw0 QUALIFY row_number() OVER (PARTITION BY query_id, sub_id, document_id {PLACES}) <= 4), sw2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id {PLACES}) AS rank FROM sw1 QUALIFY rank <= 4),
ea AS (SELECT query_id, sub_id AS sid, 0 AS sub_id, * EXCLUDE (query_id, sub_id) FROM ex2 UNION ALL SELECT query_id, sub_id, 1, * EXCLUDE (query_id, sub_id) FROM sw2), {merge('ea', 'em', 4, 'query_id, sid')}, eb AS (SELECT query_id, sid AS sub_id, chunk_id, document_id, chunk_index, score, rank FROM em), {merge('eb', 'ev', 32)},
h3 AS (FROM h2 UNION ALL SELECT query_id, 'subquery_document_evidence', document_id, chunk_id, chunk_index, score, rank FROM ev),
nh AS (SELECT * FROM h3 WHERE source IN ('indexed_sparse', 'subquery_document_evidence') QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, rank) = 1),
nt AS (SELECT h.*, sub_id, wanted, {cover_terms('wanted')} AS wt, {cover_terms("coalesce(document_title || ' ', '') || content[1:1800]")} AS ct FROM nh h JOIN chunks c USING (chunk_id) JOIN sb USING (query_id) WHERE shape IN ({CROSS}, {SAME}) AND contains({compact('document_title')}, org)),
ns AS (SELECT * FROM (SELECT *, round({share('wt', 'ct')} + least(score, 1) * 0.18, 9) AS cs FROM nt) WHERE cs > 0 QUALIFY row_number() OVER (PARTITION BY query_id, sub_id ORDER BY cs DESC, score DESC, chunk_index, chunk_id) <= 4),
nn AS (SELECT s.query_id, s.sub_id, s.document_id, c.chunk_id, c.chunk_index, 1.0 / (min(abs(c.chunk_index - s.chunk_index)) + 1) AS score FROM ns s JOIN chunks c ON c.document_id = s.document_id AND abs(c.chunk_index - s.chunk_index) <= 5 GROUP BY ALL HAVING min(abs(c.chunk_index - s.chunk_index)) > 0),
np AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY query_id, sub_id, document_id {PLACES}) <= 32), nq AS (SELECT * FROM np QUALIFY row_number() OVER (PARTITION BY query_id, sub_id {PLACES}) <= 32),
nf AS (SELECT n.*, {share(cover_terms('wanted'), cover_terms("coalesce(document_title || ' ', '') || content"))} AS ov, {compact('wanted')} <> '' AND contains({compact("coalesce(document_title || ' ', '') || content")}, {compact('wanted')}) AS exact FROM nq n JOIN sb USING (query_id, sub_id) JOIN chunks USING (chunk_id)),
nk AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id {PLACES}) AS rank FROM (SELECT query_id, sub_id, document_id, chunk_id, chunk_index, round(score + ov * 1.35 + CASE WHEN exact THEN 0.55 ELSE 0 END, 9) AS score FROM nf WHERE exact OR ov >= 0.45) QUALIFY rank <= 8), {merge('nk', 'nb', 16)},
h4 AS (FROM h3 UNION ALL SELECT query_id, 'subquery_neighbor_context', document_id, chunk_id, chunk_index, score, rank FROM nb), {fuse('h4', 'f4')}, cd AS (SELECT f4.*, content, document_title FROM f4 JOIN chunks USING (chunk_id) WHERE position <= 160)"""


@query(f", {CANDIDATES} SELECT query_id, chunk_id, position, array_to_string(sources, ' ') AS sources, round(fused, 6)::DOUBLE AS fused FROM cd")
def search_candidates(spark, d):
    """Every candidate of every question with the sources that found it: terms, exact text, pairs, expansion, evidence of sub-queries and its neighbours, fused."""
    return the_run(spark, d).candidates.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"), F.array_join("sources", " ").alias("sources"), F.round("fused", 6).alias("fused"))


# The final list: an ordered fold for diversity; then, one by one, chunks in the place of weaker ones of their document; then chunks for unanswered sub-queries at the end.
FINAL = rf"""{CANDIDATES},
fold AS (WITH RECURSIVE z(query_id, i, kept, capped, best, weak) AS (
  SELECT DISTINCT query_id, 0::BIGINT, []::STRUCT(r BIGINT, d BIGINT)[], []::BIGINT[], -1::DOUBLE, []::BIGINT[] FROM cd
  UNION ALL SELECT query_id, i + 1, CASE go WHEN 1 THEN list_append(kept, {{'r': position, 'd': document_id}}) ELSE kept END, CASE go WHEN 2 THEN list_append(capped, position) ELSE capped END, CASE go WHEN 2 THEN greatest(best, fused) ELSE best END, CASE go WHEN 3 THEN list_append(weak, position) ELSE weak END
  FROM (SELECT z.*, position, document_id, fused, CASE WHEN len(kept) >= 10 THEN 0 WHEN len(list_filter(kept, lambda x: x.d = document_id)) >= 5 THEN 2 WHEN fused <= 0.08 AND best >= 0.18 AND best >= fused + 0.2 THEN 3 ELSE 1 END AS go FROM z JOIN cd ON cd.query_id = z.query_id AND position = i + 1))
  SELECT query_id, (list_concat(list_concat(list_transform(kept, lambda x: x.r), capped), weak))[1:10] AS picked, i FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1),
back AS (SELECT *, CASE WHEN len(picked) = 10 THEN list_min(list_filter(range(1, least(10, i) + 1), lambda r: NOT list_contains(picked, r))) END AS lost FROM fold),
gone AS (SELECT *, CASE WHEN lost IS NOT NULL THEN coalesce(list_filter(picked, lambda r: r > lost)[-1], picked[1]) END AS gives FROM back),
ls AS (SELECT query_id, CASE WHEN lost IS NULL THEN picked ELSE list_sort(list_append(list_filter(picked, lambda r: r <> gives), lost)) END AS list FROM gone),
base AS (SELECT query_id, unnest(list) AS position, generate_subscripts(list, 1) AS final_rank FROM ls),
tx AS (SELECT cd.*, coalesce(document_title || ' ', '') || content[1:1800] AS txt FROM cd), tt AS (SELECT tx.*, {cover_terms('txt')} AS ct, {flat('txt')} AS fl, b.final_rank FROM tx LEFT JOIN base b USING (query_id, position)),
bq AS (SELECT query_id, {cover_terms('asked')} AS q FROM qs WHERE query_id % 4 = 2 OR regexp_matches(asked, '{coverage.LIST_HINTS}')),
w0 AS (SELECT tt.*, q, list_intersect(q, ct) AS hit, {share('q', 'ct')} AS mine FROM tt JOIN bq USING (query_id)),
w1 AS (SELECT query_id, document_id, list_distinct(flatten(list(ct))) AS has, max(mine) AS had FROM w0 WHERE final_rank IS NOT NULL GROUP BY ALL),
w2 AS (SELECT *, round(len(hit) / greatest(len(q), 1) * 0.45 + len(list_filter(hit, lambda x: NOT list_contains(has, x))) / greatest(len(q), 1) * 0.75 + greatest(mine - had, 0) * 1.25 + least(fused, 1) * 0.22 + 0.08, 9) AS score FROM w0 JOIN w1 USING (query_id, document_id)
  WHERE final_rank IS NULL AND fused >= 0.02 AND list_has_any(sources, ['document_expansion', 'document_sweep', 'document_neighbor_context', 'subquery_document_evidence', 'subquery_neighbor_context'])),
wide AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused DESC, position) AS slot FROM w2 QUALIFY slot <= 2),
m0 AS (SELECT tt.*, sub_id, wanted, shape, {flat('wanted')} AS hint, {cover_terms('wanted')} AS wt, list_filter(list_distinct(list_transform(regexp_extract_all(wanted, '[A-Za-z]*[0-9][A-Za-z0-9_.\-]*'), lambda x: {compact('x')})), lambda x: length(x) >= 2) AS must FROM tt JOIN sb USING (query_id) WHERE shape <> {TABLE} AND contains({compact('document_title')}, org)),
m1 AS (SELECT *, len(list_intersect(wt, ct)) AS n_both, {share('wt', 'ct')} AS ov, contains(fl, hint) AS exact, length(fl) - instr(fl, hint) + 1 - length(hint) AS after, len(list_filter(must, lambda m: NOT contains({compact('txt')}, m))) = 0 AS held,
  instr(txt, wanted) > 0 AND regexp_matches(substr(txt, instr(txt, wanted) + length(wanted), 80), '[。；;.!！？?》）)]') AS ended FROM m0),
m2 AS (SELECT *, length(hint) < 20 OR after >= least(48, greatest(24, length(hint) // 4)) OR ended AS enough, round(ov + CASE WHEN list_contains(sources, 'subquery_neighbor_context') THEN 0.28 WHEN list_contains(sources, 'subquery_document_evidence') THEN 0.18 ELSE 0 END + least(fused, 1) * 0.18, 9) AS cs,
  CASE WHEN list_contains(sources, 'subquery_neighbor_context') THEN 2 WHEN list_contains(sources, 'subquery_document_evidence') THEN 1 ELSE 0 END AS pri FROM m1 WHERE held AND len(wt) > 0),
m3 AS (SELECT *, CASE WHEN length(hint) >= 10 AND exact THEN enough ELSE n_both >= least(3, len(wt)) AND ov >= 0.45 END AS covers,
  CASE WHEN length(hint) >= 12 AND exact THEN enough WHEN length(hint) >= 20 THEN n_both >= least(6, len(wt)) AND ov >= 0.98 ELSE n_both >= least(4, len(wt)) AND ov >= 0.55 END AS answers FROM m2),
m4 AS (SELECT * FROM m3 WHERE final_rank IS NULL AND covers AND cs > 0 AND NOT EXISTS (SELECT 1 FROM m3 x WHERE x.query_id = m3.query_id AND x.sub_id = m3.sub_id AND x.final_rank IS NOT NULL AND x.answers) QUALIFY row_number() OVER (PARTITION BY query_id, sub_id ORDER BY cs DESC, pri DESC, fused DESC, lexical_raw DESC, position) = 1),
more AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, fused DESC, position) AS slot FROM (SELECT * FROM m4 QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub_id) = 1) QUALIFY slot <= 2),
guard AS (SELECT DISTINCT query_id, chunk_id FROM m3 WHERE final_rank IS NOT NULL AND answers),
lock AS (SELECT tt.query_id, position, document_id, fused, lexical_raw, tt.chunk_id, g.chunk_id IS NOT NULL OR list_has_any(sources, ['document_first_evidence', 'document_sweep', 'subquery_document_evidence', 'subquery_neighbor_context']) AS locked FROM tt LEFT JOIN guard g USING (query_id, chunk_id)),
slots AS (WITH RECURSIVE z(query_id, k, list) AS (SELECT query_id, 1::BIGINT, list FROM ls UNION ALL
  SELECT z.query_id, k + 1, CASE WHEN list_contains(list, w.position) OR spot IS NULL THEN list ELSE list_transform(list, lambda r, j: CASE WHEN j = spot THEN w.position ELSE r END) END FROM z JOIN wide w ON w.query_id = z.query_id AND w.slot = k
  LEFT JOIN LATERAL (SELECT arg_min(j, (fused, lexical_raw, j)) AS spot FROM (SELECT unnest(list) AS r, generate_subscripts(list, 1) AS j) JOIN lock ON lock.query_id = z.query_id AND lock.position = r
    WHERE lock.document_id = w.document_id AND NOT locked AND j > least(greatest(1, least(3, greatest(len(list) - 1, 0))), len(list))) ON true)
  SELECT query_id, list FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1),
now AS (SELECT query_id, unnest(list) AS position, generate_subscripts(list, 1) AS place FROM slots),
add AS (SELECT m.query_id, m.position, row_number() OVER (PARTITION BY m.query_id ORDER BY slot) AS s FROM more m LEFT JOIN now USING (query_id, position) WHERE now.place IS NULL),
fin AS (SELECT query_id, position, 0 AS part, place AS n FROM now LEFT JOIN (SELECT query_id, count(*) AS c FROM add GROUP BY 1) USING (query_id) WHERE place <= 10 - coalesce(c, 0) UNION ALL SELECT query_id, position, 1, s FROM add),
final AS (SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY part, n) AS final_rank FROM fin JOIN cd USING (query_id, position))"""


@query(f", {FINAL} SELECT query_id, chunk_id, final_rank FROM final")
def search_final(spark, d):
    """The whole search: the ten results of every benchmark item's question, within what its user may see."""
    return the_run(spark, d).final.select("query_id", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


KEYED = """translate(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'), '，。；：、,.!?！？;:()（）[]【】"'' ', '')"""
RUN = rf"""{FINAL},
tr AS (SELECT DISTINCT query_id AS case_id, document_id, title, m.document_id IS NOT NULL AS visible FROM (SELECT query_id, {compact('query_text')} AS nd FROM queries) JOIN hy ON length(nd) >= 10 AND contains(hay, nd) JOIN docs USING (document_id) JOIN (SELECT query_id, scope_id FROM t1) USING (query_id) LEFT JOIN mem m USING (scope_id, document_id)),
mk AS (SELECT query_id AS case_id, query_id || '-a' AS marker_id, {KEYED.format('trim(a)')} AS k FROM t1 UNION ALL SELECT query_id, query_id || '-b', {KEYED.format('trim(b)')} FROM t1),
sg AS (SELECT query_id AS case_id, CASE source WHEN 'document_expansion' THEN 'expansion' ELSE source END AS stage, rank, chunk_id FROM h4 UNION ALL SELECT query_id, unnest(['fused', 'pre_rerank']), position, chunk_id FROM f4 UNION ALL SELECT query_id, 'reranked', position, chunk_id FROM cd UNION ALL SELECT query_id, 'final', final_rank, chunk_id FROM final),
sx AS (SELECT sg.*, document_title, {KEYED.format('document_title')} AS fr, {KEYED.format('content')} AS bd FROM (FROM sg UNION ALL SELECT case_id, 'expected_document_chunks', row_number() OVER (PARTITION BY case_id ORDER BY document_id, chunk_index), chunk_id FROM tr JOIN chunks USING (document_id) WHERE visible) sg JOIN chunks USING (chunk_id)),
mh AS (SELECT case_id, marker_id, stage, min(rank) AS rank FROM mk JOIN sx USING (case_id) WHERE k <> '' AND (contains(fr, k) OR contains(bd, k)) GROUP BY ALL)"""


@query(f", {RUN} SELECT case_id, stage, rank, chunk_id FROM sg")
def evaluation_stages(spark, d):
    """What each stage of the search had for each case: one table, by stage."""
    return the_evaluation(spark, d).stages.where("stage <> 'expected_document_chunks'").select("case_id", "stage", "rank", "chunk_id")


@query(f", {RUN} SELECT case_id, marker_id, stage, rank FROM mh")
def evaluation_marker_hits(spark, d):
    """Where each stage of the search has each passage of a case."""
    return the_evaluation(spark, d).hits


@query(
    f""", {RUN}, evs AS (SELECT * FROM (SELECT query_id AS case_id FROM queries), (SELECT DISTINCT stage FROM sg)), sz AS (SELECT case_id, stage, count(*) AS candidate_count FROM sg GROUP BY ALL), wt AS (SELECT case_id, count(DISTINCT title) AS n_titles FROM tr WHERE visible GROUP BY 1),
    tl AS (SELECT case_id, stage, title, row_number() OVER (PARTITION BY case_id, stage ORDER BY r, title) AS place FROM (SELECT case_id, stage, document_title AS title, min(rank) AS r FROM sx WHERE stage <> 'expected_document_chunks' GROUP BY ALL)),
    th AS (SELECT case_id, stage, count(*) AS n_hit, min(place) AS first FROM tl JOIN (SELECT DISTINCT case_id, title FROM tr WHERE visible) USING (case_id, title) GROUP BY ALL), ms AS (SELECT case_id, stage, count(*) AS n_found, min(rank) AS best FROM mh GROUP BY ALL)
    SELECT case_id, stage, coalesce(candidate_count, 0) AS candidate_count, CASE WHEN n_titles IS NULL THEN 1 ELSE round(coalesce(n_hit, 0) / n_titles, 4) END::DOUBLE AS title_recall, CASE WHEN n_titles IS NULL THEN 1 ELSE round(coalesce(1 / first, 0), 4) END::DOUBLE AS title_mrr,
      round(coalesce(n_found, 0) / 2, 4)::DOUBLE AS evidence_recall, round(coalesce(1 / best, 0), 4)::DOUBLE AS evidence_mrr FROM evs LEFT JOIN sz USING (case_id, stage) LEFT JOIN wt USING (case_id) LEFT JOIN th USING (case_id, stage) LEFT JOIN ms USING (case_id, stage)"""
)
def evaluation_stage_scores(spark, d):
    """Recall of titles and passages after each stage of the search."""
    return the_evaluation(spark, d).scores.drop("matched")


CAUSE = f"""{RUN}, hs2 AS (SELECT case_id, marker_id, list(stage) AS s FROM mh GROUP BY ALL),
ca AS (SELECT case_id, marker_id, CASE WHEN NOT coalesce(list_contains(s, 'expected_document_chunks'), false) THEN 'marker_not_found_in_expected_document_chunks' WHEN NOT list_has_any(s, ['lexical', 'indexed_sparse', 'structural', 'vector']) THEN CASE WHEN list_contains(s, 'expansion') THEN 'only_recovered_by_in_document_expansion' ELSE 'source_candidate_generation_missed' END
  WHEN NOT list_contains(s, 'fused') THEN 'fusion_dropped_source_hit' WHEN NOT list_contains(s, 'pre_rerank') THEN 'pre_rerank_missing_after_fusion' WHEN NOT list_contains(s, 'reranked') THEN 'rerank_truncated_evidence' WHEN NOT list_contains(s, 'final') THEN 'final_top_k_truncated_evidence' ELSE 'final_hit' END AS root_cause FROM mk LEFT JOIN hs2 USING (case_id, marker_id))"""


@query(f", {CAUSE} SELECT case_id, marker_id, root_cause FROM ca")
def evaluation_root_causes(spark, d):
    """The stage of the search that lost each passage."""
    return the_evaluation(spark, d).causes.select("case_id", "marker_id", "root_cause")


@query(
    f""", {CAUSE}, o AS (SELECT unnest({list(audits.LOSS_ORDER)}) AS root_cause, unnest(range(8)) AS g), w AS (SELECT case_id, min(g) AS g, count(*) FILTER (ca.root_cause <> 'final_hit') AS lost FROM ca LEFT JOIN o USING (root_cause) GROUP BY 1),
    rt2 AS (SELECT case_id, title, row_number() OVER (PARTITION BY case_id ORDER BY r) AS rank FROM (SELECT case_id, document_title AS title, min(rank) AS r FROM sx WHERE stage = 'final' GROUP BY ALL)), rel AS (SELECT DISTINCT case_id, title FROM tr WHERE visible), bad AS (SELECT DISTINCT case_id, title FROM tr WHERE NOT visible),
    m AS (SELECT r.case_id, r.rank, l.title IS NOT NULL AS hit, sum((l.title IS NOT NULL)::INT) OVER (PARTITION BY r.case_id ORDER BY r.rank) AS so_far FROM rt2 r LEFT JOIN rel l USING (case_id, title)),
    a AS (SELECT case_id, count(*) AS n_ranked, count(*) FILTER (hit) AS hits, coalesce(sum(so_far / rank) FILTER (hit), 0) AS gain, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg, min(rank) FILTER (hit) AS first FROM m GROUP BY 1),
    x AS (SELECT query_id AS case_id, coalesce(n_found, 0) / 2 AS evidence_recall, coalesce(n_ranked, 0) AS n_ranked, coalesce(hits, 0) AS hits, coalesce(gain, 0) AS gain, coalesce(dcg, 0) AS dcg, first, coalesce(nr, 0) AS n_relevant, coalesce(leaks, 0) = 0 AS clean FROM queries q LEFT JOIN a ON a.case_id = query_id LEFT JOIN (SELECT case_id, count(*) AS nr FROM rel GROUP BY 1) r ON r.case_id = query_id
      LEFT JOIN (SELECT case_id, count(*) AS leaks FROM rt2 JOIN bad USING (case_id, title) GROUP BY 1) b ON b.case_id = query_id LEFT JOIN (SELECT case_id, count(*) AS n_found FROM mh WHERE stage = 'final' GROUP BY 1) e ON e.case_id = query_id),
    sc AS (SELECT case_id, n_relevant, CASE WHEN n_relevant = 0 THEN clean::INT ELSE round(hits / n_relevant, 4) END::DOUBLE AS recall, CASE WHEN n_relevant = 0 THEN clean::INT WHEN n_ranked = 0 THEN 0 ELSE round(hits / n_ranked, 4) END::DOUBLE AS precision, CASE WHEN n_relevant = 0 THEN clean::INT ELSE round(gain / n_relevant, 4) END::DOUBLE AS average_precision, CASE WHEN n_relevant = 0 THEN clean::INT ELSE round(coalesce(1 / first, 0), 4) END::DOUBLE AS mrr,
      CASE WHEN n_relevant = 0 THEN clean::INT WHEN least(n_ranked, n_relevant) = 0 THEN 0 ELSE round(dcg / list_sum(list_transform(range(1, least(n_ranked, n_relevant) + 1), lambda i: 1 / log2(i + 1))), 4) END::DOUBLE AS ndcg, round(evidence_recall, 4)::DOUBLE AS evidence_recall, clean AS permission_isolation_correct,
      CASE WHEN n_relevant = 0 THEN CASE WHEN clean THEN 'passed' ELSE 'forbidden_title_retrieved' END WHEN hits < n_relevant THEN 'expected_title_missing' WHEN evidence_recall < 1 THEN 'expected_evidence_missing' WHEN NOT clean THEN 'forbidden_title_retrieved' ELSE 'passed' END AS failure_mode FROM x)
    SELECT sc.*, failure_mode = 'passed' AS passed, CASE WHEN lost IS NULL THEN 'no_evidence_markers' WHEN lost = 0 THEN 'passed' ELSE o.root_cause END AS case_root_cause FROM sc LEFT JOIN w USING (case_id) LEFT JOIN o USING (g)"""
)
def evaluation_case_scores(spark, d):
    """The result of every case of the evaluation run: metrics of the final list against the documents that hold the passage and may be seen, leaks, and what lost the evidence."""
    return the_evaluation(spark, d).cases
