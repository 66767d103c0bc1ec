"""Registered queries of the control plane: access, departments, versions, citations, memory and jobs, on tables made by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, evidence, retrieval, sets, workflow
from ..streaming import traces as stream
from . import tables as D
from .registry import query


@query("SELECT acl_id, document_id, can_view, can_manage FROM acl WHERE can_view OR can_manage")
def effective_acl(spark, d):
    return workflow.prune_acl(D.acl(spark, d)).select("acl_id", "document_id", "can_view", "can_manage")


CHANGES = """ch AS (SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'public' ELSE 'user' END AS principal_type, CASE WHEN document_id % 2 = 1 THEN document_id % 150 END AS user_id, NULL::VARCHAR AS role, NULL::VARCHAR AS team_name, NULL::VARCHAR AS department_id, document_id % 3 > 0 AS can_view, document_id % 7 = 0 AS can_manage, document_id * 10 + 8 AS acl_id FROM docs WHERE document_id % 5 < 2)"""


def _changes(spark, d):
    i, none = F.col("document_id"), F.lit(None).cast("string")
    rows = D.documents(spark, d).where("document_id % 5 < 2")
    return rows.select("document_id", F.when(i % 2 == 0, "public").otherwise("user").alias("principal_type"), F.when(i % 2 == 1, i % 150).alias("user_id"), none.alias("role"), none.alias("team_name"), none.alias("department_id"), (i % 3 > 0).alias("can_view"), (i % 7 == 0).alias("can_manage"), (i * 10 + 8).alias("acl_id"))


_SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM c.{k}" for k in workflow.ACL_KEY)


@query(f", {CHANGES} SELECT c.document_id, c.principal_type, c.user_id, a.acl_id FROM ch c LEFT JOIN acl a ON {_SAME}")
def acl_lookup(spark, d):
    found = workflow.find_acl(D.acl(spark, d), _changes(spark, d).drop("acl_id", "can_view", "can_manage"))
    return found.select("document_id", "principal_type", "user_id", "acl_id")


@query(
    f""", {CHANGES}, k AS (SELECT a.acl_id, a.document_id, coalesce(c.can_view, a.can_view) AS can_view, coalesce(c.can_manage, a.can_manage) AS can_manage FROM acl a LEFT JOIN ch c ON {_SAME} UNION ALL SELECT c.acl_id, c.document_id, c.can_view, c.can_manage FROM ch c WHERE NOT EXISTS (SELECT 1 FROM acl a WHERE {_SAME}))
    SELECT * FROM k WHERE can_view OR can_manage"""
)
def acl_after_changes(spark, d):
    return workflow.apply_acl(D.acl(spark, d), _changes(spark, d)).select("acl_id", "document_id", "can_view", "can_manage")


@query(f", {CHANGES} SELECT acl_id, document_id FROM acl a WHERE document_id IN (SELECT document_id FROM ch) AND NOT EXISTS (SELECT 1 FROM ch c WHERE {_SAME})")
def acl_to_remove(spark, d):
    return workflow.reconcile_acl(D.acl(spark, d), _changes(spark, d)).select("acl_id", "document_id")


@query(
    """, u AS (SELECT * FROM users WHERE user_id <= 60), k AS (SELECT u.user_id, 'public' AS key, 'public' AS mt FROM u UNION ALL SELECT user_id, 'user:' || user_id, 'user' FROM u UNION ALL SELECT user_id, 'role:' || role, 'role' FROM u UNION ALL SELECT user_id, 'team:' || team_name, 'legacy' FROM u
      UNION ALL SELECT u.user_id, 'dept:' || ancestor_id, CASE WHEN ancestor_id = u.department_id THEN 'direct' ELSE 'ancestor' END FROM u JOIN closure USING (department_id)),
    ak AS (SELECT acl_id, document_id, can_view, can_manage, unnest([CASE principal_type WHEN 'public' THEN 'public' WHEN 'user' THEN 'user:' || user_id WHEN 'role' THEN 'role:' || role ELSE 'dept:' || department_id END, CASE WHEN principal_type = 'team' THEN 'team:' || team_name END]) AS key FROM acl WHERE document_id < 40),
    h AS (SELECT user_id, document_id, acl_id, can_view OR can_manage AS eff, mt FROM k JOIN ak USING (key)), ud AS (SELECT user_id, role, document_id, owner_user_id FROM u, docs WHERE document_id < 40),
    f AS (SELECT user_id, document_id, min(acl_id) FILTER (eff) AS acl_id, min_by(mt, acl_id) FILTER (eff) AS mt, bool_or(NOT eff) AS idle FROM h GROUP BY ALL)
    SELECT user_id, document_id, role = 'admin' OR owner_user_id = user_id OR acl_id IS NOT NULL AS visible, CASE WHEN role = 'admin' THEN 'admin' WHEN owner_user_id = user_id THEN 'owner' WHEN acl_id IS NOT NULL THEN 'acl' END AS rule, CASE WHEN role <> 'admin' AND owner_user_id <> user_id THEN acl_id END AS acl_id,
      CASE WHEN role = 'admin' THEN 'admin' WHEN owner_user_id = user_id THEN 'owner' WHEN mt IS NOT NULL THEN mt WHEN idle THEN 'matched_without_permission' ELSE 'no_matching_rule' END AS reason FROM ud LEFT JOIN f USING (user_id, document_id)"""
)
def access_explained(spark, d):
    """Why each of sixty users sees or does not see each of forty documents: a debug view of a stated table of users and documents."""
    docs = D.documents(spark, d).drop("content").where("document_id < 40")
    trace = access.decision_trace(docs, D.acl(spark, d).where("document_id < 40"), D.users(spark, d).where("user_id <= 60"), D.departments(spark, d))
    return access.access_reasons(trace)


@query("SELECT user_id, document_id, place FROM (SELECT user_id, document_id, row_number() OVER (PARTITION BY user_id ORDER BY document_id * 7919 % 1000 DESC, document_id) AS place FROM decisions) WHERE place <= 5")
def newest_visible_documents(spark, d):
    docs = D.documents(spark, d).drop("content").withColumn("created_at", F.col("document_id") * 7919 % 1000)
    best = access.newest_visible(docs, D.acl(spark, d), D.users(spark, d), D.departments(spark, d), 5)
    return best.select("user_id", "document_id", F.col("place").cast("long").alias("place"))


@query(
    """, sets AS (SELECT user_id, string_agg(document_id, ',' ORDER BY document_id) AS docs FROM decisions GROUP BY 1) SELECT min(user_id) AS scope_id, count(*) AS n_users FROM sets GROUP BY docs"""
)
def visible_scopes(spark, d):
    return access.user_scopes(D.documents(spark, d).drop("content"), D.acl(spark, d), D.users(spark, d), D.departments(spark, d))[0]


@query("SELECT user_id FROM users WHERE role = 'admin' AND user_id BETWEEN 60 AND 140 AND (SELECT count(*) FROM users WHERE role = 'admin' AND user_id BETWEEN 60 AND 140) = 1")
def last_admins(spark, d):
    """Of all admins only those with ids from 60 to 140 are active here, which is one."""
    return workflow.last_admins(D.users(spark, d).withColumn("is_active", F.col("user_id").between(60, 140)))


DEPTS = """dp AS (SELECT department_id, parent_id, id_path, name, CASE WHEN parent_id IS NULL THEN 'A' || department_id[2:] ELSE 'A' || parent_id[2:] || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (department_id[2:])::INT % 36 + 1, 1) END AS org_code FROM departments)"""


def _departments(spark, d):
    rows = D.departments(spark, d)
    own = F.expr("substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', int(substring(department_id, 2)) % 36 + 1, 1)")
    code = F.when(F.col("parent_id").isNull(), F.concat(F.lit("A"), F.expr("substring(department_id, 2)"))).otherwise(F.concat(F.lit("A"), F.expr("substring(parent_id, 2)"), own))
    return rows.withColumn("org_code", code)


@query(f", {DEPTS}, w AS (SELECT department_id AS parent_id, org_code || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', i::INT, 1) AS org_code FROM dp, range(1, 37) r(i)) SELECT parent_id, min(org_code) AS org_code FROM w WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.parent_id = w.parent_id AND dp.org_code = w.org_code) GROUP BY 1")
def next_org_codes(spark, d):
    return workflow.next_org_codes(_departments(spark, d))


@query(
    """, m AS (SELECT department_id, CASE WHEN department_id = 'n3' THEN '' WHEN department_id = 'n4' THEN 'a/b' WHEN department_id = 'n5' THEN (SELECT name FROM departments WHERE department_id = 'r1') ELSE name || ' x' END AS new_name, CASE WHEN department_id IN ('n5') THEN NULL WHEN department_id = 'n6' THEN 'n6' WHEN department_id = 'n7' THEN 'zz' WHEN parent_id IS NULL THEN 'n' || (department_id[2:])::INT * 1 ELSE 'r0' END AS new_parent_id FROM departments)
    SELECT m.department_id, new_name, new_parent_id, CASE WHEN trim(new_name) = '' THEN 'empty_name' WHEN contains(new_name, '/') THEN 'slash_in_name' WHEN new_parent_id = m.department_id THEN 'own_parent' WHEN new_parent_id IS NOT NULL AND p.department_id IS NULL THEN 'unknown_parent' WHEN starts_with(p.id_path || '/', o.id_path || '/') THEN 'below_itself'
      WHEN EXISTS (SELECT 1 FROM departments t WHERE t.parent_id IS NOT DISTINCT FROM new_parent_id AND t.name = new_name AND t.department_id <> m.department_id) THEN 'name_taken' END AS error FROM m JOIN departments o USING (department_id) LEFT JOIN departments p ON p.department_id = new_parent_id"""
)
def department_moves(spark, d):
    rows = D.departments(spark, d)
    i = F.col("department_id")
    taken = rows.where("department_id = 'r1'").select(F.col("name").alias("taken"))
    name = F.when(i == "n3", "").when(i == "n4", "a/b").when(i == "n5", F.col("taken")).otherwise(F.concat("name", F.lit(" x")))
    parent = F.when(i == "n5", None).when(i == "n6", "n6").when(i == "n7", "zz").when(F.col("parent_id").isNull(), F.concat(F.lit("n"), F.expr("substring(department_id, 2)"))).otherwise("r0")
    moves = rows.join(F.broadcast(taken)).select("department_id", name.alias("new_name"), parent.alias("new_parent_id"))  # one name
    return workflow.move_errors(moves, rows)


@query("SELECT d.department_id, CASE WHEN EXISTS (SELECT 1 FROM departments c WHERE c.parent_id = d.department_id) THEN 'children' WHEN EXISTS (SELECT 1 FROM users u WHERE u.department_id = d.department_id AND user_id % 9 = 0) THEN 'users' WHEN EXISTS (SELECT 1 FROM acl a WHERE a.department_id = d.department_id AND document_id % 2 = 0) THEN 'access' END AS blocked_by FROM departments d")
def removable_departments(spark, d):
    return workflow.removable_departments(D.departments(spark, d), D.users(spark, d).where("user_id % 9 = 0"), D.acl(spark, d).where("document_id % 2 = 0"))


VERSIONS = """vs AS (SELECT doc_id AS version_id, doc_id % 300 AS document_id, doc_id // 300 + 1 AS version_number, sha256(coalesce(text, '')) AS checksum FROM documents), dd AS (SELECT document_id, 'Title ' || document_id % 40 AS title, max(version_id) AS current_version_id FROM vs GROUP BY 1, 2),
up AS (SELECT doc_id AS upload_id, 'TITLE ' || doc_id % 41 AS title, sha256(coalesce(text, '')) AS checksum, CASE WHEN doc_id % 2 = 0 THEN doc_id % 301 END AS document_id FROM documents)"""


def _versions(spark, d):
    i = F.col("doc_id")
    t = D.table(spark, d, "documents")
    checksum = F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum")
    v = t.select(i.alias("version_id"), (i % 300).alias("document_id"), (F.floor(i / 300) + 1).alias("version_number"), checksum)
    docs = v.groupBy("document_id").agg(F.max("version_id").alias("current_version_id")).withColumn("title", F.concat(F.lit("Title "), (F.col("document_id") % 40).cast("string")))
    up = t.select(i.alias("upload_id"), F.concat(F.lit("TITLE "), (i % 41).cast("string")).alias("title"), checksum, F.when(i % 2 == 0, i % 301).alias("document_id"))
    return v, docs, up


@query(
    f""", {VERSIONS}, h AS (SELECT u.upload_id, max_by(v.version_id, v.version_number * 1000000000 + v.version_id) AS repeats FROM up u JOIN vs v USING (checksum) JOIN dd ON dd.document_id = v.document_id WHERE CASE WHEN u.document_id IS NOT NULL THEN u.document_id = v.document_id ELSE lower(u.title) = lower(dd.title) END GROUP BY 1),
    l AS (SELECT document_id, max(version_number) AS last FROM vs GROUP BY 1)
    SELECT upload_id, CASE WHEN repeats IS NOT NULL THEN 'conflict' WHEN u.document_id IS NULL THEN 'new_document' ELSE 'new_version' END AS action, CASE WHEN repeats IS NULL THEN coalesce(last, 0) + 1 END::BIGINT AS version_number, repeats FROM up u LEFT JOIN h USING (upload_id) LEFT JOIN l ON l.document_id = u.document_id"""
)
def upload_decisions(spark, d):
    v, docs, up = _versions(spark, d)
    return workflow.upload_decisions(up, docs, v).withColumn("version_number", F.col("version_number").cast("long"))


@query(f", {VERSIONS} SELECT dd.document_id, dd.title AS document_title, version_id, version_number, chunk_id FROM dd JOIN vs ON version_id = current_version_id JOIN chunks c ON c.document_id = version_id WHERE dd.document_id % 2 = 0")
def current_chunks(spark, d):
    v, docs, _ = _versions(spark, d)
    chunks = D.chunks(spark, d).select(F.col("document_id").alias("version_id"), "chunk_id")
    made = workflow.current_chunks(chunks, v, docs, docs.where("document_id % 2 = 0"))
    return made.select("document_id", "document_title", "version_id", "version_number", "chunk_id")


@query("SELECT session_id, turn, content FROM messages WHERE session_id % 9 = 4")
def messages_of_user(spark, d):
    m = D.messages(spark, d)
    sessions = m.select("session_id").distinct().withColumn("user_id", F.col("session_id") % 9)
    return workflow.messages_of_user(m, sessions, F.lit(4)).select("session_id", "turn", "content")


@query(
    """, c AS (SELECT document_id AS message_id, chunk_index AS pos, CASE WHEN chunk_index % 3 > 0 THEN (chunk_index % 4)::VARCHAR END AS chunk_id, chunk_index % 2 AS page FROM chunks),
    k AS (SELECT *, coalesce('chunk:' || chunk_id, '|||' || page || '||') AS key FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY message_id, key ORDER BY pos) AS n FROM k) SELECT message_id, pos, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS rank FROM f WHERE n = 1"""
)
def unique_citations(spark, d):
    n = F.col("chunk_index")
    rows = D.chunks(spark, d).select(F.col("document_id").alias("message_id"), n.alias("pos"), F.when(n % 3 > 0, (n % 4).cast("string")).alias("chunk_id"), (n % 2).alias("page_number_start"))
    return workflow.unique_citations(rows).select("message_id", "pos", F.col("rank").cast("long").alias("rank"))


@query(
    """, a AS (SELECT *, coalesce(sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM messages),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n, role || ': ' || trim(regexp_replace(content, '\\s+', ' ', 'g'))[1:400] AS line FROM a WHERE later >= 1)
    SELECT session_id, count(*) AS older_count, CASE WHEN count(*) > 2 THEN '... ' || (count(*) - 2) || ' earlier message(s) omitted ...' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY turn) FILTER (n <= 2) AS older_summary FROM o GROUP BY 1"""
)
def conversation_summaries(spark, d):
    return workflow.older_summary(D.messages(spark, d), 1, 2)


@query("SELECT session_id, bool_or(trim(content) <> '' AND turn % 4 <> 1) AS usable FROM messages WHERE role = 'assistant' GROUP BY 1")
def usable_sessions(spark, d):
    return workflow.usable_sessions(D.messages(spark, d).withColumn("insufficient", F.col("turn") % 4 == 1))


@query("SELECT session_id, json_extract_string(max_by(m, turn), '$.target') AS target FROM (SELECT session_id, turn, '{\"target\": \"d' || turn || '\"}' AS m FROM messages WHERE role = 'assistant') GROUP BY 1")
def last_answer_targets(spark, d):
    rows = D.messages(spark, d).withColumn("metadata", F.concat(F.lit('{"target": "d'), F.col("turn").cast("string"), F.lit('"}')))
    return workflow.last_answer_state(rows, ("target",))


REQUESTS = """rq AS (SELECT event_id AS request_id, event_type AS job_type, user_id, CASE WHEN event_id % 5 > 0 THEN (event_id % 3)::VARCHAR END AS client_request_id, event_id % 2 AS resource_id, event_id % 4 AS payload, ts FROM events)"""


@query(
    f"""WITH {REQUESTS}, w AS (SELECT *, row_number() OVER k AS n, first(request_id) OVER k AS r, first(resource_id) OVER k AS fr, first(payload) OVER k AS fp FROM rq WINDOW k AS (PARTITION BY job_type, user_id, client_request_id ORDER BY ts, request_id))
    SELECT request_id, CASE WHEN client_request_id IS NULL OR n = 1 THEN 'created' WHEN fr = resource_id AND fp = payload THEN 'existing' ELSE 'conflict' END AS outcome, CASE WHEN client_request_id IS NULL THEN request_id ELSE r END AS job_id FROM w""",
    views=False,
)
def accepted_jobs(spark, d):
    i = F.col("event_id")
    rows = D.table(spark, d, "events").select(i.alias("request_id"), F.col("event_type").alias("job_type"), "user_id", F.when(i % 5 > 0, (i % 3).cast("string")).alias("client_request_id"), (i % 2).alias("resource_id"), (i % 4).alias("payload"), "ts")
    return workflow.accepted_jobs(rows).select("request_id", "outcome", "job_id")


@query(
    """WITH j AS (SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'eval_run' ELSE 'document_ingest' END AS job_type, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, event_id % 500 AS resource_id FROM events),
    r AS (SELECT event_id AS resource_id, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS s FROM events WHERE event_id < 400)
    SELECT job_id, CASE WHEN job_type = 'eval_run' AND status IN ('queued', 'running') AND s IN ('completed', 'failed') THEN s ELSE status END AS status, CASE job_type WHEN 'eval_run' THEN 'arq:queue:eval' ELSE 'arq:queue:ingest' END AS queue FROM j LEFT JOIN r USING (resource_id)""",
    views=False,
)
def reconciled_jobs(spark, d):
    i = F.col("event_id")
    e = D.table(spark, d, "events")
    jobs = e.select(i.alias("job_id"), F.when(i % 3 == 0, "eval_run").otherwise("document_ingest").alias("job_type"), F.when(i % 4 == 0, "queued").when(i % 4 == 1, "running").when(i % 4 == 2, "failed").otherwise("completed").alias("status"), (i % 500).alias("resource_id"), F.lit(None).cast("timestamp").alias("finished_at"))
    runs = e.where("event_id < 400").select(i.alias("run_id"), F.when(i % 3 == 0, "completed").when(i % 3 == 1, "failed").otherwise("running").alias("status"), F.col("ts").alias("finished_at"))
    return workflow.reconcile_jobs(jobs, runs).select("job_id", "status", workflow.queue_name(F.col("job_type")).alias("queue"))


@query("WITH c AS (SELECT user_id AS job_id, event_id % 3 > 0 AS done FROM events) SELECT job_id, count(*) FILTER (done)::VARCHAR AS completed_cases, count(*)::VARCHAR AS total_cases, 'web' AS client FROM c GROUP BY 1", views=False)
def job_progress(spark, d):
    e = D.table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3 > 0).alias("done"))
    jobs = e.select("job_id").distinct().select("job_id", F.lit("running").alias("status"), F.create_map(F.lit("client"), F.lit("web"), F.lit("status"), F.lit("old")).alias("metadata"))
    made = workflow.progress(jobs, e)
    return made.select("job_id", *[F.element_at("summary", k).alias(k) for k in ("completed_cases", "total_cases", "client")])


@query("SELECT event_id AS trace_id, event_type AS trace_type, greatest(floor(value * 10)::BIGINT - 5, 0) AS latency_ms, '{\"k\":' || event_id % 7 || ',\"stage\":\"' || event_type || '\"}' AS trace_metadata FROM events", views=False)
def trace_rows(spark, d):
    e = D.table(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("trace_id"), F.col("event_type").alias("trace_type"), "user_id", F.col("ts").alias("created_at"), (F.floor(F.col("value") * 10) - 5).alias("latency_ms"), F.array("event_id").alias("chunks"), F.array("event_id").alias("citations"),
        F.struct((F.col("event_id") % 7).alias("k"), F.col("event_type").alias("stage")).alias("debug"),
    )
    return workflow.trace_rows(rows).select("trace_id", "trace_type", "latency_ms", "trace_metadata")


STALE = """WITH s AS (SELECT event_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'completed' END AS status, ts FROM events), n AS (SELECT max(ts) AS now FROM events)"""


@query(f"{STALE} SELECT job_id, CASE WHEN (status = 'queued' AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) >= 300) OR (status = 'running' AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) >= 900) THEN 'failed' ELSE status END AS status FROM s, n", views=False)
def stale_jobs(spark, d):
    e = D.table(spark, d, "events")
    i = F.col("event_id")
    rows = e.select(i.alias("job_id"), F.when(i % 3 == 0, "queued").when(i % 3 == 1, "running").otherwise("completed").alias("status"), "ts").join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return stream.stale_jobs(rows, F.col("now")).select("job_id", "status")


@query(
    """, v AS (SELECT document_id AS pair_id, lower(coalesce(content, '')) AS t, document_id % 4 AS n_modified, document_id % 5 AS n_added, document_id % 6 AS n_deleted FROM docs)
    SELECT pair_id, array_to_string(list_filter([CASE WHEN contains(t, 'sla') THEN 'h_sla' END, CASE WHEN contains(t, 'owner') THEN 'h_owner' END, CASE WHEN n_modified > 0 THEN 'modified' END, CASE WHEN n_added >= 3 THEN 'many_additions' END, CASE WHEN n_deleted >= 3 THEN 'many_deletions' END,
      CASE WHEN NOT contains(t, 'sla') AND NOT contains(t, 'owner') AND n_modified = 0 AND n_added < 3 AND n_deleted < 3 THEN 'review' END], lambda x: x IS NOT NULL), ',') AS hints FROM v"""
)
def change_hints(spark, d):
    i = F.col("document_id")
    hints = workflow.impact_hints(evidence.impact_words("content"), i % 4, i % 5, i % 6, {"sla": "h_sla", "owner": "h_owner"})
    return D.documents(spark, d).select(i.alias("pair_id"), F.array_join(hints, ",").alias("hints"))


CHANGE = """ch AS (SELECT document_id AS pair_id, chunk_index AS block, CASE chunk_index % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'replace' END AS kind, trim(regexp_replace(content[1:90], '\\s+', ' ', 'g')) AS new_text, trim(regexp_replace(content[5:50], '\\s+', ' ', 'g')) AS old_text FROM chunks),
tx AS (SELECT pair_id, block, kind, CASE kind WHEN 'insert' THEN new_text WHEN 'delete' THEN old_text ELSE old_text || ' -> ' || CASE WHEN length(new_text) <= 60 THEN new_text ELSE rtrim(new_text[1:57]) || '...' END END AS t FROM ch), nn AS (SELECT *, row_number() OVER (PARTITION BY pair_id, kind ORDER BY block) AS n FROM tx WHERE t <> '')"""


@query(f", {CHANGE} SELECT pair_id, " + ", ".join(f"coalesce(string_agg(t, '|' ORDER BY n) FILTER (kind = '{k}' AND n <= 3), '') AS {name}" for k, name in (("insert", "additions"), ("delete", "deletions"), ("replace", "modifications"))) + " FROM nn WHERE n <= 3 GROUP BY 1")
def diff_summaries(spark, d):
    n = F.col("chunk_index")
    rows = D.chunks(spark, d).select(F.col("document_id").alias("pair_id"), n.alias("block"), F.when(n % 3 == 0, "insert").when(n % 3 == 1, "delete").otherwise("replace").alias("change_type"), F.substring("content", 5, 46).alias("old_text"), F.substring("content", 1, 90).alias("new_text"))
    made = workflow.diff_summaries(rows)
    return made.select("pair_id", *[F.array_join(c, "|").alias(c) for c in ("additions", "deletions", "modifications")])


@query(
    """, q AS (SELECT query_id AS question_id, CASE query_id % 6 WHEN 0 THEN '??' WHEN 1 THEN 'compare v1 and v2 of ' || query_id WHEN 2 THEN 'write a weekly report' WHEN 3 THEN 'what does src' || (query_id % 20) || '-' || query_id || ' say' WHEN 4 THEN 'what does Blue Moon guide say' ELSE 'tell me about ' || query_text[1:30] END AS question, query_id % 4 > 0 AS ctx FROM queries),
    m AS (SELECT question_id, min(document_id) AS document_id FROM q JOIN docs ON contains(lower(question), lower(title)) OR contains(regexp_replace(lower(question), '[\\p{P}\\p{S}\\s]+', '', 'g'), regexp_replace(lower(title), '[\\p{P}\\p{S}\\s]+', '', 'g')) GROUP BY 1)
    SELECT question_id, CASE WHEN question_id % 6 = 0 THEN 'unsupported_or_unclear' WHEN question_id % 6 = 1 THEN 'version_compare' WHEN question_id % 6 = 2 AND ctx THEN 'workflow_generation' WHEN document_id IS NOT NULL OR question_id % 6 IN (3, 4) THEN 'document_qa' ELSE 'topic_qa' END AS intent,
      CASE question_id % 6 WHEN 4 THEN 'Blue Moon' WHEN 3 THEN 'src' || (question_id % 20) || '-' || question_id END AS requested_name, CASE WHEN question_id % 6 = 2 THEN 'weekly_report' END AS artifact_type, CASE WHEN question_id % 6 = 1 THEN 'v1' END AS from_ref, CASE WHEN question_id % 6 = 1 THEN 'v2' END AS to_ref, question_id % 6 IN (3, 4) AND document_id IS NULL AS refuse FROM q LEFT JOIN m USING (question_id)"""
)
def question_routes(spark, d):
    i = F.col("query_id")
    number = i.cast("string")
    text = (
        F.when(i % 6 == 0, "??").when(i % 6 == 1, F.concat(F.lit("compare v1 and v2 of "), number)).when(i % 6 == 2, "write a weekly report").when(i % 6 == 3, F.concat(F.lit("what does src"), (i % 20).cast("string"), F.lit("-"), number, F.lit(" say")))
        .when(i % 6 == 4, "what does Blue Moon guide say").otherwise(F.concat(F.lit("tell me about "), F.substring("query_text", 1, 30)))
    )
    q = D.queries(spark, d).select(i.alias("question_id"), text.alias("question"), (i % 4 > 0).alias("has_context"))
    return workflow.routes(q, D.documents(spark, d)).drop("document_id")


@query(
    """, w AS (SELECT document_id, title, row_number() OVER (ORDER BY document_id) AS n FROM docs WHERE document_id % 3 = 0), o AS (SELECT document_id, title FROM docs WHERE document_id % 2 = 0)
    SELECT document_id, title FROM w UNION ALL SELECT document_id, title FROM o WHERE document_id NOT IN (SELECT document_id FROM w)"""
)
def upserted_cases(spark, d):
    from ..sources.files import upsert

    docs = D.documents(spark, d).select("document_id", "title")
    return upsert(docs.where("document_id % 2 = 0"), docs.where("document_id % 3 = 0"), ["document_id"])


@query("SELECT query_id, chunk_id, max(score) AS score FROM (SELECT document_id % 7 AS query_id, chunk_index % 50 AS chunk_id, length(content) % 13 AS score FROM chunks) GROUP BY ALL")
def best_source_hits(spark, d):
    from ..operators import coverage

    rows = D.chunks(spark, d).select((F.col("document_id") % 7).alias("query_id"), (F.col("chunk_index") % 50).alias("chunk_id"), (F.length("content") % 13).cast("long").alias("score"), F.col("document_id").alias("rank"))
    return coverage.best_hits(rows).select("query_id", "chunk_id", "score")


@query(
    """SELECT user_id, case_no, status FROM (SELECT user_id, event_id AS case_no, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'view') WHERE n <= 3""",
    views=False,
)
def recent_runs(spark, d):
    rows = D.table(spark, d, "events").where("event_type <> 'view'").select("user_id", F.col("event_id").alias("case_no"), F.col("event_type").alias("status"))
    return retrieval.top_k(rows, 3, "case_no", ("user_id",), ("status",)).drop("rank")


@query(", s AS (SELECT document_id, list_distinct(list_filter(list_transform([' A ', 'b', title, 'B ', '', NULL], lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS v FROM docs) SELECT document_id, array_to_string(list_sort(v), ',') AS names FROM s")
def normalised_names(spark, d):
    values = F.array(F.lit(" A "), F.lit("b"), F.col("title"), F.lit("B "), F.lit(""), F.lit(None).cast("string"))
    return D.documents(spark, d).select("document_id", F.array_join(F.array_sort(sets.normalised_strings(values)), ",").alias("names"))
