"""The control plane as sets: departments, access entries, versions, citations, memory of conversations, jobs and routing of questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import text as T

# Fixed values.
ORG_CODE_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUEUES = {"chat_message": "arq:queue:chat", "document_diff_summary": "arq:queue:diff", "document_ingest": "arq:queue:ingest", "eval_run": "arq:queue:eval"}
SUMMARY_LINES = 6
TITLE_SUFFIXES = "document|documents|doc|file|handbook|guide|register|runbook|playbook|manual|policy|文档|手册|指南|登记|台账|流程|规范"
DOCUMENT_NAME_PATTERNS = (
    "《([^》]{1,60})》",
    r"([一-龥A-Za-z0-9《》\-\s]{2,40}?)(?:里|中)关于",
    r"([一-龥A-Za-z0-9《》\-\s]{2,40}?)(?:里|中)(?:[^？?。！!]{0,24})?(?:怎么说|写了什么|说了什么|讲了什么|要求什么|提到什么|内容是什么|写了哪些|是什么|是谁)",
    r"(?i)(?:what does|compare|show|summarize)\s+([A-Za-z0-9\-\s]{2,60}?)\s+(?:document|doc|guide|handbook|runbook|say|show)",
)
ARTIFACTS = (("tasks", "待办|任务|待办事项|整理成待办|todo|action item"), ("weekly_report", "周报|weekly report|status report"), ("faq", "faq|常见问题"))


# Departments and access entries.


def org_code_path(parent: Column, code: Column) -> Column:
    return F.concat(F.coalesce(parent, F.lit("")), F.lit("/"), code)


def next_org_codes(departments: DataFrame) -> DataFrame:
    """(parent_id, org_code): the first free child code of every department of departments(department_id, parent_id, org_code): its own code and one character; none
    where all are taken. The reference draws one of the free codes; the first makes the result repeatable."""
    chars = F.explode(F.array(*[F.lit(c) for c in ORG_CODE_CHARS]))
    wanted = departments.select(F.col("department_id").alias("parent_id"), F.col("org_code").alias("stem"), chars.alias("c")).withColumn("org_code", F.concat("stem", "c"))
    free = wanted.join(departments.select("parent_id", "org_code"), ["parent_id", "org_code"], "left_anti")
    return free.groupBy("parent_id").agg(F.min("org_code").alias("org_code"))


def move_errors(moves: DataFrame, departments: DataFrame) -> DataFrame:
    """moves(department_id, new_name, new_parent_id) with error: what forbids a renaming or move, or null: an empty name, one with a slash, a department under
    itself or its own descendants, an unknown parent, or a name that a sibling has."""
    d = departments.select("department_id", F.col("id_path").alias("_own"))
    p = departments.select(F.col("department_id").alias("new_parent_id"), F.col("id_path").alias("_parent"))
    taken = departments.select(F.col("parent_id").alias("new_parent_id"), F.col("name").alias("new_name"), F.col("department_id").alias("_other"))
    rows = moves.join(d, "department_id").join(p, "new_parent_id", "left")
    twin = rows.alias("m").join(taken.alias("t"), (F.col("m.new_parent_id").eqNullSafe(F.col("t.new_parent_id"))) & (F.col("m.new_name") == F.col("t.new_name")) & (F.col("m.department_id") != F.col("t._other"))).select("m.department_id").distinct()
    rows = rows.join(twin.withColumn("_twin", F.lit(True)), "department_id", "left")
    name = F.trim(T.text("new_name"))
    error = (
        F.when(name == "", "empty_name").when(F.contains(name, F.lit("/")), "slash_in_name").when(F.col("new_parent_id") == F.col("department_id"), "own_parent")
        .when(F.col("new_parent_id").isNotNull() & F.col("_parent").isNull(), "unknown_parent").when(F.startswith(F.concat("_parent", F.lit("/")), F.concat("_own", F.lit("/"))), "below_itself").when(F.col("_twin"), "name_taken")
    )
    return rows.select("department_id", "new_name", "new_parent_id", error.alias("error"))


def removable_departments(departments: DataFrame, users: DataFrame, acl: DataFrame) -> DataFrame:
    """(department_id, blocked_by): children, users or access entries that keep a department from being deleted, the first of them; null where nothing does."""
    once = lambda df, c, name: df.where(F.col(c).isNotNull()).select(F.col(c).alias("department_id")).distinct().withColumn(name, F.lit(True))
    rows = departments.select("department_id")
    for df, c, name in ((departments, "parent_id", "children"), (users, "department_id", "users"), (acl, "department_id", "access")):
        rows = rows.join(once(df, c, name), "department_id", "left")
    return rows.select("department_id", F.when(F.col("children"), "children").when(F.col("users"), "users").when(F.col("access"), "access").alias("blocked_by"))


ACL_KEY = ["document_id", "principal_type", "user_id", "role", "team_name", "department_id"]


def _same_key(a: str, b: str) -> Column:
    out = F.lit(True)
    for k in ACL_KEY:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def find_acl(acl: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted(ACL_KEY) with the acl_id of the entry that has just this key; nulls are equal."""
    return wanted.alias("w").join(acl.alias("a"), _same_key("w", "a"), "left").select("w.*", "a.acl_id")


def prune_acl(acl: DataFrame) -> DataFrame:
    """Access entries without those that grant nothing."""
    return acl.where(F.coalesce("can_view", F.lit(False)) | F.coalesce("can_manage", F.lit(False)))


def apply_acl(acl: DataFrame, changes: DataFrame) -> DataFrame:
    """Access entries after changes(ACL_KEY, can_view, can_manage, acl_id for new ones): an entry with a change's key takes its permissions, a key without an entry is added, and
    entries that then grant nothing are gone."""
    old = acl.alias("a").join(changes.alias("c"), _same_key("a", "c"), "left")
    kept = old.select("a.acl_id", *[f"a.{k}" for k in ACL_KEY], *[F.coalesce(F.col(f"c.{p}"), F.col(f"a.{p}")).alias(p) for p in ("can_view", "can_manage")])
    new = changes.alias("c").join(acl.alias("a"), _same_key("c", "a"), "left_anti").select("acl_id", *ACL_KEY, "can_view", "can_manage")
    return prune_acl(kept.unionByName(new))


def reconcile_acl(acl: DataFrame, target: DataFrame) -> DataFrame:
    """Entries of the documents of target(ACL_KEY) whose key it doesn't have: those that have to go. Other documents are left alone."""
    own = acl.join(target.select("document_id").distinct(), "document_id", "left_semi")
    return own.alias("a").join(target.alias("t"), _same_key("a", "t"), "left_anti")


def last_admins(users: DataFrame) -> DataFrame:
    """Users that may not lose their role or be closed: the only active admin there is."""
    n = users.where("role = 'admin' and is_active").agg(F.count("*").alias("n"))
    return users.where("role = 'admin' and is_active").join(n.where("n = 1")).select("user_id")


# Documents, versions, messages.


def duplicate_uploads(uploads: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """uploads(upload_id, title, checksum, and document_id for a new version) with the version that each repeats, or null: the latest with its checksum, of the same title (any
    case), or of the same document for a new version."""
    known = versions.join(documents.select("document_id", "title"), "document_id").select(F.col("document_id").alias("_doc"), F.lower("title").alias("_title"), "checksum", "version_id", "version_number")
    same = F.when(F.col("document_id").isNotNull(), F.col("document_id") == F.col("_doc")).otherwise(F.lower("title") == F.col("_title"))
    hits = uploads.join(known, "checksum").where(same)
    latest = hits.groupBy("upload_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("repeats"))
    return uploads.join(latest, "upload_id", "left")


def upload_decisions(uploads: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """duplicate_uploads with action (conflict, new_document, new_version) and the version number that is written."""
    rows = duplicate_uploads(uploads, documents, versions)
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("_last"))
    rows = rows.join(last, "document_id", "left")
    action = F.when(F.col("repeats").isNotNull(), "conflict").when(F.col("document_id").isNull(), "new_document").otherwise("new_version")
    return rows.select("upload_id", action.alias("action"), F.when(F.col("repeats").isNull(), F.coalesce("_last", F.lit(0)) + 1).alias("version_number"), "repeats")


def current_chunks(chunks: DataFrame, versions: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Chunks of the documents' current versions with their titles and version numbers, within scope(document_id) if one is given."""
    own = documents.select("document_id", F.col("title").alias("document_title"), F.col("current_version_id").alias("version_id"))
    if scope is not None:
        own = own.join(scope.select("document_id"), "document_id", "left_semi")
    return own.join(versions.select("version_id", "version_number"), "version_id").join(chunks.drop("document_id", "document_title"), "version_id")


def messages_of_user(messages: DataFrame, sessions: DataFrame, user: Column) -> DataFrame:
    """Messages of the sessions that a user owns."""
    return messages.join(sessions.where(F.col("user_id") == user).select("session_id"), "session_id", "left_semi")


def unique_citations(citations: DataFrame, limit: int | None = None) -> DataFrame:
    """Citations(message_id, pos, ...) numbered anew, each identity once, the first in order: by chunk, else by document, version, place and preview."""
    has = lambda c: F.col(c) if c in citations.columns else F.lit(None).cast("string")
    key = A.citation_identity(has("chunk_id"), *[has(c) for c in ("document_id", "document_version_id", "chunk_index", "page_number_start", "paragraph_start", "preview")])
    rows = citations.withColumn("_key", key).withColumn("_n", F.row_number().over(W.partitionBy("message_id", "_key").orderBy("pos"))).where("_n = 1")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("message_id").orderBy("pos"))).drop("_key", "_n")
    return rows.where(F.col("rank") <= limit) if limit else rows


def older_summary(messages: DataFrame, rounds: int = 3, lines: int = SUMMARY_LINES) -> DataFrame:
    """Per session, what lies before its last ``rounds`` rounds: the last ``lines`` lines "role: text" and how many were left out."""
    later = W.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    old = messages.withColumn("_after", F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(later), F.lit(0))).where(F.col("_after") >= rounds)
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))
    old = old.withColumn("_n", back).withColumn("_line", F.concat("role", F.lit(": "), F.substring(T.squeeze("content"), 1, 400)))
    made = old.groupBy("session_id").agg(F.count("*").alias("older_count"), F.sort_array(F.collect_list(F.when(F.col("_n") <= lines, F.struct("turn", "_line")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")
    left = F.col("older_count") - lines
    return made.select("session_id", "older_count", F.when(left > 0, F.concat(F.lit("... "), left.cast("string"), F.lit(" earlier message(s) omitted ...\n"), body)).otherwise(body).alias("older_summary"))


def last_answer_state(messages: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per session, metadata fields of its last assistant message: messages(session_id, turn, role, metadata: JSON)."""
    own = messages.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("metadata", "turn").alias("m"))
    return own.select("session_id", *[F.get_json_object("m", f"$.{f}").alias(f.rsplit(".", 1)[-1]) for f in fields])


def usable_sessions(messages: DataFrame) -> DataFrame:
    """Sessions with an assistant message that has text and enough evidence."""
    return messages.where("role = 'assistant'").groupBy("session_id").agg(F.bool_or((F.trim(T.text("content")) != "") & ~F.coalesce("insufficient", F.lit(False))).alias("usable"))


# Differences.


def unified_diffs(pairs: DataFrame, context: int = 2) -> DataFrame:
    """pairs(pair_id, old_text, new_text, from_version, to_version) as (pair_id, diff): the unified difference of their paragraphs."""
    import re

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        split = lambda t: [p.strip() for p in re.split(r"\n\s*\n+", (t or "").replace("\r\n", "\n")) if p.strip()]
        for f in frames:
            rows = [(p, "\n".join(difflib.unified_diff(split(a), split(b), f"version_{v}", f"version_{w}", lineterm="", n=context))) for p, a, b, v, w in zip(f["pair_id"], f["old_text"], f["new_text"], f["from_version"], f["to_version"], strict=True)]
            yield pd.DataFrame(rows, columns=["pair_id", "diff"])

    return pairs.select("pair_id", "old_text", "new_text", "from_version", "to_version").mapInPandas(run, f"pair_id {dict(pairs.dtypes)['pair_id']}, diff string")


def diff_summaries(changes: DataFrame, limit: int = 3) -> DataFrame:
    """Per pair of changes(pair_id, block, change_type, old_text, new_text), the first ``limit`` additions, deletions and modifications ("old -> new"), shortened."""
    text = F.when(F.col("change_type") == "insert", T.shorten("new_text", 120)).when(F.col("change_type") == "delete", T.shorten("old_text", 120)).otherwise(F.concat(T.shorten("old_text", 60), F.lit(" -> "), T.shorten("new_text", 60)))
    rows = changes.withColumn("t", text).where("t <> ''").withColumn("n", F.row_number().over(W.partitionBy("pair_id", "change_type").orderBy("block"))).where(F.col("n") <= limit)
    pick = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("change_type") == kind, F.struct("n", "t")))), lambda x: x.t)
    return rows.groupBy("pair_id").agg(pick("insert").alias("additions"), pick("delete").alias("deletions"), pick("replace").alias("modifications"))


def impact_hints(words: Column, modified: Column, added: Column, deleted: Column, hints: dict[str, str]) -> Column:
    """At most six hints about a change: one for each word that it touches, then by how much was modified, added or deleted; "review" if nothing is said."""
    found = [F.when(F.array_contains(words, w), h) for w, h in hints.items()]
    more = [F.when(modified > 0, "modified"), F.when(added >= 3, "many_additions"), F.when(deleted >= 3, "many_deletions")]
    out = F.slice(F.array_distinct(F.array_compact(F.array(*found, *more))), 1, 6)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("review")))


# Jobs.


def queue_name(job_type: Column) -> Column:
    """The queue of a job type; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for p in QUEUES.items() for x in p]), job_type)


def reconcile_jobs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """jobs(job_id, job_type, status, resource_id, finished_at) with the state of the evaluation run that they stand for, where that has ended and they have not."""
    r = runs.where("status in ('completed', 'failed')").select(F.col("run_id").alias("resource_id"), F.col("status").alias("_s"), F.col("finished_at").alias("_f"))
    rows = jobs.join(r, "resource_id", "left")
    open_ = (F.col("job_type") == "eval_run") & F.col("status").isin("queued", "running") & F.col("_s").isNotNull()
    return rows.withColumn("status", F.when(open_, F.col("_s")).otherwise(F.col("status"))).withColumn("finished_at", F.when(open_, F.coalesce("_f", "finished_at")).otherwise(F.col("finished_at"))).drop("_s", "_f")


def accepted_jobs(requests: DataFrame) -> DataFrame:
    """requests(request_id, job_type, user_id, client_request_id, resource_id, payload, ts) with outcome: the first of an idempotency key is created, a repeat of the same
    resource and payload is the existing job, another one a conflict; requests without a key are always created. The job is the first request."""
    w = W.partitionBy("job_type", "user_id", "client_request_id").orderBy("ts", "request_id")
    first = lambda c: F.first(c).over(w)
    keyed = F.coalesce(F.col("client_request_id") != "", F.lit(False))
    same = first("resource_id").eqNullSafe(F.col("resource_id")) & first("payload").eqNullSafe(F.col("payload"))
    n = F.row_number().over(w)
    outcome = F.when(~keyed | (n == 1), "created").when(same, "existing").otherwise("conflict")
    return requests.withColumn("outcome", outcome).withColumn("job_id", F.when(keyed, first("request_id")).otherwise(F.col("request_id")))


def progress(jobs: DataFrame, cases: DataFrame) -> DataFrame:
    """Per job, its request's metadata with how far it came: jobs(job_id, metadata map<string,string>, status), cases(job_id, done)."""
    n = cases.groupBy("job_id").agg(F.count("*").alias("t"), F.count(F.when(F.col("done"), 1)).alias("d"))
    rows = jobs.join(n, "job_id", "left").fillna(0, ["t", "d"])
    own = F.create_map(F.lit("status"), F.col("status"), F.lit("completed_cases"), F.col("d").cast("string"), F.lit("total_cases"), F.col("t").cast("string"))
    return rows.select("job_id", F.map_from_entries(F.concat(F.filter(F.map_entries("metadata"), lambda e: ~e.key.isin("status", "completed_cases", "total_cases")), F.map_entries(own))).alias("summary"))


def trace_rows(results: DataFrame) -> DataFrame:
    """results(trace_id, trace_type, user_id, created_at, latency_ms, chunks array, citations array, debug struct) as rows of the trace table, nested parts as JSON."""
    return results.select("trace_id", "trace_type", "user_id", "created_at", F.greatest("latency_ms", F.lit(0)).alias("latency_ms"), F.to_json("chunks").alias("retrieved_chunks_json"), F.to_json("citations").alias("selected_citations_json"), F.to_json("debug").alias("trace_metadata"))


# Routing of questions.


def requested_document(question: Column | str) -> Column:
    """The document that a question names, or null."""
    found = [F.nullif(F.regexp_replace(F.regexp_extract(T.text(question), p, 1), "^[ 《》]+|[ 《》]+$", ""), F.lit("")) for p in DOCUMENT_NAME_PATTERNS]
    return F.coalesce(*found)


def artifact_type(question: Column | str) -> Column:
    """tasks, weekly_report or faq, if a question asks for one."""
    low = F.lower(T.text(question))
    (_, tasks), *rest = ARTIFACTS
    out = F.when(low.rlike(tasks) | (F.contains(low, F.lit("整理")) & F.contains(low, F.lit("事项"))), "tasks")
    for name, words in rest:
        out = out.when(low.rlike(words), name)
    return out


def named_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, document_id, score): the document whose title a question holds as it is (1), without punctuation (.92), or without the words that end titles (.8); ties to the
    smaller id. Questions are a stated set; titles meet them where they lie."""
    q = questions.select("question_id", T.fold("question").alias("q"), T.match_text("question").alias("nq"))
    d = documents.select("document_id", T.fold("title").alias("t"), T.match_text("title").alias("nt")).withColumn("st", F.regexp_replace("nt", f"({TITLE_SUFFIXES})+$", ""))
    score = F.when((F.col("t") != "") & F.contains("q", F.col("t")), 1.0).when((F.col("nt") != "") & F.contains("nq", F.col("nt")), 0.92).when((F.col("st") != "") & F.contains("nq", F.col("st")), 0.8)
    rows = d.join(q, (F.col("t") != "") & F.contains("q", F.col("t")) | (F.col("st") != "") & F.contains("nq", F.col("st"))).withColumn("score", score).where("score is not null")
    return rows.groupBy("question_id").agg(F.max("score").alias("score"), F.min_by("document_id", F.struct((-F.col("score")).alias("s"), "document_id")).alias("document_id"))


def routes(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """questions(question_id, question, has_context) with intent, target document, named document, artifact and version references: too short is unclear; comparisons of versions; artifacts from the
    context; questions about a document that can be seen, or about one that can't; else a topic."""
    rows = questions.join(named_documents(questions, documents).drop("score"), "question_id", "left")
    q = T.text("question")
    short = F.length(F.regexp_replace(q, r"[\s？?！!。,.…]", "")) <= 2
    named, artifact = requested_document("question"), artifact_type("question")
    intent = (
        F.when(short, "unsupported_or_unclear").when(A.is_version_comparison("question"), "version_compare").when(artifact.isNotNull() & F.col("has_context"), "workflow_generation")
        .when(F.col("document_id").isNotNull() | named.isNotNull(), "document_qa").otherwise("topic_qa")
    )
    compared = intent == "version_compare"
    return rows.select(
        "question_id", intent.alias("intent"), "document_id", named.alias("requested_name"), artifact.alias("artifact_type"), F.when(compared, A.version_reference("question", "from")).alias("from_ref"), F.when(compared, A.version_reference("question", "to")).alias("to_ref"),
        (intent.isin("document_qa", "version_compare") & F.col("document_id").isNull() & named.isNotNull()).alias("refuse"),
    )
