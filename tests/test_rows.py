"""Operators on literal rows with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import anchors
from siltstone.functions import text as T
from siltstone.operators import access, conversations, corpus, evaluation, evidence, fusion, index, reports, retrieval, sets
from siltstone.sources import files, html, layout, tables
from siltstone.streaming import traces


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column("v").alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.search_tokens, "Straße A1-b 保密制") == ["strasse", "a1", "b", "保密制", "保密", "密制", "保密制"]
    assert one(spark, T.search_tokens, None) == []
    assert one(spark, T.search_tokens, "一二三四五")[:2] == ["一二", "二三"] and len(one(spark, T.search_tokens, "一二三四五")) == 9


def test_scalars(spark):
    assert one(spark, T.token_estimate, "") == 1 and one(spark, T.token_estimate, "abcde") == 2
    assert one(spark, T.structural_key, " A（b）.《c》 ") == "abc"
    assert one(spark, T.compact, "A-b 1，中") == "ab1中"
    assert one(spark, T.sentences, "One. Two!\n- three；四。五") == ["One.", "Two!", "three；四。五"]
    assert one(spark, T.task_title, "must check  it") == "Check it" and one(spark, T.task_title, "  ") == "Follow up"
    assert one(spark, lambda c: T.shorten(c, 8), "aaaa bbbb cccc") == "aaaa..."
    assert one(spark, T.priority, "Security must") == "high" and one(spark, T.priority, "please verify") == "medium" and one(spark, T.priority, None) == "low"
    assert one(spark, T.table_row_fields, "Table row: 级别=P1; 时限=15 分钟; 级别=x.") == {"级别": "P1", "时限": "15 分钟"}
    assert one(spark, lambda c: T.article_number(F.col(c)), "见第十二条之一（二）规定") == "第十二条之一（二）"
    assert one(spark, T.clause_name, "条款全称：保密 义务\nx") == "保密 义务"
    assert one(spark, T.cjk_density, "中文ab") == 0.5 and one(spark, T.cjk_density, "") == 0.0


def fold(spark, parts, **options):
    rows = [("d", i, t, s) for i, (t, s) in enumerate(parts, 1)]
    made = corpus.chunk_documents(spark.createDataFrame(rows, "document_id string, paragraph_index int, text string, section_title string"), **options)
    return [r.content for r in made.orderBy("chunk_index").collect()]


def test_chunk_fold(spark):
    a, b, c = "a" * 500, "b" * 300, "c" * 200
    # 500 + 300 + 200 exceeds 900: the last segment is kept for the next chunk.
    assert fold(spark, [(a, None), (b, None), (c, None)]) == [f"{a}\n\n{b}", f"{b}\n\n{c}"]
    # Reaching 1,200 flushes at once, and what is kept makes a last chunk of its own.
    long = "x" * 1200
    assert fold(spark, [(long, None)]) == [long, long]
    assert fold(spark, [("intro", None), ("Table row: a=1.", None), ("Table row: a=2.", None)]) == ["intro", "Table row: a=1.\n\nTable row: a=2."]
    assert fold(spark, [("t", "A"), ("B", "B"), ("u", "B")]) == ["t", "B\n\nu"]
    assert fold(spark, [("x", None), ("第一条", None), ("条款全称：甲", None), ("条款全称：乙", None)]) == ["x", "第一条\n\n条款全称：甲", "条款全称：乙"]


def test_term_index_caps(spark):
    rows = [("c", "word", " ".join(["many"] * 20))]
    got = {r.term: r.tf for r in index.term_index(spark.createDataFrame(rows, "chunk_id string, document_title string, content string")).collect()}
    assert got == {"word": 6, "many": 12}
    many = " ".join(f"t{i}" for i in range(5000))
    assert index.term_index(spark.createDataFrame([("c", many)], "chunk_id string, content string")).agg(F.sum("tf")).first()[0] == 4096


def test_rare_terms_win(spark):
    chunks = spark.createDataFrame([("a", "common common common common"), ("b", "rare word common"), ("c", "common other")], "chunk_id string, content string")
    scored = retrieval.bm25(index.query_terms(spark.createDataFrame([(1, "common rare")], "query_id int, query_text string")), index.term_index(chunks))
    assert scored.orderBy(F.desc("score")).first().chunk_id == "b"


def test_access(spark):
    users = spark.createDataFrame([(1, "viewer", "T", "n1"), (2, "viewer", None, "n2"), (3, "admin", None, "n1"), (4, "manager", "", None)], "user_id long, role string, team_name string, department_id string")
    departments = spark.createDataFrame([("r", "r"), ("n1", "r/n1"), ("n2", "r/n2")], "department_id string, id_path string")
    documents = spark.createDataFrame([(i, 2 if i == 10 else None) for i in range(10, 18)], "document_id long, owner_user_id long")
    acl = spark.createDataFrame(
        [
            (1, 11, "team", None, None, None, "r", True, False), (2, 12, "team", None, None, "T", None, False, True), (3, 13, "role", None, "manager", None, None, True, False),
            (4, 14, "user", 1, None, None, None, False, False), (5, 15, "public", None, None, None, None, True, False), (6, 16, "team", None, None, None, "n2", True, True),
        ],
        "acl_id long, document_id long, principal_type string, user_id long, role string, team_name string, department_id string, can_view boolean, can_manage boolean",
    )
    got = {(r.user_id, r.document_id): (r.can_manage, r.reason) for r in access.decisions(documents, acl, users, departments).collect()}
    assert got == {
        (2, 10): (True, "owner"), (1, 11): (False, "ancestor"), (2, 11): (False, "ancestor"), (1, 12): (True, "legacy"), (4, 13): (False, "role"),
        (1, 15): (False, "public"), (2, 15): (False, "public"), (4, 15): (False, "public"), (2, 16): (True, "direct"),
    }
    change = acl.where("acl_id = 6").withColumn("can_view", F.lit(False)).withColumn("can_manage", F.lit(False))
    assert [(r.user_id, r.impact) for r in access.acl_change_impact(documents, acl, users, departments, change).collect()] == [(2, "no_longer_visible")]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "a", "lexical", 1, 8.0), (1, "b", "lexical", 2, 4.0), (1, "b", "vector", 1, 0.9), (1, "c", "vector", 2, 0.5), (2, "x", "lexical", 1, 3.0), (1, "d", "structural", 1, 6.0)], "query_id int, chunk_id string, source string, rank int, score double")
    got = {r.chunk_id: round(r.fused, 4) for r in fusion.fuse(hits).collect()}
    assert got == {"a": 0.45, "b": 0.775, "c": 0.3056, "x": 0.45, "d": 0.54}
    rrf = {r.chunk_id: r.fused for r in fusion.fuse(hits, "rrf").collect()}
    assert rrf["b"] == 1.0 and 0 < rrf["c"] < rrf["a"] <= 1
    ranked = spark.createDataFrame([(1, "d1", f"a{i}", i) for i in range(1, 6)] + [(1, "d2", "b", 6)], "query_id int, document_id string, chunk_id string, rank int")
    assert [r.chunk_id for r in fusion.diverse_top_k(ranked, 4).orderBy("final_rank").collect()] == ["a1", "a2", "b", "a3"]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "case_id int, title string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (3, "q")], "case_id int, title string")
    forbidden = spark.createDataFrame([(2, "z"), (2, "y")], "case_id int, title string")
    got = {r.case_id: r for r in evaluation.ranking_metrics(ranked, relevant, forbidden).collect()}
    assert (got[1].recall, round(got[1].precision, 4), round(got[1].average_precision, 4), got[1].mrr) == (1.0, 0.6667, 0.5833, 0.5)
    assert round(got[1].ndcg, 4) == 0.6934
    assert got[2].recall == got[2].mrr == 0.5 and got[3].recall == got[3].ndcg == 0.0


def test_percentiles(spark):
    rows = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 9.0)], "k string, v double")
    assert evaluation.latency_summary(rows, "v", ["k"]).first().p95 == pytest.approx(8.3)
    assert evaluation.nearest_rank(rows, "v", ["k"], 0.95).first().value == 9.0


def test_conversations(spark):
    m = spark.createDataFrame([(1, 0, "user", "q0"), (1, 1, "user", "q1"), (1, 2, "assistant", "You must check it. Then rest. You MUST check it."), (1, 3, "assistant", "again"), (1, 4, "user", "q4")], "session_id int, turn int, role string, content string")
    assert [(r.question_turn, r.answer_turn) for r in conversations.question_answers(m).collect()] == [(1, 2)]
    assert [r.turn for r in conversations.recent_rounds(m, 2).orderBy("turn").collect()] == [1, 2, 3, 4]
    assert [(r.title, r.priority) for r in conversations.tasks(m, 5).collect()] == [("You must check it.", "medium")]
    assert conversations.report(m).first().next_plan == "[medium] You must check it."


def test_changes(spark):
    pairs = spark.createDataFrame([(1, "a\n\nb\n\nc", "a\n\nX\n\nc\n\nd"), (2, None, "n"), (3, "s", "s")], "pair_id int, old_text string, new_text string")
    got = [(r.pair_id, r.change_type, r.old_text, r.new_text) for r in sets.paragraph_changes(pairs).orderBy("pair_id", "block").collect()]
    assert got == [(1, "replace", "b", "X"), (1, "insert", None, "d"), (2, "insert", None, "n")]
    counts = {r.pair_id: (r.n_insert, r.n_delete, r.n_replace) for r in sets.change_counts(sets.paragraph_changes(pairs)).collect()}
    assert counts == {1: (1, 0, 1), 2: (1, 0, 0)}


def test_tables(spark):
    df = spark.createDataFrame([([["Name", "", "Name"], ["a", "b", " c  d "], ["", "", ""], ["", "x", "", "y"]],)], "rows array<array<string>>")
    got = df.select(tables.row_texts(F.col("rows"), F.lit("Cap")).alias("x")).first().x
    assert got == ["Table row: Cap. Name=a; Column 2=b; Name 2=c d.", "Table row: Cap. Column 2=x; Column 4=y."]


def test_html(spark):
    page = "<html><body><nav><p>skip this one</p></nav><h1>Title here</h1><p>First text<br>line two</p><script>x</script><div class='sidebar'><p>no no no</p></div><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><ul><li>item one</li></ul></body></html>"
    got = html.page_segments(spark.createDataFrame([(1, page), (2, None), (3, "plain words")], "page_id long, html string")).collect()
    assert [(r.page_id, r.tag, r.text, r.section_title) for r in got] == [
        (1, "h1", "Title here", "Title here"), (1, "p", "First text\nline two", "Title here"), (1, "table", "Table row: Title here. A=1; B=2.", "Title here"), (1, "li", "item one", "Title here"), (3, "body", "plain words", None),
    ]


def test_markdown(spark):
    body = "intro *one*\nstill intro\n\n# Head\ntext [link](u)\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | |\n\n- item\n"
    got = files.markdown_segments(spark.createDataFrame([(1, body)], "document_id int, content string")).orderBy("paragraph_index").collect()
    assert [(r.text, r.section_title) for r in got] == [
        ("intro one still intro", None), ("Head", "Head"), ("text link", "Head"), ("Table row: Head. a=1; b=2.", "Head"), ("Table row: Head. a=3.", "Head"), ("item", "Head"),
    ]


def test_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    (tmp_path / "t.csv").write_text('k,v\n1,"a,b"\n')
    seen = {r.name: r for r in files.inspect_uploads(spark, str(tmp_path)).collect()}
    assert seen["t.csv"].supported and len(seen["t.csv"].checksum) == 64 and set(seen) == {"a_b.txt", "t.csv"}
    assert [r.text for r in tables.read_csv(spark, str(tmp_path / "t.csv")).collect()] == ["Table row: t. k=1; v=a,b."]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq2\t0\td3\t2\n")
    assert [(r.query_id, r.document_id, r.relevance) for r in files.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "d1", 1), ("q2", "d3", 2)]
    path = str(tmp_path / "chunks")
    row = lambda v, c: spark.createDataFrame([(v, c)], "version_id string, content string")
    files.write_chunks(row("v1", "old").union(row("v2", "kept")), path)
    files.write_chunks(row("v1", "new"), path)
    assert sorted((r.version_id, r.content) for r in spark.read.parquet(path).collect()) == [("v1", "new"), ("v2", "kept")]


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=13 * i), f"t{i % 2}", float(i)) for i in range(40)]
    batch = spark.createDataFrame(rows, "ts timestamp, trace_type string, latency double")
    source = str(tmp_path / "in")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    traces.start(traces.latency_windows(stream, lateness="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    made = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in traces.latency_windows(batch).collect()}
    last = max(r[0] for r in whole)
    assert made == {r for r in whole if r[0] < last}  # the watermark holds the last window open


def test_jobs(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([(1, at(0), "queued"), (1, at(1), "running"), (1, at(2), "completed"), (1, at(3), "failed"), (2, at(0), "queued"), (3, at(0), "running")], "job_id int, ts timestamp, event string")
    states = traces.job_states(events)
    assert {r.job_id: r.status for r in states.collect()} == {1: "completed", 2: "queued", 3: "running"}
    assert {r.job_id: r.status for r in traces.stale_jobs(states, F.lit(at(10))).collect()} == {1: "completed", 2: "failed", 3: "running"}


def test_facts_and_claims(spark):
    row = spark.createDataFrame([("必须先提交完整申请，然后等待部门审批 ok", [("a", ["提交完整申请，等待部门审批"], 2.0), ("b", ["missing"], 1.0), ("c", ["OK"], 1.0)])], "t string, specs array<struct<label:string,aliases:array<string>,weight:double>>")
    got = row.select(evidence.fact_coverage(F.col("specs"), F.col("t")).alias("f")).first().f
    assert (got.matched, got.missing, got.coverage) == (["a", "c"], ["b"], 0.75)


def test_embedding(spark):
    import hashlib

    raw = [b / 127.5 - 1 for i in range(2) for b in hashlib.sha256(f"{i}:hé".encode()).digest()][:40]
    norm = sum(x * x for x in raw) ** 0.5
    assert one(spark, lambda c: evidence.embedding(c, 40), "hé") == pytest.approx([x / norm for x in raw])


def test_stage_loss(spark):
    lit = F.lit
    full = {k: lit(1.0) for k in ("title_pool", "source_pool", "base_pool", "fused", "pre_rerank", "reranked", "final")}
    row = spark.range(1)
    name = lambda passed=False, **r: row.select(evidence.stage_loss(lit(passed), lit(False), lit(None).cast("string"), full | {k: lit(v) for k, v in r.items()}).alias("x")).first().x
    assert [name(True), name(title_pool=0.0), name(source_pool=0.5), name(fused=0.5), name(pre_rerank=0.2), name(reranked=0.5), name(final=0.5)] == [
        "passed", "source_pool_title_missing", "source_pool_evidence_missing", "fusion_evidence_dropped", "expansion_or_refusion_evidence_dropped", "rerank_evidence_dropped", "final_selection_evidence_dropped",
    ]


def test_structural(spark):
    chunks = spark.createDataFrame(
        [("a", 1, 0, "保密制度", "第三章", "第十二条", None), ("b", 1, 1, "保密制度", "第三章", "第十三条", None), ("c", 2, 0, "考勤", "总则", None, None)],
        "chunk_id string, document_id int, chunk_index int, document_title string, section_title string, article_number string, clause_full_name string",
    )
    queries = spark.createDataFrame([(1, "保密制度第十二条"), (2, "no anchor here")], "query_id int, query_text string")
    got = retrieval.structural(queries, chunks, 5).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (1, "b")] and got[0].score - got[1].score > 6


def test_table_pairs_and_exact_text(spark):
    chunks = spark.createDataFrame([("a", 1, 0, "t", "Table row: 级别=P1; 时限=15分钟.", "table"), ("b", 1, 1, "t", "P1 级别 and more words here to find", "paragraph")], "chunk_id string, document_id int, chunk_index int, document_title string, content string, chunk_type string")
    pairs = spark.createDataFrame([(1, "级别", "P1")], "query_id int, field string, value string")
    assert [(r.chunk_id, r.score) for r in retrieval.table_pairs(pairs, chunks, 5).orderBy("rank").collect()] == [("a", 107.75), ("b", 95.75)]
    q = spark.createDataFrame([(1, "more words here"), (2, "20240101 2024"), (3, "short")], "query_id int, query_text string")
    assert [(r.query_id, r.chunk_id, round(r.score, 3)) for r in retrieval.exact_text(q, chunks, 5).collect()] == [(1, "b", 72.15)]


def test_anchors(spark):
    assert one(spark, anchors.quoted, 'a “甲 乙” and "x  y" “甲 乙” ""') == ["甲 乙", "x y"]
    assert one(spark, anchors.weak_anchor_reasons, "2023年5月1日") == ["date_only"] and one(spark, anchors.weak_anchor_reasons, "12.5条") == ["too_short", "numeric_only", "article_fragment"]
    assert [one(spark, lambda c, s=s: anchors.version_reference(c, s), "compare V1 with v3") for s in ("from", "to")] == ["v1", "v3"]
    assert [one(spark, lambda c, s=s: anchors.version_reference(c, s), "previous against newest") for s in ("from", "to")] == ["previous", "latest"]
    assert one(spark, anchors.is_version_comparison, "What changed in this version?") and not one(spark, anchors.is_version_comparison, "v2 please")
    nums = F.array(*[F.lit(x) for x in (5, 4, 2)])
    assert [one(spark, lambda c: anchors.resolve_version(F.col(c), nums), v) for v in ("latest", "previous", "v2", "4", "v9")] == [5, 4, 2, 4, None]
    assert tuple(one(spark, anchors.law_and_article, "保密法 第三条")) == ("保密法", "第三条") and tuple(one(spark, anchors.law_and_article, "总则")) == ("总则", "总则")
    assert one(spark, anchors.marker_key, "A，b (C)") == "abc"
    row = spark.range(1).select(anchors.location_label(F.lit(None).cast("int"), F.lit(3), F.lit(1)).alias("a"), anchors.citation_identity(F.lit(None), F.lit("d"), F.lit(None), F.lit(2)).alias("b")).first()
    assert (row.a, row.b) == ("第 3 段", "d||2")


def test_reports(spark):
    cases = spark.createDataFrame([("a", "n1", "q", "answer", ["d1"]), ("a", "n1", "", "answer", []), ("b", None, "q", "x", ["zz"])], "dataset string, case_name string, question string, expected_outcome string, expected_document_ids array<string>")
    runs = spark.createDataFrame([("a", 1, 1, "completed"), ("a", 2, 2, "failed"), ("a", 3, 3, "completed"), ("c", 4, 1, "completed")], "dataset string, run_id int, created_at int, status string")
    got = {r.dataset: (r.n_cases, r.n_completed, r.n_failed, r.latest_run) for r in reports.dataset_report(cases, runs).collect()}
    assert got == {"a": (2, 2, 1, 3), "b": (1, 0, 0, None), "c": (0, 1, 0, 4)}
    assert [(r.run_id, r.point) for r in reports.run_trend(runs, 5).where("dataset = 'a'").orderBy("point").collect()] == [(1, 1), (3, 2)]
    errors = sorted((r.case_name or "", r.error) for r in reports.case_errors(cases, spark.createDataFrame([("d1",)], "id string")).collect())
    assert errors == [("", "invalid_expected_outcome"), ("", "missing_case_name"), ("", "unknown_expected_document:zz"), ("n1", "answer_without_expected_document"), ("n1", "duplicate_case_name"), ("n1", "duplicate_case_name"), ("n1", "missing_question")]
    near = reports.nearest_candidate(spark.createDataFrame([(1, "d", 10)], "marker_id int, document_id string, chunk_index int"), spark.createDataFrame([("d", 8, 1), ("d", 12, 2), ("e", 10, 1)], "document_id string, chunk_index int, rank int")).first()
    assert (near.distance, near.nearest, near.within_1, near.within_2) == (2, 8, False, True)
    moved = reports.move_subtree(spark.createDataFrame([("a", "r/a"), ("b", "r/a/b"), ("c", "r/ab")], "department_id string, id_path string"), "r/a", "q/a")
    assert {r.department_id: r.id_path for r in moved.collect()} == {"a": "q/a", "b": "q/a/b", "c": "r/ab"}
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    ops = spark.range(1).select(*[reports.acl_operation(*x).alias(f"c{i}") for i, x in enumerate([(t, f, n, n), (f, f, n, n), (f, f, t, f), (t, f, t, f), (t, t, t, f)])]).first()
    assert list(ops) == ["create", "noop", "revoke", "unchanged", "update"]


def test_layout(spark):
    words = spark.createDataFrame([(1, "in", 1, 1, 2, 2), (1, "out", 20, 20, 22, 22), (2, "other", 1, 1, 2, 2)], "page_id int, text string, left int, top int, right int, bottom int")
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10)], "page_id int, left int, top int, right int, bottom int")
    assert sorted(r.text for r in layout.words_outside(words, boxes).collect()) == ["other", "out"]
    pages = spark.createDataFrame([("d", 1, 0, 2, ["a", "b"], True), ("d", 2, 0, 2, ["1", "2"], False), ("d", 4, 0, 2, ["3", "4"], False)], "document_id string, page int, table_no int, width int, header array<string>, has_header boolean")
    assert [r.effective_header for r in layout.carried_headers(pages).orderBy("page").collect()] == [["a", "b"], ["a", "b"], None]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 3, 3, 2, 2, 2, 3])], "image_id int, row_no int, n_cells int")
    assert tuple(layout.best_run(rows).first()) == (1, 3, 3, 2)
    boxes = spark.createDataFrame([(1, t, l, y, l + 20, y + 10) for t, l, y in [("a", 0, 0), ("b", 25, 1), ("c", 120, 0), ("d", 0, 40), ("e", 120, 41)]], "image_id int, text string, left int, top int, right int, bottom int")
    cells = tables.row_cells(tables.word_rows(boxes)).orderBy("row_no", "cell_no").collect()
    assert [(r.row_no, r.text) for r in cells] == [(0, "a b"), (0, "c"), (1, "d"), (1, "e")]
