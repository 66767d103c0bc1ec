"""The whole search, slot replacement, and what answers are made from, against sequential versions on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import coverage, evaluation_run, focus, index, retrieval, search

# Slot replacement.

PROTECTED = set(coverage.REPLACEMENT_PROTECTED)


def replaced(chosen, extra, rows, slots, protected, guarded):
    """One extra after the other, as a list operation."""
    now, n = list(chosen), 0
    start = min(max(1, min(protected, max(len(now) - 1, 0))), len(now))
    quality = lambda c: (rows[c]["rerank"] if rows[c]["rerank"] > 0 else rows[c]["fused"], rows[c]["fused"], rows[c]["lexical"])
    for x in extra:
        if n >= slots:
            break
        if x in now:
            continue
        free = lambda first: [i for i in range(first, len(now)) if rows[now[i]]["doc"] == rows[x]["doc"] and now[i] not in guarded and not PROTECTED & set(rows[now[i]]["sources"])]  # noqa: E731, B023
        places = free(start) or (free(1) if protected >= len(now) else [])
        if places:
            now[min(places, key=lambda i: (*quality(now[i]), i))] = x
            n += 1
    return now


def test_replace_slots(spark):
    r = random.Random(4)
    picked, more, cands, guards, expected = [], [], [], [], {}
    for q in range(120):
        size, slots = r.choice([1, 2, 3, 4, 8]), 2
        rows = {f"c{q}-{k}": {"doc": r.randrange(3), "fused": r.choice([0.1, 0.2, 0.2, 0.5]), "rerank": r.choice([0.0, 0.0, 0.3]), "lexical": r.choice([0.0, 1.0]), "sources": r.sample(["lexical", "document_sweep", "document_expansion"], r.choice([1, 1, 2]))} for k in range(14)}
        names = list(rows)
        chosen, extra = names[:size], r.sample(names, 5)
        guarded = set(r.sample(names, 2))
        picked += [(q, c, i + 1) for i, c in enumerate(chosen)]
        more += [(q, c, i + 1) for i, c in enumerate(extra)]
        cands += [(q, c, v["doc"], v["fused"], v["rerank"], v["lexical"], v["sources"]) for c, v in rows.items()]
        guards += [(q, c) for c in guarded]
        expected[q] = replaced(chosen, extra, rows, slots, 3, guarded)
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = coverage.replace_slots(
        df(picked, "query_id long, chunk_id string, final_rank int"), df(more, "query_id long, chunk_id string, slot int"),
        df(cands, "query_id long, chunk_id string, document_id long, fused double, rerank_score double, lexical_raw double, sources array<string>"), 2, 3, guarded=df(guards, "query_id long, chunk_id string"),
    )
    lists = {}
    for row in got.collect():
        lists.setdefault(row.query_id, {})[row.final_rank] = row.chunk_id
    assert {q: [v[k] for k in sorted(v)] for q, v in lists.items()} == expected
    assert any(expected[q] != [c for a, c, _ in picked if a == q] for q in expected)


# Search.

CHUNKS = [
    ("a", 1, "alpha reports", ["the quick onyx goblin jumps over a dwarf", "amount limit 42 is set here", "nothing to see"]),
    ("b", 2, "beta reports", ["the quick onyx goblin sleeps", "pack my box with five dozen jugs", "goblin goblin goblin"]),
    ("c", 3, "gamma reports", ["amount limit 42 elsewhere and far away", "how vexingly quick daft zebras jump", ""]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"{p}{k}", doc, k, title, text) for p, doc, title, texts in CHUNKS for k, text in enumerate(texts) if text]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id long, chunk_index int, document_title string, content string")
    terms = index.with_lengths(index.term_index(chunks.select("chunk_id", "document_title", "content")), ["chunk_id"])
    postings = terms.join(chunks.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
    one = postings.groupBy("document_id", "chunk_id").agg(F.first("doc_len").alias("doc_len"))
    return chunks, postings, one.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("doc_len").alias("sum_len"))


@pytest.fixture(scope="module")
def run(spark, corpus):
    asked = [
        (1, "goblin jumps"), (2, "goblin jumps"), (3, "请比较alpha和beta两份报告，它们分别关注“quick onyx goblin”和“five dozen jugs”"), (4, "同时核对gamma这份年报中的两个事项：“vexingly quick daft zebras”和“no such words there”"),
        (5, "核对alpha文件中的表格或清单信息“amount limit为42”"), (6, "zzz unknown"), (7, None), (8, ""),
    ]
    questions = spark.createDataFrame(asked, "query_id long, query_text string")
    members = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (9, 2)], "scope_id long, document_id long")
    scope_of = spark.createDataFrame([(q, 9 if q == 2 else 0) for q, _ in asked], "query_id long, scope_id long")
    vectors = spark.createDataFrame([(q, 3, "c1", 1, 0.9, 1) for q in (1, 3, 6)], "query_id long, document_id long, chunk_id string, chunk_index int, score double, rank int")
    return search.search(questions, members, scope_of, *corpus, vector_hits=vectors)


def of(df, *cols, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scope_comes_before_every_source(run):
    assert {r[0] for r in of(run.hits, "document_id", query_id=2)} == {2}
    assert {r[0] for r in of(run.final, "document_id", query_id=1)} >= {1, 2}


def test_the_first_way_that_finds_something_counts(run):
    ways = lambda q: {(s, w) for s, w in of(run.found, "sub_id", "way", query_id=q, source="indexed_sparse")}
    assert ways(3) == {(0, 1), (1, 1)}  # exact text of both
    assert ways(4) == {(0, 1), (1, 2)} or ways(4) == {(0, 1)}  # the second matter has terms only, if any
    assert ways(5) == {(0, 0)}  # field and value
    assert of(run.found, "chunk_id", query_id=5, source="indexed_sparse") == [("a1",)]  # gamma has the pair too, but the organisation is alpha


def test_vectors_only_where_keywords_are_few(run):
    got = {r[0] for r in of(run.hits, "query_id", source="vector")}
    assert 6 in got and 3 in got  # no keyword hits; sub-queries never skip it
    assert 1 not in got or len(of(run.found.where("query_id = 1").select("chunk_id").distinct(), "chunk_id")) < 4


def test_lists_are_ranked_and_distinct(run):
    rows = run.final.collect()
    for q in {r.query_id for r in rows}:
        own = sorted((r.final_rank, r.chunk_id) for r in rows if r.query_id == q)
        assert [k for k, _ in own] == list(range(1, len(own) + 1)) and len({c for _, c in own}) == len(own)
    assert not {7, 8} & {r.query_id for r in rows}


def test_evaluation_run(spark, run, corpus):
    chunks = corpus[0]
    cases = spark.createDataFrame([(1,), (2,), (6,)], "case_id long")
    markers = spark.createDataFrame([(1, "m1", None, ["onyx goblin jumps"]), (2, "m2", None, ["onyx goblin jumps"]), (6, "m6", None, ["five dozen"])], "case_id long, marker_id string, document_title string, aliases array<string>")
    known = spark.createDataFrame([(1, 1, "alpha reports", True), (2, 1, "alpha reports", False), (2, 2, "beta reports", True), (6, 2, "beta reports", True)], "case_id long, document_id long, title string, visible boolean")
    made = evaluation_run.evaluate(run, cases, markers, known, chunks)
    assert {r.case_id: r.root_cause for r in made.causes.collect()} == {1: "final_hit", 2: "marker_not_found_in_expected_document_chunks", 6: "source_candidate_generation_missed"}
    assert {r.case_id: (r.passed, r.failure_mode) for r in made.cases.collect()} == {1: (True, "passed"), 2: (False, "expected_evidence_missing"), 6: (False, "expected_title_missing")}
    lost = evaluation_run.lost_in(made.hits, "expected_document_chunks", "final")
    assert of(lost, "case_id", "marker_id") == [(6, "m6")]
    curve = {r.stage: r for r in evaluation_run.recall_curve(made.scores).collect()}
    assert curve["final"].cases == 3 and curve["final"].place == 7 and curve["final"].full_evidence == 1


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_exact_hits(spark, corpus, block):
    queries = [(1, "Quick-Onyx goblin"), (2, "five dozen jugs"), (3, "short"), (4, None), (5, "2024年12月31日"), (6, "quick onyx goblin"), (7, "reports the quick")]
    got = retrieval.exact_hits(spark.createDataFrame(queries, "query_id long, query_text string"), corpus[0], block=block)
    assert of(got, "query_id", "chunk_id") == [(1, "a0"), (1, "b0"), (2, "b1"), (6, "a0"), (6, "b0"), (7, "a0"), (7, "b0")]


def test_kept_tables_follow_their_files(spark, tmp_path):
    from siltstone.storage import kept

    folder = str(tmp_path / "t")
    read = lambda: kept(spark, f"{folder}/counted", lambda: spark.read.parquet(f"{folder}/x.parquet").groupBy().count()).first()[0]
    spark.range(3).write.parquet(f"{folder}/x.parquet")
    assert read() == read() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/x.parquet")
    assert read() == 5


# What answers are made from.


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("question", "table", "clause"),
    [
        ("审批链路和处理时限", True, False), ("负责人 是谁，按级别", True, False), ("负责人是谁", False, False), ("第三条的审批和时限", False, True), ("本办法的材料、期限", False, True),
        ("最迟多久应当完成", False, True), ("", False, False), (None, False, False), ("what is the limit", False, False),
    ],
)
def test_kinds_of_questions(spark, question, table, clause):
    assert one(spark, focus.is_table_lookup("q"), q=question) is table
    assert one(spark, focus.is_clause_question("q"), q=question) is clause


def test_focus_terms(spark):
    got = one(spark, focus.focus_terms(F.col("q")), q="什么a审批链路x1yabcdefghi")
    long = "x1yabcdefghi"
    assert got == ["审批链路", *dict.fromkeys(long[i : i + n] for n in (4, 5, 6) for i in range(len(long) - n + 1))]


def test_hints(spark):
    assert one(spark, focus.hints("q"), q='“one  two，” and "three" “x” “one two” "three"') == ["one two", "three"]


ROWS = ["Table row: 工单等级=P1; 首次响应=15分钟", "Table row: 工单等级=P2; 首次响应=1小时", "Table row: 问题类型=高优先级工单; 历史响应时间=20分钟", "Table row: 访问对象=生产环境; 审批链路=甲; 有效期=7天", "Table row: 访问对象=测试环境; 有效期=30天"]


def test_focused_rows(spark):
    text = "\n".join(["说明 生产环境 的 有效期", *ROWS, "无关"])
    asked = {1: "高优先级工单的首次响应时间", 2: "生产环境的有效期和审批", 3: "测试环境 有效期", 4: "zzz"}
    df = spark.createDataFrame([(k, v, f"c{k}", text) for k, v in asked.items()] + [(5, "审批", "c5", "no rows"), (6, "审批", "c6", None)], "query_id long, query_text string, chunk_id string, content string")
    got = {r.query_id: r for r in focus.focused_rows(df.withColumn("section_title", F.lit("标题"))).collect()}
    assert got[1].rows == [ROWS[0], ROWS[2]]  # current, then past
    assert got[2].rows == [ROWS[3]] and got[2].lines == ["说明 生产环境 的 有效期"] and got[2].focused == f"标题\n说明 生产环境 的 有效期\n{ROWS[3]}"  # only rows about production are let in
    assert got[3].rows == [ROWS[3], ROWS[4]]  # both have the field and neither the whole run: ties to the first
    assert got[4].rows == [ROWS[0]]  # nothing fits: the first row
    assert got[5].focused == "no rows" and got[6].focused is None


def greedy(rows, n_hints):
    picked = []
    for k in range(n_hints):
        free = [r for r in rows if r["m"][k] and r not in picked]
        picked += free[:1]
    for r in rows:
        if len(picked) < 5 and r not in picked and sum(p["doc"] == r["doc"] for p in picked) < 2:
            picked.append(r)
    return [r["id"] for r in picked]


def test_focused_chunks(spark):
    r = random.Random(2)
    spans = ["quick brown foxes", "lazy dogs sleeping", "jugs of liquor"]
    rows, expected = [], {}
    for q in range(40):
        n = r.choice([0, 1, 2, 3])
        question = " ".join(f"“{s}”" for s in spans[:n]) or "zz"
        own = []
        for k in range(r.choice([1, 4, 8])):
            held = [r.random() < 0.3 for _ in spans]
            own.append({"id": f"{q}-{k}", "doc": r.randrange(3), "m": [h for h, _ in zip(held, range(n), strict=False)], "fused": round(1 - k / 10, 2), "text": " / ".join(s for s, h in zip(spans, held, strict=True) if h) or "nil"})
        # The terms of spans weigh too; so the order is that of the score.
        terms = {t for s in re.findall("“([^”]*)”", question) for t in grams(s.replace(" ", ""))} if n else set()
        for o in own:
            e = ("t" + o["text"]).replace(" ", "")
            o["score"] = round(o["fused"] + sum(0.08 for t in terms if t in e), 9)
        own.sort(key=lambda o: (-o["score"], -o["fused"]))
        expected[q] = greedy(own, n if n >= 2 else 0)
        rows += [(q, question, int(o["id"].split("-")[1]) + 1, o["id"], o["doc"], "t", o["text"], None, o["fused"], 0.0) for o in own]
    df = spark.createDataFrame(rows, "query_id long, query_text string, position int, chunk_id string, document_id long, document_title string, content string, rerank double, fused double, lexical_norm double").repartition(3)
    got = {}
    for x in focus.focused_chunks(df).orderBy("place").collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    assert got == expected


def grams(t):
    return {t[i : i + n] for n in (4, 5, 6) for i in range(len(t) - n + 1)} if len(t) > 8 else {t}


def test_tables_take_the_place_of_chunks(spark):
    rows = [(1, "审批链路和有效期", k, f"c{k}", 1, "t", text, None, 1.0 - k / 10, 0.0) for k, text in enumerate(["plain", "\n".join(ROWS), ROWS[3], "plain", ROWS[4], ROWS[0]], 1)]
    df = spark.createDataFrame(rows, "query_id long, query_text string, position int, chunk_id string, document_id long, document_title string, content string, rerank double, fused double, lexical_norm double")
    got = focus.focused_chunks(df).orderBy("place").collect()
    assert [(x.chunk_id, x.place) for x in got] == [("c2", 1), ("c3", 2), ("c5", 3)] and got[1].focused == ROWS[3]


def test_chunk_summaries(spark):
    long = "goblin " * 60 + "ends"
    cases = {
        "one two three four five；goblin walks over the hill；short；and another thing is said about goblin；": "goblin walks over the hill。 and another thing is said about goblin。",
        "nothing fits in this first sentence；neither in this other one；": "nothing fits in this first sentence。",
        f"{long}；{long} again；goblin again in a few words；": None,
        "": "", "tiny": "", "A sentence that goes on without any mark at all": "A sentence that goes on without any mark at all。",
    }
    df = spark.createDataFrame([(k, "find a goblin", f"c{k}", t) for k, t in enumerate(cases)] + [(9, "审批链路", "c9", "\n".join(ROWS)), (10, "x", "c10", None)], "query_id long, query_text string, chunk_id string, content string")
    got = {r.query_id: r.summary for r in focus.chunk_summaries(df).collect()}
    for k, wanted in enumerate(cases.values()):
        assert wanted is None or got[k] == wanted, k
    assert got[2].endswith("。 goblin again in a few words。") and len(got[2]) <= 530  # the second long one does not fit and is passed over
    assert got[9].startswith("访问对象=生产环境；审批链路=甲；有效期=7天。") and got[10] == ""


def test_composed_answers(spark):
    rows = [(1, 1, "A", "x", "one。"), (1, 2, "A", "y", "two；"), (2, 1, "A", "x", "one。"), (2, 2, "B", "y", "two"), (3, 1, "A", "x", ""), (4, 1, "A", "x", "a。"), (4, 2, "A", "x", "b。"), (4, 3, "A", "x", "c。"), (4, 4, "A", "x", "d。")]
    got = {r.query_id: r.answer for r in focus.composed_answers(spark.createDataFrame(rows, "query_id long, place int, document_title string, location string, summary string")).collect()}
    lead = "根据当前可访问文档中的证据，"
    assert got == {1: f"{lead}A主要有两点：第一，one；第二，two。", 2: f"{lead}A（x）提到：one；B（y）提到：two。", 3: f"{lead}A包含与该问题相关的说明，建议结合引用片段进一步确认。", 4: f"{lead}A主要有三点：第一，a；第二，b；第三，c。"}


def spans_of(quote, content):
    folded = lambda v: [(i, c) for i, ch in enumerate(v or "") for c in ch.lower().replace("ß", "ss") if c.isalpha() or c.isnumeric()]
    f, q = folded(content), "".join(c for _, c in folded(quote))
    text = "".join(c for _, c in f)
    return [(f[i][0], f[i + len(q) - 1][0] + 1) for i in range(len(text) - len(q) + 1) if q and text[i : i + len(q)] == q]


def test_quote_spans(spark):
    cases = [("aa", "a a-A a"), ("Straße 7", "die STRASSE, 7!"), ("strasse", "eine Straße."), ("日本", "（日 本）日本"), ("", "x"), ("...", "x..."), (None, "x"), ("x", None), ("no", "nein"), ("é", "É é e")]
    df = spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(cases)], "id int, quote string, content string")
    got = {}
    for r in focus.quote_spans(df).collect():
        got.setdefault(r.id, []).append((r.start, r.stop))
    assert {k: sorted(v) for k, v in got.items()} == {i: s for i, (q, c) in enumerate(cases) if (s := spans_of(q, c))}
