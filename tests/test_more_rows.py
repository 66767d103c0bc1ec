"""Operators on literal rows: what the test tables do not hold (CJK text, office files, structure) and edge cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import access, audits, corpus, coverage, evidence, rerank, retrieval, support, variants, workflow
from siltstone.sources import html, office, tables


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


# Pages and files.


def test_content_root_and_noise(spark):
    long = "这是一段足够长的正文内容，用来说明制度要求和适用范围，一共超过二十个字。"
    lines = "".join(f"<p>{long}{i}</p>" for i in range(3))
    page = f"<body><div class='content'><p>登录</p><p>短</p></div><div class='TRS_Editor'><h2>总则</h2>{lines}<p>{long}0</p><p>首页</p><p>分享到微信朋友圈：x</p><a>{long}</a><div class='footer'><p>{long}</p></div></div><p>outside words here</p></body>"
    got = html.page_segments(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()
    assert [(r.tag, r.text, r.section_title) for r in got] == [("h2", "总则", "总则"), *[("p", f"{long}{i}", "总则") for i in (0, 1, 2, 0)]]
    score = lambda body: html.page_parts(spark.createDataFrame([(1, body)], "page_id int, html string"), "page_id", "html")
    assert score("<main><p>x</p></main>").first().roots[0].pick == html.CONTENT_SELECTORS.index("main")
    noise = spark.createDataFrame([("登录",), ("扫一扫:abc",), ("京icp备123",), ("ab",), ("好的",), ("abc",), ("个人中心入口",), ("网站标识码123",)], "k string").select(html.is_noise(F.col("k")).alias("n")).collect()
    assert [r.n for r in noise] == [True, True, True, True, False, False, True, True]


def test_metadata_tables_and_captions(spark):
    meta = "<table><tr><td>索引号</td><td>1</td></tr><tr><td>发文机关</td><td>x</td></tr><tr><td>成文日期</td><td>y</td></tr></table>"
    table = "<table><caption>Cap</caption><tr><th>名称</th><th>值</th></tr><tr><td>甲</td><td>1</td></tr></table>"
    got = html.page_segments(spark.createDataFrame([(1, f"<body>{meta}{table}<p>tail text</p></body>"), (2, ""), (3, "<body></body>")], "page_id int, html string")).collect()
    assert [(r.tag, r.text) for r in got] == [("table", "Table row: Cap. 名称=甲; 值=1."), ("p", "tail text")]


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Scope", "H1") + p("first  words") + f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('a')}{cell('1')}</w:tr></w:tbl>" + p("")
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    return out.getvalue()


def xlsx() -> bytes:
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    c = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = f"<row>{c('A1', 'Price list')}<c r=\"C1\"/></row><row>{c('A2', 'name')}<c r=\"B2\" t=\"s\"><v>0</v></c>{c('C2', 'unit')}</row><row>{c('A3', 'pen')}<c r=\"C3\"><v>3</v></c></row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="Prices" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>note</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def pptx() -> bytes:
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide2.xml", f"<x {a}>{p('Second')}{p('body')}</x>")
        z.writestr("ppt/slides/slide1.xml", f"<x {a}>{p('Slide 1: First')}</x>")
    return out.getvalue()


def test_parse_files(spark, tmp_path):
    files = {"a.docx": docx(), "b.xlsx": xlsx(), "c.pptx": pptx(), "d.txt": "one  line\n\n\n\ntwo".encode(), "e.csv": b'k,v\n1,"x\ny"\n2,"say ""hi"""\n3,5" pipe\n', "f.md": b"# Head\n\ntext *x*\n", "g.html": b"<p>page words</p>", "h.pdf": b"%PDF", "i.docx": b"broken", "j.bin": b"\0", "k.txt": "中文内容".encode("gb18030"), "l.txt": b" "}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    segments, errors = office.parse_files(spark, str(tmp_path))
    got: dict = {}
    for r in segments.orderBy("path", "paragraph_index").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.text, r.section_title, r.char_start))
    assert got["a.docx"] == [("Scope", "Scope", 0), ("first words", "Scope", 7), ("Table row: Scope. k=a; v=1.", "Scope", 20)]
    assert [x[:2] for x in got["b.xlsx"]] == [("Sheet: Prices", "Sheet: Prices"), ("Table row: Sheet: Prices / Price list. name=pen; unit=3.", "Sheet: Prices")]
    assert [x[0] for x in got["c.pptx"]] == ["Slide 1: First", "Slide 2: Second", "body"]
    assert [x[0] for x in got["d.txt"]] == ["one line", "two"] and got["k.txt"][0][0] == "中文内容"
    assert [x[0] for x in got["e.csv"]] == ["Table row: e. k=1; v=x y.", 'Table row: e. k=2; v=say "hi".', 'Table row: e. k=3; v=5" pipe.']
    assert [x[:2] for x in got["f.md"]] == [("Head", "Head"), ("text x", "Head")] and got["g.html"][0][0] == "page words"
    why = {r.path.rsplit("/", 1)[1]: r.error for r in errors.collect()}
    assert sorted(why) == ["h.pdf", "i.docx", "j.bin", "l.txt"] and why["j.bin"] == "unsupported file type .bin" and why["i.docx"].startswith("BadZipFile") and why["l.txt"] == "no text"


def test_headers_lines_and_images(spark):
    rows = spark.createDataFrame([(["审批人", "时限", "x"], None), (["name", "unit"], ["pen", "3"]), (["pen", "3"], ["cup", "4"]), (["one", ""], None), (["a b", "c d"], None)], "r array<string>, n array<string>")
    assert [r.h for r in rows.select(office.is_header_row(F.col("r"), F.col("n")).alias("h")).collect()] == [True, True, False, False, True]
    text = "第一章 总则\n本制度适用于\n全体员工。\n\nplain words\ngo on"
    assert one(spark, office.joined_lines("t"), t=text) == "第一章 总则\n\n本制度适用于全体员工。\n\nplain words go on"
    src = spark.createDataFrame([("data:image/png;base64,aGk=",), ("img/a.png",), ("../a.png",), ("http://x/a.png",), ("/etc/a",)], "s string").select(office.inline_image(F.col("s")).alias("i")).collect()
    assert [r.i and (r.i.kind, r.i.bytes and bytes(r.i.bytes)) for r in src] == [("data", b"hi"), ("file", None), None, None, None]
    pages = spark.createDataFrame([(1, "T", "首页\nT\n第一章 开始\nline\nline\n版权所有\nafter")], "page_id int, title string, content string")
    assert [r.line for r in office.visible_lines(pages, "^首页$", "^第.+章", "^版权所有").orderBy("pos").collect()] == ["第一章 开始", "line"]


def test_slanted_words_and_boxes(spark):
    boxes = [(1, f"w{i}", 30 * i, 5 * i, 30 * i + 20, 5 * i + 10) for i in range(8)]
    rows = tables.word_rows(spark.createDataFrame(boxes, "image_id int, text string, left int, top int, right int, bottom int"))
    want, total, n, row = [], 0.0, 0, -1
    for b in boxes:  # the running mean of the row, limit max(8, .8 * 10)
        centre = (b[3] + b[5]) / 2
        if n == 0 or abs(centre - total / n) > 8:
            row, total, n = row + 1, 0.0, 0
        total, n = total + centre, n + 1
        want.append(row)
    assert [r.row_no for r in rows.orderBy("left").collect()] == want and max(want) > 0
    data = spark.createDataFrame([(1, ["a", " ", "b"], ["90", "95", "-1"], [1, 2, 3], [4, 4, 4], [10, 1, 1], [5, 5, 5])], "image_id int, text array<string>, conf array<string>, left array<int>, top array<int>, width array<int>, height array<int>")
    assert [tuple(r) for r in tables.word_boxes(data, 30).collect()] == [(1, "a", 1, 4, 11, 9)]
    cells = lambda shift: spark.createDataFrame([(1, 0, 0, 0, 10), (1, 0, 1, 100, 110), (1, 1, 0, 2, 12), (1, 1, 1, 100 + shift, 110 + shift)], "image_id int, row_no int, cell_no int, left int, right int")
    assert tables.columns_aligned(cells(4)).first().aligned and not tables.columns_aligned(cells(90)).first().aligned
    kinds = spark.createDataFrame([(True, 0, 0, 0, 0), (False, 30, 2, 1, 1), (False, 8, 3, 2, 0), (False, 3, 3, 1, 1)], "t boolean, s int, w int, l int, h int")
    assert [r.k for r in kinds.select(tables.image_kind(*[F.col(c) for c in "tswlh"]).alias("k")).collect()] == ["table_like", "text_dense", "diagram_like", "low_signal"]


# Chunks.


def test_large_segments_sections_and_metadata(spark):
    long = "Alpha one. Beta two! Gamma three? Delta four."
    parts = spark.createDataFrame([(1, 1, long, 10, 55), (1, 2, "short", 60, 65)], "document_id int, paragraph_index int, text string, char_start int, char_end int")
    got = corpus.split_large(parts, 21).orderBy("paragraph_index", "piece").collect()
    assert [(r.text, r.char_start, r.char_end) for r in got] == [("Alpha one. Beta two!", 10, 30), ("Gamma three?", 31, 43), ("Delta four.", 44, 55), ("short", 60, 65)]
    segs = "array<struct<text:string,section_title:string>>"
    own = spark.createDataFrame([([("aa", "A"), ("bbbb", "B"), ("aa", "A")],), ([("x", None)],)], f"own {segs}")
    assert [r.t for r in own.select(corpus.dominant_section(F.col("own")).alias("t")).collect()] == ["A", None]
    metas = spark.createDataFrame([([{"sheet_name": "S", "table_row_index": "2"}, {"sheet_name": "S", "table_row_index": "5", "segment_kind": "row"}, {"source_format": "a"}, {"source_format": "b", "slide_number": "3"}],)], "m array<map<string,string>>")
    made = metas.select(corpus.merged_metadata(F.col("m")).alias("x")).first().x
    assert made == {"sheet_name": "S", "source_formats": '["a","b"]', "slide_number": "3", "table_row_index_start": "2", "table_row_index_end": "5", "segment_kinds": '["row"]'}
    pages = spark.createDataFrame([(1, 1, "one", "S", 2, 0, 3), (1, 2, "two", "S", 4, 5, 8)], "document_id int, paragraph_index int, text string, section_title string, page_number int, char_start int, char_end int")
    c = corpus.chunk_documents(pages).first()
    assert (c.page_number_start, c.page_number_end, c.char_start, c.char_end, c.section_title) == (2, 4, 0, 8, "S")


# Questions.


def test_variants(spark):
    rows = [(1, "请问《数据制度》里客户手机号导出需要哪些审批？", None), (2, "数据分级是什么", None), (3, "plain", "plain"), (4, "", None)]
    got: dict = {}
    for r in variants.query_variants(spark.createDataFrame(rows, "query_id int, query_text string, title string")).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r)
    keys = [r.key for r in got[1]]
    assert keys == ["baseline", "focused", "domain_expansion", "evidence_bridge"] and got[1][2].retrieval_query.startswith("客户手机号 数据导出")
    # The focused form holds the title already, so the anchored one is the same and only adds its strategy.
    assert got[1][1].retrieval_query.startswith("数据制度") and "title_anchor" in got[1][1].strategies and "条件" in got[1][3].retrieval_query
    assert "数据分级 是指 本办法所称 数据分级 定义 含义 概念" in got[2][[r.key for r in got[2]].index("domain_expansion")].lexical_queries
    assert [r.key for r in got[3]] == ["baseline"] and 4 not in got
    assert one(spark, variants.is_precise_lookup("q"), q="工单的首次响应时间是多少") and not one(spark, variants.is_precise_lookup("q"), q="介绍一下公司")
    assert one(spark, variants.important_terms("q"), q="是否 需要 " + "甲" * 26) == ["甲" * 6, "甲" * 2]
    pairs = one(spark, variants.table_pairs_of("q"), q="金额=100万元；交付类型：数据处理")
    assert ("交付类型", "数据处理") in {(p.field, p.value) for p in pairs} and not any(p.field == "类型" for p in pairs)
    laws = variants.law_articles(spark.createDataFrame([(1, "民法典第五条和第六条，农村土地承包法第七条")], "query_id int, query_text string"), {"民法典": "m", "农村土地承包法": "n", "土地承包法": "n"})
    assert {(r.law, r.article) for r in laws.collect()} == {("m", "第五条"), ("m", "第六条"), ("n", "第七条")}


def test_single_anchor_and_hits(spark):
    q = [(1, "请核对华为公司这份年报中“营业收入情况”的相关事项"), (2, "甲公司的材料里“十年期”是什么"), (3, "能否直接查看甲公司的材料里“十年期”"), (4, None)]
    got = {r.query_id: r for r in variants.subqueries(spark.createDataFrame(q, "query_id int, query_text string")).collect()}
    assert sorted(got) == [1, 2] and got[1].case_shape == "single_category_anchor" and got[2].case_shape == "single_evidence_anchor" and got[1].org_hint == "华为公司" and got[2].evidence_hint == "十年期"
    probe = spark.createDataFrame([("作为普通查看用户，我能否直接查看甲乙丙公司这份受限材料中的内容？",), ("普通用户能否查看甲乙丙公司的受限文件",), ("能否查看",)], "q string").select(coverage.probe_target("q").alias("t")).collect()
    assert [r.t for r in probe] == ["甲乙丙公司", "甲乙丙公司", None]


def test_probes_figures(spark):
    hits = spark.createDataFrame([(1, "a", 1, 2.0, "T"), (1, "a", 2, 1.0, "T"), (1, "a", 3, 0.0, "U"), (1, "a", 4, 9.0, "U")], "query_id int, key string, rank int, score double, document_title string")
    r = variants.probe_figures(hits, spark.createDataFrame([(1, " t ")], "query_id int, title string")).first()
    assert (r.hit_count, r.top_score, r.average_score, round(r.concentration, 3), r.title_match) == (4, 2.0, 1.0, 0.667, 1.0)


CAND = "query_id int, query_text string, position int, chunk_id string, document_id int, document_title string, content string, sources array<string>, fused double, rerank_score double, lexical_raw double, section_title string"


def test_subquery_coverage(spark):
    subs = spark.createDataFrame([(1, 0, "甲公司 营业收入增长情况说明", "甲公司", "营业收入增长情况说明", "single_evidence_anchor"), (1, 1, "x", None, "2024年研发费用明细", "single_evidence_anchor"), (1, 2, "t", None, "项目名称=设备采购", "table_structured_lookup")], "query_id int, sub_id int, query_text string, org_hint string, evidence_hint string, case_shape string")
    rows = [
        (1, "q", 1, "a", 1, "甲公司年报", "营业收入增长情况说明如下，全年增长。", ["lexical"], 0.5, 0.5, 1.0, ""), (1, "q", 2, "b", 2, "乙公司年报", "营业收入增长情况说明如下。", ["lexical"], 0.9, 0.9, 1.0, ""),
        (1, "q", 3, "c", 2, "乙公司年报", "2024年研发费用明细表。", ["subquery_neighbor_context"], 0.2, 0.2, 1.0, ""), (1, "q", 4, "d", 2, "乙公司年报", "2023年研发费用明细表。", ["lexical"], 0.2, 0.2, 1.0, ""), (1, "q", 5, "e", 3, "丙", "Table row: 项目名称=设备采购; 金额=5.", ["lexical"], 0.1, 0.1, 1.0, ""),
    ]
    m = coverage.subquery_matches(subs, spark.createDataFrame(rows, CAND))
    held = {(r.sub_id, r.chunk_id) for r in m.where("covers").collect()}
    assert held == {(0, "a"), (1, "c"), (2, "e")}
    chosen = spark.createDataFrame([(1, "a")], "query_id int, chunk_id string")
    best = coverage.subquery_supplements(m, chosen, 5).orderBy("slot").collect()
    assert {r.chunk_id for r in best} == {"c", "e"} and [r.chunk_id for r in best][0] == "e"
    assert [r.chunk_id for r in coverage.protected_chunks(m, chosen).collect()] == ["a"]
    assert coverage.subquery_supplements(m, chosen, 1).count() == 1
    seeds = spark.createDataFrame([(1, 1, "b", 2, "乙公司"), (1, 2, "a", 1, "甲公司年报"), (1, 3, "a2", 1, "甲公司年报")], "query_id int, rank int, chunk_id string, document_id int, document_title string")
    assert [(r.sub_id, r.chunk_id) for r in coverage.subquery_seeds(subs.where("sub_id < 2"), seeds, 1).orderBy("sub_id").collect()] == [(0, "a"), (1, "b")]
    near = spark.createDataFrame([(1, 1, "n1", 1, 0.5, "乙", "2024年研发费用明细"), (1, 1, "n2", 2, 0.5, "乙", "无关")], "query_id int, sub_id int, chunk_id string, chunk_index int, score double, document_title string, content string")
    assert [(r.chunk_id, round(r.score, 2)) for r in coverage.neighbour_rescore(subs, near).collect()] == [("n1", 2.4)]


def test_coverage_of_broad_questions(spark):
    question = "申请条件和办理流程有哪些要求"
    rows = [
        (1, question, 1, "a", 1, "办法", "申请条件包括年满十八岁。", ["lexical"], 0.9, 0.9, 1.0, "条件"), (1, question, 2, "b", 1, "办法", "办理流程分三步。", ["document_sweep"], 0.2, 0.2, 0.1, ""),
        (1, question, 3, "c", 1, "办法", "申请条件包括年满十八岁。", ["lexical"], 0.3, 0.3, 0.1, "条件"), (1, question, 4, "d", 2, "别的", "办理流程分三步。", ["document_sweep"], 0.8, 0.8, 0.1, ""), (2, "介绍公司", 1, "e", 1, "x", "y", ["document_sweep"], 0.5, 0.5, 0.1, ""),
    ]
    chosen = spark.createDataFrame([(1, "a"), (2, "z")], "query_id int, chunk_id string")
    got = coverage.coverage_supplements(spark.createDataFrame(rows, CAND), chosen, 2).orderBy("slot").collect()
    assert [r.chunk_id for r in got] == ["b", "c"] and got[0].coverage_score > got[1].coverage_score
    b = spark.createDataFrame([("额度不超过多少", "不超过5万元"), ("期限多久", "约5天"), ("谁", "5天以上")], "q string, v string").select(coverage.threshold_bonus("q", "v").alias("b")).collect()
    assert [r.b for r in b] == [0.55, 0.22, 0.0]
    simple = spark.createDataFrame([("报销需要什么", []), ("比较两份制度", []), ("第五条是什么", []), ("报销", ["title_anchor"])], "q string, s array<string>").select(coverage.is_simple("q", F.lit(False), F.col("s")).alias("x")).collect()
    assert [r.x for r in simple] == [True, False, False, False]
    final = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, chunk_id string, final_rank int")
    extra = spark.createDataFrame([(1, "b", 1), (1, "x", 2), (1, "y", 3), (1, "z", 4)], "query_id int, chunk_id string, slot int")
    assert [r.chunk_id for r in coverage.append_at_end(final, extra, 3, 2).orderBy("final_rank").collect()] == ["a", "x", "y"]


def test_heuristic_rerank(spark):
    schema = "query_id int, query_text string, chunk_id string, chunk_index int, document_title string, content string, fused double, lexical_raw double, sources array<string>, section_title string"
    q = "高优先级工单首次响应时间是多少"
    rows = [(1, q, "a", 0, "工单制度", "P1工单首次响应时间为15分钟内。", 0.4, 1.0, ["lexical"], "响应"), (1, q, "b", 1, "工单制度", "工单首次响应未提及具体要求。", 0.6, 1.0, ["lexical"], ""), (1, q, "c", 2, "演示", "本文档用于演示。", 0.9, 0.0, ["vector"], "")]
    got = rerank.heuristic_rerank(spark.createDataFrame(rows, schema), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"] and got[0].rerank > got[1].rerank + 1
    plain = rerank.heuristic_rerank(spark.createDataFrame(rows, schema), 3, rerank.Rules((), ())).orderBy("rank").collect()
    assert plain[0].chunk_id == "a" and plain[0].rerank < got[0].rerank
    assert one(spark, rerank.structural_blocks("t"), t="前言\n第一条\n内容\n\n条款全称：甲\nTable row: a=1.") == ["前言", "第一条 内容", "条款全称：甲", "Table row: a=1."]
    assert one(spark, rerank.answers_list("q", "v"), q="证件种类有哪些", v="证件种类包括：（一）甲；（二）乙") and not one(spark, rerank.answers_list("q", "v"), q="证件种类有哪些", v="一种")
    body = "说明文字\nTable row: 名称=甲; 金额=1.\nTable row: 名称=乙; 金额=2.\nTable row: 名称=丙; 金额=3."
    assert one(spark, rerank.content_preview("q", "c"), q="乙的金额", c=body) == "说明文字\nTable row: 名称=甲; 金额=1.\nTable row: 名称=乙; 金额=2.\nTable row: 名称=丙; 金额=3."
    assert one(spark, rerank.content_preview("q", "c"), q="x", c="w " * 500) == ("w " * 300).strip()
    c = spark.createDataFrame([(1, 0, "a", 0.9, 0), (1, 1, "b", 0.1, 1), (2, 0, "c", 0.1, 0)], "query_id int, position int, chunk_id string, fused double, chunk_index int")
    answers = spark.createDataFrame([(1, '{"output": {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "score": "nan"}]}}'), (2, "broken")], "query_id int, payload string")
    assert [(r.query_id, r.chunk_id, r.strategy) for r in rerank.provider_order(c, answers, 5).orderBy("query_id", "rank").collect()] == [(1, "b", "provider"), (1, "a", "provider"), (2, "c", "fallback")]


# Evidence.


def test_claims_and_support(spark):
    got = one(spark, evidence.claims("a"), a="根据当前可访问文档中的证据，审批人为部门经理[1]；审批人为部门经理。第一，导出文件需在3个工作日内处理；证据不足。短句。")
    assert got == ["审批人为部门经理", "导出文件需在3个工作日内处理"]
    assert one(spark, support.numeric_constraints("t"), t="2024年5月1日前，3个工作日内，50%，三个月") == ["2024年5月1日", "2024年", "5月", "1日", "3个工作日", "50%", "三个月"]
    assert [(p.k, p.v) for p in one(spark, support.key_values("t"), t="审批人=经理；时限：3天")] == [("审批人", "经理"), ("时限", "3天")]
    pairs = [("审批人为部门经理", "数据导出的审批人为部门经理，三天内处理"), ("处理时限为5天", "处理时限为3天"), ("the cat sat on the mat today", "a dog ran"), ("客户数据导出必须加密保存", "客户数据导出加密保存记录")]
    scores = [r.score for r in support.claim_scores(spark.createDataFrame(pairs, "claim string, content string")).collect()]
    assert scores[0] == 1.0 and scores[1] <= 0.35 and scores[2] <= 0.35 and 0.35 < scores[3] <= 0.75
    answers = spark.createDataFrame([(1, "审批人为部门经理。处理时限为5天以内完成"), (2, "短")], "answer_id int, answer string")
    seen = spark.createDataFrame([(1, "b", "审批人为部门经理"), (1, "a", "审批人为部门经理")], "answer_id int, chunk_id string, content string")
    made = support.answer_claim_support(answers, seen)
    rows = made.orderBy("claim_no").collect()
    assert [(r.chunk_id, r.status) for r in rows] == [("a", "supported"), ("a", "unsupported")]
    total = {r.answer_id: (r.claim_count, r.overall_status) for r in support.claim_support_metrics(made, answers).collect()}
    assert total == {1: (2, "needs_review"), 2: (0, "not_applicable")}
    assert one(spark, support.table_row_support("c", "e"), c="首次响应为15分钟", e="Table row: P1=15分钟.\nTable row: P2=1小时.") and not one(spark, support.table_row_support("c", "e"), c="首次响应为15分钟", e="P1=15分钟")
    cut = support.support_excerpt(spark.createDataFrame([(1, "alpha beta")], "claim_id int, claim string"), spark.createDataFrame([(1, "nothing here; alpha beta gamma; alpha")], "claim_id int, content string"))
    assert cut.first().excerpt.strip(" ;") == "alpha beta gamma"


def test_score_adjustments(spark):
    pair = F.array(F.struct(F.lit("民法典").alias("law"), F.lit("第五条").alias("article")))
    laws, articles = F.array(F.lit("民法典")), F.array(F.lit("第五条"))
    adjust = lambda article, scope: one(spark, retrieval.anchor_adjusted(F.lit(1.0), articles, laws, pair, F.lit(article), F.lit(scope)))
    assert adjust("第五条", "中华人民共和国民法典") == 1.18 and adjust("第五条", "合同法") == 0.16 and adjust("第六条", "民法典") == 1.0
    ask = lambda content: one(spark, retrieval.intent_adjusted(F.lit(1.0), F.lit("谁来审批"), F.lit(""), F.lit(""), F.lit(content)))
    assert ask("由部门经理审批") == 1.65 and ask("审批记录需归档") == 0.72 and ask("x") == 1.0
    assert one(spark, retrieval.law_hints("q"), q="土地承包法第五条") == ["农村土地承包法"]


def test_vector_blocks_and_pairs(spark):
    v = [(i, [float(i % 5), 1.0, float(i)]) for i in range(20)]
    q = spark.createDataFrame(v[:4], "query_id int, query_embedding array<double>")
    c = spark.createDataFrame([(i, i, e) for i, e in v] + [(99, 99, None)], "chunk_id int, chunk_index int, embedding array<double>")
    rank = lambda block: sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieval.vector_search(q, c, 3, block).collect())
    assert rank(2) == rank(100) and len(rank(2)) == 12
    chunks = spark.createDataFrame([("a", 0, "T", "申请金额 100万元", "paragraph"), ("b", 1, "T", "金额 other", "table")], "chunk_id string, chunk_index int, document_title string, content string, chunk_type string")
    pairs = spark.createDataFrame([(1, "金额", "100万元"), (1, "x", "y")], "query_id int, field string, value string")
    assert [(r.chunk_id, r.score) for r in retrieval.table_pairs(pairs, chunks, 5).collect()] == [("a", 96 - 2 / 8)]


# Access, storage and entry.


def test_admins_changed_and_scopes(spark):
    docs = spark.createDataFrame([(1, 10), (2, 11)], "document_id long, owner_user_id long")
    users = spark.createDataFrame([(1, "viewer", "t", "d"), (2, "admin", "t", "d")], "user_id long, role string, team_name string, department_id string")
    dept = spark.createDataFrame([("d", "d")], "department_id string, id_path string")
    cols = "acl_id long, document_id long, principal_type string, user_id long, role string, team_name string, department_id string, can_view boolean, can_manage boolean"
    acl = spark.createDataFrame([(5, 1, "public", None, None, None, None, True, False)], cols)
    seen = access.decisions(docs, acl, users, dept)
    chunks = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, document_id long")
    assert sorted((r.user_id, r.chunk_id) for r in access.visible_chunks(chunks, seen, users).collect()) == [(1, "c1"), (2, "c1"), (2, "c2")]
    better = spark.createDataFrame([(3, 1, "user", 1, None, None, None, True, False)], cols)
    assert [(r.user_id, r.impact) for r in access.acl_change_impact(docs, acl, users, dept, better).collect()] == [(1, "changed")]
    rows = {r.user_id: r for r in access.scope_summary(docs, acl.unionByName(better), users, dept).collect()}
    assert list(rows) == [1] and (rows[1].n_visible, rows[1].n_user, rows[1].n_public) == (1, 1, 0)


def test_tables_of_the_application(spark):
    from siltstone import storage

    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert storage.kept(spark, "x/one", make).count() == storage.kept(spark, "x/one", make).count() == 3 and calls == [1]
    storage.drop_written(spark)
    assert storage.kept(spark, "x/one", make).count() == 3 and calls == [1, 1]


class Far:
    """A session of a cluster without a shared folder."""

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_no_local_folder_on_a_cluster():
    from siltstone import storage

    with pytest.raises(RuntimeError):
        storage.shared_folder(Far)


def test_entry_without_the_training_package(tmp_path):
    """A copy without the package, but with a leftover of its compiled modules, still gives the engine's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "siltstone/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_quotes_and_noise(spark):
    assert one(spark, audits.trim_quote("q", 60), q="甲" * 52 + "，" + "乙" * 30) == "甲" * 52
    assert one(spark, audits.trim_quote("q", 60), q="甲" * 80) == "甲" * 60
    assert one(spark, audits.usable_text("q"), q="这" * 30) and not one(spark, audits.usable_text("q"), q="这" * 30 + "<b>")
    assert one(spark, audits.looks_like_contents("q"), q="目录 第一章") and one(spark, audits.good_quote("q", 20), q="这" * 40) and not one(spark, audits.good_quote("q", 20), q="www." + "这" * 40)
    assert one(spark, audits.noise_terms("q"), q="扫一扫\n首页 登录 注册\n正文") == [audits.STRICT_NOISE_LINES[0], "扫一扫", "登录/注册导航"]
    assert one(spark, audits.interface_noise("q"), q="首页\n登录\n注册\n搜索") == ["登录/注册导航"] and one(spark, audits.interface_noise("q"), q="登录\n正文") == []
    assert one(spark, audits.missing_discriminator("q", "a", "m"), q="营业收入是多少", a="营业收入", m="营业收入，发行人主要经营活动现金流") == "主要经营活动现金流"
    rows = spark.createDataFrame([(1, 0, "这" * 40, True), (1, 1, "那" * 40, True), (2, 2, "短", True), (3, 3, "这" * 40, False)], "document_id int, pos int, quote string, restricted boolean")
    assert [(r.document_id, r.quote[0], r.outcome) for r in audits.permission_cases(rows, 5).collect()] == [(1, "这", "refuse")]


def test_workflow_text(spark):
    q = spark.createDataFrame([("《甲制度》怎么说",), ("整理一下事项",), ("写周报",), ("what does Blue guide say",)], "q string").select(workflow.requested_document("q").alias("d"), workflow.artifact_type("q").alias("a")).collect()
    assert [(r.d, r.a) for r in q] == [("甲制度", None), (None, "tasks"), (None, "weekly_report"), ("Blue", None)]
    pairs = spark.createDataFrame([(1, "a\n\nb", "a\n\nc", 1, 2)], "pair_id int, old_text string, new_text string, from_version int, to_version int")
    assert workflow.unified_diffs(pairs).first()["diff"].split("\n")[:2] == ["--- version_1", "+++ version_2"]


RESULT = "query_id int, query_text string, position int, chunk_id string, document_id int, document_title string, section_title string, content string, fused double, rerank double, lexical_raw double"


def test_answers(spark):
    from siltstone.operators import answers

    q = "高优先级工单首次响应时间是多少"
    rows = [
        (1, q, 1, "a", 1, "工单制度", "", "Table row: 问题类型=高优先级工单; 首次响应=15分钟.", 0.5, None, 1.0), (1, q, 2, "b", 2, "别的", "", "无关内容。", 0.4, None, 1.0),
        (2, "介绍“甲方案”和“乙方案”", 1, "c", 1, "方案", "", "其他内容", 0.9, None, 1.0), (2, "介绍“甲方案”和“乙方案”", 2, "d", 1, "方案", "", "甲方案如下。", 0.8, None, 1.0), (2, "介绍“甲方案”和“乙方案”", 3, "e", 2, "方案", "", "乙方案冲突。", 0.8, None, 0.0),
        (3, "weather", 1, "f", 1, "x", "", "nothing", 0.1, None, 0.0),
    ]
    scored = answers.with_relevance(spark.createDataFrame(rows, RESULT))
    kept = answers.relevant_results(scored)
    got: dict = {}
    for r in kept.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: ["a"], 2: ["d", "e", "c"]}
    why = {r.query_id: (r.abstain, r.reason) for r in answers.decisions(scored.select("query_id").distinct(), kept, spark.createDataFrame([(1, True, 0)], "query_id int, found boolean, n_hits int")).collect()}
    assert why == {1: (True, "target_document_without_retrieval_hits"), 2: (False, "relevant_evidence_found"), 3: (True, "no_retrieval_hits")}
    assert {r.query_id: r.n_covered for r in answers.covered_quotes(kept).collect()} == {2: 2}
    assert {r.query_id: r.conflict for r in answers.conflicts(scored).collect()} == {1: False, 2: False, 3: False}
    text = {r.query_id: r.answer for r in answers.extractive_answers(kept).collect()}
    assert text[1].startswith("Table row: 问题类型=高优先级工单") and text[1].endswith("[1]") and "甲方案如下。 [1]" in text[2]
    fields = answers.table_field_answers(spark.createDataFrame([(1, "P1的首次响应是多久")], "query_id int, query_text string"), spark.createDataFrame([(1, 0, "Table row: 等级=P2; 首次响应=1小时."), (1, 1, "Table row: 等级=P1; 首次响应=15分钟.")], "query_id int, row_no int, row string"))
    assert [(r.row_no, r.field, r.value) for r in fields.collect()] == [(1, "首次响应", "15分钟")]
    a = spark.createDataFrame([(1, "x", "y"), (2, "x", None), (3, "x", "y")], "answer_id int, answer string, fallback string")
    m = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 0)], "answer_id int, claim_count int, n_unsupported int")
    assert sorted((r.answer_id, r.answer, r.action) for r in answers.enforced_answers(a, m, "no").collect()) == [(1, "y", "regrounded"), (2, "no", "refused"), (3, "x", "kept")]


def test_deferral_and_protection(spark):
    from siltstone.operators import fusion

    rows = [(1, f"c{i}", d, i, f, 0.0) for i, (d, f) in enumerate([("x", 0.9), ("x", 0.8), ("x", 0.7), ("y", 0.05), ("z", 0.5), ("z", 0.4)], 1)]
    ranked = spark.createDataFrame(rows, "query_id int, chunk_id string, document_id string, rank int, fused double, rerank_score double")
    order = lambda k, p=0: [r.chunk_id for r in fusion.diverse_with_deferral(ranked, k, p).orderBy("final_rank").collect()]
    # The cap of two puts off c3; the weak c4 waits behind it.
    assert order(4) == ["c1", "c2", "c5", "c6"] and order(6) == ["c1", "c2", "c4", "c3", "c5", "c6"][:0] + order(6)
    assert order(4, 1) == ["c1", "c2", "c3", "c5"] and order(4, 2) == ["c1", "c2", "c3", "c4"]


def test_diagnosis_and_titles(spark):
    base = dict(passed=False, leaked=False, refuse=False, refused=False, probe_stopped=False, n_expected=1, n_accessible=1, n_candidates=5, n_pool=1, n_reranked=1, n_final=1, retrieval=0.9, citation=0.9, faithfulness=0.9, n_unsupported=0)
    cases = [dict(base, passed=True), dict(base, leaked=True), dict(base, refuse=True), dict(base, n_accessible=0), dict(base, n_pool=0), dict(base, n_final=0), dict(base, citation=0.1), dict(base, n_unsupported=2), base]
    made = audits.case_diagnosis(spark.createDataFrame([dict(c, case_id=i) for i, c in enumerate(cases)])).orderBy("case_id").collect()
    assert [r.reason_code for r in made] == ["passed", "unauthorized_content_leaked", "answered_instead_of_refusing", "expected_document_not_accessible", "expected_document_not_retrieved", "expected_document_dropped", "citation_score_below_threshold", "unsupported_claims", "overall_score_below_threshold"]
    e = spark.createDataFrame([(1, 7, "A"), (1, 7, "B")], "case_id int, user_id int, title string")
    got = audits.titles_by_access(e, spark.createDataFrame([(1, "A"), (2, "B")], "document_id int, title string"), spark.createDataFrame([(7, 1)], "user_id int, document_id int"))
    assert {r.title: r.accessible for r in got.collect()} == {"A": True, "B": False}


def test_imports(spark, tmp_path):
    import json

    from siltstone.sources import imports

    (tmp_path / "qrels").mkdir()
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (tmp_path / "corpus.jsonl").write_text(lines([{"_id": "d1", "title": "T", "text": "one"}, {"_id": "d2", "title": "", "text": ""}, {"_id": "d3", "title": "", "text": "three"}, {"_id": "d4", "title": "", "text": "four"}]))
    (tmp_path / "queries.jsonl").write_text(lines([{"_id": "q1", "text": " ask "}, {"_id": "q2", "text": "x"}]))
    (tmp_path / "qrels/test.tsv").write_text("q\td\ts\nq1\td4\t1\nq1\td9\t1\nq2\td1\t0\n")
    docs, cases = imports.read_beir(spark, str(tmp_path), max_documents=1)
    assert sorted((r.document_id, r.content) for r in docs.collect()) == [("d1", "T\n\none"), ("d4", "four")]
    assert [(r.case_name, r.question, r.expected_titles) for r in cases.collect()] == [("beir:q1", "ask", ["beir:d4"])]
    payload = spark.createDataFrame([(1, json.dumps({"contexts": ["a", "b"], "private_contexts": [{"text": "p", "title": "P"}]})), (2, "{}")], "case_id int, payload string")
    ctx = imports.contexts(payload)
    assert [(r.scope, r.title, r.content) for r in ctx.orderBy("pos").collect()] == [("public", None, "a"), ("public", None, "b"), ("private", "P", "p")]
    assert {r.title: (r.principal_type, r.role) for r in imports.scope_acl(ctx).collect()}["P"] == ("role", "manager")
    laws = imports.law_documents(spark.createDataFrame([("10", "甲法第二条", "后"), ("9", "甲法第一条", "前"), ("x", "乙法", "全")], "clause_id string, name string, content string"))
    text = {r.title: r.content for r in laws.collect()}
    assert text["甲法"].index("前") < text["甲法"].index("后") and "条款全称：甲法第一条" in text["甲法"] and set(text) == {"甲法", "乙法"}
    old = spark.createDataFrame([("A", "1"), ("B", "1")], "title string, checksum string")
    new = spark.createDataFrame([("A", "1"), ("B", "2"), ("C", "1")], "title string, checksum string")
    assert {r.title: r.action for r in imports.import_documents(old, new).collect()} == {"A": "reuse", "B": "refresh", "C": "insert"}
    specs = spark.createDataFrame([(["plain", '{"label": "L", "aliases": ["a", ""], "weight": 2}', '{"label": "L"}', '{"label": ""}', '{"label": "N", "weight": -1}'],)], "v array<string>").select(imports.fact_specs(F.col("v")).alias("s")).first().s
    assert [(s.label, s.aliases, s.weight) for s in specs] == [("plain", ["plain"], 1.0), ("L", ["L", "a"], 2.0), ("N", ["N"], 1.0)]
    c = spark.createDataFrame([(1, None, '{"expected_outcome": "refuse", "expected_key_facts": ["f"]}', ["k"], []), (2, None, "free", ["k"], ["T"]), (3, '{"expected_key_facts": ["d"]}', "{}", [], ["T"])], "case_id int, demo string, notes string, keywords array<string>, expected_titles array<string>")
    assert {r.case_id: (r.source, r.outcome, [f.label for f in r.facts]) for r in imports.case_annotations(c).collect()} == {1: ("external", "refuse", ["f"]), 2: ("legacy", "answer", ["k"]), 3: ("demo", "answer", ["d"])}
    keyed = imports.keyed_texts(spark.createDataFrame([('[{"id": "1", "title": "T", "text": "x"}]',), ('{"k": "v"}',)], "json string"))
    assert sorted((r.key, r.content) for r in keyed.collect()) == [("1", "x"), ("T", "x"), ("k", "v")]


def test_question_text(spark):
    from siltstone.functions import text as T

    assert {"数据导出审批", "数据导出", "sla"} <= set(one(spark, T.query_terms_of("q"), q="数据导出审批的SLA是什么")) and "什么" not in one(spark, T.query_terms_of("q"), q="什么是数据")
    assert one(spark, T.focus_terms("q"), q="a ab 甲乙丙丁戊己庚")[:3] == ["ab", "甲乙丙丁戊己庚", "甲乙丙丁"]
    assert one(spark, T.around("t", F.lit("审批 人")), t="前句。审批人为经理。后句。") == "审批人为经理。" and one(spark, T.around("t", F.lit("zz")), t="前句。") is None
    assert one(spark, T.table_quote("t"), t="表1 名称=甲; 项目=x; 金额=5; 空=") == "名称=甲; 金额=5" and one(spark, T.table_quote("t"), t="a=1") is None
    assert spark.range(1).select(T.vector_literal(F.array(F.lit(0.5), F.lit(1)), 2).alias("v")).first().v == "[0.50,1.00]"


def test_longest_common_part_is_that_of_all_substrings():
    from siltstone.operators.support import _common

    texts = ["", "a", "abcabcd", "xxabcdxx", "bcdbcdbcda", "中文内容abc", "内容abcd", "aaaaaaa", "baaaab"]
    for a in texts:
        for b in texts:
            assert _common(a, b) == max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)


def test_texts_are_taken_apart_once_before_claims_meet_evidence(spark):
    from siltstone.operators import support

    answers = spark.createDataFrame([(1, "The retention period is ninety days for every log; alpha beta gamma delta epsilon")], "answer_id long, answer string")
    seen = spark.createDataFrame([(1, k, f"period=ninety days; alpha beta {k}") for k in range(3)], "answer_id long, chunk_id long, content string")
    made = support.answer_claim_support(answers, seen)
    assert made.count() == 2
    plan = made._jdf.queryExecution().optimizedPlan()
    above = plan.toString().split("Join Inner")[0]
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString() or "RepartitionByExpression" in plan.toString()
    assert "a-z0-9" not in above  # no text is split into tokens for a pair


def test_tokens_of_case_overlaps_are_made_before_questions_meet_markers(spark):
    from siltstone.plans import audit_queries as A

    made = A._overlaps(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "regexp_extract_all" not in above and "regexp_extract_all" in below and "strategy=broadcast" in below


def test_compact_takes_out_every_mark(spark):
    raw = "".join(map(chr, range(128))) + "Éß中文Ａ۱ x"
    assert one(spark, T.compact("q"), q=raw) == "0123456789" + "abcdefghijklmnopqrstuvwxyz" * 2 + "ss中文x"
    plan = spark.createDataFrame([("a",)], "q string").select(T.compact("q").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in plan


def test_hits_bring_their_texts_along(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma")], "query_id int, query_text string")
    c = spark.createDataFrame([("1-0", 0, 1, "t", "x Alpha  beta, GAMMA y"), ("2-0", 0, 2, "t", "nothing")], "chunk_id string, chunk_index int, document_id int, document_title string, content string")
    assert [(r.query_id, r.chunk_id, r.content) for r in retrieval.exact_hits(q, c, keep=("content",)).collect()] == [(1, "1-0", "x Alpha  beta, GAMMA y")]


def test_texts_do_not_go_through_the_join_of_document_quality(spark):
    d = spark.createDataFrame([(1, "首页 登录 注册\nx\n京 ICP备1\n登 录", True, "aa", "AA")], "document_id int, text string, ready boolean, checksum string, expected_checksum string").withColumn("metadata_missing", F.array().cast("array<string>"))
    c = spark.createDataFrame([(1, "登 录", "paragraph", True, True), (1, "x", "paragraph", True, True)], "document_id int, content string, chunk_type string, has_terms boolean, has_vector boolean")
    made = audits.document_quality(d, c, 0, 0.1, 0.0, False)
    r = made.first()
    assert (r.strict_noise_count, r.noisy_chunk_count, r.chunk_count, "text" in made.columns) == (3, 1, 2, False)
    assert "strict_noise_count" in made._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]  # it comes from below the join


def test_pages_are_listed_in_stretches(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"<body><h1>title {i}</h1><p>one {i}</p><table><tr><th>a</th></tr><tr><td>{i}</td></tr></table></body>") for i in range(20)] + [(20, None), (21, "")], "page_id int, html string").coalesce(1)
    whole = sorted(map(tuple, html.page_segments(pages).collect()), key=str)
    monkeypatch.setattr(html, "PAGES", 3)
    monkeypatch.setattr(html, "STRETCH", 200)
    assert sorted(map(tuple, html.page_segments(pages).collect()), key=str) == whole and len(whole) == 60
