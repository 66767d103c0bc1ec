"""What an answer is made from: a few chunks that cover a question's quoted evidence, the table rows that it asks for, summaries under a budget, and the answer composed of them.

A question's results are a bounded pool, so choices that depend on one another are folds over an array for each question, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
SOURCE_MARKERS = ("条例", "办法", "规定", "制度", "规则", "条款")
FIELD_MARKERS = (
    "负责人", "责任人", "审批", "审批链路", "处理时限", "时限", "期限", "周期", "方式", "材料", "有效期", "条件", "等级", "级别", "字段", "检查项", "禁止", "允许", "响应时间", "首次响应", "验收", "回收", "保留期限",
)
TABLE_WORDS = ("矩阵", "表格", "按级别", "由谁审批", "哪一项", "字段")
TIMING_MARKERS = ("时间", "多久", "期限", "时限", "最迟", "几日", "几个月", "多少天", "24小时")
RULE_MARKERS = ("要求", "应当", "不得", "可以", "分别", "哪些", "什么情况下", "是否")
CLAUSE_QUESTION = ("条", "规定", "债务", "合同", "承包", "个体工商户", "商标")
CLAUSE_CANDIDATES = ("条", "规定", "合同", "承包", "个体工商户", "商标", "责任")
ARTICLE = "第[一二三四五六七八九十百千万零〇0-9]+条"
FOCUS_STOP = ("什么", "哪些", "分别", "要求", "供应商", "文档", "规范", "需要")
#: (what a question has one of, what a row has one of).
ROW_RULES = (
    (("l4", "高风险"), ("准入等级=l4高风险", "l4高风险")),
    (("审批链路", "审批", "链路"), ("审批链路=",)),
    (("谁来批", "审批", "审批人"), ("必须审批人=", "审批人=", "审批链路=")),
    (("复核周期", "复核"), ("复核周期=",)),
    (("退出要求", "退出"), ("退出要求=",)),
    (("先救火", "紧急", "最小权限", "最低权限"), ("紧急场景=", "可先执行动作=", "最低权限服务", "最小可用服务")),
    (("补材料", "补齐材料"), ("事后补齐材料=", "最少材料=")),
    (("关账号", "关闭", "回收"), ("账号关闭时限=", "回收责任人=")),
    (("禁止发法", "禁止方式", "导出文件"), ("禁止方式=", "访问对象=数据导出文件")),
    (("生产环境",), ("访问对象=生产环境", "可访问生产环境")),
    (("允许方式", "允许"), ("允许方式=",)),
    (("有效期",), ("有效期=",)),
    (("回收责任人", "责任人"), ("回收责任人=",)),
    (("日志要求", "日志"), ("日志要求=",)),
    (("首次响应", "响应时间", "响应要求", "多久响应"), ("首次响应=",)),
    (("响应时间",), ("历史响应时间=",)),
    (("高优先级", "高优"), ("工单等级=p1", "问题类型=高优先级工单")),
    (("数据处理服务",), ("交付类型=数据处理服务",)),
    (("验收材料", "材料"), ("验收材料=",)),
    (("验收人",), ("验收人=",)),
    (("保留多久", "保留期限", "资料保留"), ("保留期限=",)),
)
RESPONSE, PRIORITY = ("首次响应", "响应时间", "响应要求", "多久响应"), ("高优先级", "高优", "p1")
EMERGENCY = ("先救火", "紧急", "最小权限", "最低权限")
EMERGENCY_LINES = ("最小可用服务", "最低权限服务", "临时采购", "先行建立")
#: (what a question has one of, markers of which a row needs one); the first that fits counts.
REQUIRED_ROWS = (
    (("l4", "高风险"), ("准入等级=l4", "l4高风险")),
    (("数据处理服务",), ("交付类型=数据处理服务",)),
    (RESPONSE, None),
    (("先救火", "紧急", "最小权限", "最低权限", "补材料", "关账号", "禁止发法", "导出文件"), ("紧急场景=", "可先执行动作=", "事后补齐材料=", "账号关闭时限=", "禁止方式=")),
    (("生产环境",), ("访问对象=生产环境", "可访问生产环境")),
    (("客户手机号", "手机号"), ("客户手机号",)),
)
SUMMARY_STOP = ("what", "does", "document", "guide", "handbook", "runbook", "about", "from", "with", "should", "什么样", "问题", "内容", "文档", "指南", "手册", "登记", "应该", "发生", "写了", "说了", "关于", "里面")
DUTY_WORDS = ("需要", "应", "必须", "负责", "安排", "流程", "步骤", "升级", "回滚", "沟通", "复盘")
UNFINISHED = ("例如", "比如", "另外", "还有", "只有这", "以及", "并", "和")
ROW = "Table row:"


def flat(value: Column | str) -> Column:
    return F.regexp_replace(T.fold(value), r"(?U)\s+", "")


def has_any(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out


def is_table_lookup(question: Column | str) -> Column:
    """Whether a question asks for fields of a table: two field names, or one and a word for tables, and no source of rules."""
    q = flat(question)
    hits = sum((F.contains(q, F.lit(m)).cast("int") for m in FIELD_MARKERS[1:]), F.contains(q, F.lit(FIELD_MARKERS[0])).cast("int"))
    return ~has_any(q, SOURCE_MARKERS) & ~q.rlike(ARTICLE) & ((hits >= 2) | ((hits >= 1) & has_any(q, TABLE_WORDS)))


def is_clause_question(question: Column | str) -> Column:
    """Whether a question is about what a rule says: it names a source or an article, or asks how long something may, must or can take."""
    q = flat(question)
    hits = sum((F.contains(q, F.lit(m)).cast("int") for m in FIELD_MARKERS[1:]), F.contains(q, F.lit(FIELD_MARKERS[0])).cast("int"))
    return (q != "") & ~is_table_lookup(question) & (has_any(q, SOURCE_MARKERS) | q.rlike(ARTICLE) | (has_any(q, TIMING_MARKERS) & has_any(q, RULE_MARKERS) & (hits <= 2)))


def has_clause(value: Column) -> Column:
    return F.contains(value, F.lit("条款全称")) | value.rlike(ARTICLE)


def focus_terms(flat_question: Column) -> Column:
    """Distinct runs of CJK or Latin characters of a text without white space, two or more; of those over eight characters all 4-, 5- and 6-grams instead."""
    tokens = F.regexp_extract_all(flat_question, F.lit(f"([{T.CJK}]{{2,}}|[a-z0-9]{{2,}})"), 1)
    gram = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    out = F.flatten(F.transform(tokens, lambda t: F.when(t.isin(*FOCUS_STOP), F.array().cast("array<string>")).when(F.length(t) > 8, F.concat(*[gram(t, n) for n in (4, 5, 6)])).otherwise(F.array(t))))
    return F.array_distinct(F.filter(out, lambda t: ~t.isin(*FOCUS_STOP)))


def evidence_text(rows: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.nullif(T.text(c), F.lit("")) for c in ("document_title", "section_title", "preview", "content") if c in rows.columns])


def focus_score(results: DataFrame, pairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """Rerank (without one, fused) score + .06 lexical + .08 or .04 for each focus term in the text + what clauses and tables add or take for such questions + .16 for each pair (in the question,
    in the text) that fits."""
    q, e = flat("query_text"), flat(evidence_text(results))
    text, table = evidence_text(results), F.contains(T.text("content"), F.lit(ROW))
    score = F.coalesce("rerank", "fused") + F.col("lexical_norm") * 0.06
    score = score + F.aggregate(focus_terms(q), F.lit(0.0), lambda a, t: a + F.when(F.contains(e, t), F.when(F.length(t) >= 4, 0.08).otherwise(0.04)).otherwise(0.0))
    clause = is_clause_question("query_text")
    score = score + F.when(F.contains(e, F.lit("条款全称")) & has_any(q, CLAUSE_QUESTION), 0.12).otherwise(0.0)
    score = score + F.when(clause, F.when(has_clause(text), 0.18).otherwise(0.0) - F.when(table & ~has_clause(text), 0.2).otherwise(0.0)).when(is_table_lookup("query_text") & table, 0.14).otherwise(0.0)
    for asked, said in pairs:
        score = score + F.when(F.contains(q, F.lit(asked)) & F.contains(e, F.lit(said)), 0.16).otherwise(0.0)
    return F.round(score, 9)


def hints(question: Column | str) -> Column:
    """Quoted spans of 2 to 260 characters, squeezed, without marks at the ends, distinct: those in curly quotes first."""
    q = T.text(question)
    found = F.concat(F.regexp_extract_all(q, F.lit("“([^”]{2,260})”"), 1), F.regexp_extract_all(q, F.lit('"([^"]{2,260})"'), 1))
    clean = F.transform(found, lambda s: F.regexp_replace(T.squeeze(s), "^[ ：:；;，,、]+|[ ：:；;，,、]+$", ""))
    return F.array_distinct(F.filter(clean, lambda s: s != ""))


def matches_hint(evidence: Column, hint: Column) -> Column:
    """Whether flattened evidence holds a hint of four characters or more, or all but one (two at least) of its focus terms of three characters or more."""
    h = flat(hint)
    terms = F.filter(focus_terms(h), lambda t: F.length(t) >= 3)
    hit = F.size(F.filter(terms, lambda t: F.contains(evidence, t)))
    return (F.length(h) >= 4) & (F.contains(evidence, h) | ((F.size(terms) > 0) & (hit >= F.greatest(F.lit(2), F.size(terms) - 1))))


# Table rows.


def rows_of(content: Column | str) -> Column:
    lines = F.transform(F.split(T.text(content), r"\r\n|\r|\n"), F.trim)
    return F.filter(lines, lambda s: F.startswith(s, F.lit(ROW)))


def required_markers(question: Column) -> Column:
    """Markers of which a row needs one, by what a flattened question asks for; none if it asks for nothing of the kind."""
    urgent = F.when(has_any(question, PRIORITY), F.array(*[F.lit(x) for x in ("工单等级=p1", "问题类型=高优先级工单", "首次响应=")])).otherwise(F.array(F.lit("首次响应="), F.lit("历史响应时间=")))
    out = None
    for words, markers in REQUIRED_ROWS:
        value = urgent if markers is None else F.array(*[F.lit(m) for m in markers])
        out = F.when(has_any(question, words), value) if out is None else out.when(has_any(question, words), value)
    return out.otherwise(F.array().cast("array<string>"))


def row_score(question: Column, terms: Column, row: Column, rules: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ROW_RULES) -> Column:
    """How well a flattened row fits a flattened question: 4 or 2 for each focus term, 8 for each rule that fits, and what urgent questions add."""
    score = F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.contains(row, t), F.when(F.length(t) >= 4, 4).otherwise(2)).otherwise(0))
    for asked, there in rules:
        score = score + F.when(has_any(question, asked) & has_any(row, there), 8).otherwise(0)
    current = F.contains(row, F.lit("工单等级=p1")) & F.contains(row, F.lit("首次响应="))
    past = F.contains(row, F.lit("问题类型=高优先级工单")) & F.contains(row, F.lit("历史响应时间="))
    return score + F.when(has_any(question, PRIORITY), F.when(current, 18).when(past, 8).otherwise(0)).otherwise(0)


def focused_rows(results: DataFrame) -> DataFrame:
    """results(query_id, query_text, chunk_id, content, and if there are, section_title and preview) with rows (the two table rows of a chunk that fit the question best, a second one only with three quarters of the best score), lines (the
    two other lines with most of its terms) and focused: a heading, the lines and the rows; a chunk without table rows keeps its content."""
    q = flat("query_text")
    rows = results.withColumn("_q", q).withColumn("_terms", focus_terms(F.col("_q"))).withColumn("_all", rows_of("content"))
    must = required_markers(F.col("_q"))
    strict = F.filter("_all", lambda r: F.exists(must, lambda m: F.contains(flat(r), m)))
    rows = rows.withColumn("_rows", F.when((F.size(must) > 0) & (F.size(strict) > 0), strict).otherwise(F.col("_all")))
    holds = lambda r, *words: sum((F.contains(flat(r), F.lit(w)).cast("int") for w in words[1:]), F.contains(flat(r), F.lit(words[0])).cast("int")) == len(words)
    urgent = has_any(F.col("_q"), RESPONSE) & has_any(F.col("_q"), PRIORITY)
    first = F.concat(F.slice(F.filter("_rows", lambda r: holds(r, "工单等级=p1", "首次响应=")), 1, 1), F.slice(F.filter("_rows", lambda r: holds(r, "问题类型=高优先级工单", "历史响应时间=") & ~holds(r, "工单等级=p1", "首次响应=")), 1, 1))
    keyed = F.array_sort(F.transform("_rows", lambda r, i: F.struct((-row_score(F.col("_q"), F.col("_terms"), flat(r))).alias("s"), i.alias("i"), r.alias("r"))))
    rows = rows.withColumn("_keyed", keyed)
    best = F.get("_keyed", F.lit(0))
    second = F.get(F.filter("_keyed", lambda x, i: (i > 0) & (x.s < 0) & (-x.s >= -best.s * 0.75) & (x.r != best.r)), F.lit(0))
    chosen = F.when(urgent & (F.size(first) > 0), first).otherwise(F.array_compact(F.array(best.r, second.r)))
    lines = F.filter(F.transform(F.split(T.text("content"), r"\r\n|\r|\n"), F.trim), lambda s: (s != "") & ~F.startswith(s, F.lit(ROW)))
    scored = lambda s: F.aggregate(F.col("_terms"), F.lit(0), lambda a, t: a + F.when(F.contains(flat(s), t), F.when(F.length(t) >= 4, 3).otherwise(1)).otherwise(0)) + F.when(has_any(F.col("_q"), EMERGENCY) & has_any(flat(s), EMERGENCY_LINES), 8).otherwise(0)
    lined = F.array_sort(F.filter(F.transform(lines, lambda s, i: F.struct((-scored(s)).alias("s"), i.alias("i"), s.alias("r"))), lambda x: x.s < 0))
    rows = rows.withColumn("rows", F.when(F.size("_rows") > 0, chosen).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("lines", F.when(F.size("_rows") > 0, F.slice(F.array_distinct(F.transform(lined, lambda x: x.r)), 1, 2)).otherwise(F.array().cast("array<string>")))
    heads = [F.when((T.text(c) != "") & ~F.contains(T.text(c), F.lit(ROW)), F.col(c)) for c in ("section_title", "preview") if c in results.columns]
    head = F.coalesce(*heads) if heads else F.lit(None).cast("string")
    body = F.trim(F.array_join(F.concat(F.array_compact(F.array(head)), "lines", "rows"), "\n"))
    return rows.withColumn("focused", F.when((F.size("_rows") > 0) & (body != ""), body).otherwise(F.col("content"))).drop("_q", "_terms", "_all", "_rows", "_keyed")


# Chunks.


def focused_chunks(results: DataFrame, pairs: tuple[tuple[str, str], ...] = (), pool: int = 8, most: int = 5, per_document: int = 2) -> DataFrame:
    """(query_id, chunk_id, document_id, place, focused): what each question's answer is made from.

    results(query_id, query_text, position, chunk_id, document_id, document_title, content, rerank, fused, lexical_norm, and if there are section_title and preview), a bounded pool for each question. A question for fields of a table takes the
    first three tables of the first five results, cut to their rows. Others take the ``pool`` first by focus_score: for each of the first three hints of a question with two or more, the best chunk not taken yet that matches it; then the best,
    ``per_document`` a document, ``most`` in all."""
    tables = results.where((F.col("position") <= 5) & is_table_lookup("query_text") & F.contains(T.text("content"), F.lit(ROW)))
    tables = tables.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("position"))).where("place <= 3")
    rows = results.where(F.col("position") <= pool).join(tables.select("query_id").distinct(), "query_id", "left_anti")
    rows = rows.withColumn("_e", flat(evidence_text(rows))).withColumn("_h", F.slice(hints("query_text"), 1, 3)).withColumn("_all", F.size(hints("query_text")))
    matched = F.when(F.col("_all") >= 2, F.transform("_h", lambda h: matches_hint(F.col("_e"), h))).otherwise(F.array().cast("array<boolean>"))
    order = W.partitionBy("query_id").orderBy(F.desc("_score"), F.coalesce("rerank", "fused").desc(), F.desc("fused"), "position")
    rows = rows.withColumn("_score", focus_score(rows, pairs)).withColumn("_n", F.row_number().over(order)).withColumn("_m", matched)
    kind = "struct<n:int,chunk_id:string,document_id:string,m:array<boolean>>"
    item = F.struct(F.col("_n").alias("n"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), F.col("_m").alias("m")).cast(kind)
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("pool"), F.max(F.size("_m")).alias("n_hints"))
    none = F.array().cast(f"array<{kind}>")
    taken = lambda s, x: F.exists(s, lambda y: y.n == x.n)

    def for_hint(s: Column, k: Column) -> Column:
        free = F.filter("pool", lambda x: F.coalesce(F.get(x.m, k), F.lit(False)) & ~taken(s, x))
        return F.concat(s, F.slice(free, 1, 1))

    def by_score(s: Column, x: Column) -> Column:
        room = (F.size(s) < most) & ~taken(s, x) & (F.size(F.filter(s, lambda y: y.document_id == x.document_id)) < per_document)
        return F.when(room, F.concat(s, F.array(x))).otherwise(s)

    start = F.aggregate(F.when(F.col("n_hints") > 0, F.sequence(F.lit(0), F.col("n_hints") - 1)).otherwise(F.array().cast("array<int>")), none, for_hint)
    lists = lists.withColumn("start", start)
    picked = lists.select("query_id", F.posexplode(F.aggregate("pool", F.col("start"), by_score)).alias("pos", "x")).select("query_id", F.col("x.chunk_id").alias("_id"), (F.col("pos") + 1).alias("place"))
    plain = rows.withColumn("_id", F.col("chunk_id").cast("string")).join(picked, ["query_id", "_id"]).select("query_id", "chunk_id", "document_id", "place", F.col("content").alias("focused"))
    return plain.unionByName(focused_rows(tables).select("query_id", "chunk_id", "document_id", "place", "focused"))


def with_clauses(kept: DataFrame, results: DataFrame, most: int = 8, pairs: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(query_id, chunk_id, place): kept(query_id, chunk_id, place) and, for questions about rules, further chunks with a clause among the first ten results by focus_score, up to ``most``."""
    asked = results.where(has_any(flat("query_text"), CLAUSE_CANDIDATES) & (F.col("position") <= 10) & has_clause(T.text("content")))
    size = kept.groupBy("query_id").agg(F.max("place").alias("_had"))
    new = asked.join(kept.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(size, "query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("_s"), F.coalesce("rerank", "fused").desc(), F.desc("fused"), "position")
    new = new.withColumn("_s", focus_score(new, pairs)).withColumn("place", F.col("_had") + F.row_number().over(order)).where(F.col("place") <= most)
    return kept.select("query_id", "chunk_id", "place").unionByName(new.select("query_id", "chunk_id", "place"))


# Summaries.


def summary_terms(question: Column | str) -> Column:
    return F.filter(T.query_terms_of(question), lambda t: ~t.isin(*SUMMARY_STOP))


def sentence_score(sentence: Column, terms: Column) -> Column:
    """2 for each long term, 1 for each short one, 1 for a word of duty."""
    low = T.fold(sentence)
    return F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.contains(low, t), F.when(F.length(t) >= 4, 2).otherwise(1)).otherwise(0)) + F.when(has_any(low, DUTY_WORDS), 1).otherwise(0)


def ended(value: Column) -> Column:
    """With a full stop, in place of a comma, colon or semicolon at the end; nothing stays nothing."""
    v = F.trim(value)
    return F.when((v == "") | v.rlike("[。！？…]$"), v).otherwise(F.concat(F.rtrim(F.regexp_replace(v, "[；;：:，,]$", "")), F.lit("。")))


def complete_sentences(content: Column | str) -> Column:
    """Sentences of a text: its last part only if the text ends with a mark or has one part; none that is short or breaks off."""
    flat_ = T.squeeze(content)
    parts = F.filter(F.transform(F.split(F.regexp_replace(flat_, "([。！？!?；;])\\s*", "$1\u0001"), "\u0001"), lambda p: F.regexp_replace(p, "^[ ，；;。]+|[ ，；;。]+$", "")), lambda p: p != "")
    whole = F.when((F.size(parts) > 1) & ~flat_.rlike("[。！？!?；;]$"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    broken = lambda p: (F.length(p) < 12) | p.rlike(f"({'|'.join(UNFINISHED)})$") | (p.rlike(f"[A-Za-z0-9{T.CJK}]$") & (F.length(p) <= 16))
    return F.filter(whole, lambda p: ~broken(p))


def clean_row(row: Column) -> Column:
    out = F.trim(F.regexp_replace(row, f"^{ROW}", ""))
    return ended(T.shorten(F.replace(F.regexp_replace(out, "^(.*?)\\. ", "$1："), F.lit("; "), F.lit("；")), 420))


def chunk_summaries(chunks: DataFrame, budget: int = 520, row_budget: int = 260) -> DataFrame:
    """chunks(query_id, query_text, chunk_id, content) with summary: of a table its three best rows within ``row_budget`` characters, of a text its two best sentences within ``budget``; a first one counts however long or weak it is, others only with a
    score, and one that doesn't fit is passed over. Without a complete sentence the longest one that there is, and '' for nothing."""
    terms = summary_terms("query_text")
    rows = chunks.withColumn("_t", terms).withColumn("_table", F.size(rows_of("content")) > 0)
    sentences = complete_sentences("content")
    clean = lambda s: ended(T.shorten(F.regexp_replace(T.squeeze(s), "^[ ：:；;，,]+|[ ：:；;，,]+$", ""), 520))
    units = F.when(F.col("_table"), F.transform(rows_of("content"), lambda r: F.struct(r.alias("raw"), clean_row(r).alias("text")))).otherwise(F.transform(sentences, lambda s: F.struct(s.alias("raw"), clean(s).alias("text"))))
    ranked = F.array_sort(F.transform(units, lambda u, i: F.struct((-sentence_score(u.raw, F.col("_t"))).alias("s"), i.alias("i"), u.text.alias("text"))))
    room, count = F.when(F.col("_table"), row_budget).otherwise(budget), F.when(F.col("_table"), 3).otherwise(2)

    def step(s: Column, u: Column) -> Column:
        fits = (u.text != "") & ~F.array_contains(s, u.text) & (F.size(s) < count)
        later = (u.s < 0) & (F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)) + F.length(u.text) <= room)
        return F.when(fits & ((F.size(s) == 0) | later), F.concat(s, F.array(u.text))).otherwise(s)

    rows = rows.withColumn("summary", F.array_join(F.aggregate(ranked, F.array().cast("array<string>"), step), " "))
    return rows.drop("_t", "_table")


def clause_of(summary: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(summary), "[。！？!?；;，,：:]$", ""))


def composed_answers(summaries: DataFrame) -> DataFrame:
    """(query_id, answer): one text from summaries(query_id, place, document_title, location, summary). One document: its first three points, numbered; several: what each says, with the place."""
    rows = summaries.withColumn("clause", clause_of(F.col("summary")))
    made = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "document_title", "location", "clause"))).alias("parts"), F.count_distinct(F.coalesce("document_title", F.lit(""))).alias("titles"))
    said = F.filter("parts", lambda p: p.clause != "")
    title = F.coalesce(F.get("parts", F.lit(0)).getField("document_title"), F.lit(""))
    at = lambda i: F.get(said, F.lit(i)).getField("clause")
    lead = F.concat(F.lit("根据当前可访问文档中的证据，"), title)
    one = (
        F.when(F.size(said) >= 3, F.concat(lead, F.lit("主要有三点：第一，"), at(0), F.lit("；第二，"), at(1), F.lit("；第三，"), at(2), F.lit("。")))
        .when(F.size(said) == 2, F.concat(lead, F.lit("主要有两点：第一，"), at(0), F.lit("；第二，"), at(1), F.lit("。")))
        .when(F.size(said) == 1, F.concat(lead, F.lit("主要说明："), at(0), F.lit("。")))
        .otherwise(F.concat(lead, F.lit("包含与该问题相关的说明，建议结合引用片段进一步确认。")))
    )
    many = ended(F.concat(F.lit("根据当前可访问文档中的证据，"), F.array_join(F.transform(said, lambda p: F.concat(F.coalesce(p.document_title, F.lit("")), F.lit("（"), p.location, F.lit("）提到："), p.clause)), "；")))
    return made.select("query_id", F.when(F.col("titles") == 1, one).otherwise(many).alias("answer"))


# Spans.


def folded_places(value: Column | str) -> Column:
    """struct(text, at): a text folded, without what is no letter or digit, and for each of its characters the place (from 0) of the raw character that it came from."""
    v = T.text(value)
    chars = F.filter(F.transform(F.when(F.length(v) > 0, F.sequence(F.lit(1), F.length(v))).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i - 1).alias("at"), T.fold(F.substring(v, i, F.lit(1))).alias("c"))), lambda x: x.c.rlike("[\\p{L}\\p{N}]"))
    places = F.flatten(F.transform(chars, lambda x: F.array_repeat(x.at, F.length(x.c))))
    return F.struct(F.array_join(F.transform(chars, lambda x: x.c), "").alias("text"), places.alias("at"))


def quote_spans(hits: DataFrame) -> DataFrame:
    """(key columns, start, stop): the raw span, from start up to stop, of every place where hits(..., quote, content) has the quote in its content, compared folded and without what is no letter or digit. Quotes without
    such a character have none. A text costs an array as long as itself."""
    keys = [c for c in hits.columns if c not in ("quote", "content")]
    # A row of its own keeps the places from being made again for each condition on them.
    rows = hits.select(*keys, F.explode(F.array(F.struct(folded_places("content").alias("f"), folded_places("quote").getField("text").alias("q")))).alias("_x")).select(*keys, "_x.f", "_x.q")
    rows = rows.where("q <> '' and contains(f.text, q)")
    n = F.length("q")
    starts = F.filter(F.sequence(F.lit(1), F.length("f.text") - n + 1), lambda i: F.substring(F.col("f.text"), i, n) == F.col("q"))
    rows = rows.withColumn("i", F.explode(starts))
    return rows.select(*keys, F.get("f.at", F.col("i") - 1).alias("start"), (F.get("f.at", F.col("i") + n - 2) + 1).alias("stop"))
