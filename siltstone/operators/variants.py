"""Ways to ask one question: normalised, focused, expanded, anchored and decomposed forms of a table of queries.

Everything is columns over the queries; rule sets are parameters, so that a deployment brings its own domain. NFKC folding is left to the
caller: the forms that occur in Latin and CJK text are covered by the patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import text as T

# Fixed values.
FILLERS = (
    "请问", "想问一下", "想问下", "麻烦问一下", "麻烦问下", "帮我看下", "帮我看一下", "能不能告诉我", "可以告诉我", "可以帮我", "里面提到",
    "里提到", "里面说", "里说", "是怎么说的", "怎么说",
)
ENGLISH_FILLERS = ("please tell me", "can you tell me", "help me find", "what does", "what is")
STOP_TERMS = ("一下", "一下子", "吗", "么", "呢", "呀", "啊", "吧", "请", "问", "一下呢", "里面", "里", "提到", "提及", "关于")
QUESTION_HINTS = "是否|能否|可否|可以|哪些|有什么|如何|怎么|谁|哪个|找谁|多少|多久|多长"
#: Words of a question, and what its evidence is likely to say.
BRIDGES = (
    ("哪些|有什么|包括|列出|分别|范围", "条件 情形 范围 要求 义务 责任 标准 处理"),
    ("是否|能否|可否|可以|会不会|需不需要|要不要", "条件 要求 规定 允许 禁止 可以 不得 有效 无效 责任 义务"),
    ("责任|赔偿|损害|损失|侵害|受伤|承担", "责任 义务 赔偿 损害 过错 风险 处理"),
    ("合同|协议|承诺|约定", "合同 协议 效力 有效 无效 条件 程序 同意 审批"),
    ("谁|哪个|哪一个|找谁|由谁", "主体 负责人 责任人 部门 机构 范围"),
    ("多少|多久|多长|时限|期限|时间", "时限 期限 时间 要求 工作日 完成 响应"),
)
IGNORED_TERMS = ("是否", "能否", "可否", "可以", "哪些", "什么", "如何", "怎么", "多少", "多久", "需要", "要求")
DEFINITION_WORDS = "定义|是什么|什么是|是指什么|含义|概念"
DEFINITION_PATTERNS = (
    "(?:对|关于)([一-鿿A-Za-z0-9《》“”\"_\\-]{2,40}?)(?:本身)?(?:是怎么定义的|怎么定义|如何定义|的定义|定义)",
    "([一-鿿A-Za-z0-9《》“”\"_\\-]{2,40}?)(?:本身)?(?:是指什么|是什么|的含义|的概念|的定义)",
    "什么是([一-鿿A-Za-z0-9《》“”\"_\\-]{2,40})",
)
ATTRIBUTES = "要求|时限|材料|流程|步骤|方式|条件|责任|期限|审批人|字段|内容|事项"
LOOKUP_WORDS = (
    "首次响应|响应时间|响应要求|多久响应|处理时限|审批人|脱敏要求|有效期|目标|总体目标|主要目标|适用情形|适用范围|基本原则|复核周期|"
    "退出要求|验收材料|验收人|保留期限"
)
LOOKUP_QUESTIONS = "多少|多久|谁|哪些|要求|是什么|怎么|如何|目标|情形|范围"
#: All terms that a question has to hold, and the words that it is expanded by.
ENTERPRISE_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("客户手机号",), "客户手机号 数据导出 审批人 处理时限 脱敏要求 敏感字段 加密交付"),
    (("客户数据导出",), "客户数据导出 数据范围 审批人 处理时限 脱敏要求 证据要求 交付渠道"),
    (("临时高权限访问",), "临时高权限访问 生产环境 审批人 有效期 回收责任人 日志要求 证据要求"),
    (("生产环境", "高权限"), "生产环境 临时高权限访问 允许方式 有效期 回收责任人 日志要求 操作审计"),
    (("l4", "供应商"), "L4 高风险供应商 准入等级 审批链路 复核周期 退出要求 账号回收"),
    (("高风险供应商",), "L4 高风险供应商 准入等级 审批链路 复核周期 退出要求 账号回收"),
    (("数据处理服务",), "数据处理服务 交付类型 验收材料 验收人 保留期限 归档位置"),
    (("验收材料",), "验收材料 字段说明 脱敏方式 抽样检查结果 验收人 保留期限"),
    (("制度版本", "检查"), "制度版本 版本更新 检查清单 检查项 是否必须 知识库维护动作"),
    (("扫描", "动作"), "扫描附件 OCR 表格 编号 动作 负责人 时限 核验日志"),
)
LOW_SIGNAL = ("一下", "哪些", "有哪", "什么", "怎么", "如何", "分别", "各自", "以及", "相关", "内容", "要求", "合规", "适用", "企业", "文档", "规定")
DISCRIMINATORS = (
    r"20[0-9]{2}\s*年(?:\s*[0-9]{1,2}\s*月(?:\s*[0-9]{1,2}\s*日)?)?",
    r"[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日",
    "第[一二三四五六七八九十百千万两0-9]+(?:期|条|章|节|阶段|次|轮)",
    r"[A-Za-z]*[0-9][A-Za-z0-9一-鿿_.\-]*",
)
PAIR_FIELD, PAIR_VALUE = r"[一-鿿A-Za-z0-9（）() /·\-_%％]", r"[一-鿿A-Za-z0-9（）() /·\-_.%％]"

_NONE = "array<string>"


def normalized(value: Column | str) -> Column:
    """Quotes and brackets as blanks, white space squeezed."""
    out = F.regexp_replace(F.trim(T.text(value)), "[“”\"'`]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[《》〈〉【】\[\]（）()]+", " "), r"(?U)\s+", " "))


def focused(value: Column | str) -> Column:
    """Folded, without filler phrases, punctuation and stop terms (longer ones first)."""
    out = T.fold(value)
    for phrase in (*ENGLISH_FILLERS, *FILLERS):
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[，。！？、,:;；]+", " "), r"(?U)\s+", " "))
    for term in sorted(STOP_TERMS, key=len, reverse=True):
        out = F.replace(out, F.lit(term), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def signature(value: Column | str) -> Column:
    return F.regexp_replace(T.fold(normalized(value)), r"(?U)\s+", "")


def important_terms(value: Column | str) -> Column:
    """Latin and CJK tokens without question words, distinct; CJK runs of over 24 characters in pieces of six."""
    tokens = F.regexp_extract_all(normalized(value), F.lit("([A-Za-z0-9]+|[一-鿿]{2,})"), 1)
    kept = F.filter(tokens, lambda t: ~t.isin(*IGNORED_TERMS))
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t), F.lit(6)), lambda i: F.substring(t, i, F.lit(6)))
    return F.array_distinct(F.flatten(F.transform(kept, lambda t: F.when((F.length(t) > 24) & t.rlike("^[一-鿿]+$"), cut(t)).otherwise(F.array(t)))))


def definition_queries(original: Column | str, focus: Column) -> Column:
    """For a question that asks what a term means, the ways in which a definition may be worded."""
    flat = F.regexp_replace(T.fold(normalized(F.concat_ws(" ", T.text(original), focus))), r"(?U)\s+", "")
    found = F.coalesce(*[F.nullif(F.regexp_extract(flat, p, 1), F.lit("")) for p in DEFINITION_PATTERNS])
    term = F.regexp_replace(F.regexp_replace(found, "^[《》“”\"' ]+|[《》“”\"' ]+$", ""), "^(?:办法|条例|规定|制度|文档|文件|手册)?(?:中|里)?", "")
    term = F.regexp_replace(F.regexp_replace(term, "(?:本身|相关|这个|该)$", ""), "^[的 ]+|[的 ]+$", "")
    fits = flat.rlike(DEFINITION_WORDS) & ~flat.rlike("表格或清单信息|对应的数值|对象或判断") & ~term.rlike(f"({ATTRIBUTES})$") & F.length(term).between(2, 30)
    both = F.array(F.concat(term, F.lit(" 是指 本办法所称 "), term, F.lit(" 定义 含义 概念")), F.concat(F.lit("本办法所称 "), term, F.lit(" 是指")))
    return F.when(F.coalesce(fits, F.lit(False)), both).otherwise(F.array().cast(_NONE))


def domain_queries(original: Column | str, focus: Column, rules: Sequence[tuple[Sequence[str], str]] = ENTERPRISE_RULES) -> Column:
    """Expansions of the rules all of whose terms a question holds, those with more terms first, after its definition queries."""
    flat = F.regexp_replace(T.fold(F.concat_ws(" ", T.text(original), focus)), r"(?U)\s+", "")
    made = []
    for terms, expansion in sorted(rules, key=lambda r: -len(r[0])):
        holds = F.lit(True)
        for t in terms:
            holds = holds & F.contains(flat, F.lit(t.casefold()))
        made.append(F.when(holds, expansion))
    found = F.array_compact(F.array(*made)) if made else F.array().cast(_NONE)
    return unique(F.concat(definition_queries(original, focus), found))


def bridge_queries(original: Column | str, focus: Column, limit: int = 3) -> Column:
    """A question together with what its evidence is likely to say, by the words that it asks with."""
    flat = F.regexp_replace(T.fold(F.concat_ws(" ", T.text(original), focus)), r"(?U)\s+", "")
    base = normalized(F.coalesce(F.nullif(focus, F.lit("")), T.text(original)))
    generic = F.array_distinct(F.flatten(F.array(*[F.when(flat.rlike(words), F.split(F.lit(answer), " ")).otherwise(F.array().cast(_NONE)) for words, answer in BRIDGES])))
    own = important_terms(base)
    join = lambda *parts: F.concat_ws(" ", *parts)
    some, mine = F.size(generic) > 0, F.size(own) > 0
    made = F.array_compact(F.array(
        F.when(some, join(base, F.array_join(F.slice(generic, 1, 12), " "))), F.when(some & mine, join(F.array_join(F.slice(own, 1, 10), " "), F.array_join(F.slice(generic, 1, 10), " "))), F.when(mine, F.array_join(F.slice(own, 1, 14), " ")),
    ))
    return F.when(flat.rlike(QUESTION_HINTS), F.slice(unique(F.transform(made, normalized)), 1, limit)).otherwise(F.array().cast(_NONE))


def anchored(title: Column, query: Column) -> Column:
    """The query with the document's title before it, unless it holds the title."""
    t, q = normalized(title), normalized(query)
    return F.when((t == "") | F.contains(q, t), q).otherwise(F.concat(t, F.lit(" "), q))


def unique(values: Column) -> Column:
    """Trimmed, not empty, the first of those with one signature."""
    some = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    keys = F.transform(some, signature)
    return F.filter(some, lambda v, i: F.array_position(keys, signature(v)) == i + 1)


def is_precise_lookup(value: Column | str) -> Column:
    """A short question for a named attribute."""
    q = normalized(value)
    return (F.length(q) <= 80) & q.rlike(LOOKUP_WORDS) & q.rlike(LOOKUP_QUESTIONS)


def query_variants(queries: DataFrame, rules: Sequence[tuple[Sequence[str], str]] = ENTERPRISE_RULES, bridge: int = 3) -> DataFrame:
    """queries(query_id, query_text, and if known title) as (query_id, pos, key, retrieval_query, lexical_queries, strategies): the baseline, and the focused,
    domain, evidence-bridge and title-anchored forms that differ from those before. Forms with equal text are one, with the strategies of
    all."""
    title = F.col("title") if "title" in queries.columns else F.lit(None).cast("string")
    title = F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.regexp_extract(T.text("query_text"), "《([^》]{1,80})》", 1), F.lit("")))
    rows = queries.withColumn("o", F.trim(T.text("query_text"))).withColumn("title_", title)
    rows = rows.withColumn("n", normalized("o")).withColumn("base", F.coalesce(F.nullif("n", F.lit("")), F.col("o"))).withColumn("f", focused("n"))
    rows = rows.withColumn("focus", F.coalesce(F.nullif("f", F.lit("")), F.col("base"))).withColumn("domain", domain_queries("o", F.col("focus"), rules)).withColumn("bridge", bridge_queries("o", F.col("focus"), bridge) if bridge else F.array().cast(_NONE))
    differs = (F.col("n") != "") & (F.col("n") != F.col("o"))
    start = F.when(differs, F.array(F.lit("normalize"))).otherwise(F.array().cast(_NONE))
    plain = F.when(differs, F.array("o", "n")).otherwise(F.array("o"))
    with_focus = F.when(F.col("f") != "", F.concat(start, F.array(F.lit("focus_keywords")))).otherwise(start)

    def form(key: str, query: Column, lexical: Column, strategies: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(key).alias("key"), normalized(query).alias("retrieval_query"), unique(F.concat(F.array(normalized(query)), lexical)).alias("lexical_queries"), F.array_distinct(strategies).alias("strategies")))

    first = lambda c: F.get(c, F.lit(0))
    named = lambda c, name: F.concat(c, F.array(F.lit(name)))
    whole = anchored(F.col("title_"), F.col("focus"))
    forms = F.array_compact(F.array(
        form("baseline", F.col("base"), plain, start, F.col("base") != ""),
        form("focused", F.col("focus"), F.concat(F.array("focus"), plain), named(start, "focus_keywords"), signature("focus") != signature("base")),
        form("domain_expansion", first(F.col("domain")), F.concat(F.col("domain"), F.array("focus"), plain), named(with_focus, "domain_expansion"), F.size("domain") > 0),
        form("evidence_bridge", first(F.col("bridge")), F.concat(F.col("bridge"), F.array("focus"), plain), named(with_focus, "evidence_bridge"), F.size("bridge") > 0),
        form("title_anchor", whole, F.concat(F.array(whole, F.col("focus")), plain), named(with_focus, "title_anchor"), F.col("title_").isNotNull()),
    ))
    long = rows.select("query_id", F.posexplode(forms).alias("pos", "v")).select("query_id", "pos", "v.*").where("retrieval_query <> ''")
    same = F.concat_ws("\u0001", signature("retrieval_query"), F.array_join(F.transform("lexical_queries", signature), "\u0002"))
    long = long.withColumn("sig", same)
    made = long.groupBy("query_id", "sig").agg(F.min("pos").alias("pos"), F.min_by(F.struct("key", "retrieval_query", "lexical_queries"), "pos").alias("v"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "strategies"))), lambda x: x.strategies))).alias("strategies"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("pos")) - 1
    return made.select("query_id", place.alias("pos"), "v.key", "v.retrieval_query", "v.lexical_queries", "strategies")


def select_plans(variants: DataFrame, probes: DataFrame) -> DataFrame:
    """The variant of each query that its probe prefers. probes(query_id, key, hit_count, top_score, average_score, concentration, title_match); relative
    scores are min-max within the query."""

    def relative(c: str) -> Column:
        w = W.partitionBy("query_id")
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high == low, (F.col(c) > 0).cast("double")).otherwise((F.col(c) - low) / (high - low))

    rows = variants.join(probes, ["query_id", "key"])
    score = 0.35 * relative("top_score") + 0.2 * relative("average_score") + 0.2 * relative("hit_count") + 0.15 * F.col("concentration") + 0.1 * F.col("title_match")
    score = score + F.when(F.array_contains("strategies", "title_anchor") & (F.col("hit_count") > 0), 0.08).otherwise(0.0)
    rows = rows.withColumn("final_score", F.round(score, 9))
    order = [F.desc(c) for c in ("final_score", "title_match", "hit_count", "average_score", "top_score")]
    return rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(*order, "pos"))).where("n = 1").drop("n")


def probe_figures(hits: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """hits(query_id, key, rank, score, document_title) of a short search with each variant as the probes that select_plans takes: best and mean score of the
    first three hits, the share of their most frequent document, and whether the title that is wanted is among them."""
    three = hits.where("rank <= 3")
    by_title = three.groupBy("query_id", "key", "document_title").agg(F.count("*").alias("n"))
    if titles is not None:
        by_title = by_title.join(titles.select("query_id", F.lower(F.trim("title")).alias("wanted")), "query_id", "left")
    else:
        by_title = by_title.withColumn("wanted", F.lit(None).cast("string"))
    share = by_title.groupBy("query_id", "key").agg((F.max("n") / F.sum("n")).alias("concentration"), F.max(F.coalesce(F.lower(F.trim("document_title")) == F.col("wanted"), F.lit(False)).cast("double")).alias("title_match"))
    made = hits.groupBy("query_id", "key").agg(F.count("*").alias("hit_count"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("average_score"))
    return made.join(share, ["query_id", "key"])


# Sub-queries.


def organisation(value: Column) -> Column:
    """An organisation's name as a question has it: without quotes, brackets, verbs and particles around it."""
    out = F.regexp_replace(F.regexp_replace(value, "[“”\"'`《》〈〉【】\\[\\]]+", " "), r"(?U)\s+", " ")
    out = F.regexp_replace(F.trim(out), "^(?:请|请你|麻烦|帮我|需要在|在)?(?:比较|核对)?", "")
    return F.regexp_replace(F.regexp_replace(out, "的$", ""), "^[ ，,。；;：:]+|[ ，,。；;：:]+$", "")


def subqueries(queries: DataFrame) -> DataFrame:
    """queries(query_id, query_text) as (query_id, sub_id, query_text, org_hint, evidence_hint, case_shape), for the questions that have one of four shapes: a
    comparison of two documents, two matters of one, a table lookup, and a single quoted anchor. Others have none."""
    q = T.text("query_text")
    strip = lambda c: F.regexp_replace(normalized(c), "^[ ，,。；;：:、]+|[ ，,。；;：:、]+$", "")
    quotes = F.filter(F.transform(A.quoted("query_text"), strip), lambda s: s != "")
    cross = "比较(.+?)和(.+?)两份([^，,。；;]{0,48})"
    same = "同时核对(.+?)这份([^，,。；;]{0,48}?)中的两个事项"
    table = "核对(.+?)文件中的表格或清单信息"
    single = "([一-鿿A-Za-z0-9（）() /·\\-]+?)(?:这份|的)([^，,。；;“”]{0,48}?)(?:中|里)"
    get = lambda pattern, k: F.regexp_extract(q, pattern, k)
    hint = lambda c: F.regexp_replace(normalized(c), "^[ ，,。；;：:]+|[ ，,。；;：:]+$", "")

    def shape(name, n: int, orgs: list[Column], document: Column, when: Column) -> Column:
        parts = [F.struct(o.alias("org_hint"), document.alias("document"), F.get("quotes", F.lit(i)).alias("evidence_hint"), (name if isinstance(name, Column) else F.lit(name)).alias("case_shape")) for i, o in enumerate(orgs[:n])]
        named = F.lit(True)
        for o in orgs:
            named = named & (o != "")
        return F.when(when & named, F.array(*parts))

    rows = queries.select("query_id", "query_text", quotes.alias("quotes"))
    org = organisation(get(single, 1))
    lone = ~q.rlike("普通查看用户|受限材料|能否直接查看|分别关注|两个事项") & (F.size("quotes") == 1) & q.rlike(single)
    kind = F.when(q.rlike("相关事项|处理口径"), "single_category_anchor").otherwise("single_evidence_anchor")
    found = F.coalesce(
        shape("cross_document_comparison", 2, [organisation(get(cross, 1)), organisation(get(cross, 2))], hint(get(cross, 3)), F.contains(q, F.lit("分别关注")) & q.rlike(cross) & (F.size("quotes") >= 2)),
        shape("same_document_two_matters", 2, [organisation(get(same, 1)), organisation(get(same, 1))], hint(get(same, 2)), q.rlike(same) & (F.size("quotes") >= 2)),
        shape("table_structured_lookup", 1, [organisation(get(table, 1))], F.lit("表格 清单"), q.rlike(table) & (F.size("quotes") >= 1)),
        shape(kind, 1, [org], hint(get(single, 2)), lone),
    )
    out = rows.select("query_id", F.posexplode(found).alias("sub_id", "s"))
    text = normalized(F.concat_ws(" ", *[F.when(F.col(f"s.{c}") != "", F.col(f"s.{c}")) for c in ("org_hint", "document", "evidence_hint")]))
    return out.select("query_id", "sub_id", text.alias("query_text"), "s.org_hint", "s.evidence_hint", "s.case_shape")


def source_query(subs: DataFrame, source: str) -> Column:
    """The text that a source is searched with for a sub-query: its evidence, but the whole of it for a category; a comparison searches terms with the four
    that say most."""
    own = F.coalesce(F.nullif("evidence_hint", F.lit("")), F.col("query_text"))
    if source not in ("indexed_sparse", "lexical", "structural"):
        return F.col("query_text")
    out = F.when(F.col("case_shape") == "single_category_anchor", F.col("query_text"))
    if source != "structural":
        out = out.when(F.col("case_shape") == "cross_document_comparison", strongest(own, 4))
    return out.otherwise(own)


def strongest(value: Column, n: int) -> Column:
    """The n terms of a text that come first by (has a digit, length, CJK characters, term), joined; the text itself without terms."""
    terms = F.filter(F.array_distinct(T.search_tokens(value)), lambda t: ~t.rlike(f"^([0-9]{{1,2}}|[{T.CJK}])$"))
    keyed = F.transform(terms, lambda t: F.struct(t.rlike("[0-9]").alias("d"), F.length(t).alias("l"), F.length(F.regexp_replace(t, f"[^{T.CJK}]", "")).alias("c"), t.alias("t")))
    best = F.slice(F.reverse(F.array_sort(keyed)), 1, n)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(best, lambda x: x.t), " ")).otherwise(value)


def source_limit(source: str, default: int, caps: dict[str, int]) -> Column:
    """How many hits a sub-query may bring: ``default``, or a cap for its shape (cross_document_comparison, table_structured_lookup, and single_anchor for a
    named organisation with evidence of six characters or more)."""
    if source not in ("indexed_sparse", "lexical"):
        return F.lit(default)
    anchored_ = F.col("case_shape").isin("single_evidence_anchor", "table_structured_lookup") & (T.text("org_hint") != "") & (F.length(T.compact("evidence_hint")) >= 6)
    cap = F.when(F.col("case_shape") == "cross_document_comparison", caps.get("cross_document_comparison"))
    if source == "indexed_sparse":
        cap = cap.when(F.col("case_shape") == "table_structured_lookup", caps.get("table_structured_lookup"))
    cap = cap.when(anchored_, caps.get("single_anchor"))
    return F.greatest(F.lit(1), F.least(F.lit(default), F.coalesce(cap, F.lit(default))))


def per_subquery_limit(total: int, n: Column, least: int = 4) -> Column:
    """An equal share of ``total`` for each of n sub-queries, at least ``least``."""
    return F.when(n <= 0, total).otherwise(F.least(F.lit(max(1, total)), F.greatest(F.lit(max(1, least)), F.ceil(F.lit(max(1, total)) / n)))).cast("int")


def pool_size(k: int) -> int:
    """How many candidates a source brings for k results."""
    return min(120, max(30, 8 * k))


def discriminators(value: Column | str) -> Column:
    """Dates, ordinals and codes that evidence has to repeat, compact and distinct."""
    found = F.flatten(F.array(*[F.regexp_extract_all(T.text(value), F.lit(f"({p})"), 1) for p in DISCRIMINATORS]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, T.compact), lambda t: F.length(t) >= 2)))


def table_pairs_of(value: Column | str) -> Column:
    """Array of compact (field, value) pairs that a text states with =, :, 为 or 是, from every place where a field can begin; of fields that end one another with
    one value, the longest."""
    t = T.text(value)
    # A field may begin at any character: each suffix that starts a match is tried, as the matches overlap.
    pattern = f"^({PAIR_FIELD}{{2,32}}?)\\s*(?:=|＝|:|：|为|是)\\s*[“”\"'‘’「」『』]?({PAIR_VALUE}{{2,80}})"
    starts = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
    tail = lambda i: F.substring(t, i, F.lit(120))
    pairs = F.transform(F.filter(starts, lambda i: tail(i).rlike(pattern)), lambda i: F.struct(T.compact(F.regexp_extract(tail(i), pattern, 1)).alias("field"), T.compact(F.regexp_extract(tail(i), pattern, 2)).alias("value")))
    pairs = F.array_distinct(F.filter(pairs, lambda p: (F.length(p.field) >= 2) & (F.length(p.value) >= 2)))
    return F.filter(pairs, lambda p: ~F.exists(pairs, lambda o: (o.value == p.value) & (o.field != p.field) & F.contains(o.field, p.field)))


def law_articles(queries: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(query_id, law, article): article numbers that follow the name of a law, up to the next name or, after the last, 80 characters. aliases: name -> the
    law's key; the longest name at a place counts."""
    names = "|".join(sorted(aliases, key=lambda a: (-len(a), a)))
    mapping = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    parts = F.split(F.regexp_replace(T.text("query_text"), f"({names})", "\u0001$1\u0002"), "\u0001")
    rows = queries.select("query_id", F.posexplode(parts).alias("pos", "part")).where(F.contains("part", F.lit("\u0002")))
    last = F.max("pos").over(W.partitionBy("query_id"))
    tail = F.split_part("part", F.lit("\u0002"), F.lit(2))
    rows = rows.select("query_id", F.element_at(mapping, F.split_part("part", F.lit("\u0002"), F.lit(1))).alias("law"), F.when(F.col("pos") == last, F.substring(tail, 1, 80)).otherwise(tail).alias("tail"))
    return rows.select("query_id", "law", F.explode(F.regexp_extract_all("tail", F.lit(f"({T.ARTICLE_PATTERN})"), 1)).alias("article")).distinct()
