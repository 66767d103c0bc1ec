"""Reranking of fused candidates by features that a question and a chunk share, and the choice of what a reranker sees.

Rule sets (synonyms and pairs of words that belong together) are parameters of a few rows each; candidates are scored where they lie, and only
the final order shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add as plus
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import overlap_coefficient, terms
from .retrieval import tie, top_k

# Fixed values.
STOPWORDS = ("a", "an", "and", "are", "for", "how", "in", "is", "of", "on", "or", "the", "to", "what", "which")
CHINESE_STOP = ("什么", "怎么", "如何", "哪些", "一下", "关于", "里面", "要求", "内容", "需要", "规定", "说明", "相关", "里的", "文档", "手册", "指南", "登记")
#: If a text holds one of the words, its features also hold the others.
ENTERPRISE_SYNONYMS: tuple[tuple[str, str], ...] = (
    ("高优先级|高优先级工单|高优先|高优", "p1 p1工单 高优先级 高优先 工单"),
    ("首次响应", "首次响应 响应时间 响应时限"),
    ("数据导出", "数据导出 导出 审批 审批人 处理时限 脱敏要求"),
    ("客户手机号|手机号", "客户手机号 手机号 脱敏 敏感字段"),
    ("处理时限|时限|sla", "处理时限 时限 sla"),
    ("脱敏", "脱敏 敏感字段"),
    ("版本发生变化|(?=.*制度版本).*检查", "版本更新 版本更新检查清单 检查清单 检查项 是否必须 必须"),
    ("检查项", "检查清单 检查项 是否必须"),
    ("l4|高风险供应商", "l4 高风险 高风险供应商 准入等级 审批链路 复核周期 退出要求"),
    ("审批链路", "审批链路 审批人 负责人"),
    ("复核周期", "复核周期 复核"),
    ("退出要求", "退出要求 退出清单 账号回收 复盘记录"),
    ("生产环境", "生产环境 访问对象 允许方式 有效期 回收责任人 日志要求 l4"),
    ("允许方式", "允许方式 访问对象"),
    ("有效期", "有效期 最长"),
    ("回收责任人", "回收责任人 责任人"),
    ("日志要求", "日志要求 操作审计 事后复盘"),
    ("数据处理服务", "数据处理服务 交付类型 验收材料 验收人 保留期限"),
    ("验收材料|哪些材料", "验收材料 字段说明 脱敏方式 抽样检查结果"),
    ("验收人", "验收人 数据owner 信息安全负责人"),
    ("资料保留|保留多久", "保留期限 5年 归档位置"),
    ("周报", "weeklyreport"),
)
#: A pattern that the question has to meet, one for the text, and the bonus.
ENTERPRISE_PAIRS: tuple[tuple[str, str, float], ...] = (
    ("高优先级|高优先级工单|高优先|高优", "p1", 0.34),
    ("首次响应", "首次响应", 0.24),
    ("多少|多久|多长时间|时间要求|响应时间|响应时限|首次响应|要求|规定", "(?=.*(?:首次响应|响应时间|响应时限)).*([0-9]+|[一二三四五六七八九十两]+)(分钟|小时)", 0.18),
    ("工单", "工单", 0.06),
    ("(?=.*(?:出境|境外|跨境)).*重要数据", "(?=.*重要数据)(?=.*(?:向境外提供|境外提供|数据出境)).*安全评估", 0.46),
    ("(?=.*(?:出境|境外|跨境)).*个人信息", "(?=.*个人信息).*(?:向境外提供|境外提供|出境标准合同|个人信息保护认证)", 0.22),
)


class Rule(NamedTuple):
    """A bonus (or deduction) for a text that fits a question. asked, said: groups of words, of each of which one has to be there; pattern: what the text has to meet besides; unless: a word that it must not have;
    parent: the name of a rule that has to hold as well."""

    name: str
    asked: tuple[tuple[str, ...], ...]
    said: tuple[tuple[str, ...], ...]
    bonus: float
    parent: str = ""
    pattern: str = ""
    unless: str = ""


#: The rules of an enterprise's tables, a parent before its children.
ENTERPRISE_ALIGNMENT: tuple[Rule, ...] = (
    Rule("phone", (("客户手机号", "手机号"),), (("数据范围=包含客户手机号",),), 0.42),
    Rule("phone_limit", (), (("处理时限=",),), 0.12, "phone"),
    Rule("phone_masking", (), (("脱敏要求=",),), 0.12, "phone"),
    Rule("export", (("客户数据导出",),), (("事项=客户数据导出",),), 0.44),
    Rule("export_proof", (("证据",),), (("证据要求=",),), 0.18, "export"),
    Rule("export_approver", (("审批",),), (("审批人=",),), 0.12, "export"),
    Rule("export_limit", (("时限",),), (("时限=",),), 0.12, "export"),
    Rule("approval", (("审批",), ("谁", "审批人", "由谁", "负责人")), (), 0.0),
    Rule("approval_named", (), (), 0.3, "approval", "审批人=|共同审批|由[一-鿿a-z0-9=；;、,，和及与]{1,48}审批"),
    Rule("approval_archive", (), (("审批记录",), ("归档",)), -0.12, "approval", unless="共同审批"),
    Rule("access", (("临时高权限访问",),), (("事项=临时高权限访问",),), 0.44),
    Rule("access_approver", (("审批",),), (("审批人=",),), 0.12, "access"),
    Rule("access_limit", (("时限",),), (("时限=",),), 0.12, "access"),
    Rule("access_proof", (("证据",),), (("证据要求=",),), 0.12, "access"),
    Rule("scan", (("扫描a", "scana"),), (("编号=扫描a", "编号=scana"),), 0.48),
    Rule("scan_action", (("动作",),), (("动作=",),), 0.18, "scan"),
    Rule("checks", (("检查项", "哪些检查"),), (("版本更新检查清单",),), 0.42),
    Rule("checks_required", (), (("是否必须=必须",),), 0.12, "checks"),
    Rule("changed_version", (("制度版本发生变化",),), (("知识库维护动作",),), -0.12, unless="版本更新检查清单"),
    Rule("supplier", (("l4", "高风险供应商"),), (("准入等级=l4高风险",),), 0.52),
    Rule("supplier_approval", (), (("审批链路=",),), 0.14, "supplier"),
    Rule("supplier_review", (), (("复核周期=",),), 0.14, "supplier"),
    Rule("supplier_exit", (), (("退出要求=",),), 0.14, "supplier"),
    Rule("production", (("生产环境",),), (("访问对象=生产环境",),), 0.52),
    Rule("production_way", (), (("允许方式=",),), 0.1, "production"),
    Rule("production_term", (), (("有效期=",),), 0.1, "production"),
    Rule("production_owner", (), (("回收责任人=",),), 0.1, "production"),
    Rule("production_logs", (), (("日志要求=",),), 0.1, "production"),
    Rule("processing", (("数据处理服务",),), (("交付类型=数据处理服务",),), 0.52),
    Rule("processing_material", (), (("验收材料=",),), 0.14, "processing"),
    Rule("processing_acceptor", (), (("验收人=",),), 0.14, "processing"),
    Rule("processing_retention", (), (("保留期限=",),), 0.14, "processing"),
)
NEGATIVE = "没有定义|未定义|未提及|未涉及|不涉及|不包含|无法确认|无法判断"
META = "本文档用于演示|为了方便测试|为了方便上传后立即测试|你可以尝试以下问题|faq入库前需要检查|文档目的"
REQUIREMENT = "多少|多久|多长时间|时间要求|响应时间|响应时限|首次响应|要求|规定"
LISTING = "包括哪些|有哪些|哪几类|哪几种|种类|类型|清单|列表"
RESERVED_SOURCES = ("document_expansion", "document_neighbor_context", "document_first_evidence", "document_sweep")
PREVIEW, TABLE_PREVIEW, TABLE_INTRO, ROWS = 600, 800, 160, (2, 4)

_NONE = "array<string>"


@dataclass
class Rules:
    """Synonyms, pairs and alignment rules of a domain."""

    synonyms: Sequence[tuple[str, str]] = field(default=ENTERPRISE_SYNONYMS)
    pairs: Sequence[tuple[str, str, float]] = field(default=ENTERPRISE_PAIRS)
    alignment: Sequence[Rule] = field(default=ENTERPRISE_ALIGNMENT)


def _flat(value: Column | str) -> Column:
    return F.regexp_replace(T.fold(value), r"(?U)\s+", "")


def features(value: Column | str, stop_words: Sequence[str] = (*STOPWORDS, *CHINESE_STOP)) -> Column:
    """Distinct Latin words that are no stop words, CJK runs of up to four characters, and 2- and 3-grams of CJK runs."""
    stop = F.array(*[F.lit(s) for s in stop_words])
    runs = F.filter(F.regexp_extract_all(T.fold(value), F.lit(f"([{T.CJK}]+)"), 1), lambda r: F.length(r) <= 4)
    return F.array_except(F.array_distinct(F.concat(terms(value, (2, 3)), runs)), stop)


def expanded(flat: Column, own: Column, rules: Rules) -> Column:
    """Features with the synonyms of the rules that a text, given folded and without white space, meets."""
    if not rules.synonyms:
        return own
    more = F.flatten(F.array(*[F.when(flat.rlike(when), F.split(F.lit(words), " ")).otherwise(F.array().cast(_NONE)) for when, words in rules.synonyms]))
    return F.array_union(own, more)


def holding(question: Column, value: Column, alignment: Sequence[Rule]) -> dict[str, Column]:
    """For each alignment rule whether a question and a text, both folded and without white space, meet it and its parents."""
    groups = lambda text, words: reduce(and_, [reduce(or_, [F.contains(text, F.lit(w)) for w in one]) for one in words], F.lit(True))
    made: dict[str, Column] = {}
    for r in alignment:
        holds = groups(question, r.asked) & groups(value, r.said)
        holds = holds & value.rlike(r.pattern) if r.pattern else holds
        holds = holds & ~F.contains(value, F.lit(r.unless)) if r.unless else holds
        made[r.name] = made[r.parent] & holds if r.parent else holds
    return made


def alignment_bonus(question: Column, value: Column, alignment: Sequence[Rule]) -> Column:
    """Sum of the bonuses of the alignment rules that hold."""
    holds = holding(question, value, alignment)
    return reduce(plus, [F.when(holds[r.name], r.bonus).otherwise(0.0) for r in alignment if r.bonus], F.lit(0.0))


def pair_bonus(question: Column, value: Column, rules: Rules) -> Column:
    """Sum of the bonuses of the pairs and alignment rules that a question and a text, both folded and without white space, meet."""
    out = F.lit(0.0)
    for asked, said, bonus in rules.pairs:
        out = out + F.when(question.rlike(asked) & value.rlike(said), bonus).otherwise(0.0)
    # Every rule needs one of its words in the question: most questions have none, and then no rule is looked at.
    words = sorted({w for r in rules.alignment if not r.parent for one in r.asked[:1] for w in one})
    if not words:
        return out
    some = reduce(or_, [F.contains(question, F.lit(w)) for w in words])
    return out + F.when(some, alignment_bonus(question, value, rules.alignment)).otherwise(0.0)


def structural_blocks(value: Column | str) -> Column:
    """The text's lines as blocks: a table row, an article, a clause, a heading or a numbered title begins one; each joined by blanks."""
    lines = F.filter(F.transform(F.split(T.text(value), "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    number = "第[一二三四五六七八九十百千万零〇两0-9]+条(?:之[一二三四五六七八九十百千万零〇两0-9]+)?"
    begins = rf"^(?:Table row:.*|(?:#{{1,6}}\s*)?{number}|条款全称：.*|#{{1,6}}\s+\S.*|(?:[一二三四五六七八九十]+、|[0-9]+[.、])\S{{2,40}})$"
    marked = F.transform(lines, lambda x: F.when(x.rlike(begins), F.concat(F.lit("\u0001"), x)).otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), "\u0001"), lambda b: F.trim(b)), lambda b: b != "")


def block_score(question: Column, content: Column | str, wanted: Column, rules: Rules) -> Column:
    """The best block of a content: overlap, a part of its pair bonus, and .08 for a clause or an article; 1.5 at most. question: folded, without white space."""
    # What the rules look at is made once for each block.
    blocks = F.transform(structural_blocks(content), lambda b: F.struct(b.alias("text"), _flat(b).alias("flat"), features(b).alias("own")))
    blocks = F.transform(blocks, lambda b: F.struct(b.text.alias("text"), b.flat.alias("flat"), expanded(b.flat, b.own, rules).alias("all")))

    def one(b: Column) -> Column:
        bonus = F.least(pair_bonus(question, b.flat, rules), F.lit(0.9)) / 1.6
        legal = F.when(b.text.rlike("条款全称|第[一二三四五六七八九十百千万零〇两0-9]+条"), 0.08).otherwise(0.0)
        return overlap_coefficient(wanted, b["all"]) + bonus + legal

    return F.least(F.coalesce(F.array_max(F.transform(blocks, one)), F.lit(0.0)), F.lit(1.5))


def answers_requirement(value: Column | str) -> Column:
    """Whether a text states a requirement: a quantity of time or items, or a word of duty, and no word that denies one."""
    v = _flat(value)
    return ~v.rlike(NEGATIVE) & ~v.rlike(META) & (v.rlike("([0-9]+|[一二三四五六七八九十两]+)(分钟|小时|天|项)") | v.rlike("必须|需要|应当|需在"))


def answers_list(question: Column | str, value: Column | str) -> Column:
    """Whether a text enumerates what a question asks for."""
    q, v, raw = _flat(question), _flat(value), T.text(value)
    counted = (F.regexp_count(raw, F.lit(r"[（(][一二三四五六七八九十0-9]+[）)]")) >= 2) | (F.regexp_count(raw, F.lit("[；;]")) >= 2)
    return counted & F.when(q.rlike("种类|类型"), v.rlike("(种类|类型)(为|包括|有|分为)")).otherwise(v.rlike("包括下列|包括以下|如下|下列|分为"))


def heuristic_rerank(candidates: DataFrame, k: int, rules: Rules | None = None, target: str | None = None) -> DataFrame:
    """The k best of candidates(query_id, query_text, chunk_id, chunk_index, document_title, content, fused, lexical_raw, sources, and any of section_title,
    clause_full_name, article_number, heading_path) by fused score, overlaps with text, title, section, structure and blocks, fitting
    pairs, direct answers, and deductions for texts that deny or only talk about an answer. target: a boolean column for the document that the
    question means."""
    rules = rules or Rules()
    has = lambda c: F.col(c) if c in candidates.columns else F.lit("")
    structure = F.concat_ws(" ", *[F.nullif(T.text(has(c)), F.lit("")) for c in ("clause_full_name", "article_number", "heading_path")])
    whole = F.concat_ws(" ", T.text("document_title"), *[F.nullif(T.text(has(c)), F.lit("")) for c in ("section_title", "clause_full_name", "article_number", "heading_path")], F.substring(T.text("content"), 1, 1600))
    titles = F.array_join(F.regexp_extract_all(T.text("content"), F.lit("(?:条款全称|章节|小节|标题|流程节点|审批条件|例外条件)[:：]\\s*([^\\n\\r]{2,120})"), 1), " ")
    rows = candidates.withColumn("_fq", _flat("query_text")).withColumn("_fw", _flat(whole)).withColumn("_fc", _flat("content"))
    rows = rows.withColumn("_q", expanded(F.col("_fq"), features("query_text"), rules)).withColumn("_c", expanded(F.col("_fw"), features(whole), rules))
    # Each feature set is a column of its own: overlaps read it several times.
    sets = {"_title": "document_title", "_section": has("section_title"), "_structure": structure, "_named": titles}
    rows = rows.withColumns({f"{k}_f": features(v) for k, v in sets.items()}).withColumn("_all", overlap_coefficient(F.col("_q"), F.col("_c")))
    rows = rows.withColumns({k: overlap_coefficient(F.col("_q"), F.col(f"{k}_f")) for k in sets}).drop(*[f"{k}_f" for k in sets]).withColumn("_block", block_score(F.col("_fq"), "content", F.col("_q"), rules))
    c = F.col
    lexical = c("lexical_raw") > 0
    add = lambda when, bonus: F.when(when, bonus).otherwise(0.0)
    needs, lists = c("_fq").rlike(REQUIREMENT), c("_fq").rlike(LISTING)
    direct, flat = answers_requirement("content"), c("_fc")
    placed = (c("_title") >= 0.22) | (c("_section") >= 0.22) | (c("_structure") >= 0.22) | (c("_named") >= 0.22)
    score = (
        c("fused") + c("_all") * 0.22 + c("_title") * 0.12 + c("_section") * 0.06 + c("_structure") * 0.18 + c("_named") * 0.14 + c("_block") * 0.56
        + add(lexical, 0.04) + add((c("_section") >= 0.2) | (c("_structure") >= 0.2) | (c("_named") >= 0.2) | (c("_block") >= 0.2), 0.08)
        + add(F.array_contains("sources", "structural"), 0.08) + add(c("_block") >= 0.5, 0.12) + add(F.contains("content", F.lit("Table row:")) & (c("_all") >= 0.16), 0.22)
        + (add(c(target), 0.08) if target else F.lit(0.0)) + pair_bonus(c("_fq"), c("_fc"), rules) + add(F.array_contains("_q", "p1") & F.array_contains("_c", "p1"), 0.08)
        + add(needs & direct, 0.36) + add(lists & placed & answers_list("query_text", "content"), 0.65) - add(needs & flat.rlike(NEGATIVE), 0.42) - add(needs & flat.rlike(META) & ~direct, 0.85)
        - add((c("_all") < 0.08) & ~lexical, 0.09) - add((c("_all") < 0.12) & (c("_title") == 0) & (c("_section") == 0) & (c("fused") < 0.35), 0.06)
    )
    rows = rows.withColumn("rerank", tie(score)).drop("_fq", "_fw", "_fc", "_q", "_c", "_all", "_title", "_section", "_structure", "_named", "_block")
    return top_k(rows, k, score="rerank", ties=(F.desc("fused"), F.desc("lexical_raw"), "chunk_index", "chunk_id"))


def rerank_pool(candidates: DataFrame, limit: int) -> DataFrame:
    """Which ``limit`` of candidates(query_id, chunk_id, chunk_index, fused, lexical_raw, vector_raw, sources) a costly reranker sees: half by fused score; the reserve (32
    at most) is shared evenly by the evidence sources, each by lexical score; what is left goes to other evidence, then to the rest."""
    w = W.partitionBy("query_id")
    general = [F.desc("fused"), F.desc("lexical_raw"), F.desc("vector_raw"), "chunk_index", "chunk_id"]
    evident = [F.desc("lexical_raw"), F.desc("fused"), F.desc("vector_raw"), "chunk_index", "chunk_id"]
    reserve = min(max(limit // 2, 1), 32)
    rows = candidates.withColumn("_n", F.row_number().over(w.orderBy(*general))).withColumn("_size", F.count("*").over(w))
    rows = rows.withColumn("_first", (F.col("_n") <= limit - reserve) | (F.col("_size") <= limit))
    # Each open candidate counts for the first of its sources; per source, an even share of the reserve.
    own = F.filter(F.array(*[F.lit(s) for s in RESERVED_SOURCES]), lambda s: F.array_contains("sources", s))
    rows = rows.withColumn("_source", F.when(~F.col("_first"), F.get(own, F.lit(0))))
    active = F.size(F.collect_set("_source").over(w))
    turn = F.row_number().over(W.partitionBy("query_id", "_source").orderBy(*evident))
    share = F.ceil(F.lit(reserve) / F.greatest(active, F.lit(1)))
    rows = rows.withColumn("_tier", F.when(F.col("_first"), 0).when(F.col("_source").isNotNull() & (turn <= share), 1).when(F.col("_source").isNotNull(), 2).otherwise(3))
    place = F.array_position(F.array(*[F.lit(s) for s in RESERVED_SOURCES]), F.col("_source"))
    within = F.row_number().over(W.partitionBy("query_id", "_tier").orderBy(F.when(F.col("_tier") == 1, place), *[F.when(F.col("_tier").isin(1, 2), -F.col(x)) for x in ("lexical_raw", "fused")], *general))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("_tier", within)))
    return rows.where(F.col("place") <= limit).drop("_n", "_size", "_first", "_source", "_tier")


def table_rows(value: Column | str) -> Column:
    """The table rows of a content, squeezed, from each "Table row:" to the next."""
    parts = F.split(F.regexp_replace(T.text(value), "Table row:", "\u0001Table row:"), "\u0001")
    return F.filter(F.transform(parts, T.squeeze), lambda p: F.startswith(p, F.lit("Table row:")))


def relevant_rows(question: Column | str, rows: Column, rules: Rules | None = None) -> Column:
    """The two to four rows that fit a question best (10 x overlap, .3 for each of its features that the row spells, pairs), in their order."""
    rules = rules or Rules()
    asked = _flat(question)
    wanted = expanded(asked, features(question), rules)

    def scored(row: Column, i: Column) -> Column:
        hits = F.size(F.filter(wanted, lambda t: (F.length(t) >= 2) & F.contains(asked, t) & F.contains(_flat(row), t)))
        score = overlap_coefficient(wanted, expanded(_flat(row), features(row), rules)) * 10 + hits * 0.3 + pair_bonus(asked, _flat(row), rules)
        return F.struct((-F.round(score, 9)).alias("s"), i.alias("i"), row.alias("row"))

    ranked = F.array_sort(F.transform(rows, scored))
    good = F.size(F.filter(ranked, lambda x: x.s < 0))
    n = F.least(F.size(rows), F.lit(ROWS[1]), F.greatest(F.lit(ROWS[0]), F.when(good > 0, good).otherwise(ROWS[0])))
    best = F.array_sort(F.transform(F.slice(ranked, F.lit(1), F.greatest(n, F.lit(1))), lambda x: F.struct(x.i.alias("i"), x.row.alias("row"))))
    return F.when(F.size(rows) <= 1, rows).otherwise(F.transform(best, lambda x: x.row))


def content_preview(question: Column | str, content: Column | str, rules: Rules | None = None) -> Column:
    """What a reranker is shown: the beginning of a text; of a table, what stands before it and the rows that fit."""
    rows = table_rows(content)
    intro = T.squeeze(F.split_part(T.text(content), F.lit("Table row:"), F.lit(1)))
    intro = F.when(intro != "", F.array(F.rtrim(F.substring(intro, 1, TABLE_INTRO)))).otherwise(F.array().cast(_NONE))
    table = F.rtrim(F.substring(F.array_join(F.concat(intro, relevant_rows(question, rows, rules)), "\n"), 1, TABLE_PREVIEW))
    return F.when(F.size(rows) > 0, table).otherwise(F.rtrim(F.substring(T.squeeze(content), 1, PREVIEW)))


def provider_order(candidates: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Candidates in the order of a reranking service: answers(query_id, payload: JSON with results, or output.results, of index or document_index and relevance_score or score)
    say places in candidates(query_id, position from 0, chunk_id, fused, chunk_index); what the service leaves out follows by fused score. Scores
    that are no finite numbers are left out; a query without an answer keeps its fused order, strategy says which."""
    item = "array<struct<index:int,document_index:int,relevance_score:string,score:string>>"
    parsed = F.from_json("payload", f"results {item}, output struct<results {item}>")
    rows = answers.select("query_id", F.explode(F.coalesce(parsed.results, parsed.output.results)).alias("r"))
    score = F.expr("try_cast(coalesce(r.relevance_score, r.score) as double)")
    rows = rows.select("query_id", F.coalesce("r.index", "r.document_index").alias("position"), score.alias("provider_score")).where("provider_score is not null and not isnan(provider_score) and abs(provider_score) < double('Infinity')")
    rows = rows.groupBy("query_id", "position").agg(F.max("provider_score").alias("provider_score"))
    out = candidates.join(rows, ["query_id", "position"], "left")
    seen = F.max("provider_score").over(W.partitionBy("query_id")).isNotNull()
    out = out.withColumn("strategy", F.when(seen, "provider").otherwise("fallback"))
    order = W.partitionBy("query_id").orderBy(F.col("provider_score").desc_nulls_last(), F.desc("fused"), "chunk_index", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
