"""Whether results can carry an answer, and which of them: relevance, refusal, conflicts and extractive answers, for all questions in one plan.

Results are the few chunks that a search gave each question, so lists gathered for a question are bounded by its pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import text as T
from .evidence import overlap_coefficient
from .rerank import META, NEGATIVE, REQUIREMENT, Rules, answers_requirement, expanded, features, pair_bonus, table_rows
from .retrieval import tie

# Fixed values.
STOP = (
    "what", "does", "the", "say", "about", "tell", "me", "is", "in", "a", "an", "of", "for", "and", "to", "should", "require", "requires",
    "document", "documents", "doc", "file", "handbook", "guide", "register", "runbook", "playbook", "manual", "policy", "文档", "手册", "指南",
    "登记", "台账", "流程", "规范",
)
#: What a question asks for, and what a table row that answers it holds.
TABLE_ANSWERS = (
    ("l4", "准入等级=l4"), ("高风险", "准入等级=l4高风险"), ("审批链路", "审批链路="), ("复核周期", "复核周期="), ("退出要求", "退出要求="), ("生产环境", "访问对象=生产环境"), ("生产环境", "可访问生产环境"),
    ("允许方式", "允许方式="), ("有效期", "有效期="), ("回收责任人", "回收责任人="), ("日志要求", "日志要求="), ("数据处理服务", "交付类型=数据处理服务"), ("验收材料", "验收材料="), ("验收人", "验收人="),
    ("保留", "保留期限="), ("客户手机号", "数据范围=包含客户手机号"), ("手机号", "数据范围=包含客户手机号"), ("审批", "审批人="), ("处理时限", "处理时限="), ("时限", "处理时限="), ("首次响应", "首次响应="),
    ("响应时间", "首次响应="), ("响应时间", "历史响应时间="), ("响应要求", "首次响应="), ("多久响应", "首次响应="), ("高优先级", "工单等级=p1"), ("高优先级", "问题类型=高优先级工单"), ("脱敏", "脱敏要求="),
    ("检查项", "版本更新检查清单"), ("必须", "是否必须=必须"), ("制度版本", "版本更新检查清单"), ("版本发生变化", "版本更新检查清单"),
)
CONFLICTS = "不一致|相冲突|冲突|另有规定|以本办法为准|废止|失效|不得适用"
MODAL = "必须|应当|需要|不得|应"
WEAK_TOP, WEAK_OVERLAP, PLAIN_OVERLAP, PLAIN_SCORE, WEAK_MEAN, STRONG = 0.28, 0.12, 0.18, 0.6, 0.22, 0.9
SAME_STRENGTH, CLEAR_OVERLAP, CONFLICT_GAP = 0.08, 0.24, 0.1


def _flat(value: Column | str) -> Column:
    return F.regexp_replace(T.fold(value), r"(?U)\s+", "")


def table_answer(question: Column | str, content: Column | str) -> Column:
    """Whether table rows hold at least two of the fields that a question asks for."""
    q, c = _flat(question), _flat(content)
    hits = sum(((F.contains(q, F.lit(a)) & F.contains(c, F.lit(b))).cast("int") for a, b in TABLE_ANSWERS[1:]), (F.contains(q, F.lit(TABLE_ANSWERS[0][0])) & F.contains(c, F.lit(TABLE_ANSWERS[0][1]))).cast("int"))
    return F.contains(T.text(content), F.lit("Table row:")) & (hits >= 2)


def with_relevance(results: DataFrame, rules: Rules | None = None) -> DataFrame:
    """results(query_id, query_text, position, chunk_id, document_id, document_title, section_title, content, fused, rerank, lexical_raw) with overlap, relevance
    (rerank or fused score, overlaps with text, title and section, fitting pairs, direct answers, deductions) and effective, the best of all scores."""
    rules = rules or Rules()
    own = lambda c: expanded(_flat(c), features(c, STOP), rules)
    whole = F.concat_ws(" ", *[F.nullif(T.text(c), F.lit("")) for c in ("document_title", "section_title", "content")])
    rows = results.withColumn("_fq", _flat("query_text")).withColumn("_fc", _flat("content")).withColumn("_fw", _flat(whole))
    rows = rows.withColumn("_q", expanded(F.col("_fq"), features("query_text", STOP), rules)).withColumn("_w", expanded(F.col("_fw"), features(whole, STOP), rules))
    rows = rows.withColumn("overlap", overlap_coefficient(F.col("_q"), F.col("_w")))
    rows = rows.withColumn("_t", own("document_title")).withColumn("_s", own("section_title"))
    over = lambda c: overlap_coefficient(F.col("_q"), F.col(c))
    needs, direct = F.col("_fq").rlike(REQUIREMENT), answers_requirement("content")
    add = lambda when, value: F.when(when, value).otherwise(0.0)
    score = F.coalesce("rerank", "fused") + F.col("overlap") * 0.18 + over("_t") * 0.08 + over("_s") * 0.04 + pair_bonus(F.col("_fq"), F.col("_fc"), rules)
    score = score + add(F.array_contains("_q", "p1") & F.array_contains("_w", "p1"), 0.08) + add(needs & direct, 0.36) - add(needs & F.col("_fc").rlike(NEGATIVE), 0.42) - add(needs & F.col("_fc").rlike(META) & ~direct, 0.85)
    rows = rows.withColumn("relevance", tie(score)).drop("_q", "_w", "_fq", "_fc", "_fw", "_t", "_s")
    return rows.withColumn("effective", F.greatest("fused", F.coalesce("rerank", F.lit(0.0)), "relevance"))


def relevant_results(scored: DataFrame, keep: int = 3) -> DataFrame:
    """Of each question's scored results, the ``keep`` that can carry an answer, with place. A first result that is a fitting table stands alone; else fitting tables of the
    first ten; else, of the first six (ten for questions with two or more quotes), one for each quote, and those that overlap, have lexical support or score well, and are not
    far behind the best in another document."""
    w = W.partitionBy("query_id")
    rows = scored.withColumn("_table", table_answer("query_text", "content")).withColumn("_quotes", F.slice(A.quoted("query_text"), 1, 3))
    rows = rows.withColumn("_alone", F.max(F.when(F.col("position") == 1, F.col("_table"))).over(w)).withColumn("_tables", F.max(F.when(F.col("position") <= 10, F.col("_table"))).over(w))
    plain = ~F.coalesce("_alone", F.lit(False)) & ~F.coalesce("_tables", F.lit(False))
    rows = rows.where(F.when(F.col("_alone"), F.col("position") == 1).when(F.col("_tables"), F.col("_table") & (F.col("position") <= 10)).otherwise(F.col("position") <= F.when(F.size("_quotes") >= 2, 10).otherwise(6)))
    order = [F.desc("relevance"), F.coalesce("rerank", "fused").desc(), F.desc("fused"), "position"]
    rows = rows.withColumn("_rank", F.when(plain, F.row_number().over(w.orderBy(*order))).otherwise(F.row_number().over(w.orderBy("position")))).withColumn("_plain", plain)
    top = lambda c: F.first(c).over(w.orderBy("_rank"))
    rows = rows.withColumn("_fused", top("fused")).withColumn("_doc", top("document_id")).withColumn("_best", top("relevance"))
    support, o, e = F.col("lexical_raw") > 0, F.col("overlap"), F.col("effective")
    weak = (o < WEAK_OVERLAP) & ~support & (e < STRONG)
    low = (F.col("fused") < F.greatest(F.lit(0.16), F.col("_fused") * 0.45)) & (o < PLAIN_OVERLAP) & ~support & (e < 0.95)
    denies = (F.col("relevance") < 0.18) & _flat("content").rlike(NEGATIVE)
    other = (F.col("document_id") != F.col("_doc")) & ((F.col("relevance") + 0.08 < F.col("_best")) | ((F.col("fused") < F.col("_fused") * 0.85) & (o < 0.22)))
    # The best-ranked result that holds a quote is kept for it.
    held = F.filter(F.transform("_quotes", lambda q, i: F.when(F.contains(T.compact("content"), T.compact(q)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_for", F.when(F.size("_quotes") >= 2, F.get(held, F.lit(0))))
    first = (F.col("_for").isNotNull()) & (F.row_number().over(W.partitionBy("query_id", "_for").orderBy("_rank")) == 1)
    rows = rows.withColumn("_kept", first)
    rows = rows.where(~F.col("_plain") | F.col("_kept") | ~(weak | low | denies | other))
    place = F.row_number().over(w.orderBy((~F.col("_kept")).cast("int"), "_rank"))
    rows = rows.withColumn("place", place).where(F.col("place") <= keep)
    return rows.drop("_table", "_quotes", "_alone", "_tables", "_rank", "_plain", "_fused", "_doc", "_best", "_for", "_kept")


def covered_quotes(relevant: DataFrame) -> DataFrame:
    """(query_id, n_covered): how many quoted spans of a question its relevant results hold."""
    rows = relevant.select("query_id", "content", F.explode(A.quoted("query_text")).alias("q")).where(F.contains(T.compact("content"), T.compact("q")))
    return rows.groupBy("query_id").agg(F.countDistinct("q").alias("n_covered"))


def decisions(queries: DataFrame, relevant: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(query_id, abstain, reason) for every question of queries(query_id): a target that can't be seen or has no results; no results; a weak best or mean; or two equally strong results of
    different documents that overlap little. relevant: of relevant_results; targets(query_id, found, n_hits) of questions that name a document."""
    one = relevant.groupBy("query_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("overlap"))).alias("o"), F.max(F.when(F.col("place") == 1, F.col("effective"))).alias("e"), F.max(F.when(F.col("place") == 1, F.col("lexical_raw"))).alias("x"), F.avg(F.when(F.col("place") <= 3, F.col("effective"))).alias("mean"),
        F.max(F.when(F.col("place") == 2, F.col("effective"))).alias("e2"), F.max(F.when(F.col("place") == 1, F.col("document_id"))).alias("d1"), F.max(F.when(F.col("place") == 2, F.col("document_id"))).alias("d2"), F.count("*").alias("n"),
    )
    rows = queries.select("query_id").join(one, "query_id", "left").join(covered_quotes(relevant), "query_id", "left")
    if targets is not None:
        rows = rows.join(targets.select("query_id", "found", "n_hits"), "query_id", "left")
    else:
        rows = rows.withColumn("found", F.lit(None).cast("boolean")).withColumn("n_hits", F.lit(None).cast("long"))
    c = F.col
    quoted = F.coalesce("n_covered", F.lit(0)) >= 2
    weak = (c("e") < WEAK_TOP) | ((c("o") < WEAK_OVERLAP) & (c("x") <= 0) & (c("e") < STRONG)) | ((c("o") < PLAIN_OVERLAP) & (c("e") < PLAIN_SCORE)) | (c("mean") < WEAK_MEAN)
    rivals = (c("n") >= 2) & (F.abs(c("e") - c("e2")) <= SAME_STRENGTH) & (c("d1") != c("d2")) & (c("o") < CLEAR_OVERLAP)
    reason = (
        F.when(~c("found"), "target_document_not_accessible_or_not_found").when(c("found") & (c("n_hits") == 0), "target_document_without_retrieval_hits").when(c("found"), "target_document_matched").when(c("n").isNull(), "no_retrieval_hits")
        .when(weak & ~quoted, "insufficient_relevant_evidence").when(F.coalesce(rivals, F.lit(False)), "conflicting_or_ambiguous_evidence").otherwise("relevant_evidence_found")
    )
    return rows.select("query_id", (~reason.isin("target_document_matched", "relevant_evidence_found")).alias("abstain"), reason.alias("reason"))


def conflicts(results: DataFrame) -> DataFrame:
    """(query_id, conflict): whether the first two results come from different documents, are about equally strong, and speak of a conflict."""
    pick = lambda p, v: F.max(F.when(F.col("position") == p, v))
    rows = results.where("position <= 2").groupBy("query_id").agg(pick(1, F.col("document_id")).alias("a"), pick(2, F.col("document_id")).alias("b"), pick(1, F.col("fused")).alias("x"), pick(2, F.col("fused")).alias("y"), F.max(_flat("content").rlike(CONFLICTS)).alias("said"))
    return rows.select("query_id", (F.col("b").isNotNull() & (F.col("a") != F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= CONFLICT_GAP) & F.col("said")).alias("conflict"))


def dominant_documents(chunks: DataFrame, margin: int = 2, strong: int = 4) -> DataFrame:
    """(query_id, document_id) where one document clearly holds most of what a question asks: chunks(query_id, document_id, facets array, score, n_asked). It holds all facets (four at most) and
    ``margin`` more than the next, or ``strong`` of them, more than the next and with a score .03 higher."""
    by = chunks.groupBy("query_id", "document_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("facets")))).alias("n"), F.max("score").alias("score"), F.count("*").alias("size"), F.max("n_asked").alias("asked"))
    w = W.partitionBy("query_id").orderBy(F.desc("n"), F.desc("score"), F.desc("size"), "document_id")
    rows = by.withColumn("r", F.row_number().over(w)).withColumn("n2", F.lead("n").over(w)).withColumn("s2", F.lead("score").over(w)).where("r = 1 and n2 is not null and asked >= 3")
    clear = ((F.col("n") >= F.least("asked", F.lit(4))) & (F.col("n") >= F.col("n2") + margin)) | ((F.col("n") >= strong) & (F.col("n") > F.col("n2")) & (F.col("score") >= F.col("s2") + 0.03))
    return rows.where(clear).select("query_id", "document_id")


def sentence_score(sentence: Column, terms: Column) -> Column:
    """2 for each long term of a question that a sentence has, 1 for each short one, 1 for a word of duty."""
    hit = lambda t: F.contains(F.lower(sentence), F.lower(t))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(hit(t), F.when(F.length(t) >= 4, 2).otherwise(1)).otherwise(0)) + F.when(sentence.rlike(MODAL), 1).otherwise(0)


def extractive_answers(relevant: DataFrame, per_chunk: int = 2, limit: int = 260) -> DataFrame:
    """(query_id, answer, n_chunks): for each of the relevant results its best sentences by sentence_score (ties to the earlier), in their order and cut to ``limit`` characters, marked with the place
    of their chunk; a chunk of table rows gives rows. What no sentence answers is not said."""
    terms = features("query_text", STOP)
    parts = F.filter(F.transform(F.split(F.regexp_replace(T.text("content"), "([。！？!?；;]|\\.(?=\\s)|\\n)", "$1\u0001"), "\u0001"), T.squeeze), lambda s: s != "")
    units = F.when(F.size(table_rows("content")) > 0, table_rows("content")).otherwise(parts)
    rows = relevant.select("query_id", "place", terms.alias("terms"), F.posexplode(units).alias("pos", "unit"))
    rows = rows.withColumn("score", sentence_score(F.col("unit"), F.col("terms"))).where("score > 0")
    best = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", "place").orderBy(F.desc("score"), "pos"))).where(F.col("n") <= per_chunk)
    chunk = best.groupBy("query_id", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit"))), lambda x: x.unit), " ").alias("t"))
    chunk = chunk.withColumn("t", F.concat(T.shorten("t", limit), F.lit(" ["), F.col("place").cast("string"), F.lit("]")))
    return chunk.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x.t), "\n").alias("answer"), F.count("*").alias("n_chunks"))


def table_field_answers(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, row_no, field, value): the fields of parsed table rows(query_id, row_no, row) that a question names, from the row that shares most of its values and fields with the
    question, ties to the first."""
    fields = T.table_row_fields("row")
    long = rows.join(questions, "query_id").select("query_id", "row_no", "query_text", F.explode(fields).alias("field", "value"))
    asked, named = F.contains(T.match_text("query_text"), T.match_text("field")), F.contains(T.match_text("query_text"), T.match_text("value"))
    long = long.withColumn("asked", asked & (T.match_text("field") != "")).withColumn("named", named & (T.match_text("value") != ""))
    best = long.groupBy("query_id", "row_no").agg((F.sum(F.col("named").cast("int")) * 2 + F.sum(F.col("asked").cast("int"))).alias("score"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row_no"))).where("n = 1 and score > 0")
    return long.where("asked").join(best.select("query_id", "row_no"), ["query_id", "row_no"]).select("query_id", "row_no", "field", "value")


def enforced_answers(answers: DataFrame, metrics: DataFrame, refusal: str) -> DataFrame:
    """answers(answer_id, answer, fallback) as (answer_id, answer, action): kept where no claim is unsupported, else the grounded fallback, else the refusal. metrics: of
    support.claim_support_metrics."""
    rows = answers.join(metrics.select("answer_id", "claim_count", "n_unsupported"), "answer_id", "left")
    bad = F.coalesce("n_unsupported", F.lit(0)) > 0
    action = F.when(~bad, "kept").when(T.text("fallback") != "", "regrounded").otherwise("refused")
    return rows.select("answer_id", F.when(action == "kept", F.col("answer")).when(action == "regrounded", F.col("fallback")).otherwise(refusal).alias("answer"), action.alias("action"))
