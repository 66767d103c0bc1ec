"""How far evidence supports an answer: claims, facts, numbers, key-value pairs, and the metrics made of them.

Text parts are column expressions; only the longest common substring is an Arrow function, over pairs that a join made.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from .evaluation import f1
from .evidence import ALIAS_SEPARATORS, claims, fact_coverage, share_found, support_status

# Fixed values.
NUMBER_PATTERNS = (
    r"[0-9]{4}[-/年][0-9]{1,2}(?:[-/月][0-9]{1,2}日?)?",
    r"[0-9]+(?:\.[0-9]+)?\s*(?:%|％|个工作日|工作日|分钟内|小时内|日内|天内|分钟|小时|个月|月|天|日|年|万元|亿元|元|人|次|条|份|级|类)",
    r"[一二两三四五六七八九十百千]+(?:个)?(?:工作日|分钟内|小时内|日内|天内|分钟|小时|个月|月|天|日|年)",
)
SUPPORT_STOP = (
    "根据", "当前", "可访问", "文档", "证据", "主要", "这个", "场景", "相关", "要求", "说明", "包括", "包含", "以及", "同时", "其中",
    "应当", "需要", "必须", "可以", "进行", "通过", "如果", "对于", "里面", "条款",
)
PART_WORDS = "的|了|在|和|与|及|或|并|对|中|里|为|是|由|将|把|向|于"
RELATIONS = (
    "需要", "必须", "应", "不得", "禁止", "负责", "审批", "提交", "保留", "关闭", "回收", "升级", "建立", "明确", "同步", "补齐",
    "脱敏", "导出", "执行", "处理", "验收", "复核", "通知",
)
PAIR_PATTERNS = (
    "([一-鿿A-Za-z0-9]{2,18}?)(?:为|是|包括|包含)([^；;。,.，]{2,60})",
    "(账号)(?:应在|需要在)([^；;。,.，]{2,60})",
    "(导出文件|文件)(?:禁止通过|不得通过)([^；;。,.，]{2,60})",
    "(紧急场景|临时场景)(?:下)?可以先([^；;。,.，]{2,60})",
    "(先同步|同步)([^；;。,.，]{2,60})",
)
TOKEN_WEIGHT, ORDER_WEIGHT, COMMON_WEIGHT = 0.55, 0.25, 0.20
KEY_WEIGHT, VALUE_WEIGHT = 0.35, 0.65
ALL_MISSING_CAP, SOME_MISSING_CAP, WEAK_RECALL, WEAK_ORDER = 0.35, 0.65, 0.28, 0.34
EVIDENCE_FIELDS = ("document_title", "section_title", "heading_path", "clause_full_name", "article_number", "preview", "content")

_NONE = "array<string>"


def all_matches(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(f"({pattern})"), 1)


def numeric_constraints(value: Column | str) -> Column:
    """Dates and quantities with a unit that a text names, each once, pattern by pattern."""
    t = T.text(value)
    return F.array_distinct(F.transform(F.concat(*[all_matches(t, p) for p in NUMBER_PATTERNS]), lambda x: F.trim(x)))


def support_tokens(value: Column | str) -> Column:
    """What a text asserts, as distinct tokens: its constraints, Latin words of two characters or more, and the parts of its CJK
    runs between function words, with 2- to 4-grams of longer ones."""
    low = T.fold(value)
    stop = F.array(*[F.lit(s) for s in SUPPORT_STOP])
    parts = F.flatten(F.transform(all_matches(low, f"[{T.CJK}]{{2,}}"), lambda run: F.filter(F.split(run, PART_WORDS), lambda p: (F.length(p) >= 2) & ~F.array_contains(stop, p))))
    grams = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 4, F.concat(F.array(p), *[T._grams(p, n) for n in (2, 3, 4)])).otherwise(F.array(p))))
    tokens = F.concat(F.transform(numeric_constraints(value), T.match_text), all_matches(low, "[a-z0-9]{2,}"), grams)
    return F.array_except(F.filter(F.array_distinct(tokens), lambda x: x != ""), stop)


def clause_parts(claim: Column | str) -> Column:
    return F.filter(F.transform(F.split(T.fold(claim), ALIAS_SEPARATORS), T.match_text), lambda p: F.length(p) >= 4)


def ordered_support(parts: Column, flat: Column) -> Column:
    """Share of a claim's clause parts (4 characters or more) that a normalised text has one after the other."""
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("hits"))

    def step(s, p):
        place = F.call_function("locate", p, flat, s["at"])
        return F.struct(F.when(place > 0, place + F.length(p)).otherwise(s["at"]).cast("int").alias("at"), (s["hits"] + (place > 0).cast("int")).alias("hits"))

    return F.when(F.size(parts) > 0, F.aggregate(parts, start, step, lambda s: s["hits"]) / F.size(parts)).otherwise(0.0)


def relations(value: Column | str) -> Column:
    t = T.text(value)
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(r)), r) for r in RELATIONS]))


def key_values(value: Column | str) -> Column:
    """Array of (k, v): "key=value" and "key:value" pairs, whose values reach to the next key, and stated ones ("key is value");
    the first of equal pairs."""
    t = T.text(value)
    strip = lambda x: F.regexp_replace(x, "^[ ，,；;。]+|[ ，,；;。]+$", "")
    marked = F.split(F.regexp_replace(F.regexp_replace(t, "[：:]", "="), "([^=;；。,\\n]{2,32}?)=", "\u0001$1\u0002"), "\u0001")
    named = F.transform(F.filter(marked, lambda p: F.contains(p, F.lit("\u0002"))), lambda p: F.struct(strip(F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("k"), strip(F.split_part(p, F.lit("\u0002"), F.lit(2))).alias("v")))
    named = F.filter(named, lambda x: (x.k != "") & (F.length(T.match_text(x.v)) >= 2))
    stated = [F.zip_with(F.regexp_extract_all(t, F.lit(p), 1), F.regexp_extract_all(t, F.lit(p), 2), lambda k, v: F.struct(F.trim(k).alias("k"), strip(v).alias("v"))) for p in PAIR_PATTERNS]
    every = F.filter(F.concat(named, *stated), lambda x: (x.k != "") & (x.v != ""))
    keyed = F.transform(every, lambda x: F.struct(x.k.alias("k"), x.v.alias("v"), F.concat_ws("\u0001", T.match_text(x.k), T.match_text(x.v)).alias("key")))
    first = lambda made: T.let(F.transform(made, lambda x: x.key), lambda keys: F.filter(made, lambda x, i: F.array_position(keys, x.key) == i + 1))
    return F.transform(T.let(keyed, first), lambda x: F.struct(x.k.alias("k"), x.v.alias("v")))


def pair_tokens(value: Column | str) -> Column:
    """The key_values of a text as (k, v, flat): tokens of the key and of the value, and the normalised value."""
    return F.transform(key_values(value), lambda x: F.struct(support_tokens(x.k).alias("k"), support_tokens(x.v).alias("v"), T.match_text(x.v).alias("flat")))


def structured_support(mine: Column, theirs: Column) -> Column:
    """Mean over a claim's pairs of the best .35 key + .65 value agreement with a pair of the evidence; 0 without pairs. Both: of pair_tokens."""

    def best(c):
        def score(e):
            held = (c.flat != "") & F.contains(e.flat, c.flat)
            value = F.when(held, 1.0).otherwise(share_found(c.v, e.v))
            return KEY_WEIGHT * share_found(c.k, e.k) + VALUE_WEIGHT * value

        return F.coalesce(F.array_max(F.transform(theirs, score)), F.lit(0.0))

    total = F.aggregate(F.transform(mine, best), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(mine) > 0, T.clamp(total / F.size(mine))).otherwise(0.0)


def _common(a: str, b: str) -> int:
    """Length of the longest common substring: it grows at each place of the first text for as long as the second holds the piece."""
    n = 0
    for i in range(len(a)):
        while i + n < len(a) and a[i : i + n + 1] in b:
            n += 1
    return n


@F.pandas_udf(DoubleType())
def common_ratio(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    """Longest common substring over the claim's length."""
    return pd.Series([_common(c, e) / len(c) if c and e else 0.0 for c, e in zip(claim, evidence, strict=True)])


def with_claim_features(rows: DataFrame) -> DataFrame:
    """rows(claim, ...) with what claim_scores reads off a claim."""
    rows = rows.withColumn("_c", T.match_text("claim")).withColumn("_c_tokens", support_tokens("claim")).withColumn("_c_parts", clause_parts("claim")).withColumn("_c_pairs", pair_tokens("claim"))
    return rows.withColumn("_numbers", F.transform(numeric_constraints("claim"), T.match_text)).withColumn("_c_relations", relations("claim"))


def with_content_features(rows: DataFrame) -> DataFrame:
    """rows(content, ...) with what claim_scores reads off a piece of evidence."""
    return rows.withColumn("_e", T.match_text("content")).withColumn("_e_tokens", support_tokens("content")).withColumn("_e_pairs", pair_tokens("content")).withColumn("_e_relations", relations("content"))


def claim_scores(pairs: DataFrame) -> DataFrame:
    """pairs(claim, content, ...) with score: 1 where the evidence holds the claim, else the larger of structured support and .55
    token recall + .25 ordered parts + .20 longest common part, capped where numbers or all relation words are missing or the
    overlap is only topical. Features of the two sides that are there already are taken as they are."""
    rows = pairs if "_c" in pairs.columns else with_claim_features(pairs)
    rows = rows if "_e" in rows.columns else with_content_features(rows)
    features = [c for c in rows.columns if c.startswith(("_c", "_e", "_numbers"))]
    rows = rows.withColumn("_long", common_ratio("_c", "_e"))
    rows = rows.withColumn("_recall", share_found(F.col("_c_tokens"), F.col("_e_tokens"))).withColumn("_order", ordered_support(F.col("_c_parts"), F.col("_e")))
    rows = rows.withColumn("_pairs", structured_support(F.col("_c_pairs"), F.col("_e_pairs")))
    missing = F.size(F.filter("_numbers", lambda x: ~F.contains(F.col("_e"), x)))
    blend = TOKEN_WEIGHT * F.col("_recall") + ORDER_WEIGHT * F.col("_order") + COMMON_WEIGHT * F.col("_long")
    score = F.greatest("_pairs", blend)
    score = F.when(missing == 0, score).otherwise(F.least(score, F.when(missing == F.size("_numbers"), ALL_MISSING_CAP).otherwise(SOME_MISSING_CAP)))
    strange = (F.size("_c_relations") > 0) & (F.size(F.array_intersect("_c_relations", "_e_relations")) == 0)
    score = F.when(strange, F.least(score, F.lit(SOME_MISSING_CAP))).otherwise(score)
    weak = (F.col("_pairs") <= 0) & (F.col("_recall") < WEAK_RECALL) & (F.col("_order") < WEAK_ORDER)
    score = F.when(weak, F.least(score, F.lit(ALL_MISSING_CAP))).otherwise(score)
    score = F.when((F.col("_c") == "") | (F.col("_e") == ""), 0.0).when(F.contains("_e", F.col("_c")), 1.0).otherwise(T.clamp(score))
    return rows.withColumn("score", score).drop(*features, "_long", "_recall", "_order", "_pairs")


def evidence_text(chunks: DataFrame) -> Column:
    """The fields of a chunk that speak for it, one after the other."""
    return F.concat_ws(" ", *[F.when(F.trim(T.text(f)) != "", F.col(f)) for f in EVIDENCE_FIELDS if f in chunks.columns])


def answer_claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, claim) of answers(answer_id, answer)."""
    return answers.select("answer_id", F.posexplode(claims("answer")).alias("claim_no", "claim"))


def answer_claim_support(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers(answer_id, answer) and evidence(answer_id, chunk_id, content) as (answer_id, claim_no, claim, best, chunk_id, status):
    each claim's best evidence, ties to the smaller chunk_id; claims with which no evidence shares anything have no chunk."""
    # Few bytes, much work: both sides are dealt to all tasks, and each text is taken apart once, before it meets others.
    tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    claim = answer_claims(answers.repartition(tasks, "answer_id"))
    own = with_content_features(evidence.select("answer_id", "chunk_id", "content").repartition(tasks, "answer_id"))
    scored = claim_scores(with_claim_features(claim).join(own, "answer_id"))
    best = scored.where("score > 0").groupBy("answer_id", "claim_no").agg(F.max("score").alias("best"), F.min_by("chunk_id", F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("chunk_id"))
    rows = claim.join(best, ["answer_id", "claim_no"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return rows.withColumn("status", support_status(F.col("best")))


def claim_support_metrics(scored: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Per answer: claim_count, score (mean of best support), unsupported claims (under .5), and the overall status of an evidence audit. Answers
    without a claim have none of either."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    made = scored.groupBy("answer_id").agg(
        F.count("*").alias("claim_count"), T.clamp(F.avg("best")).alias("score"), F.sort_array(F.collect_list(F.when(F.col("best") < 0.5, F.col("claim")))).alias("unsupported_claims"),
        count("supported").alias("n_supported"), count("partial").alias("n_partial"), count("unsupported").alias("n_unsupported"),
    )
    if answers is not None:
        made = answers.select("answer_id").join(made, "answer_id", "left").fillna(0, ["claim_count", "n_supported", "n_partial", "n_unsupported"]).fillna(0.0, ["score"])
    return made.withColumn("overall_status", overall_status(F.col("n_supported"), F.col("n_partial"), F.col("n_unsupported")))


def overall_status(supported: Column, partial: Column, unsupported: Column) -> Column:
    return F.when(unsupported > 0, "needs_review").when(partial > 0, "partial").when(supported > 0, "supported").otherwise("not_applicable")


def fact_support(cases: DataFrame) -> DataFrame:
    """cases(case_id, specs, answer, evidence) with the weighted precision, recall and F1 of the facts that both the answer and its
    evidence hold. Cases without facts have 1 for each."""
    rows = cases.withColumn("_a", fact_coverage(F.col("specs"), F.col("answer"))).withColumn("_e", fact_coverage(F.col("specs"), F.col("evidence")))
    weight = lambda keep: F.aggregate(F.filter("specs", keep), F.lit(0.0), lambda a, s: a + s.weight)
    said, known = (lambda s: F.array_contains("_a.matched", s.label)), (lambda s: F.array_contains("_e.matched", s.label))
    total, answered, both = weight(lambda s: F.lit(True)), weight(said), weight(lambda s: said(s) & known(s))
    p = F.when(answered > 0, both / answered).otherwise(0.0)
    r = F.when(total > 0, both / total).otherwise(0.0)
    one = lambda x: F.when(total > 0, T.clamp(x)).otherwise(1.0)
    return rows.select(
        "case_id", one(p).alias("support_precision"), one(r).alias("support_recall"), one(f1(p, r)).alias("support_f1"), F.col("_a.coverage").alias("answer_fact_recall"), F.col("_e.coverage").alias("evidence_fact_recall"),
        F.array_intersect("_a.matched", "_e.matched").alias("supported"), F.array_except("_a.matched", "_e.matched").alias("unsupported"), F.array_except("_e.matched", "_a.matched").alias("evidence_only"),
    )


def citation_metrics(cited: DataFrame, relevant: DataFrame, forbidden: DataFrame, facts: DataFrame) -> DataFrame:
    """Per case of facts(case_id, evidence_fact_recall): precision, recall and F1 of the cited titles against the relevant ones, the rate
    of forbidden titles that were cited, and the score: the mean of F1 and fact recall; for a case without relevant titles, 1 - that
    rate. All three title tables are (case_id, title), distinct."""
    mark = lambda df, name: df.select("case_id", "title").withColumn(name, F.lit(1))
    rows = mark(cited, "c").join(mark(relevant, "r"), ["case_id", "title"], "full_outer").join(mark(forbidden, "f"), ["case_id", "title"], "full_outer")
    n = rows.groupBy("case_id").agg(F.count("c").alias("n_c"), F.count("r").alias("n_r"), F.count("f").alias("n_f"), F.count(F.col("c") + F.col("r")).alias("n_cr"), F.count(F.col("c") + F.col("f")).alias("n_cf"))
    n = facts.join(n, "case_id", "left").fillna(0, ["n_c", "n_r", "n_f", "n_cr", "n_cf"])
    rate = F.when(F.col("n_f") > 0, F.col("n_cf") / F.col("n_f")).otherwise(0.0)
    p = F.when(F.col("n_c") > 0, F.col("n_cr") / F.col("n_c")).otherwise(0.0)
    r = F.when(F.col("n_r") > 0, F.col("n_cr") / F.col("n_r")).otherwise(0.0)
    asked = F.col("n_r") > 0
    pick = lambda value: F.when(asked, value).otherwise(1 - rate)
    return n.select(
        "case_id", F.round(pick(p), 4).alias("precision"), F.round(pick(r), 4).alias("recall"), F.round(pick(f1(p, r)), 4).alias("f1"), F.round(rate, 4).alias("unauthorized_citation_rate"),
        T.clamp(pick((f1(p, r) + F.col("evidence_fact_recall")) / 2)).alias("score"), F.when(asked, "answer_expected").otherwise("refusal_expected").alias("mode"),
    )


def faithfulness(refusal_expected: Column, claim_support: Column, leak_ratio: Column) -> Column:
    """Claim support less the share of protected facts that leaked; where a refusal is expected, 1 less that share."""
    return T.clamp(F.when(refusal_expected, 1 - leak_ratio).otherwise(F.greatest(claim_support - leak_ratio, F.lit(0.0))))


def support_excerpt(claims_of: DataFrame, evidence: DataFrame, limit: int = 220) -> DataFrame:
    """(claim_id, excerpt): of the sentences and table rows of a claim's evidence(claim_id, content), the one that shares most of the claim's
    tokens, ties to the earlier one, squeezed and cut; none where nothing is shared."""
    units = evidence.select("claim_id", F.posexplode(F.filter(F.split(F.regexp_replace(T.text("content"), "([。！？!?；;\\n]+)", "$1\u0001"), "\u0001"), lambda u: F.trim(u) != "")).alias("pos", "unit"))
    units = units.withColumn("_u", support_tokens("unit"))
    rows = claims_of.withColumn("_c", support_tokens("claim")).join(units, "claim_id").withColumn("share", F.round(share_found(F.col("_c"), F.col("_u")), 9)).where("share > 0")
    best = rows.groupBy("claim_id").agg(F.min_by("unit", F.struct((-F.col("share")).alias("s"), "pos")).alias("unit"))
    return best.select("claim_id", T.shorten("unit", limit).alias("excerpt"))


def table_row_support(claim: Column | str, evidence: Column | str) -> Column:
    """Whether one table row of the evidence holds all numbers of a claim that names a number and a response or handling time."""
    timed = T.text(claim).rlike("首次响应|响应时间|响应时限|处理时限")
    rows = F.filter(F.split(T.text(evidence), "\n"), lambda x: F.startswith(F.trim(x), F.lit("Table row:")))
    numbers = numeric_constraints(claim)
    return timed & (F.size(numbers) > 0) & F.exists(rows, lambda row: F.forall(numbers, lambda x: F.contains(T.match_text(row), T.match_text(x))))
