"""Evidence for answers: facts, claims, overlaps, embeddings of the offline provider, and diagnoses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
ALIAS_SEPARATORS = "并且|并|且|同时|然后|以及|需要|必须|应当|应|要|需|，|。|；|;|：|:|、|\\(|\\)|（|）"
POSITION_BUCKETS = ((20, "<=20"), (80, "21-80"), (120, "81-120"), (300, "121-300"))
SUPPORTED, PARTIAL = 0.75, 0.5
CITATION_MARKS = (r"\[[0-9,\s]+\]", "【[^】]{1,80}】", r"\(来源[:：][^)）]{1,120}[)）]")
ORDINALS = "第一|第二|第三|第四|第五|第六|第七|第八|其一|其二|其三|一是|二是|三是"
LEAD_INS = (
    "^根据当前可访问文档中的证据[，,]?", "^当前可访问文档中的证据[，,]?", "^《[^》]{1,120}》(?:里|中)?", "^[^：:]{0,160}（[^）]{1,120}）提到[:：]",
    "^[^：:]{0,160}(?:提到|显示|说明|指出)[:：]", "^[^：:]{0,160}(?:主要有[一二三四五六七八九十两0-9]+点|主要说明|直接相关的要求是|要求是|要求为)[:：]",
    "^(?:第一|第二|第三|第四|第五|第六|第七|第八|其一|其二|其三|一是|二是|三是)[，,:：]?",
)
LOW_INFORMATION = (
    "未找到足够相关", "证据不足", "暂时无法", "请换个问法", "建议结合引用片段", "建议你继续", "建议你把问题", "我已经检索到", "进一步确认",
    "当前可访问范围内未找到", "文档可能不存在", "没有访问权限",
)
FACTUAL = (
    "为", "是", "包括", "包含", "需要", "必须", "应", "不得", "禁止", "负责", "审批", "处理", "时限", "要求", "同步", "补齐", "关闭", "回收",
    "导出", "升级", "建立", "明确", "可以", "先",
)
#: Word in a change, and the hint that it gives.
IMPACT_WORDS = ("security", "access", "deadline", "sla", "rollback", "release", "approval", "policy", "compliance", "owner")


def embedding(value: Column | str, dims: int = 64) -> Column:
    """The offline embedding: bytes of sha256("counter:text") / 127.5 - 1, up to dims, to unit length."""
    rounds = -(-dims // 32)
    hexes = F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), T.text(value)), 256) for i in range(rounds)])
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.conv(F.substring(hexes, 2 * k + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def terms(value: Column | str, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct [a-z0-9]+ tokens and n-grams of CJK runs."""
    runs = F.regexp_extract_all(T.fold(value), F.lit(f"([a-z0-9]+|[{T.CJK}]+)"), 1)
    grams = lambda r: F.concat(*[T._grams(r, n) for n in sizes])
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(grams(r)))))


def share_found(wanted: Column, there: Column) -> Column:
    """Share of the wanted terms that are there; 0 without wanted ones."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, there)) / F.size(wanted)).otherwise(0.0)


def overlap_coefficient(a: Column, b: Column) -> Column:
    low = F.least(F.size(a), F.size(b))
    return F.when(low > 0, F.size(F.array_intersect(a, b)) / low).otherwise(0.0)


def alias_matches(alias: Column, raw: Column) -> Column:
    """Whether text holds an alias as it is, or without punctuation, or all its parts of 4 characters or more in order."""
    flat, low = T.match_text(raw), T.fold(raw)
    parts = F.filter(F.transform(F.split(T.fold(alias), ALIAS_SEPARATORS), T.match_text), lambda p: F.length(p) >= 4)
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(s, p):
        found = F.instr(F.substring(flat, s["at"], F.length(flat)), p)
        return F.struct(F.when(found > 0, s["at"] + found - 1 + F.length(p)).otherwise(s["at"]).cast("int").alias("at"), (s.ok & (found > 0)).alias("ok"))

    ordered = (F.size(parts) >= 2) & F.aggregate(parts, start, step, lambda s: s.ok)
    return F.contains(low, T.fold(alias)) | F.contains(flat, T.match_text(alias)) | ordered


def fact_coverage(specs: Column, raw: Column) -> Column:
    """Struct (matched, missing, coverage) of specs, an array of (label, aliases, weight), in a text."""
    known = F.transform(specs, lambda s: F.struct(s.label.alias("label"), s.weight.alias("weight"), F.exists(s.aliases, lambda a: alias_matches(a, raw)).alias("hit")))
    total = F.aggregate(known, F.lit(0.0), lambda a, s: a + s.weight)
    hit = F.aggregate(F.filter(known, lambda s: s.hit), F.lit(0.0), lambda a, s: a + s.weight)
    pick = lambda keep: F.transform(F.filter(known, keep), lambda s: s.label)
    return F.struct(pick(lambda s: s.hit).alias("matched"), pick(lambda s: ~s.hit).alias("missing"), F.when(total > 0, T.clamp(hit / total)).otherwise(0.0).alias("coverage"))


def is_factual(claim: Column) -> Column:
    """Whether a cleaned piece of an answer asserts something: long enough or with a number, no phrase of refusal, and of 14
    normalised characters or with a word of assertion."""
    from .support import numeric_constraints

    n = F.length(T.match_text(claim))
    empty = claim.rlike("|".join(LOW_INFORMATION))
    return (claim != "") & ~((n < 6) & (F.size(numeric_constraints(claim)) == 0)) & ~empty & ((n >= 14) | claim.rlike("|".join(FACTUAL)))


def claims(answer: Column | str) -> Column:
    """The factual statements of an answer, the first of equal ones: citation marks removed, split at ends of sentences, semicolons and
    ordinals, without lead-ins."""
    clean = T.text(answer)
    for pattern in CITATION_MARKS:
        clean = F.regexp_replace(clean, pattern, "")
    clean = F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
    clean = F.regexp_replace(clean, rf"(?:^|[，,；;。]\s*)({ORDINALS})\s*[，,:：]", "；")

    def bare(part):
        part = F.regexp_replace(part, "^[ ，,。；;：:]+|[ ，,。；;：:]+$", "")
        for pattern in LEAD_INS:
            part = F.regexp_replace(part, pattern, "")
        return F.regexp_replace(part, "^[ ，,。；;：:]+|[ ，,。；;：:]+$", "")

    parts = F.filter(F.transform(F.split(clean, "[。！？!?；;]+"), bare), is_factual)
    keyed = F.transform(parts, lambda p: F.struct(p.alias("part"), T.match_text(p).alias("key")))
    first = lambda made: T.let(F.transform(made, lambda x: x.key), lambda keys: F.filter(made, lambda x, i: (x.key != "") & (F.array_position(keys, x.key) == i + 1)))
    return F.transform(T.let(keyed, first), lambda x: x.part)


def support_status(score: Column) -> Column:
    return F.when(score >= SUPPORTED, "supported").when(score >= PARTIAL, "partial").otherwise("unsupported")


def position_bucket(index: Column | str) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    out = None
    for limit, name in POSITION_BUCKETS:
        out = F.when(index <= limit, name) if out is None else out.when(index <= limit, name)
    return out.otherwise(">300")


def stage_loss(passed: Column, refusal: Column, mode: Column, recall: dict[str, Column]) -> Column:
    """The first stage that lost the evidence. recall: title_pool, source_pool, base_pool, fused, pre_rerank,
    reranked, final, and if there is one, preserved."""
    r = {k: F.coalesce(v, F.lit(0.0)) for k, v in recall.items()}
    dropped = (r["base_pool"] >= 1) & (r["fused"] < 1)
    return (
        F.when(passed, "passed").when(refusal, F.coalesce(mode, F.lit("permission_failure"))).when(r["title_pool"] <= 0, "source_pool_title_missing")
        .when(r["source_pool"] < 1, "source_pool_evidence_missing").when(dropped, "fusion_evidence_dropped").when(r["pre_rerank"] < 1, "expansion_or_refusion_evidence_dropped")
        .when((r["reranked"] < 1) & (r.get("preserved", F.lit(0.0)) >= 1), "evidence_preservation_evidence_dropped").when(r["reranked"] < 1, "rerank_evidence_dropped")
        .when(r["final"] < 1, "final_selection_evidence_dropped").otherwise(F.coalesce(mode, F.lit("final_scoring_failure")))
    )


def impact_words(changed: Column | str) -> Column:
    low = F.lower(T.text(changed))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in IMPACT_WORDS]))


def confidence(chunks: Column, top: Column, mean: Column, dominant: Column, conflict: Column, from_table: Column) -> Column:
    """high, medium, low or insufficient, from the number of chunks, the best and mean score, the share of the dominant
    document, and whether the chunks conflict or the answer was read off a table."""
    return (
        F.when(F.coalesce(chunks, F.lit(0)) == 0, "insufficient").when(conflict, F.when(top >= 0.6, "medium").otherwise("low")).when(from_table, "high")
        .when((chunks >= 2) & (top >= 0.7) & (mean >= 0.55) & (dominant >= 0.5), "high").when(top >= 0.4, "medium").otherwise("low")
    )
