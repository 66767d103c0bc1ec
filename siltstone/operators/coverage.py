"""What the final list still lacks: coverage of sub-queries and aspects, merging of sub-query hits, and candidates worth keeping.

Text sets are array columns; choices within a query are windows, so that all queries are decided in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import text as T
from . import variants as V
from .retrieval import tie

# Fixed values.
LIST_HINTS = "包括|列出|清单|步骤|材料|范围"
ASK_HINTS = "哪些|有哪些|有什么"
BROAD_HINTS = "要求|义务|责任|职责|条件|流程|措施|依据"
DELIMITERS = "和|及|与|以及|、|分别|同时|各自"
THRESHOLD_HINTS = "规模|数量|数额|金额|额度|比例|达到|超过|不满|以上|以下|以内|不少于|不超过|多少|多久|时限|期限"
_AMOUNT = r"(?:[0-9]+(?:\.[0-9]+)?|[一二三四五六七八九十百千万亿两]+)\s*(?:万|亿)?"
_UNIT = "(?:人|户|个|件|次|元|万元|亿元|天|日|月|年|小时|分钟|工作日|%|％)"
THRESHOLD_VALUE = rf"(?:不少于|不低于|不超过|不满|超过|达到|高于|低于|大于|小于)\s*{_AMOUNT}{_UNIT}?|{_AMOUNT}{_UNIT}?\s*(?:以上|以下|以内|以外|不满|少于|超过)"
MEASURE_VALUE = _AMOUNT + _UNIT
COVERAGE_SOURCES = ("document_expansion", "document_sweep", "document_neighbor_context", "subquery_document_evidence", "subquery_neighbor_context")
KEPT_SOURCES = ("lexical", "indexed_sparse", "structural", "document_expansion", "document_sweep", "subquery_document_evidence", "subquery_neighbor_context", "document_first_evidence", "document_neighbor_context")
#: What a source adds to the worth of keeping a candidate.
KEEP_BONUS = {"structural": 0.06, "document_sweep": 0.04, "subquery_document_evidence": 0.05, "subquery_neighbor_context": 0.04, "document_first_evidence": 0.04, "document_neighbor_context": 0.02, "document_expansion": 0.02}
ORG_SUFFIX = "(?:有限公司|股份有限公司|集团有限公司|集团|公司)$"
TEXT_FIELDS = ("document_title", "section_title", "clause_full_name", "article_number", "heading_path")


def terms(value: Column | str) -> Column:
    """Distinct search terms of two characters or more, without words that every question has."""
    low = F.array(*[F.lit(s) for s in V.LOW_SIGNAL])
    return F.array_except(F.filter(F.array_distinct(T.search_tokens(value)), lambda t: F.length(t) > 1), low)


def share(wanted: Column, there: Column) -> Column:
    """How much of the wanted terms is there; 0 if either has none."""
    return F.when((F.size(wanted) > 0) & (F.size(there) > 0), F.size(F.array_intersect(wanted, there)) / F.size(wanted)).otherwise(0.0)


def candidate_text(rows: DataFrame, limit: int | None = 1_800) -> Column:
    """Title and structural fields, and the content or its beginning."""
    fields = [F.when(T.text(c) != "", F.col(c)) for c in TEXT_FIELDS if c in rows.columns]
    return F.concat_ws(" ", *fields, F.substring(T.text("content"), 1, limit) if limit else T.text("content"))


def matches_organisation(title: Column | str, hint: Column | str) -> Column:
    """Whether a title names an organisation: either holds the other, or the title holds its name without the legal form (4 characters or more)."""
    h = T.compact(hint)
    return compact_match(T.compact(title), h, organisation_core(h))


def organisation_core(hint: Column) -> Column:
    """A compact organisation name without its legal form."""
    return F.regexp_replace(hint, ORG_SUFFIX, "")


def compact_match(title: Column, hint: Column, core: Column) -> Column:
    """matches_organisation of a title, a name and its core that are compact already."""
    return (title != "") & (hint != "") & (F.contains(title, hint) | F.contains(hint, title) | ((F.length(core) >= 4) & F.contains(title, core)))


def probe_target(question: Column | str) -> Column:
    """The restricted document that a plain user asks to see, or null: what follows the last modal, before the words for restricted material."""
    q = T.squeeze(question)
    tail = F.regexp_extract(q, "^.*(?:能否|是否可以|能不能|可否)(.*)$", 1)
    asks = q.rlike("普通查看用户|普通用户|查看用户") & q.rlike("能否|是否可以|能不能|可否") & q.rlike("受限材料|受限文件|受限文档")
    found = F.regexp_extract_all(tail, F.lit("(?:直接查看|查看)([一-鿿A-Za-z0-9（）() /·\\-]{4,80}?)(?:这份|的)?(?:受限材料|受限文件|受限文档)"), 1)
    target = F.regexp_replace(F.get(found, F.size(found) - 1), "^(?:作为)?(?:普通查看用户|普通用户|查看用户)[，,。；;：:\\s]*", "")
    target = F.regexp_replace(target, "^[ ，,。；;：:]+|[ ，,。；;：:]+$", "")
    return F.when(asks & (F.length(T.compact(target)) >= 4), target)


def stopped_probes(queries: DataFrame, documents: DataFrame, visible: DataFrame) -> DataFrame:
    """Queries that must get an empty answer: (query_id, target, inaccessible_count) of queries(query_id, user_id, query_text) that name a document nobody showed
    their user. The queries with a target are few and stated; every title is matched against them where it lies."""
    asked = queries.select("query_id", "user_id", probe_target("query_text").alias("target")).where("target is not null")
    hits = documents.select("document_id", "title").join(asked, matches_organisation(F.col("title"), F.col("target")))
    seen = visible.select("user_id", "document_id", F.lit(True).alias("_seen"))
    made = hits.join(seen, ["user_id", "document_id"], "left").groupBy("query_id", "target").agg(F.count("_seen").alias("n_seen"), F.count(F.when(F.col("_seen").isNull(), 1)).alias("inaccessible_count"))
    return made.where("n_seen = 0 and inaccessible_count > 0").drop("n_seen")


def is_broad(question: Column | str) -> Column:
    """Whether a question asks for a list or for several things, so that more of one document is wanted."""
    q = T.text(question)
    return q.rlike(LIST_HINTS) | (q.rlike(BROAD_HINTS) & (q.rlike(ASK_HINTS) | q.rlike(DELIMITERS)))


def is_simple(question: Column | str, decomposed: Column, strategies: Column) -> Column:
    """A short question without decomposition, anchors, quotes and comparisons."""
    q = T.text(question)
    anchored = q.rlike("第[一二三四五六七八九十百千万零〇两0-9]+[章节条款项]") | q.rlike("条款全称|章节|小节|章标题|节标题|条款标题|款项")
    several = q.rlike('“|”|"|比较|分别|各自|同时核对|两个事项') | q.rlike("(?:和|及|与|以及|、).{0,18}(?:是什么|哪些|要求|结论|清单|材料|流程|条件)")
    return ~decomposed & ~anchored & ~F.array_contains(strategies, "title_anchor") & (F.length(T.compact(q)) <= 96) & ~several


def threshold_bonus(question: Column | str, value: Column | str) -> Column:
    """For questions about amounts and limits: .55 for a text with a threshold, .22 for one with a measure where the question asks how much or how long."""
    q, v = (F.regexp_replace(T.text(x), r"(?U)\s+", "") for x in (question, value))
    return F.when(~q.rlike(THRESHOLD_HINTS), 0.0).when(v.rlike(THRESHOLD_VALUE), 0.55).when(q.rlike("多少|多久|时限|期限") & v.rlike(MEASURE_VALUE), 0.22).otherwise(0.0)


def aspects(question: Column | str) -> Column:
    """The question's parts between conjunctions, as term sets; parts without a term are left out."""
    parts = F.filter(F.transform(F.split(T.text(question), "以及|分别|同时|各自|[、与及和]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    return F.filter(F.transform(parts, terms), lambda t: F.size(t) > 0)


# Sub-queries.


def _strength() -> Column:
    return F.greatest("rerank_score", "fused")


def subquery_matches(subs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate of a query against each of its sub-queries, with covers (good enough to be offered), covers_selected (so good that the sub-query
    counts as answered) and coverage_score.

    subs: as variants.subqueries; candidates(query_id, chunk_id, document_title, content, sources, fused, rerank_score, and structural fields): a bounded pool
    for each query."""
    s = subs.select("query_id", "sub_id", "org_hint", "case_shape", F.coalesce(F.nullif("evidence_hint", F.lit("")), F.col("query_text")).alias("wanted"))
    s = s.withColumn("wanted_terms", terms("wanted")).withColumn("must", V.discriminators("wanted")).withColumn("pairs", V.table_pairs_of("wanted")).withColumn("hint", A.marker_key("wanted"))
    c = candidates.withColumn("_text", candidate_text(candidates)).withColumn("_terms", terms("_text")).withColumn("_flat", A.marker_key("_text")).withColumn("_pairs", V.table_pairs_of("_text"))
    rows = c.join(s, "query_id")
    org = (T.text("org_hint") == "") | matches_organisation("document_title", "org_hint")
    table = (F.col("case_shape") == "table_structured_lookup") & (F.size("pairs") > 0)
    pair = F.arrays_overlap("pairs", "_pairs")
    held = F.forall("must", lambda m: F.contains(T.compact("_text"), m))
    both = F.size(F.array_intersect("wanted_terms", "_terms"))
    overlap = share(F.col("wanted_terms"), F.col("_terms"))
    n = F.size("wanted_terms")
    exact = F.contains("_flat", F.col("hint"))
    after = F.length("_flat") - F.instr("_flat", F.col("hint")) + 1 - F.length("hint")
    raw_after = F.substring(F.col("_text"), F.instr("_text", T.squeeze("wanted")) + F.length(T.squeeze("wanted")), F.lit(80))
    ended = (F.instr("_text", T.squeeze("wanted")) > 0) & raw_after.rlike("[。；;.!！？?》）)]")
    enough = (F.length("hint") < 20) | (after >= F.least(F.lit(48), F.greatest(F.lit(24), F.floor(F.length("hint") / 4)))) | ended

    def judged(least_exact: int, otherwise: Column) -> Column:
        plain = F.when((F.length("hint") >= least_exact) & exact, enough).otherwise(otherwise)
        return org & F.when(table, pair).otherwise(held & (n > 0) & plain)

    offered = (both >= F.least(F.lit(3), n)) & (overlap >= 0.45)
    answered = F.when(F.length("hint") >= 20, (both >= F.least(F.lit(6), n)) & (overlap >= 0.98)).otherwise((both >= F.least(F.lit(4), n)) & (overlap >= 0.55))
    has = lambda x: F.array_contains("sources", x)
    bonus = F.when(table & pair, 0.72).when(has("subquery_neighbor_context"), 0.28).when(has("subquery_document_evidence"), 0.18).otherwise(0.0)
    score = overlap + bonus + F.least(_strength(), F.lit(1.0)) * 0.18
    rows = rows.withColumn("covers", judged(10, offered)).withColumn("covers_selected", judged(12, answered)).withColumn("coverage_score", F.round(score, 9))
    return rows.drop("_text", "_terms", "_flat", "_pairs", "wanted_terms", "must", "pairs", "hint", "wanted")


def subquery_supplements(matches: DataFrame, selected: DataFrame, slots: int) -> DataFrame:
    """The best candidate for each sub-query that no selected(query_id, chunk_id) one answers, ``slots`` a query at most: by score, then source (neighbour context,
    document evidence), strength, lexical score and position. matches: of subquery_matches, with position and lexical_raw. A candidate that is the best of
    several sub-queries serves the first of them."""
    rows = matches.join(selected.select("query_id", "chunk_id", F.lit(True).alias("_in")), ["query_id", "chunk_id"], "left").where("case_shape <> 'single_category_anchor'")
    done = rows.where("_in and covers_selected").select("query_id", "sub_id").distinct()
    has = lambda x: F.array_contains("sources", x)
    priority = F.when(has("subquery_neighbor_context"), 2).when(has("subquery_document_evidence"), 1).otherwise(0)
    open_ = rows.where("_in is null and covers and coverage_score > 0").join(done, ["query_id", "sub_id"], "left_anti")
    w = W.partitionBy("query_id", "sub_id").orderBy(F.desc("coverage_score"), priority.desc(), _strength().desc(), F.desc("lexical_raw"), "position")
    best = open_.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    best = best.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("sub_id"))).where("_n = 1")
    order = W.partitionBy("query_id").orderBy(F.desc("coverage_score"), F.desc("rerank_score"), F.desc("fused"), "position")
    return best.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= slots).drop("_n", "_in")


def protected_chunks(matches: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of selected chunks that answer a sub-query."""
    return selected.select("query_id", "chunk_id").join(matches.where("covers_selected").select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")


def merge_subquery_hits(hits: DataFrame, total: int, least: int = 4, subs: int = 4) -> DataFrame:
    """One list of ``total`` from hits(query_id, sub_id, rank, chunk_id, document_id, chunk_index, score) of several sub-queries (sub_id under ``subs``): each gets ``least`` that
    those before didn't take, one of each document first; the rest goes to the best scores. A chunk counts with its best score."""
    best = hits.groupBy("query_id", "chunk_id", "document_id", "chunk_index").agg(F.max("score").alias("score"))
    taken = None
    for sub in range(subs):
        own = hits.where(F.col("sub_id") == sub).select("query_id", "chunk_id", "document_id", "rank")
        if taken is not None:
            own = own.join(taken.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        turn = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("rank", "chunk_id"))
        own = own.withColumn("late", (turn > 1).cast("int")).withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("late", "rank", "chunk_id"))).where(F.col("n") <= least)
        part = own.select("query_id", "chunk_id", F.lit(sub).alias("tier"), "n")
        taken = part if taken is None else taken.unionByName(part)
    rows = best.join(taken, ["query_id", "chunk_id"], "left").withColumn("tier", F.coalesce("tier", F.lit(subs)))
    order = W.partitionBy("query_id").orderBy("tier", F.coalesce("n", F.lit(0)), F.desc("score"), "chunk_index", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= total).drop("n", "tier")


def subquery_seeds(subs: DataFrame, ranked: DataFrame, documents: int) -> DataFrame:
    """The best candidate of each of the first ``documents`` documents that fit a sub-query's organisation (any, if it names none):
    (query_id, sub_id, document_id, chunk_id, place). ranked(query_id, rank, chunk_id, document_id, document_title)."""
    rows = ranked.join(subs.select("query_id", "sub_id", "org_hint"), "query_id").where((T.text("org_hint") == "") | matches_organisation("document_title", "org_hint"))
    first = rows.groupBy("query_id", "sub_id", "document_id").agg(F.min("rank").alias("rank"), F.min_by("chunk_id", "rank").alias("chunk_id"))
    place = F.row_number().over(W.partitionBy("query_id", "sub_id").orderBy("rank"))
    return first.withColumn("place", place).where(F.col("place") <= documents)


def neighbour_rescore(subs: DataFrame, hits: DataFrame) -> DataFrame:
    """Neighbour hits(query_id, sub_id, chunk_id, chunk_index, score, document_title, content, ...) scored for their sub-query: adjacency + 1.35 overlap + .55 for its exact text + .08 for
    structure; without the exact text, an overlap under .45 drops a hit."""
    s = subs.select("query_id", "sub_id", F.coalesce(F.nullif("evidence_hint", F.lit("")), F.col("query_text")).alias("wanted"))
    text = candidate_text(hits, None)
    rows = hits.withColumn("_t", text).join(s, ["query_id", "sub_id"])
    overlap = share(terms("wanted"), terms("_t"))
    exact = (T.compact("wanted") != "") & F.contains(T.compact("_t"), T.compact("wanted"))
    fields = [T.text(c) != "" for c in ("section_title", "heading_path", "clause_full_name") if c in hits.columns]
    structure = fields[0] if fields else F.lit(False)
    for f in fields[1:]:
        structure = structure | f
    score = F.col("score") + overlap * 1.35 + F.when(exact, 0.55).otherwise(0.0) + F.when(structure, 0.08).otherwise(0.0)
    return rows.where(exact | (overlap >= 0.45)).withColumn("score", F.round(score, 9)).where("score > 0").drop("_t", "wanted")


def best_hits(hits: DataFrame) -> DataFrame:
    """Each chunk of hits(query_id, chunk_id, score, rank) once, with its best score, the earliest of equal ones."""
    w = W.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Final list.


def keep_score() -> Column:
    """Worth of keeping a candidate: .46 fused + .42 normalised + .12 raw lexical score (up to 1), and what its sources add."""
    out = F.col("fused") * 0.46 + F.col("lexical_norm") * 0.42 + F.least("lexical_raw", F.lit(1.0)) * 0.12
    for source, bonus in KEEP_BONUS.items():
        out = out + F.when(F.array_contains("sources", source), bonus).otherwise(0.0)
    return out


def kept_candidates(candidates: DataFrame, limit: int = 40, least_lexical: float = 0.0, least_fused: float = 0.0) -> DataFrame:
    """The ``limit`` candidates of each query that are most worth keeping, of those from a source that counts and with enough lexical or fused score."""
    ok = F.arrays_overlap("sources", F.array(*[F.lit(s) for s in KEPT_SOURCES])) & ~((F.col("lexical_norm") < least_lexical) & (F.col("fused") < least_fused))
    rows = candidates.where(ok).withColumn("keep_score", tie(keep_score()))
    order = W.partitionBy("query_id").orderBy(F.desc("keep_score"), F.desc("fused"), F.desc("lexical_norm"), F.desc("lexical_raw"), "chunk_index", "chunk_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def coverage_supplements(candidates: DataFrame, selected: DataFrame, slots: int, least_rerank: float = 0.0, least_fused: float = 0.0) -> DataFrame:
    """For broad questions, further chunks of the documents that are already in the list, ``slots`` a query, by what they add: overlap with the question (.45), terms that
    the document's chosen chunks lack (.75), the best gain on an aspect (1.25), thresholds, strength and source.

    candidates(query_id, query_text, position, chunk_id, document_id, sources, fused, rerank_score, document_title, content, structural fields); selected
    (query_id, chunk_id)."""
    c = candidates.where(is_broad("query_text")).withColumn("_text", candidate_text(candidates)).withColumn("_terms", terms("_text")).withColumn("_aspects", aspects("query_text"))
    c = c.withColumn("_by_aspect", F.transform("_aspects", lambda a: share(a, F.col("_terms"))))
    mark = c.join(selected.select("query_id", "chunk_id", F.lit(True).alias("_in")), ["query_id", "chunk_id"], "left")
    n = "_n_aspects"
    chosen = mark.where("_in").groupBy("query_id", "document_id").agg(F.array_distinct(F.flatten(F.collect_list("_terms"))).alias("_has"), F.collect_list("_by_aspect").alias("_all"))
    top = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get("_all", F.lit(0))) - 1, F.lit(0))), lambda i: F.array_max(F.transform("_all", lambda x: F.get(x, i))))
    chosen = chosen.withColumn("_top", top).drop("_all")
    structured = F.lit(False)
    for f in ("clause_full_name", "article_number", "heading_path", "section_title"):
        if f in candidates.columns:
            structured = structured | (T.text(f) != "")
    strong = (F.col("rerank_score") >= least_rerank) | (F.col("fused") >= least_fused)
    booster = F.arrays_overlap("sources", F.array(*[F.lit(s) for s in COVERAGE_SOURCES]))
    pool = mark.where("_in is null").join(chosen, ["query_id", "document_id"]).where(strong & (booster | structured))
    q = terms("query_text")
    hit = F.array_intersect(q, F.col("_terms"))
    size = F.greatest(F.size(q), F.lit(1))
    gain = F.coalesce(F.array_max(F.zip_with("_by_aspect", "_top", lambda mine, had: mine - F.coalesce(had, F.lit(0.0)))), F.lit(0.0))
    article = F.lit(False)
    for f in ("article_number", "clause_full_name"):
        if f in candidates.columns:
            article = article | (T.text(f) != "")
    score = F.size(hit) / size * 0.45 + F.size(F.array_except(hit, F.col("_has"))) / size * 0.75 + F.greatest(gain, F.lit(0.0)) * 1.25 + threshold_bonus("query_text", F.col("_text"))
    score = score + F.least(_strength(), F.lit(1.0)) * 0.22 + F.when(booster, 0.08).otherwise(0.0) + F.when(article, 0.04).otherwise(0.0)
    pool = pool.withColumn("coverage_score", F.round(score, 9))
    order = W.partitionBy("query_id").orderBy(F.desc("coverage_score"), F.desc("rerank_score"), F.desc("fused"), "position")
    return pool.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= slots).drop("_text", "_terms", "_aspects", "_by_aspect", "_in", "_has", "_top", n)


def append_at_end(selected: DataFrame, extra: DataFrame, k: int, slots: int) -> DataFrame:
    """selected(query_id, chunk_id, final_rank) with up to ``slots`` of extra(query_id, chunk_id, slot) that it lacks in its last places: (query_id, chunk_id, final_rank)."""
    new = extra.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    new = new.withColumn("slot", F.row_number().over(W.partitionBy("query_id").orderBy("slot"))).where(F.col("slot") <= min(slots, k))
    count = new.groupBy("query_id").agg(F.count("*").alias("n_new"))
    old = selected.join(count, "query_id", "left").where(F.col("final_rank") <= k - F.coalesce("n_new", F.lit(0)))
    rows = old.select("query_id", "chunk_id", F.lit(0).alias("part"), F.col("final_rank").alias("n")).unionByName(new.select("query_id", "chunk_id", F.lit(1).alias("part"), F.col("slot").alias("n")))
    return rows.select("query_id", "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy("part", "n")).alias("final_rank"))


#: Candidates from these sources are never replaced.
REPLACEMENT_PROTECTED = ("document_first_evidence", "document_sweep", "subquery_document_evidence", "subquery_neighbor_context")


def replace_slots(selected: DataFrame, extra: DataFrame, candidates: DataFrame, slots: int, protected: int = 3, always: int = 1, guarded: DataFrame | None = None) -> DataFrame:
    """selected(query_id, chunk_id, final_rank) with up to ``slots`` of extra(query_id, chunk_id, slot), in turn, each in the place of the weakest chunk of its own document: (query_id, chunk_id, final_rank).

    The first ``protected`` places (of a list that short, all but the last; at least ``always``) stay; where they are the whole list, only the first ``always``. So do chunks of guarded(query_id, chunk_id) and
    those from REPLACEMENT_PROTECTED sources. Weakest: least rerank (without one, fused), then fused, then lexical score, then the earliest place. An extra chunk that is in the list, or whose document has no
    place to give, is passed over; one that was replaced may come back. candidates(query_id, chunk_id, document_id, fused, lexical_raw, rerank_score, sources) has a row for every chunk named. A list is
    bounded by its length, and the turns by the extras; they depend on one another, so they are one fold for each query, in the JVM."""
    kind = "struct<pos:int,chunk_id:string,document_id:string,quality:double,fused:double,lexical:double,locked:boolean>"
    own = candidates.select(
        "query_id", "chunk_id", F.col("document_id").cast("string").alias("document_id"), F.when(F.col("rerank_score") > 0, F.col("rerank_score")).otherwise(F.col("fused")).cast("double").alias("quality"),
        F.col("fused").cast("double").alias("fused"), F.col("lexical_raw").cast("double").alias("lexical"), F.arrays_overlap("sources", F.array(*[F.lit(s) for s in REPLACEMENT_PROTECTED])).alias("locked"),
    )
    if guarded is not None:
        own = own.join(guarded.select("query_id", "chunk_id", F.lit(True).alias("_g")).distinct(), ["query_id", "chunk_id"], "left").withColumn("locked", F.col("locked") | F.coalesce("_g", F.lit(False)))

    def packed(rows: DataFrame, place: str, name: str) -> DataFrame:
        item = F.struct(F.col(place).cast("int").alias("pos"), F.col("chunk_id").cast("string").alias("chunk_id"), "document_id", "quality", "fused", "lexical", F.coalesce("locked", F.lit(False)).alias("locked")).cast(kind)
        return rows.join(own, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias(name))

    lists = packed(selected.select("query_id", "chunk_id", "final_rank"), "final_rank", "picked").join(packed(extra.select("query_id", "chunk_id", "slot"), "slot", "more"), "query_id", "left")
    size = F.size("picked")
    start = F.least(F.greatest(F.lit(always), F.least(F.lit(protected), F.greatest(size - 1, F.lit(0)))), size)

    def weakest(now: Column, x: Column, first: Column) -> Column:
        """(quality, fused, lexical, place) of the chunk that gives way to x, or null."""
        keyed = F.transform(now, lambda y, i: F.when((i >= first) & (y.document_id == x.document_id) & ~y.locked, F.struct(y.quality.alias("quality"), y.fused.alias("fused"), y.lexical.alias("lexical"), i.alias("at"))))
        return F.array_min(F.array_compact(keyed))

    def step(s: Column, x: Column) -> Column:
        full = s.n >= slots
        there = F.exists(s.now, lambda y: y.chunk_id == x.chunk_id)
        at = weakest(s.now, x, start).getField("at")
        at = F.coalesce(at, F.when(F.lit(protected) >= size, weakest(s.now, x, F.least(F.lit(always), size)).getField("at")))
        goes = ~full & ~there & at.isNotNull()
        new = F.transform(s.now, lambda y, i: F.when(i == at, x).otherwise(y))
        return F.struct(F.when(goes, new).otherwise(s.now).alias("now"), (s.n + goes.cast("int")).alias("n"))

    begin = F.struct(F.col("picked").alias("now"), F.lit(0).alias("n"))
    final = F.aggregate(F.coalesce("more", F.array().cast(f"array<{kind}>")), begin, step, lambda s: s.now)
    rows = lists.select("query_id", F.posexplode(final).alias("pos", "x"))
    return rows.select("query_id", F.col("x.chunk_id").alias("chunk_id"), (F.col("pos") + 1).alias("final_rank"))
