"""From questions to final lists in one plan: every form and sub-query of every question is a tagged row, and each source is read once for all of them.

An *ask* is one text that one source is searched with: a form of a question, or a sub-query. Access comes before any score: an ask knows its scope (the set of
documents that its user sees, narrowed to those of the organisation that a sub-query names), and statistics are the scope's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from . import coverage as C
from . import fusion, index, retrieval
from . import variants as V


@dataclass(frozen=True)
class Limits:
    """How much each stage may bring; the defaults are fixed values."""

    top_k: int = 10
    least_of_subquery: int = 4
    sparse_terms: int = 10
    source_caps: tuple[tuple[str, int], ...] = (("cross_document_comparison", 24), ("table_structured_lookup", 24))
    expansion: tuple[int, int, int, int] = (10, 5, 32, 2)  # seeds, a document, in all, window
    evidence: tuple[int, int, int] = (3, 4, 32)  # documents, a sub-query, in all
    neighbours: tuple[int, int, int, int] = (4, 5, 8, 16)  # seeds, window, a sub-query, in all
    coverage_slots: int = 2
    subquery_slots: int = 2
    protected: int = 3
    scan: int = 160
    least_rerank: float = 0.28
    least_fused: float = 0.02

    @property
    def pool(self) -> int:
        return V.pool_size(self.top_k)


def asks(questions: DataFrame, subs: DataFrame, limits: Limits = Limits(), title: str | None = None) -> DataFrame:
    """(ask, query_id, sub_id, source, query_text, wanted, org_hint, case_shape, most): what each source is searched with.

    Questions(query_id, query_text) that have sub-queries (subs, as of variants.subqueries) ask with those, the others with the forms of variants.query_variants' first
    variant (sub_id is the form's place then). Comparisons and pairs of matters are not searched lexically beside the sparse source."""
    plain = questions.join(subs.select("query_id").distinct(), "query_id", "left_anti")
    forms = V.query_variants(plain.select("query_id", "query_text", *([title] if title else []))).where("pos = 0")
    forms = forms.select("query_id", F.posexplode("lexical_queries").alias("sub_id", "query_text"))
    none = F.lit("")
    forms = forms.select("query_id", "sub_id", F.explode(F.array(F.lit("lexical"), F.lit("indexed_sparse"))).alias("source"), "query_text", none.alias("wanted"), none.alias("org_hint"), none.alias("case_shape"), F.lit(limits.pool).alias("most"))
    many = subs.withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    many = many.withColumn("wanted", F.coalesce(F.nullif("evidence_hint", F.lit("")), F.col("query_text"))).withColumn("share", V.per_subquery_limit(limits.pool, F.col("n"), limits.least_of_subquery))
    parts = []
    for source in ("lexical", "indexed_sparse"):
        own = many if source == "indexed_sparse" else many.where("case_shape not in ('cross_document_comparison', 'same_document_two_matters')")
        cap = F.create_map(*[F.lit(x) for pair in limits.source_caps for x in pair])
        most = F.greatest(F.lit(1), F.least("share", F.coalesce(F.get(F.map_values(F.map_filter(cap, lambda k, v: k == F.col("case_shape"))), F.lit(0)), F.col("share")))) if source == "indexed_sparse" else F.col("share")  # noqa: B023
        parts.append(own.select("query_id", "sub_id", F.lit(source).alias("source"), V.source_query(own, source).alias("query_text"), "wanted", F.coalesce("org_hint", F.lit("")).alias("org_hint"), "case_shape", most.cast("int").alias("most")))
    rows = forms.unionByName(parts[0]).unionByName(parts[1])
    return rows.withColumn("ask", F.concat_ws("/", "query_id", "sub_id", "source"))


def ask_scopes(made: DataFrame, scope_of: DataFrame, members: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asks with their scope and hint, and members(scope_id, hint, document_id) of all that are asked in.

    scope_of(query_id, scope_id); members(scope_id, document_id); titles(document_id, title). An ask that names an organisation has the scope's documents whose title holds the name, else those
    that match it, else all of the scope (hint '')."""
    rows = made.join(scope_of, "query_id")
    named = rows.where("org_hint <> ''").select("scope_id", F.col("org_hint").alias("hint")).distinct()
    own = members.join(rows.select("scope_id").distinct(), "scope_id", "left_semi")
    # Titles meet the names, few, before they meet the scopes; each text is folded once.
    names = named.select("hint").distinct().select("hint", F.lower(T.squeeze("hint")).alias("_low"), T.compact("hint").alias("_h")).withColumn("_core", C.organisation_core(F.col("_h")))
    texts = titles.select("document_id", F.lower("title").alias("_title"), T.compact("title").alias("_t"))
    tier = F.when(F.contains("_title", F.col("_low")), 0).when(C.compact_match(F.col("_t"), F.col("_h"), F.col("_core")), 1)
    fits = texts.join(F.broadcast(names)).withColumn("tier", tier).where("tier is not null").select("document_id", "hint", "tier")
    seen = own.join(F.broadcast(named), "scope_id").join(fits, ["document_id", "hint"])
    seen = seen.withColumn("best", F.min("tier").over(W.partitionBy("scope_id", "hint"))).where("tier = best")
    narrowed = written(seen.select("scope_id", "hint", "document_id"), "narrowed")
    some = narrowed.select("scope_id", F.col("hint").alias("org_hint"), F.col("hint").alias("found")).distinct()
    rows = rows.join(some, ["scope_id", "org_hint"], "left").withColumn("hint", F.coalesce("found", F.lit(""))).drop("found")
    return rows, own.select("scope_id", F.lit("").alias("hint"), "document_id").unionByName(narrowed)


def source_hits(asked: DataFrame, members: DataFrame, chunks: DataFrame, postings: DataFrame, sizes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(ask, query_id, sub_id, source, way, document_id, chunk_id, chunk_index, score, rank): the hits of each ask, at most its ``most``.

    A sub-query takes the first of three ways that finds something: its (field, value) pairs (table lookups in the sparse source), its exact text, terms. All ways of all asks run in one plan;
    a window over the ask decides. By terms an ask brings its ``limits.pool`` best, as no more than these can be among its hits."""
    words = [index.query_terms(asked.where(F.col("source") == s).select(F.col("ask").alias("query_id"), "query_text"), n) for s, n in (("lexical", 64), ("indexed_sparse", limits.sparse_terms))]
    words = words[0].unionByName(words[1]).withColumnRenamed("query_id", "ask")
    asked, lists = retrieval.scope_lists(asked, members)
    best = retrieval.bm25_by_ask(words, asked, index.gathered(postings), lists, sizes, limits.pool)
    by_term = best.select("ask", "document_id", "chunk_id", "chunk_index", "score").withColumn("way", F.lit(2))
    # A hit meets the list of its document's scopes, so a scope's documents are not shuffled for the hits.
    inside = lambda hits: hits.withColumnRenamed("query_id", "ask").join(F.broadcast(asked.select("ask", "scope")), "ask").join(lists, "document_id").where(F.array_contains("scopes", F.col("scope"))).select("ask", "document_id", "chunk_id", "chunk_index", "score")
    anchored = asked.where("case_shape not in ('', 'single_category_anchor', 'table_structured_lookup')")
    exact = inside(retrieval.exact_hits(anchored.select(F.col("ask").alias("query_id"), F.col("wanted").alias("query_text")), chunks))
    exact = exact.withColumn("way", F.lit(1))
    tables = asked.where("case_shape = 'table_structured_lookup' and source = 'indexed_sparse'").select(F.col("ask").alias("query_id"), F.explode(V.table_pairs_of("wanted")).alias("p"))
    pairs = inside(retrieval.table_pair_hits(tables.select("query_id", "p.field", "p.value"), chunks)).withColumn("way", F.lit(0))
    rows = by_term.unionByName(exact).unionByName(pairs)
    rows = rows.withColumn("first", F.min("way").over(W.partitionBy("ask"))).where("way = first").drop("first")
    order = W.partitionBy("ask").orderBy(F.desc("score"), "chunk_index", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limits.pool)
    return rows.join(asked.select("ask", "query_id", "sub_id", "source", "case_shape", "most"), "ask").where("rank <= most").drop("most")


def merged_sources(hits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(query_id, source, document_id, chunk_id, chunk_index, score, rank): one list for each question and source. Forms give each chunk its best score, sub-queries take turns."""
    out = None
    for source in ("lexical", "indexed_sparse"):
        own = hits.where(F.col("source") == source)
        forms = own.where("case_shape = ''").groupBy("query_id", "document_id", "chunk_id", "chunk_index").agg(F.max("score").alias("score"))
        forms = retrieval.top_k(forms, limits.pool)
        turns = C.merge_subquery_hits(own.where("case_shape <> ''").select("query_id", "sub_id", "rank", "chunk_id", "document_id", "chunk_index", "score"), limits.pool, limits.least_of_subquery, 2)
        cols = ["query_id", "document_id", "chunk_id", "chunk_index", "score", "rank"]
        part = forms.select(*cols).unionByName(turns.select(*cols)).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out


def fused(hits: DataFrame, strategy: str = "weighted") -> DataFrame:
    """fusion.fuse with the chunk's place, scores rounded so that equal ones tie, and position: the order by fused, lexical, vector score and chunk index."""
    places = hits.groupBy("query_id", "chunk_id").agg(F.first("document_id").alias("document_id"), F.first("chunk_index").alias("chunk_index"))
    rows = fusion.fuse(hits, strategy).join(places, ["query_id", "chunk_id"])
    for c in ("fused", "lexical_raw", "lexical_norm", "vector_raw", "vector_norm"):
        rows = rows.withColumn(c, F.round(c, 9))
    order = W.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("lexical_raw"), F.desc("vector_raw"), "chunk_index", "chunk_id")
    return rows.withColumn("position", F.row_number().over(order))


def expansion(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, postings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Hits in the documents of the first candidates: near them, or with the question's terms. questions(query_id, query_text)."""
    seeds, per_document, most, window = limits.expansion
    best = candidates.where(F.col("position") <= seeds)
    own = index.within(postings, best.select("query_id", "document_id").distinct(), "chunk_id").drop("document_id")
    tokens = questions.select("query_id", F.explode(T.search_tokens("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    scores = retrieval.weighted_terms(tokens, own).withColumn("score", F.round("score", 9))
    return retrieval.expand_documents(best, chunks, scores, per_document, most, window).withColumn("score", F.round("score", 9)).withColumn("source", F.lit("document_expansion"))


def subquery_evidence(subs: DataFrame, candidates: DataFrame, chunks: DataFrame, postings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """For each sub-query, hits inside the best documents of its organisation: its exact text first, then terms by those documents' own statistics.

    candidates: as of fused, with document_title."""
    documents, per, most = limits.evidence
    own = subs.where("case_shape <> 'single_category_anchor'").withColumn("sub", F.concat_ws("/", "query_id", "sub_id"))
    seeds = C.subquery_seeds(own, candidates.withColumnRenamed("position", "rank"), documents).withColumn("sub", F.concat_ws("/", "query_id", "sub_id"))
    seeds = written(seeds.select(F.col("sub").alias("query_id"), "document_id", "chunk_id", F.col("place").alias("rank")), "sub_seeds")
    wanted = own.select(F.col("sub").alias("query_id"), F.coalesce(F.nullif("evidence_hint", F.lit("")), F.col("query_text")).alias("query_text"))
    # Only the seeds' documents are read again.
    near = chunks.join(F.broadcast(seeds.select("document_id").distinct()), "document_id", "left_semi")  # few documents a question
    terms = index.within(postings, seeds.select("document_id").distinct(), "chunk_id", "doc_len").select("chunk_id", "term", "tf", "doc_len")
    exact = retrieval.exact_text_within(wanted, seeds, near, documents, per, per).withColumn("part", F.lit(0))
    swept = retrieval.sweep_documents(index.query_terms(wanted), seeds, near, terms, documents, per, per).withColumn("part", F.lit(1))
    both = exact.unionByName(swept).withColumnRenamed("part", "sub_id")
    one = C.merge_subquery_hits(both, per, limits.least_of_subquery, 2)
    one = one.withColumn("sub_id", F.element_at(F.split("query_id", "/"), -1).cast("int")).withColumnRenamed("query_id", "sub").join(own.select("sub", "query_id"), "sub")
    merged = C.merge_subquery_hits(one.select("query_id", "sub_id", "rank", "chunk_id", "document_id", "chunk_index", "score"), most, limits.least_of_subquery, 2)
    return merged.withColumn("source", F.lit("subquery_document_evidence"))


def subquery_neighbours(subs: DataFrame, hits: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """For sub-queries of two matters or documents, chunks around the hits(query_id, chunk_id, score, rank, document_id, chunk_index) that answer them best."""
    count, window, per, most = limits.neighbours
    own = subs.where("case_shape in ('same_document_two_matters', 'cross_document_comparison')")
    best = C.best_hits(hits.join(own.select("query_id").distinct(), "query_id", "left_semi")).drop("rank")
    pool = best.join(only(chunks, best).drop("document_id", "chunk_index"), "chunk_id").withColumn("lexical_raw", F.col("score")).withColumn("fused", F.col("score")).withColumn("rerank_score", F.lit(0.0)).withColumn("sources", F.array(F.lit("indexed_sparse")))
    matched = C.subquery_matches(own, pool).where(((T.text("org_hint") == "") | C.matches_organisation("document_title", "org_hint")) & (F.col("coverage_score") > 0))
    order = W.partitionBy("query_id", "sub_id").orderBy(F.desc("coverage_score"), F.desc("score"), "chunk_index", "chunk_id")
    seeds = matched.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count)
    raw = max(per, min(count * window * 2, max(per * 4, 16)))
    seeds = seeds.select(F.concat_ws("/", "query_id", "sub_id").alias("query_id"), "document_id", "chunk_index")
    near = retrieval.neighbours(seeds, chunks, window, raw, raw)
    near = near.select(F.split("query_id", "/")[0].cast(dict(subs.dtypes)["query_id"]).alias("query_id"), F.split("query_id", "/")[1].cast("int").alias("sub_id"), "document_id", "chunk_id", "chunk_index", "score")
    scored = C.neighbour_rescore(own, near.join(only(chunks, near).drop("document_id", "chunk_index"), "chunk_id"))
    order = W.partitionBy("query_id", "sub_id").orderBy(F.desc("score"), "chunk_index", "chunk_id")
    scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per)
    merged = C.merge_subquery_hits(scored.select("query_id", "sub_id", "rank", "chunk_id", "document_id", "chunk_index", "score"), most, limits.least_of_subquery, 2)
    return merged.withColumn("source", F.lit("subquery_neighbor_context"))


def only(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """The chunks that rows(chunk_id, ...), bounded for each question, name: their ids are broadcast, so other chunks never leave the task that reads them."""
    return chunks.join(F.broadcast(rows.select("chunk_id").distinct()), "chunk_id", "left_semi")


HIT = ["query_id", "source", "document_id", "chunk_id", "chunk_index", "score", "rank"]


@dataclass
class Run:
    """What a search made, stage by stage: asks, the source hits with the way that found them, every hit that was fused, candidates and the final list. members: (scope_id, document_id) of the scopes that were asked in."""

    asks: DataFrame
    found: DataFrame
    hits: DataFrame
    candidates: DataFrame
    final: DataFrame
    members: DataFrame | None = None


def search(questions: DataFrame, members: DataFrame, scope_of: DataFrame, chunks: DataFrame, postings: DataFrame, sizes: DataFrame, limits: Limits = Limits(), vector_hits: DataFrame | None = None) -> Run:
    """The final lists of all questions(query_id, query_text).

    members(scope_id, document_id) and scope_of(query_id, scope_id) say what each question may see; chunks(chunk_id, document_id, chunk_index, document_title, content, and
    structural fields); postings: an index, as of index.chunk_terms with document_id and chunk_index, or exploded with doc_len; sizes(document_id, n_chunks, sum_len): of the documents' chunks that have a term. vector_hits(query_id, document_id, chunk_id, chunk_index, score, rank): of an embedding source, already in scope; a question without
    sub-queries that has four keyword hits or more goes without. Each stage is a written table, bounded by its limits for each question."""
    subs = written(V.subqueries(questions), "subs")
    members = written(members.join(F.broadcast(scope_of.select("scope_id").distinct()), "scope_id", "left_semi").select("scope_id", "document_id"), "scopes")
    titles = chunks.select("document_id", F.col("document_title").alias("title")).distinct()
    asked, inside = ask_scopes(asks(questions, subs, limits), scope_of, members, titles)
    asked, inside = written(asked, "asks"), written(inside, "members")
    found = written(source_hits(asked, inside, chunks, postings, sizes, limits), "source_hits")
    hits = written(merged_sources(found, limits).select(*HIT), "merged")
    forms = asked.where("case_shape = ''").groupBy("query_id").agg(F.min_by("query_text", "sub_id").alias("retrieval_query"))
    read_as = questions.join(forms, "query_id", "left").select("query_id", F.coalesce("retrieval_query", V.normalized("query_text")).alias("query_text"))
    if vector_hits is not None:
        enough = hits.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n")).where("n >= 4").join(subs.select("query_id").distinct(), "query_id", "left_anti")
        hits = hits.unionByName(vector_hits.join(enough, "query_id", "left_anti").withColumn("source", F.lit("vector")).select(*HIT))
    named = lambda rows: rows.join(only(chunks, rows).select("chunk_id", "document_title"), "chunk_id")
    hits = written(hits.unionByName(expansion(read_as, fused(hits), chunks, postings, limits).select(*HIT)), "expanded")
    evidence = subquery_evidence(subs, named(fused(hits)), chunks, postings, limits).select(*HIT)
    hits = written(hits.unionByName(evidence), "evidence")
    around = hits.where("source in ('indexed_sparse', 'subquery_document_evidence')")
    hits = written(hits.unionByName(subquery_neighbours(subs, around, chunks, limits).select(*HIT)), "all_hits")
    ranked = fused(hits).where(F.col("position") <= limits.scan).withColumn("rerank_score", F.lit(0.0))
    candidates = written(ranked.join(only(chunks, ranked).drop("document_id", "chunk_index"), "chunk_id").join(questions.select("query_id", "query_text"), "query_id"), "candidates")
    return Run(asked, found, hits, candidates, final_list(candidates, subs, limits), members)


def final_list(candidates: DataFrame, subs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(query_id, chunk_id, document_id, final_rank): a diverse list; then chunks that broad questions lack, in place of the weakest of the same document; then the best chunk for each sub-query that nothing
    answers, in the last places."""
    base = fusion.diverse_with_deferral(candidates.withColumn("rank", F.col("position")), limits.top_k, 1)
    wide = C.coverage_supplements(candidates, base, limits.coverage_slots, limits.least_rerank, limits.least_fused)
    matches = C.subquery_matches(subs, candidates)
    more = C.subquery_supplements(matches, base, limits.subquery_slots)
    guarded = C.protected_chunks(matches, base)
    replaced = C.replace_slots(base, wide, candidates, limits.coverage_slots, limits.protected, guarded=guarded)
    return C.append_at_end(replaced, more.select("query_id", "chunk_id", "slot"), limits.top_k, limits.subquery_slots).join(candidates.select("query_id", "chunk_id", "document_id"), ["query_id", "chunk_id"])
