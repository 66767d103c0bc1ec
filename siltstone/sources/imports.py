"""Public benchmark files as documents, access entries and cases; annotations of cases; upserts of what was imported before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import text as T
from .files import read_qrels

#: Other names of a context's text and its scope, and of fields of an annotation; fixed values.
CONTEXT_KEYS = ("contexts", "context", "passages", "documents", "evidence", "supporting_facts", "sp", "gold_contexts", "public_contexts", "private_contexts", "texts")
ANNOTATIONS = ("expected_outcome", "expected_evidence_markers", "expected_key_facts", "forbidden_key_facts", "scoring_notes", "metadata")


def read_beir(spark: SparkSession, folder: str, split: str = "test", dataset: str = "beir", max_documents: int = 1_000, limit: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(documents, cases) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv: the first ``limit`` judged queries, and the first ``max_documents`` documents together with all that
    those queries need; both limits are the import's own."""
    q = spark.read.json(f"{folder}/queries.jsonl").select(F.col("_id").cast("string").alias("query_id"), F.trim("text").alias("question"))
    judged = read_qrels(spark, f"{folder}/qrels/{split}.tsv").join(q, "query_id")
    chosen = judged.select("query_id").distinct().orderBy("query_id").limit(limit)
    judged = judged.join(chosen, "query_id", "left_semi")
    name = F.concat(F.lit(f"{dataset}:"), "document_id")
    text = F.concat_ws("\n\n", F.nullif(F.trim(T.text("title")), F.lit("")), F.nullif(F.trim(T.text("text")), F.lit("")))
    corpus = spark.read.json(f"{folder}/corpus.jsonl").select(F.col("_id").cast("string").alias("document_id"), text.alias("content")).where("content <> ''")
    some = corpus.orderBy("document_id").limit(max_documents).unionByName(corpus.join(judged.select("document_id").distinct(), "document_id", "left_semi")).dropDuplicates(["document_id"])
    documents = some.select("document_id", name.alias("title"), "content", F.lit("public").alias("principal_type"))
    titles = judged.join(documents.select("document_id", "title"), "document_id").groupBy("query_id", "question").agg(F.sort_array(F.collect_set("title")).alias("expected_titles"))
    return documents, titles.select(F.concat(F.lit("beir:"), "query_id").alias("case_name"), "question", "expected_titles", F.lit("answer").alias("outcome"))


def contexts(rows: DataFrame) -> DataFrame:
    """rows(case_id, payload: JSON) as (case_id, pos, scope, title, content): the contexts under any of the known names, as strings or objects with text, content or passage; private where the name or
    the object says so, else public."""
    kind = "array<struct<text:string,content:string,passage:string,title:string,scope:string>>"
    parts = []
    for key in CONTEXT_KEYS:
        own = F.get_json_object("payload", f"$.{key}")
        plain = F.transform(F.from_json(own, "array<string>"), lambda s: F.when(~s.startswith("{"), F.struct(s.alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("scope"))))
        full = F.transform(F.from_json(own, kind), lambda x: F.struct(F.coalesce(x.text, x.content, x.passage).alias("content"), x.title.alias("title"), x.scope.alias("scope")))
        scope = "private" if key.startswith("private") else "public"
        items = F.filter(F.when(F.trim(own).rlike(r"^\[\s*\{"), full).otherwise(plain), lambda x: x.isNotNull() & (T.text(x.content) != ""))
        parts.append(F.coalesce(F.transform(items, lambda x: F.struct(F.coalesce(x.scope, F.lit(scope)).alias("scope"), x.title.alias("title"), x.content.alias("content"))), F.array().cast("array<struct<scope:string,title:string,content:string>>")))  # noqa: B023 - called at once
    return rows.select("case_id", F.posexplode(F.concat(*parts)).alias("pos", "c")).select("case_id", "pos", "c.*")


def scope_acl(rows: DataFrame) -> DataFrame:
    """contexts() as access entries (title, principal_type, role): public ones for all, private ones for managers; a text of both scopes is public."""
    by = rows.groupBy(F.coalesce("title", F.sha2("content", 256)).alias("title")).agg(F.bool_or(F.col("scope") != "private").alias("public"))
    return by.select("title", F.when(F.col("public"), "public").otherwise("role").alias("principal_type"), F.when(~F.col("public"), "manager").alias("role"))


def law_documents(clauses: DataFrame) -> DataFrame:
    """clauses(clause_id, name, content) as one document for each law: (title, content, n_clauses), its clauses headed by their articles, in the order of their numeric ids."""
    named = A.law_and_article("name")
    rows = clauses.select(named.alias("n"), F.expr("try_cast(clause_id as int)").alias("k"), F.col("clause_id").cast("string").alias("id"), F.trim(T.text("content")).alias("content")).where("content <> ''")
    part = F.concat(F.lit("## "), "n.article_name", F.lit("\n条款全称："), "n.law_name", "n.article_name", F.lit("\n"), "content")
    rows = rows.select(F.col("n.law_name").alias("title"), F.struct(F.coalesce("k", F.lit(2**31 - 1)).alias("k"), "id", part.alias("part")).alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x.part), "\n\n")
    return rows.groupBy("title").agg(F.concat(F.lit("# "), F.first("title"), F.lit("\n\n"), body).alias("content"), F.count("*").alias("n_clauses"))


def finance_cases(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, cases) of rows(financebench_id, question, answer, doc_name, evidence array of struct evidence_text): the documents are those of files(path) whose stem is a row's doc_name; rows without a
    file make no case."""
    own = files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("doc_name"))
    docs = own.join(rows.select("doc_name").distinct(), "doc_name", "left_semi").select(F.col("doc_name").alias("title"), "path")
    kept = rows.join(own.select("doc_name").distinct(), "doc_name", "left_semi")
    marks = F.filter(F.transform("evidence", lambda e: F.trim(e.evidence_text)), lambda t: F.coalesce(t, F.lit("")) != "")
    return docs, kept.select(F.concat(F.lit("financebench:"), F.col("financebench_id").cast("string")).alias("case_name"), "question", F.array("doc_name").alias("expected_titles"), marks.alias("markers"), F.array("answer").alias("facts"))


def import_documents(old: DataFrame, new: DataFrame, refresh: bool = True) -> DataFrame:
    """new(title, checksum, ...) with action against old(title, checksum): insert, refresh (another checksum: a new version) or reuse; without ``refresh`` a known title is always reused."""
    known = old.groupBy("title").agg(F.max("checksum").alias("_old"))
    changed = F.col("_old").isNotNull() & (F.col("_old") != F.col("checksum"))
    action = F.when(F.col("_old").isNull(), "insert").when(changed & F.lit(refresh), "refresh").otherwise("reuse")
    return new.join(known, "title", "left").withColumn("action", action).drop("_old")


def changed_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new(path, content) that a text sink has to write: unknown paths, and those whose content differs."""
    return new.join(old.select("path", F.sha2("content", 256).alias("_h")), "path", "left").where(F.col("_h").isNull() | (F.col("_h") != F.sha2("content", 256))).drop("_h")


def keyed_texts(payload: DataFrame) -> DataFrame:
    """payload(json) as (key, content): a mapping of keys to texts, or a list of objects whose key is any of id, document_id, title and document_title; each of its names is a key."""
    item = "array<struct<id:string,document_id:string,title:string,document_title:string,text:string,content:string,extracted_text:string>>"
    many = F.from_json("json", item)
    one = F.map_entries(F.from_json("json", "map<string,string>"))
    rows = payload.select(F.explode(F.coalesce(many, F.array().cast(item))).alias("x")).select(F.array("x.id", "x.document_id", "x.title", "x.document_title").alias("keys"), F.coalesce("x.text", "x.content", "x.extracted_text").alias("content"))
    rows = rows.select(F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"), "content")
    plain = payload.where(F.trim("json").startswith("{")).select(F.explode(one).alias("e")).select("e.key", F.col("e.value").alias("content"))
    return rows.unionByName(plain).where("content is not null and key <> ''")


def fact_specs(values: Column) -> Column:
    """JSON texts or plain strings as fact specs (label, aliases with the label first, weight of 1 if none or not positive); the first of equal labels."""
    own = F.transform(values, lambda v: F.struct(F.from_json(v, "label string, aliases array<string>, weight double").alias("j"), v.alias("raw")))
    spec = F.transform(own, lambda x: F.struct(
        F.trim(F.coalesce(x.j.label, F.when(~F.trim(x.raw).startswith("{"), x.raw), F.lit(""))).alias("label"), x.j.aliases.alias("aliases"), F.when(F.coalesce(x.j.weight, F.lit(1.0)) > 0, F.coalesce(x.j.weight, F.lit(1.0))).otherwise(1.0).alias("weight"),
    ))
    spec = F.filter(spec, lambda s: s.label != "")
    labels = F.transform(spec, lambda s: s.label)
    spec = F.filter(spec, lambda s, i: F.array_position(labels, s.label) == i + 1)
    return F.transform(spec, lambda s: F.struct(s.label.alias("label"), F.array_distinct(F.concat(F.array(s.label), F.coalesce(F.filter(s.aliases, lambda a: T.text(a) != ""), F.array().cast("array<string>")))).alias("aliases"), s.weight.alias("weight")))


def case_annotations(cases: DataFrame) -> DataFrame:
    """cases(case_id, demo, notes: JSON or free text, keywords array, expected_titles array) with the annotation that counts: of the demo set, else of the notes (known fields only), else made of keywords: (case_id,
    outcome, facts, source)."""
    valid = F.trim(T.text("notes")).startswith("{") & F.get_json_object("notes", "$").isNotNull()
    pick = lambda c, key: F.get_json_object(c, f"$.{key}")
    source = F.when(T.text("demo") != "", "demo").when(valid, "external").otherwise("legacy")
    text = F.when(source == "demo", F.col("demo")).when(source == "external", F.col("notes"))
    outcome = F.coalesce(pick(text, "expected_outcome"), F.when(F.size("expected_titles") > 0, "answer").otherwise("refuse"))
    facts = F.from_json(pick(text, "expected_key_facts"), "array<string>")
    return cases.select("case_id", outcome.alias("outcome"), fact_specs(F.coalesce(facts, F.col("keywords"))).alias("facts"), source.alias("source"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each document of versions(document_id, version_number, ...)."""
    n = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("version_number")))
    return versions.withColumn("_n", n).where("_n = 1").drop("_n")
