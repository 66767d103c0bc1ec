"""The registered queries of this package: thin wrappers over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import small_batches
from .divergence_audit import AUDIT_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's Arrow batches become small, as rows hold whole texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


_byte_level: dict[str, object] = {}


def _byte_level_encoder():
    """The column encoder of this process: a worker keeps its piece table from task to task."""
    from ._byte_level import ByteLevelColumns
    from ._pieces import task_threads

    path = tokenizer_file("byte_bpe_50k.json")
    if path not in _byte_level:
        _byte_level[path] = ByteLevelColumns(path, task_threads())
    return _byte_level[path].column


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every vector whose id is divisible by 50."""
    from .permutation_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet-matrix shards and read back."""
    from .wavelet_matrix import wavelet_store

    return wavelet_store(table(spark, sf_dir, "documents"), _byte_level_encoder, bits=16, end_id=2)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    from .divide_skip import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a SentencePiece model run by the tokenizers library."""
    from .spm_backend import spm_encode

    return spm_encode(table(spark, sf_dir, "documents"), lambda: tokenizer_file("piece_bpe_32k.model")).drop("ids")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated 400-byte strings cover."""
    from .bucket_pointer import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by compression with a good and a bad dictionary."""
    from .compression_classifier import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that 50-word windows of earlier documents cover."""
    from .relative_lz import rlz_dedup

    out = rlz_dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within a tenth of its length in edits."""
    from .pigeonhole_edit import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


#: Host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Globs over host + path that block a url without a rule.
URL_DEFAULTS = ("*adult*", "*casino*", "*/ads/*", "*.exe")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    from .glob_automaton import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES, URL_DEFAULTS)


OP9_SQL = """
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN (host || path) LIKE '%adult%' OR (host || path) LIKE '%casino%' OR (host || path) LIKE '%/ads/%' OR (host || path) LIKE '%.exe' THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by class-conditional Kneser-Ney models."""
    from .kneser_ney import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of a twentieth of the documents, weighed towards the benchmark's texts."""
    from .byte_automaton import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


#: The CRC-32 of every different feature byte by byte, with a table made from the polynomial.
OP11_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step),
raw AS (SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark),
w AS (SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
f AS (SELECT r, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM w),
n AS (SELECT feature, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f GROUP BY feature),
x AS (SELECT feature, s, t, hex(encode(feature)) AS h FROM n),
b AS (SELECT feature, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
             lambda a, c: xor(step[(xor(a, c) & 255) + 1], a >> 8))) % 10000 AS bucket FROM x, crc),
g AS (SELECT bucket, floor(1000 * ln(((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)) / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000))))::BIGINT AS gain FROM b GROUP BY bucket),
weights AS (SELECT f.r, sum(g.gain)::BIGINT AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE NOT f.target GROUP BY f.r),
scored AS (SELECT w.r, w.doc_id, len(w.w) AS n_words, len(w.w) + greatest(len(w.w) - 1, 0) + greatest(len(w.w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM w LEFT JOIN weights USING (r) WHERE NOT w.target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, n_words, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank FROM ranked
"""


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    from .cross_polytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


#: Every pair of a label, and reach by recursion.
OP12_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(b, vec_id) AS component_id, coalesce(b, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN many ON many.a = vec_id LEFT JOIN least ON least.a = vec_id WHERE vec_id IS NOT NULL
"""


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, pair by pair and term by term."""
    from .divergence_audit import divergence_audit

    return divergence_audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_permutation_index, op2_wavelet_matrix, op3_ngram_jaccard_join, op4_sentencepiece, op5_suffix_array_dedup,
        op6_quality_classifier, op7_substring_dedup, op8_benchmark_decontamination, op9_url_filter, op10_toxicity,
        op11_importance_resampling, op12_cross_polytope, op13_divergence_audit,
    )
}
ORACLE_SQL: dict[str, str] = {"op9_url_filter": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_cross_polytope": OP12_SQL, "op13_divergence_audit": AUDIT_SQL}
