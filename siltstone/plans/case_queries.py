"""Registered queries of building benchmark cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing
from . import tables as D
from .registry import query


@query(
    """, c AS (SELECT lang AS domain, document_id AS doc_id, document_id * 100000 + chunk_index AS key, row_number() OVER (PARTITION BY lang ORDER BY document_id, chunk_index) AS place FROM chunks JOIN docs USING (document_id) WHERE lang IS NOT NULL),
    z AS (WITH RECURSIVE w(domain, i, doc, q, a, b) AS (SELECT DISTINCT domain, 0::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM c
      UNION ALL SELECT w.domain, i + 1, CASE WHEN len(q) = 0 THEN c.doc_id ELSE doc END, CASE WHEN len(q) = 0 OR doc = c.doc_id THEN list_append(q, c.key) ELSE q[2:] END, CASE WHEN len(q) > 0 AND doc <> c.doc_id THEN q[1] END, CASE WHEN len(q) > 0 AND doc <> c.doc_id THEN c.key END FROM w JOIN c ON c.domain = w.domain AND c.place = i + 1) SELECT * FROM w)
    SELECT domain, a AS first_key, b AS second_key, row_number() OVER (PARTITION BY domain ORDER BY a) AS pair_no FROM z WHERE a IS NOT NULL"""
)
def cross_document_pairs(spark, d):
    """Chunks of different documents of a language, paired as the case builder pairs evidence."""
    rows = D.chunks(spark, d).join(D.documents(spark, d).select("document_id", "lang"), "document_id")
    key = F.col("document_id") * 100_000 + F.col("chunk_index")
    return pairing.cross_document_pairs(rows.select(F.col("lang").alias("domain"), F.col("document_id").alias("doc_id"), key.alias("key")))
