"""Source divergence audit by a baseline-correction inverted index.

Within a language each source spreads its term counts over the kept terms with a smoothed probability p, and two sources
differ on a term by f = (p - q)^2 / (p + q). Nearly all counts are zero, so a pair of sources starts at V times the f of two
zero counts, and only postings change that: a term that one of the two has adds f(p, q0) - f(p0, q0), which depends on the
count alone and is summed over a source's different counts; a term that both have adds what is left,
f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Terms that neither has are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Scratch, checked_broadcast


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of (lang, source, text): the occurrences of each (lang, source, term) and the documents that have the term."""
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lang, source)]
        group = codes[0] * len(source.dictionary) + codes[1]
        for at, n, data, off in X.steps(batch.column(2)):
            h, start, end, first = X.words(data, off, lower=True, space=X.NOT_LETTER)
            if not len(h):
                continue
            row = np.repeat(np.arange(n), np.diff(first))
            # Occurrences in order of document and term: heads are distinct terms of a document.
            order = np.lexsort((h, row))
            head = np.flatnonzero(np.append(True, (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])))
            many, some = np.diff(np.append(head, len(h))), order[head]
            g = group[at : at + n][row[some]]
            again = np.lexsort((h[some], g))
            new = np.flatnonzero(np.append(True, (g[again][1:] != g[again][:-1]) | (h[some][again][1:] != h[some][again][:-1])))
            one = some[again[new]]
            count, docs = np.add.reduceat(many[again], new), np.diff(np.append(new, len(again)))
            small = X.LOWER[data]
            size = end[one] - start[one]
            flat = small[X.ranges(start[one], size)]
            term = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(flat)).cast(pa.string())
            which = g[again[new]]
            keys = [lang.dictionary.take(pa.array(which // len(source.dictionary))), source.dictionary.take(pa.array(which % len(source.dictionary)))]
            yield pa.RecordBatch.from_arrays([k.cast(pa.string()) for k in keys] + [term, pa.array(count), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _share(n, total, v) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exact for counts beyond 9 * 10^9 too."""
    wide = [F.col(c).cast("decimal(20,0)") if isinstance(c, str) else F.lit(c).cast("decimal(20,0)") for c in (n, total, v)]
    return F.when(wide[1] + wide[2] > 0, 1 + F.call_function("div", (wide[0] + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide[1] + wide[2] * 2))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence_audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """How sources of a language differ in their words, from documents(text, lang, source).

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps the V terms that ``least_docs``
    of its documents have. Every occurring (lang, source) and each language gives each kept term
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of kept terms. Returns lang, source, part, item, value and rank:
    part 'pair' has each other source of the language and the sum over all kept terms of f = floor((p - q)^2 / (p + q)), q the other's
    (0 if V is 0); part 'term' the ``top`` kept terms of the source with p > q, q the language's, and their f. Ranks
    start at 1 for each source and part, largest value first, then the item's UTF-8 bytes.

    Null text, lang and source are ''; empty texts make their source occur; repeated rows are documents of their own. Other
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = texts.mapInArrow(X.trimmed(_counts), "lang string, source string, term string, n long, docs long")
    counted = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "all_n")
    index = scratch.save(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "index")

    # One row for each source, with what its language has; sources without a kept term too.
    sums = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = scratch.save(groups.withColumn("p0", _share(0, "total", "v")), "groups")
    near = checked_broadcast(groups, 100)
    posted = index.join(near, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    posted = scratch.save(posted.select("lang", "source", "term", "n", "all_n", "p", "p0", "v", "lang_total"), "postings")

    one, two = groups.select("lang", "source", "p0", "v"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").where("source <> item")
    start = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _gap(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    # Terms that one side has, whatever the other: by different counts of a source.
    levels = posted.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")).join(two, "lang").where("source <> item")
    single = (F.col("terms") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))).alias("value")
    levels = levels.select("lang", "source", "item", single).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Terms that both sides have: each pair of a term's postings once.
    a = posted.select("lang", "term", "source", "p", "p0")
    b = posted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = a.join(b, ["lang", "term"]).where("source < item")
    both = both.select("lang", "source", "item", (_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("value"))
    both = both.where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # f is symmetric, so a correction of one side counts for both orders of the pair.
    turned = levels.unionByName(both)
    every = start.unionByName(turned).unionByName(turned.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = every.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    share = posted.withColumn("q", _share("all_n", "lang_total", "v")).where("p > q")
    terms = share.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    return pair_rows.unionByName(terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))


#: The same sums over every kept term, without an index.
AUDIT_SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(tot.total, 0) + 2 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
      FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
