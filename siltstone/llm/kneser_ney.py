"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model give every word a probability as a chain of units: its first bytes, then longer
and longer beginnings, then the whole word, each conditioned on the one before. Counts are Kneser-Ney style
continuation counts (documents, not occurrences). A unit's class count is discounted absolutely; the mass so
freed goes to the backoff distribution of the unit among all documents, which both models share, so that a
rare expression says nothing by itself and an unknown word is judged by the beginning that it shares with
known ones. A unit that a single document of a class has is discounted wholly: all its weight goes to the backoff. A
text's evidence is the difference of the two log-likelihoods over its number of words; that and the strong part of it
are calibrated by logistic regression on labelled texts, each judged by models that have not counted its fold.

As the shared part cancels out, each unit needs one number only: its log ratio. A unit that no class has in two
documents has exactly the ratio of what is unknown below its parent, and needs no row. Counts are Spark aggregations
over all rows, and scoring reads every word of every text. A model within MODEL_BYTES is broadcast; a larger one stays
a table, and the corpus' words meet it in joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import crc_remainder, fit_logistic, label_of_each, labelled_sample, logistic
from ._shared import Scratch, with_text

_PREFIXES = (3, 4, 5, 6)
_ROOT = np.uint64(0x51ED270B9F1C3A55)
_BY_ROW = np.uint64(0xD1342543DE82EF95)
#: Units that a task gathers before it hands them on.
_HELD_UNITS = 1_000_000
#: Parts of the labelled rows for the calibration.
FOLDS = 4
#: Bytes of a model (12 for a unit or parent) that the driver takes and broadcasts.
MODEL_BYTES = 128 << 20


def _units(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[level, word]: a common root, the beginnings, the whole word."""
    sums = X.byte_prefix(data, lower=True)
    rows = [np.full(len(start), _ROOT)]
    rows += [X.spans(sums, start, np.minimum(start + k, end)) ^ np.uint64(k) for k in _PREFIXES]
    return np.stack([*rows, X.spans(sums, start, end)])


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(table) == 0:
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def unit_counts(docs: DataFrame) -> DataFrame:
    """In how many documents each unit is: all of docs(text, y, fold), those of each class (y is 0 or 1; null: of
    none), and those of each class in each fold. Columns level, unit, parent, n, c0, c1, and for each fold k<fold>0, k<fold>1."""
    names = ["n", "c0", "c1", *[f"k{f}{c}" for f in range(FOLDS) for c in (0, 1)]]

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        level, unit, parent, *seen = np.concatenate(parts, 1)
        _, first, of = np.unique(X.mix(unit + level * _BY_ROW), return_index=True, return_inverse=True)
        return np.stack([level[first], unit[first], parent[first], *[np.bincount(of, c, len(first)).astype(np.uint64) for c in seen]])

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(X.signed(np.ascontiguousarray(x))) for x in rows], ["level", "unit", "parent", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            y = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for at, _, data, off in X.steps(batch.column(0)):
                h, start, end, first = X.words(data, off, True, X.NOT_LETTER)
                row = np.repeat(np.arange(len(off) - 1), np.diff(first))
                _, one = np.unique(X.mix(h + row.astype(np.uint64) * _BY_ROW), return_index=True)
                row = row[one]
                u = _units(data, start[one], end[one])
                for level in range(len(_PREFIXES) + 1):  # a document counts once for each of its units
                    _, one = np.unique(X.mix(u[level + 1] + row.astype(np.uint64) * _BY_ROW), return_index=True)
                    unit, where, of = np.unique(u[level + 1, one], return_index=True, return_inverse=True)
                    of_class = [y[at + row[one]] == k for k in (0, 1)]
                    of_fold = fold[at + row[one]]
                    seen = [np.ones(len(one)), *of_class, *[c & (of_fold == f) for f in range(FOLDS) for c in of_class]]
                    parts.append(np.stack([np.full(len(unit), level, np.uint64), unit, u[level, one][where], *[np.bincount(of, x, len(unit)).astype(np.uint64) for x in seen]]))
                    size += len(unit)
            if size > _HELD_UNITS:
                parts = [merged(parts)]
                size = parts[0].shape[1]
                if size > _HELD_UNITS // 2:
                    yield batch_of(parts[0])
                    parts, size = [], 0
        if parts:
            yield batch_of(merged(parts))

    made = docs.select("text", "y", "fold").mapInArrow(X.trimmed(count), ", ".join(f"{c} long" for c in ("level", "unit", "parent", *names)))
    return made.groupBy("level", "unit", "parent").agg(*[F.sum(c).alias(c) for c in names])


def unit_ratios(counts: DataFrame, discount: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Log ratios from the rows of unit_counts: (level, unit, ratio, tried0, ...) of units that two documents of a class have, and
    (level, parent, ratio, tried0, ...) of all else below a parent. tried<fold>: the same without the documents of that fold; null
    where these are the only ones. ``discount`` is taken off a count, and the whole of a count of one."""
    pairs = [("c0", "c1"), *[(f"c0 - k{f}0", f"c1 - k{f}1") for f in range(FOLDS)]]
    counts = counts.select("level", "unit", "parent", "n", *[F.expr(x).alias(f"s{2 * i + c}") for i, pair in enumerate(pairs) for c, x in enumerate(pair)])
    every = range(2 * len(pairs))

    def off(i: int):
        return F.when(F.col(f"s{i}") > 1, F.lit(discount)).otherwise(F.col(f"s{i}").cast("double"))

    above = counts.groupBy("level", "parent").agg(F.sum("n").alias("n_parent"), *[F.sum(f"s{i}").alias(f"t{i}") for i in every], *[F.sum(off(i)).alias(f"f{i}") for i in every]).where("t0 + t1 > 0")
    share = F.col("n") / F.col("n_parent")

    def p(i: int):
        """A class that never saw the parent backs off to the shared distribution alone."""
        return F.when(F.col(f"t{i}") > 0, (F.col(f"s{i}") - off(i) + F.col(f"f{i}") * share) / F.col(f"t{i}")).otherwise(share)

    def rest(i: int):
        return F.when(F.col(f"t{i}") > 0, F.col(f"f{i}") / F.col(f"t{i}")).otherwise(F.lit(1.0))

    def ratios(of, seen: str) -> list:
        names = ["ratio", *[f"tried{f}" for f in range(FOLDS)]]
        return [F.when(F.expr(f"{seen}{2 * k} + {seen}{2 * k + 1} > 0"), F.log(of(2 * k + 1) / of(2 * k)).cast("float")).alias(name) for k, name in enumerate(names)]

    units = counts.where("greatest(s0, s1) > 1").join(above, ["level", "parent"])
    return units.select("level", "unit", *ratios(p, "s")), above.select("level", "parent", *ratios(rest, "t"))


@dataclass
class KneserNey:
    """Per level: known units and their log ratios; parents and the log ratio of what is unknown below them."""

    units: list[np.ndarray]
    ratios: list[np.ndarray]
    parents: list[np.ndarray]
    rest: list[np.ndarray]

    @classmethod
    def read(cls, units: DataFrame, above: DataFrame, value: str = "ratio") -> KneserNey:
        """From the written tables of unit_ratios, a level at a time; value: ratio, or tried<fold>."""
        out = cls([], [], [], [])
        for level in range(len(_PREFIXES) + 1):
            for df, key, keys, values in ((units, "unit", out.units, out.ratios), (above, "parent", out.parents, out.rest)):
                rows = df.where((F.col("level") == level) & F.col(value).isNotNull()).select(key, value).toArrow()
                hashes, found = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
                order = np.argsort(hashes)
                keys.append(hashes[order])
                values.append(found[order])
        return out

    def word_ratios(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        u = _units(data, start, end)
        out = np.zeros(len(start))
        for level, (units, ratios, parents, rest) in enumerate(zip(self.units, self.ratios, self.parents, self.rest, strict=True)):
            if len(units) == 0:
                continue
            at, known = _find(units, u[level + 1])
            up, seen = _find(parents, u[level])
            out += np.where(known, ratios[at], np.where(seen, rest[up], 0.0))
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text: mean log ratio, mean of its part over 1.5, largest, log of the word count."""
        out = np.zeros((len(column), 4))
        for at, count, data, off in X.steps(column):
            h, start, end, first = X.words(data, off, True, X.NOT_LETTER)
            _, one, of = np.unique(h, return_index=True, return_inverse=True)
            ratio = self.word_ratios(data, start[one], end[one])[of]
            n = np.diff(first)
            sums = [np.append(0.0, np.cumsum(x)) for x in (ratio, np.maximum(ratio - 1.5, 0))]
            block = out[at : at + count]
            for k, s in enumerate(sums):
                block[:, k] = (s[first[1:]] - s[first[:-1]]) / np.maximum(n, 1)
            some = n > 0
            if some.any():
                block[some, 2] = np.maximum.reduceat(ratio, first[:-1][some])
            block[:, 3] = np.log1p(n)
        return out


def shape(f: np.ndarray) -> np.ndarray:
    """Features as the calibration takes them: also the evidence summed over the text, damped."""
    n = np.expm1(f[:, 3])
    return np.column_stack([f, f[:, 0] * np.sqrt(n), np.log1p(f[:, 1] * n)])


def word_lists(docs: DataFrame) -> DataFrame:
    """docs(doc_id, held_out, text) as (doc_id, held_out, words): the different words of each text, their units from the first beginning to the whole word, and how often
    the text has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count, data, off in X.steps(batch.column(2)):
                h, start, end, first = X.words(data, off, True, X.NOT_LETTER)
                row = np.repeat(np.arange(count), np.diff(first))
                _, one, of = np.unique(X.mix(h + row.astype(np.uint64) * _BY_ROW), return_index=True, return_inverse=True)
                one = one[np.argsort(row[one], kind="stable")]
                many = np.bincount(of, minlength=len(one))[of[one]] if len(one) else np.zeros(0, np.int64)
                u = _units(data, start[one], end[one])[1:]
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1, dtype=np.int32) * len(u)), pa.array(X.signed(np.ascontiguousarray(u.T.ravel()))))
                words = pa.StructArray.from_arrays([units, pa.array(many)], ["units", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[one], minlength=count))).astype(np.int32)), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, count), batch.column(1).slice(at, count), lists], ["doc_id", "held_out", "words"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(X.trimmed(run), "doc_id long, held_out boolean, words array<struct<units:array<long>,n:long>>")


def features_by_joins(docs: DataFrame, units: DataFrame, above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, held_out, f0 ... f5): what shape(features) gives, with the model as tables: the different words of the corpus get their ratios in joins with its units and parents, and each text's words theirs in one more.
    Texts hold each word once, and joins with the commonest words can be split."""
    lists = scratch.save(word_lists(docs).withColumn("row", F.monotonically_increasing_id()), f"words{name}")
    long = lists.select("row", F.explode("words").alias("x")).select("row", F.element_at("x.units", -1).alias("word"), "x.n", "x.units")
    chain = long.groupBy("word").agg(F.first("units").alias("units"))
    chain = chain.select("word", F.posexplode("units").alias("level", "unit"), F.concat(F.array(F.lit(int(_ROOT.view(np.int64)))), F.slice("units", 1, len(_PREFIXES))).alias("before"))
    chain = chain.select("word", "level", "unit", F.get("before", F.col("level")).alias("parent"))
    known = chain.join(units.select("level", "unit", "ratio"), ["level", "unit"], "left").join(above.select("level", "parent", F.col("ratio").alias("rest")), ["level", "parent"], "left")
    ratio = scratch.save(known.groupBy("word").agg(F.sum(F.coalesce("ratio", "rest", F.lit(0.0)).cast("double")).alias("ratio")), f"word_ratios{name}")
    said = long.select("row", "word", "n").join(ratio, "word")
    sums = said.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("ratio") * F.col("n")).alias("all"), F.sum(F.greatest(F.col("ratio") - 1.5, F.lit(0.0)) * F.col("n")).alias("strong"), F.max("ratio").alias("most"))
    rows = lists.select("row", "doc_id", "held_out").join(sums, "row", "left").na.fill(0, ["n", "all", "strong", "most"])
    n = F.greatest("n", F.lit(1)).cast("double")
    mean, strong, count = F.col("all") / n, F.col("strong") / n, F.col("n").cast("double")
    features = [mean, strong, F.col("most"), F.log1p(count), mean * F.sqrt(count), F.log1p(strong * count)]
    return rows.select("doc_id", "held_out", *[x.alias(f"f{i}") for i, x in enumerate(features)])


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.5, max_docs: int = 12_000, max_bytes: int = 40 << 20, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Score documents(doc_id, text) for toxicity, learned from labels(doc_id, toxic).

    Labels are used only from rows whose crc32(doc_id as text) modulo ``modulus`` is not ``held_out``. The models count
    all of these rows, and the shared backoff counts all documents. The calibration learns from a sample of at most
    max_docs documents a class and about max_bytes of text; the evidence of each is taken from counts without its fold, one of FOLDS.
    Returns doc_id, held_out (of a null doc_id: false), score (0 to 1) and predicted
    (score >= threshold). Null and empty texts, and texts without letters, get the score of no evidence. If one
    class has no labels, every score is the calibration's base rate. Of contradicting labels of a document the larger
    counts. Repeated rows stay rows; other columns are ignored; an empty table gives no rows. A model of over model_bytes
    is never gathered: the calibration's texts and all others meet it in joins, with the same scores but for rounding.
    """
    rest = F.coalesce(crc_remainder(modulus) == held_out, F.lit(False))
    fold = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(10)), F.lit(FOLDS)), F.lit(0)).cast("int")
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    of_class = scratch.save(label_of_each(labels, "toxic", ~rest), "labels")
    known = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of_class, 0, "left")
    counts = scratch.save(unit_counts(known.select("text", "y", fold.alias("fold"))), "counts")
    units, above = (scratch.save(df, name) for df, name in zip(unit_ratios(counts), ("units", "above"), strict=True))
    small = 12 * (units.count() + above.count()) <= model_bytes
    texts, y, part = labelled_sample(docs, labels, "toxic", ~rest, max_docs, max_bytes, fold)
    evidence = np.zeros((len(y), 6))
    if small:
        for f in np.unique(part):
            own = np.flatnonzero(part == f)
            evidence[own] = shape(KneserNey.read(units, above, f"tried{f}").features(pa.array([texts[i] for i in own], pa.large_string())))
    elif len(y):
        asked = spark.createDataFrame([(i, int(f), t) for i, (f, t) in enumerate(zip(part, texts, strict=True))], "doc_id long, fold int, text string")
        for f in np.unique(part):
            one = asked.where(F.col("fold") == int(f)).withColumn("held_out", F.lit(False))
            own = [d.withColumn("ratio", F.col(f"tried{f}")).where("ratio is not null") for d in (units, above)]
            for r in features_by_joins(one, *own, scratch, f"_of{f}").collect():  # as many rows as the sample has
                evidence[r.doc_id] = [r[f"f{i}"] for i in range(6)]
    del texts
    w = fit_logistic(evidence, y)
    scratch.drop("labels", "counts")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rest.alias("held_out"), "text")
    if not small:
        made, z = features_by_joins(some, units, above, scratch, ""), F.lit(float(w[-1]))
        for i, weight in enumerate(w[:-1].tolist()):
            z = z + F.col(f"f{i}") * weight
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        return made.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    shared = spark.sparkContext.broadcast((KneserNey.read(units, above), w))
    scratch.drop("units", "above")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = shared.value
        for batch in batches:
            p = logistic(shape(model.features(batch.column(2))), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return some.mapInArrow(X.trimmed(score), "doc_id long, held_out boolean, score double, predicted int")
