"""Labelled rows for classifiers, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def crc_remainder(modulus: int):
    """crc32(doc_id as text) modulo modulus; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def label_of_each(labels: DataFrame, label: str, use) -> DataFrame:
    """doc_id and its label y of the rows that meet use; rows with null or other labels are left out, and of
    contradicting labels the larger counts."""
    return labels.where(use).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use, max_docs: int, max_bytes: int, fold=None) -> tuple[list[str], np.ndarray] | tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and 0/1 labels of at most max_docs documents of each class and about max_bytes of text in all.

    use: condition on doc_id that a row must meet. Which rows are taken depends on hashes of doc_ids alone. Rows
    with null or other labels are left out; of contradicting labels of a document the larger counts. fold: a number on
    doc_id, returned for each text as a third value.
    """
    one = label_of_each(labels, label, use)
    # A bounded top list of narrow rows for each class: limits are pushed before the shuffle.
    picked = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    running = F.sum(F.octet_length("text")).over(W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(W.unboundedPreceding, -1))
    part = F.lit(0) if fold is None else fold
    rows = texts.withColumn("before", running).where(F.coalesce("before", F.lit(0)) < max_bytes // 2).select("doc_id", "text", "y", part.alias("fold")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    made = [r.text for r in rows], np.array([r.y for r in rows], np.int64)
    return made if fold is None else (*made, np.array([r.fold for r in rows], np.int64))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression on standardised features, folded back to raw ones."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    damp = np.full(len(w), ridge)
    damp[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(damp + 1e-9), a.T @ (y - p) - damp * w)
        # A full Newton step may overshoot on separable data.
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
