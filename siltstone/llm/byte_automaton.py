"""Target-distribution importance resampling over hashed n-grams.

The bytes of a whole Arrow column are classified with one lookup table; words begin and end where the class changes. The
CRC-32 of every n-gram is then advanced for all starts of the column at once, one byte a step, by table: after the bytes of
its first word each start holds the CRC of a 1-gram, after a space and the next word that of a 2-gram, and so on. Only
two tables of a fixed number of buckets leave the corpus: its counts and, from them, the gain of each bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Scratch

#: All bytes but digits, ASCII letters and the bytes of other characters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Words that are still running when only so few are left, or after so many bytes, are finished one by one: a single very
#: long word would otherwise take a step of its own for every byte.
FEW, LONG = 32, 255


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 of polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = crc_table()


def step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))


def advance(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Inner CRC states after data[start:end], for all starts at once; longer words stay in the race, shorter ones leave it."""
    size = end - start
    key = np.minimum(size, LONG).astype(np.uint8)
    order = np.argsort(np.uint8(LONG) - key, kind="stable")  # longest first: those still running are always a prefix
    crc, at, size = crc[order], start[order], size[order]
    # running[j]: how many have more than j bytes.
    running = len(size) - np.cumsum(np.bincount(key, minlength=LONG + 1))
    done = 0
    while done < LONG and running[done] > FEW:
        live = running[done]
        crc[:live] = step(crc[:live], data[at[:live] + done])
        done += 1
    for i in range(int(np.count_nonzero(size > done))):
        crc[i] = zlib.crc32(data[at[i] + done : at[i] + size[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def boundaries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (+ end)."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~NOT_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return start, end, np.searchsorted(start, off)


def features(data: np.ndarray, off: np.ndarray, longest: int = 3) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each row; and for n = 1 .. longest the rows and unsigned CRC-32s of all runs of n words joined by one space."""
    data = X.LOWER[data]
    start, end, first = boundaries(data, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    last = first[1:][row] if len(row) else row
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    out, held = [], np.arange(len(start))
    for n in range(longest):
        if n:
            go = held + n < last[held]
            held, crc = held[go], step(crc[go], np.uint32(0x20))
        crc = advance(crc, data, start[held + n], end[held + n])
        out.append((row[held], crc ^ np.uint32(0xFFFFFFFF)))
    return np.diff(first), out


#: Tasks that add up what all tasks have counted; as many arrays come to the driver.
SUM_TASKS = 32


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of the texts (column text) fall in each bucket. Each task passes on one array of counts; SUM_TASKS tasks add them up, and the driver adds their sums."""

    def total_of(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for counts in arrays:
            total += counts
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, _, data, off in X.steps(batch.column(0)):
                    for _, crc in features(data, off, longest)[1]:
                        yield np.bincount(crc % np.uint32(buckets), minlength=buckets)

        return total_of(each())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total_of(np.frombuffer(x.as_buffer(), np.int64) for batch in batches for x in batch.column(0))

    counted = texts.select(F.col("text").cast("string")).mapInArrow(X.trimmed(count), "counts binary").repartition(SUM_TASKS)
    rows = counted.mapInArrow(X.trimmed(add), "counts binary").collect()
    return sum((np.frombuffer(r.counts, np.int64) for r in rows), np.zeros(buckets, np.int64))


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's smoothed shares in target and corpus)."""
    n, big, small = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (big + n)) / ((s + 1) * (small + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """Documents(doc_id, text) weighed by how much more likely their word runs are in target(text), and a draw of them without
    replacement (the highest sums of weight and Gumbel noise that the doc_id and seed fix).

    Returns, for every row of docs, doc_id, n_features (runs of 1 to ``longest`` words, repeats counted), n_words, weight,
    score and rank: 1, 2, 3 ... for the ``percent`` percent (rounded down) best of the documents with ``least_words`` words
    or more, ties to the smaller doc_id (then fewer features, then the smaller weight); null for the others. Null and empty texts
    have no features and weight 0; a null doc_id is '' in the noise and comes first among ties. Rows repeated under a doc_id are documents of their own.
    Other columns are ignored; an empty table gives no rows, and an empty target counts 0 in every bucket.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    gain = gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for at, n, data, off in X.steps(batch.column(1)):
                words[at : at + n], found = features(data, off, longest)
                for row, crc in found:
                    total[at : at + n] += np.bincount(row, minlength=n)
                    # Sums of integers under 2**53 are exact in the doubles that bincount adds.
                    weight[at : at + n] += np.bincount(row, gain[crc % np.uint32(buckets)], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(total), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(X.trimmed(weigh), "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = scratch.save(rows.withColumn("score", F.col("weight") + noise).withColumn("fits", F.col("n_words") >= least_words), "weights")

    # Places in the global order without one task that sees every row: ranges in order, each row's place in its range, and
    # how many rows stand before the range.
    order = [F.desc("fits"), F.desc("score"), "doc_id", "n_features", "weight"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, "ranged").withColumn("part", F.shiftright("at", 33))
    per_part = {r.part: (r.n, r.fits) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fits").alias("fits")).collect()}
    draw, before, upto = percent * sum(f for _, f in per_part.values()) // 100, [], 0
    for part in sorted(per_part):
        before.append((part, upto))
        upto += per_part[part][0]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))  # a row for each task
    rank = F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1
    return ranged.join(offsets, "part").withColumn("rank", F.when(F.col("fits") & (rank <= draw), rank)).select("doc_id", "n_features", "n_words", "weight", "score", "rank")
