"""Substring dedup by relative Lempel-Ziv parsing.

Every document is a reference for those with a larger doc_id. A document is parsed greedily into factors,
each the longest match in an indexed reference block that reaches furthest; factors of at least ``window``
words are duplicate spans, and at the boundary of two factors the parse goes back to the first window that
crosses it, so that no window is missed.

The reference index is distributed: blocks are the word neighbourhoods of minimiser anchors (see _windows),
indexed by the anchor's q-gram. A window and every earlier copy of it have the same anchor at the same
offset, so all blocks against which a piece of a document has to be factored meet under one index key, and
no task holds the corpus. Equal blocks are one class, represented by its least doc_id. Index keys with over
``hot`` different blocks are resolved by window hash and least doc_id, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Scratch, with_text
from ._windows import ANCHOR, per_document, shared_buckets
from .bucket_pointer import marked


def factor_reach(blocks: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the matches of each pair of blocks reach from their anchors: words before and from the anchor on.

    blocks: word hashes; at: each block's anchor position. [i, j] compares block i with block j.
    """
    m, before = len(blocks), int(at.max())
    after = max(len(b) - int(a) for b, a in zip(blocks, at, strict=True))
    grid = np.zeros((m, before + after), np.uint64)
    real = np.zeros((m, before + after), bool)
    for i, (b, a) in enumerate(zip(blocks, at, strict=True)):
        grid[i, before - a : before - a + len(b)] = b
        real[i, before - a : before - a + len(b)] = True
    left, right = np.empty((m, m), np.int64), np.empty((m, m), np.int64)
    for i in range(m):
        differ = (grid != grid[i]) | ~real | ~real[i]
        left[i] = np.where(differ[:, :before].any(1), np.argmax(differ[:, :before][:, ::-1], 1), before) if before else 0
        right[i] = np.where(differ[:, before:].any(1), np.argmax(differ[:, before:], 1), after)
    return left, right


def parse(at: int, last: int, left: np.ndarray, right: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors of one block: (first window start, number of starts) of every factor of at least ``window`` words.

    at: the anchor; last: the block's last window start; left, right: reach of the match with each reference block.
    """
    fit = left + right >= window
    begin, end = at - left[fit], at + right[fit]
    out = []
    pos = 0
    while pos <= last:
        open_ = begin <= pos
        far = int(end[open_].max()) if open_.any() else -1
        if far - pos >= window:  # the longest factor from here on
            stop = min(far - window, last)
            out.append((pos, stop - pos + 1))
            pos = stop + 1  # the first window across the factor's end
        else:
            later = begin[begin > pos]
            if len(later) == 0:
                break
            pos = int(later.min())
    return out


def earlier_ranges(docs: DataFrame, scratch: Scratch, window: int, q: int, hot: int) -> DataFrame:
    """(doc_id, lo, n): runs of starts of windows that also start in a document with a smaller doc_id."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, data, off in X.steps(batch.column(1)):
                h, _, _, first = X.words(data, off)
                sums = X.prefix(h)
                gram = X.grams(sums, q)
                row, pos, lo, n = X.anchors(gram, first[:-1], np.diff(first), window, q)
                c = X.spans(sums, lo, lo + n - 1 + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at + row]), pa.array(X.signed(gram[pos])), pa.array(X.signed(c)), pa.array(lo - first[row]), pa.array(n)],
                    ["doc_id", "h", "c", "lo", "n"],
                )

    buckets = shared_buckets(docs.mapInArrow(X.trimmed(find), ANCHOR), scratch, hot)
    # The class's least document may still repeat an earlier block in part.
    wanted = buckets.classes.groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", "lo", "n", "hot")).alias("wanted"))
    wanted = scratch.save(wanted, "wanted")
    held = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    texts = with_text(docs, wanted, 40 * held, "inner").select("doc_id", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "c", "lo", "n", "anchor", "body", "w"]
        for batch in batches:
            for at, count, data, off in X.steps(batch.column(1)):
                want = batch.column(2).slice(at, count)
                size = np.asarray(pa.compute.list_value_length(want)).astype(np.int64)
                f = want.flatten()
                row = np.repeat(np.arange(count), size)
                h, c, lo, n, is_hot = (f.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                word, _, _, first = X.words(data, off)
                sums = X.prefix(word)
                begin = first[row] + lo
                end = begin + n - 1 + window
                real = end <= first[row + 1]
                real[real] = X.signed(X.spans(sums, begin[real], end[real])) == c[real]
                gram = X.signed(X.grams(sums, q))
                doc = batch.column(0).slice(at, count).to_numpy(zero_copy_only=False)[row]
                one = np.flatnonzero(real & ~is_hot)
                size = end[one] - begin[one]
                anchor = np.array([int(np.argmax(gram[b : e - q + 1] == k)) for b, e, k in zip(begin[one], end[one], h[one], strict=True)], np.int64)
                body = np.ascontiguousarray(word[X.ranges(begin[one], size)])
                blob = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.append(0, np.cumsum(size * 8)).astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(x[one]) for x in (doc, h, c, lo, n)] + [pa.array(anchor), blob, pa.nulls(len(one), pa.int64())], names)
                each = np.flatnonzero(real & is_hot)
                if len(each):
                    start = X.ranges(begin[each], n[each])
                    again = np.repeat(each, n[each])
                    w = X.signed(X.spans(sums, start, start + window))
                    none = pa.nulls(len(again), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(h[again]), pa.array(c[again]), pa.array(start - begin[again]), pa.array(np.ones(len(again), np.int64)), none, pa.nulls(len(again), pa.binary()), pa.array(w)], names)

    pieces = scratch.save(texts.mapInArrow(X.trimmed(cut), "doc_id long, h long, c long, lo long, n long, anchor long, body binary, w long"), "pieces")

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple[int, int, int, int]] = []

        def flush() -> None:
            # Reference blocks in ascending doc_id; a document never refers to itself.
            if len(held) < 2 or held[0][0] == held[-1][0]:
                return
            left, right = factor_reach([np.frombuffer(x[4], np.uint64) for x in held], np.array([x[3] for x in held]))
            owners = np.array([x[0] for x in held])
            for i, (doc, c, n, a, _) in enumerate(held):
                refs = int(np.searchsorted(owners, doc))
                if refs:
                    out.extend((key, c, *x) for x in parse(a, n - 1, left[i, :refs], right[i, :refs], window))

        def emit() -> pa.RecordBatch:
            table = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            out.clear()
            return pa.RecordBatch.from_arrays(table, ["h", "c", "lo", "n"])

        for batch in batches:
            for doc, h, c, n, a, body in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if h != key:
                    flush()
                    key, held = h, []
                held.append((doc, c, n, a, body))
            yield emit()
        flush()
        yield emit()

    ordered = pieces.where("w is null").select("doc_id", "h", "c", "n", "anchor", "body").repartition("h").sortWithinPartitions("h", "doc_id", "c")
    parsed = ordered.mapInArrow(X.trimmed(factor), "h long, c long, lo long, n long")
    hot_rows = pieces.where("w is not null").select("w", "doc_id", "h", "c", "lo", "n")
    least = hot_rows.groupBy("w").agg(F.min("doc_id").alias("first"))
    parsed = parsed.unionByName(hot_rows.join(least, "w").where("doc_id > first").select("h", "c", "lo", "n"))
    parts = parsed.groupBy("h", "c").agg(F.collect_list(F.struct("lo", "n")).alias("parts"))
    # Documents after the class's least repeat it whole; the least one only where an earlier block matches.
    info = buckets.info.where("copies > 1 or width > 1").join(parts, ["h", "c"], "left")
    info = scratch.save(info.where("copies > 1 or parts is not null"), "resolved")
    ranges = F.when(F.col("doc_id") > F.col("least"), F.array(F.struct("lo", "n"))).otherwise(
        F.transform("parts", lambda p: F.struct((F.col("lo") + p.lo).alias("lo"), p.n.alias("n")))
    )
    return buckets.anchors.join(info, ["h", "c"]).select("doc_id", F.explode(ranges).alias("r")).select("doc_id", "r.lo", "r.n")


def rlz_dedup(docs: DataFrame, window: int = 50, q: int = 20, hot: int = 256) -> DataFrame:
    """documents(doc_id, text) without words that windows of ``window`` words cover which an earlier document has.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; earlier means a smaller doc_id; windows are those of the input.
    Returns doc_id, n_words, n_removed, kept (the other words joined by one space). Null and empty texts have no
    words; repeats within one document stay; rows repeated under one doc_id count as one document; rows with a
    null doc_id take no part and are kept whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "rlz")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = earlier_ranges(docs.where("doc_id is not null"), scratch, window, q, hot)
    table, size = per_document(ranges, scratch, "marks")
    scratch.drop("anchors", "shared", "wanted", "pieces", "resolved")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count, data, off in X.steps(batch.column(1)):
                _, start, end, first = X.words(data, off)
                marks = batch.column(2).slice(at, count)
                mask = np.zeros(len(start), bool)
                for i in np.flatnonzero(np.asarray(marks.is_valid())):
                    f = marks[int(i)].values
                    mine = np.stack([f.field(0).to_numpy(), f.field(1).to_numpy()], 1)
                    mine = mine[mine[:, 0] + mine[:, 1] - 1 + window <= first[i + 1] - first[i]]
                    mask[first[i] : first[i + 1]] = marked(int(first[i + 1] - first[i]), mine, window)
                # One space between kept words: copy each with a space in front, then drop each row's first.
                keep = np.flatnonzero(~mask)
                row = np.searchsorted(first, keep, "right") - 1
                size = end[keep] - start[keep]
                out = np.full(int(size.sum()) + len(keep), 0x20, np.uint8)
                to = np.cumsum(size + 1) - size
                out[X.ranges(to, size)] = data[X.ranges(start[keep], size)]
                head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
                hold = np.ones(len(out), bool)
                hold[to[head] - 1] = False
                length = np.bincount(row, size + 1, count).astype(np.int64)
                length[row[head]] -= 1
                blob = pa.Array.from_buffers(pa.large_string(), count, [None, pa.py_buffer(np.append(0, np.cumsum(length))), pa.py_buffer(out[hold])]).cast(pa.string())
                n, gone = np.diff(first), np.append(0, np.cumsum(mask))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, count), pa.array(n), pa.array(gone[first[1:]] - gone[first[:-1]]), blob], ["doc_id", "n_words", "n_removed", "kept"])

    return with_text(docs, table, size, "left").select("doc_id", "text", "marks").mapInArrow(X.trimmed(remove), "doc_id long, n_words long, n_removed long, kept string")
