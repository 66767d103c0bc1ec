"""Repeated substrings by suffix sorting with bucket-pointer refinement.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too. Whether the
string at a position is repeated is read off a suffix order sorted to depth ``length``: positions are put
into buckets of their first q bytes, and buckets are refined by the bucket identifiers of the positions
q further on; the new identifiers are at once the sort keys of the next, twice as deep refinement.
Positions alone in their bucket leave the sort.

The sort never holds the corpus. Runs of neighbourhoods that are equal as a whole, as in copies of documents and
passages, are one row to begin with (cut by content, so that equal passages are cut alike). Of the rest, minimiser anchors (see _windows) hand each task whole buckets of the
corpus-wide suffix order: all positions whose windows can be equal meet in one task, and no other.
Equal neighbourhoods are compared by hash and never shipped. Buckets of over ``hot`` different
neighbourhoods are counted by window instead, as rows that Spark combines and spreads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Scratch, with_text
from ._windows import per_document, shared_buckets

_Q = 8  # bytes of the initial buckets: one 64-bit word
_RUN = np.uint64(8)  # neighbourhoods in a run, on average


def _identifiers(*keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers in the order of the keys: the index of the bucket's first position."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def repeated_starts(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the identifier of its bucket at depth ``length``: equal where the strings are equal.

    data: bytes of several pieces; ends: for each position, the end of its piece; a start has ``length``
    bytes before that. Only positions that a later refinement reads are sorted.
    """
    n = len(data)
    depths = [min(_Q, length)]
    while depths[-1] < length:
        depths.append(min(depths[-1] * 2, length))
    # Positions needed at each depth, from the last one back.
    need = [starts]
    for deep, shallow in zip(depths[:0:-1], depths[-2::-1], strict=True):
        mark = np.zeros(n, bool)
        mark[need[-1]] = True
        mark[need[-1] + deep - shallow] = True
        need.append(np.flatnonzero(mark))
    need.reverse()
    pointer = np.full(n, -1, np.int64)
    at = need[0]
    word = np.zeros(len(at), np.uint64)
    for k in range(depths[0]):
        word = (word << np.uint64(8)) | data[at + k].astype(np.uint64)
    pointer[at] = _identifiers(word)
    for shallow, deep, at in zip(depths, depths[1:], need[1:], strict=False):
        first, later = pointer[at], pointer[at + deep - shallow]
        size = np.bincount(first, minlength=n)
        many = size[first] > 1
        # A position alone in its bucket stays alone; its pointer is already final.
        fresh = first.copy()
        sub = _identifiers(first[many], later[many])
        where = np.flatnonzero(many)
        # The first position of each new bucket takes a slot inside the old bucket: pointers stay in sorted order.
        if len(where):
            order = np.lexsort((later[many], first[many]))
            f = first[many][order]
            run = np.maximum.accumulate(np.where(np.append(True, f[1:] != f[:-1]), np.arange(len(f)), 0))
            fresh[where] = first[where] + (sub - run_of(sub, run, order))
        pointer[at] = fresh
    return pointer[starts]


def run_of(sub: np.ndarray, run: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, where its old bucket begins in the refined order."""
    out = np.empty(len(sub), np.int64)
    out[order] = run
    return out


def _bytes(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8)


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int, q: int, hot: int, bucket_bytes: int) -> DataFrame:
    """(doc_id, lo, n): runs of starts of strings of ``length`` bytes that start more than once in all texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, count, data, off in X.steps(batch.column(1)):
                sums = X.byte_prefix(data)
                gram = X.grams(sums, q)
                row, pos, lo, n = X.anchors(gram, off[:-1], np.diff(off), length, q)
                c = X.spans(sums, lo, lo + n - 1 + length)
                if not len(row):
                    continue
                # A document's neighbourhoods follow each other; a run begins with the document, and where the hash says so.
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]) | (c % _RUN == 0))
                size = np.diff(np.append(first, len(row)))
                many = np.add.reduceat(n, first)
                g = X.spans(sums, lo[first], lo[first] + many - 1 + length)
                inside = lo - np.repeat(lo[first], size)
                parts = pa.StructArray.from_arrays([pa.array(X.signed(gram[pos])), pa.array(X.signed(c)), pa.array(inside), pa.array(n)], ["h", "c", "lo", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + row[first]]), pa.array(X.signed(g)), pa.array(lo[first] - off[row[first]]), pa.array(many), lists], ["doc_id", "g", "lo", "n", "parts"])

    runs = scratch.save(docs.mapInArrow(X.trimmed(find), "doc_id long, g long, lo long, n long, parts array<struct<h:long,c:long,lo:long,n:long>>"), "runs")
    kinds = runs.groupBy("g").agg(F.count("*").alias("w"), F.min(F.struct("doc_id", "lo", "parts")).alias("rep"))
    kinds = scratch.save(kinds.select("g", "w", "rep.doc_id", "rep.lo", "rep.parts"), "kinds")
    copied = runs.select("doc_id", "g", "lo", "n").join(kinds.where("w > 1").select("g"), "g", "left_semi").select("doc_id", "lo", "n")
    one = kinds.select("doc_id", "w", F.col("lo").alias("begin"), F.explode("parts").alias("p"))
    one = one.select("doc_id", "p.h", "p.c", (F.col("begin") + F.col("p.lo")).alias("lo"), "p.n", "w")
    buckets = shared_buckets(one, scratch, hot)
    whole = buckets.anchors.join(buckets.info.where("copies > 1"), ["h", "c"]).select("doc_id", "lo", "n").unionByName(copied)
    wanted = buckets.classes.groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", "copies", "lo", "n", "hot")).alias("wanted"))
    wanted = scratch.save(wanted, "wanted")
    held = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    texts = with_text(docs, wanted, 48 * held, "inner").select("doc_id", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count, data, off in X.steps(batch.column(1)):
                want = batch.column(2).slice(at, count)
                size = np.asarray(pa.compute.list_value_length(want)).astype(np.int64)
                f = want.flatten()
                row = np.repeat(np.arange(count), size)
                h, c, copies, lo, n, is_hot = (f.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                begin = off[row] + lo
                end = begin + n - 1 + length
                # A repeated doc_id may hold another text: only contexts that are really there count.
                real = end <= off[row + 1]
                sums = X.byte_prefix(data)
                real[real] = X.signed(X.spans(sums, begin[real], end[real])) == c[real]
                one = np.flatnonzero(real & ~is_hot)
                cut_off = np.append(0, np.cumsum(end[one] - begin[one]))
                body = data[X.ranges(begin[one], end[one] - begin[one])]
                blob = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(cut_off.astype(np.int32)), pa.py_buffer(body)])
                doc = batch.column(0).slice(at, count).to_numpy(zero_copy_only=False)[row]
                names = ["doc_id", "h", "copies", "lo", "n", "body", "w"]
                yield pa.RecordBatch.from_arrays([pa.array(x[one]) for x in (doc, h, copies, lo, n)] + [blob, pa.nulls(len(one), pa.int64())], names)
                if (real & is_hot).any():
                    each = np.flatnonzero(real & is_hot)
                    start = X.ranges(begin[each], n[each])
                    again = np.repeat(each, n[each])
                    w = X.signed(X.spans(sums, start, start + length))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[again]), pa.array(h[again]), pa.array(copies[again]), pa.array(start - off[row[again]]), pa.array(np.ones(len(again), np.int64)), pa.nulls(len(again), pa.binary()), pa.array(w)], names
                    )

    pieces = texts.mapInArrow(X.trimmed(cut), "doc_id long, h long, copies long, lo long, n long, body binary, w long")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            doc, h, copies, lo, n = (batch.column(k).to_numpy() for k in range(5))
            data = _bytes(batch, 5)
            many = n - 1 + length
            begin = np.cumsum(many) - many
            starts = X.ranges(begin, n)
            piece = np.repeat(np.arange(len(n)), n)
            pointer = repeated_starts(data, np.repeat(begin + many, many), starts, length)
            twice = np.bincount(pointer, minlength=len(data))[pointer] > 1
            on = np.flatnonzero(twice & (copies[piece] == 1))
            if len(on):
                head = np.append(True, (np.diff(on) != 1) | (np.diff(piece[on]) != 0))
                k = np.flatnonzero(head)
                p, s = piece[on[k]], starts[on[k]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array(lo[p] + s - begin[p]), pa.array(np.diff(np.append(k, len(on))))], ["doc_id", "lo", "n"])

        for batch in batches:
            if not len(batch):
                continue
            h = batch.column(1).to_numpy()
            at = 0
            for to in [*(np.flatnonzero(h[1:] != h[:-1]) + 1), len(h)]:  # rows of a bucket are together
                if size >= bucket_bytes and h[at] != last:
                    yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
                part = batch.slice(at, to - at)
                held.append(part)
                size += int(np.sum(batch.column(4).to_numpy()[at:to]) + (to - at) * length)
                last, at = h[at], to
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    pieces = scratch.save(pieces, "pieces")
    sorted_pieces = pieces.where("w is null").drop("w").repartition("h").sortWithinPartitions("h")
    refined = sorted_pieces.mapInArrow(X.trimmed(refine), "doc_id long, lo long, n long")
    hot_rows = pieces.where("w is not null").select("w", "doc_id", "lo", "n", "copies")
    seen = hot_rows.groupBy("w").agg(F.count("*").alias("times")).where("times > 1")
    return whole.unionByName(refined).unionByName(hot_rows.where("copies = 1").join(seen, "w").select("doc_id", "lo", "n"))


def marked(data_len: int, marks: np.ndarray, length: int) -> np.ndarray:
    """Mask of what runs of starts cover."""
    edge = np.zeros(data_len + 1, np.int64)
    np.add.at(edge, marks[:, 0], 1)
    np.add.at(edge, marks[:, 0] + marks[:, 1] - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_dedup(docs: DataFrame, length: int = 400, q: int = 100, hot: int = 4_000, bucket_bytes: int = 1 << 19, whole_chars: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """documents(doc_id, text) without the bytes that repeated strings of ``length`` bytes cover.

    Strings are those of the input, overlaps count, occurrences in the same document count, matches never
    cross documents. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary), and the columns
    named in ``keep`` as they are (other names than those). With
    whole_chars a run shrinks to whole UTF-8 characters, so that kept stays text. Null texts are empty; texts
    under ``length`` bytes are kept whole; rows repeated under one doc_id count as different places, and as
    their removed bytes are found by doc_id, should hold the same text; rows with a null doc_id take no part and
    are kept whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    some = docs.select("doc_id", "text").where("doc_id is not null")
    table, size = per_document(repeated_ranges(some, scratch, length, q, hot, bucket_bytes), scratch, "marks")
    scratch.drop("runs", "kinds", "anchors", "shared", "wanted", "pieces")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, marks in zip(batch.column(1).fill_null(""), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.as_buffer() else b""
                gone, runs, kept = 0, 0, raw
                if marks.is_valid:
                    data = np.frombuffer(raw, np.uint8)
                    f = marks.values
                    mask = marked(len(data), np.stack([f.field(0).to_numpy(), f.field(1).to_numpy()], 1), length)
                    if whole_chars:
                        mask = whole_characters(data, mask)
                    gone, runs = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = data[~mask].tobytes()
                for k, v in zip(out, (len(raw), gone, runs, kept), strict=True):
                    out[k].append(v)
            columns = [batch.column(0), *(pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], ["doc_id", *out, *keep])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    schema += "".join(f", `{k}` {dict(docs.dtypes)[k]}" for k in keep)
    return with_text(docs, table, size, "left").select("doc_id", "text", "marks", *keep).mapInArrow(X.trimmed(remove), schema)


def whole_characters(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """mask without characters that are only partly in it."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    full = np.ones(int(char[-1]) + 1 if len(char) else 0, bool)
    full[char[~mask]] = False
    return full[char]
