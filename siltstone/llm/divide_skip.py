"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Which documents may link is narrowed without loss before any list is merged. Two sets with
J(A, B) >= t differ in at most D = (|A| + |B|) (1 - t) / (1 + t) elements, so of D + 1 parts of the hash
universe one is equal in both. Of the documents that share such a part, those whose parity sketches differ
in more bits than D are no candidates (every such bit is a differing element); the others form candidate
clusters. Each cluster is one small inverted index, on which the T-occurrence search runs: a document's shingle lists are
sorted by length, the short ones merged, the L longest left out and binary-probed only for documents
that already occur often enough in the short ones to still reach the required overlap T. L is DivideSkip's
T / (mu log M + 1), M the longest list. Merging sorted lists by a heap and by one sort of their concatenation count the
same occurrences; the sort runs on whole arrays and is what is done here.

Cost at scale: copies collapse to one set before anything is joined; a document makes about
2 D narrow rows; one shuffle by part; a spanning forest (never all pairs) between the sets of a part; the
texts of candidate documents only are read again. Clusters over ``cluster_shingles`` are cut into
blocks and searched block against block, so that no task holds an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import BROADCAST_BYTES, Scratch, with_text
from .components import connected_components


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes: row, hash, and the index of each row's first (+ end).

    A row with fewer than k words has its whole word sequence as one shingle; without words, none.
    """
    h, _, _, first = X.words(data, offsets, lower)
    count = np.diff(first)
    sums = X.prefix(h)
    long = np.maximum(count - k + 1, 0)
    start = X.ranges(first[:-1], long)
    row = np.repeat(np.arange(len(count)), long)
    few = np.flatnonzero((count > 0) & (count < k))
    start, size = np.append(start, first[few]), np.append(np.full(len(start), k), count[few])
    row, h = np.append(row, few), X.spans(sums, start, start + size)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(len(count) + 1))


class Threshold:
    """J >= num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """The least intersection of sets of sizes a and b that links them."""
        total = (a + b) * self.num
        return -(-total // (self.den + self.num))

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower size ends of bands such that linked sets are in the same or adjacent ones, and parts for each band."""
        ends, t = [1], Fraction(self.num, self.den)
        while ends[-1] <= largest:
            ends.append(max(ends[-1] + 1, math.floor(ends[-1] / t) + 1))
        parts = []
        for upper in ends[1:]:
            a = upper - 1  # the largest smaller set of the band, and its largest partner
            b = math.floor(a / t)
            parts.append((a + b) * (self.den - self.num) // (self.den + self.num) + 1)
        return np.array(ends[:-1]), np.array(parts)


def signatures(row: np.ndarray, h: np.ndarray, first: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every part of every set: under its own band's parts and those of the band below."""
    size = np.diff(first)
    if len(h) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, parts = rule.bands(int(size.max()))
    band = np.searchsorted(low, size, "right") - 1
    rows, sigs = [], []
    top, scrambled = (h >> np.uint64(32)), X.mix(h.copy())
    for back in (0, 1):
        b = band - back
        k = np.where((size > 0) & (b >= 0), parts[np.maximum(b, 0)], 0)
        base = np.cumsum(k) - k
        live = np.repeat(k > 0, size)
        # Hashes of a row ascend, so a part is a run of them.
        part = np.repeat(base, size)[live] + ((top[live] * np.repeat(k, size)[live].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(k.sum()), np.uint64)
        if len(part):
            run = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            total[part[run]] = np.add.reduceat(scrambled[live], run)
        within = X.ranges(np.zeros(len(k), np.int64), k)
        salt = (np.repeat(np.maximum(b, 0), k).astype(np.uint64) << np.uint64(32)) | within.astype(np.uint64)
        rows.append(np.repeat(np.arange(len(k)), k))
        sigs.append(X.mix(total + X.mix(salt + np.uint64(1))))
    return np.concatenate(rows), np.concatenate(sigs)


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(X.mix(h + np.uint64(0x1234567)), first[:-1][some])
    return X.mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set, the parity of the number of its elements at every bit: a power of two of bits, the set's size or more.

    h: the sets' hashes one after the other. Two sketches of one length differ in at most as many bits as the sets differ in
    elements; the XOR of a sketch's halves is the sketch of half the length.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    at = np.repeat(base, size) + (X.mix(h + np.uint64(0x51)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [packed[b // 8 : (b + n) // 8] for b, n in zip(base.tolist(), bits.tolist(), strict=True)]


def _folded(sketch: bytes, length: int) -> int:
    value, n = int.from_bytes(sketch, "little"), len(sketch)
    while n > length:
        n //= 2
        value = (value >> (8 * n)) ^ (value & ((1 << (8 * n)) - 1))
    return value


def plausible_links(sizes: list[int], marks: list[bytes], rule: Threshold) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches allow a link."""
    n = len(sizes)
    length = min(map(len, marks))
    if n == 2:
        a, b = sizes
        apart = (_folded(marks[0], length) ^ _folded(marks[1], length)).bit_count()
        if min(a, b) >= rule.overlap(a, b) and apart <= (a + b) * (rule.den - rule.num) // (rule.den + rule.num):
            yield 0, 1
        return
    words = np.frombuffer(b"".join(_folded(m, length).to_bytes(length, "little") for m in marks), np.uint64).reshape(n, -1)
    size = np.array(sizes)
    union = _Union(n)
    for i in range(n - 1):
        total = size[i] + size[i + 1 :]
        fit = np.minimum(size[i], size[i + 1 :]) >= rule.overlap(size[i], size[i + 1 :])
        fit &= np.bitwise_count(words[i + 1 :] ^ words[i]).sum(1) <= total * (rule.den - rule.num) // (rule.den + rule.num)
        for j in np.flatnonzero(fit):
            if union.join(i, i + 1 + int(j)):
                yield i, i + 1 + int(j)


#: DivideSkip's weight of a probe against a merge step.
MU = 0.01


def long_lists(least: int, longest: int) -> int:
    """How many of the longest lists are probed and not merged, for a required overlap of ``least``."""
    return min(least - 1, int(least / (MU * math.log2(max(longest, 2)) + 1)))


class _Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        r = self.root
        while r[i] != i:
            r[i] = r[r[i]]
            i = r[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j


def t_occurrence(sets: list[np.ndarray], rule: Threshold, left: int | None = None) -> Iterator[tuple[int, int]]:
    """Links (i, j) that connect what links connect: a spanning forest of the links, found by DivideSkip.

    sets: sorted distinct shingle hashes. With ``left``, sets[:left] are one block and the rest another
    and only links between the blocks are sought. A pair already connected isn't probed again.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")  # lists keep ascending owners
    sorted_h, lists = every[order], owner[order]
    new = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1])) if len(sorted_h) else np.zeros(0, np.int64)
    length = np.diff(np.append(new, len(sorted_h)))
    which = np.empty(len(every), np.int64)
    which[order] = np.repeat(np.arange(len(new)), length)
    at = np.append(0, np.cumsum(size))
    union = _Union(n)
    for i in range(n):
        mine = which[at[i] : at[i + 1]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        a = int(size[i])
        # The least overlap with any partner of a fitting size; at most T - 1 of the lists may stay unmerged.
        least = max(1, int(rule.overlap(a, -(-a * rule.num // rule.den))))
        skipped = min(long_lists(least, int(length[mine[-1]])), a) if a else 0
        short, long = mine[: a - skipped], mine[a - skipped :]
        short = short[length[short] > 1]
        if len(short) == 0:
            continue
        merged = lists[X.ranges(new[short], length[short])]
        found, count = np.unique(merged, return_counts=True)
        ok = found > i if left is None else (found >= left if i < left else np.zeros(len(found), bool))
        found, count = found[ok], count[ok]
        need = rule.overlap(a, size[found])
        fit = (np.minimum(a, size[found]) >= need) & (count + skipped >= need)
        found, count, need = found[fit], count[fit], need[fit]
        by = np.argsort(-count, kind="stable")
        for j, c, t in zip(found[by], count[by], need[by], strict=True):
            if union.find(i) == union.find(int(j)):
                continue
            c = int(c)
            if c < t and len(long):
                other = sets[j]
                values = sorted_h[new[long]]
                probe = np.searchsorted(other, values)
                probe[probe == len(other)] = 0
                c += int((other[probe] == values).sum())
            if c >= t and union.join(i, int(j)):
                yield i, int(j)


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, lower: bool = True, cluster_shingles: int = 4_000_000, group_limit: int = 4_096) -> DataFrame:
    """Classes and components of documents(doc_id, text) whose k-word shingle sets have J >= num / den.

    Returns doc_id, n_shingles (set size), component_id (least doc_id reachable by links). A link is
    den * |A & B| >= num * |A | B|. Null and empty texts, and texts without words, have no shingles and
    link with nothing: each is its own component. Repeated rows stay rows. Rows with a null doc_id have
    no part in any component and come back with a null component_id. Other columns are ignored; an empty
    table gives no rows. Copies (equal sets) collapse to one set before the search and are never paired.
    """
    spark, rule = docs.sparkSession, Threshold(num, den)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, count, data, off in X.steps(batch.column(1)):
                row, h, first = shingles(data, off, k, lower)
                fp = fingerprints(h, first)
                size = np.diff(first)
                _, kept = np.unique(fp, return_index=True)  # one of equal sets makes the signatures
                keep = np.zeros(len(fp), bool)
                keep[kept] = True
                on = np.repeat(keep, size)
                srow, sig = signatures(row[on], h[on], np.append(0, np.cumsum(np.where(keep, size, 0))), rule)
                sig_by = np.bincount(srow, minlength=count)
                off32 = np.append(0, np.cumsum(sig_by * 8)).astype(np.int32)
                order = np.argsort(srow, kind="stable")
                blob = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(off32), pa.py_buffer(np.ascontiguousarray(sig[order]))])
                marks = np.full(count, b"", object)
                marks[keep] = sketches(h[on], size[keep])
                yield pa.RecordBatch.from_arrays([ids.slice(at, count), pa.array(size, pa.int64()), pa.array(X.signed(fp)), blob, pa.array(marks, pa.binary())], ["doc_id", "n", "fp", "sigs", "sketch"])

    made = scratch.save(docs.mapInArrow(X.trimmed(sets_of), "doc_id long, n long, fp long, sigs binary, sketch binary"), "sets")
    per_doc = made.select("doc_id", "n", "fp", "sketch")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob = batch.column(1)
            size = np.asarray(pa.compute.binary_length(blob)).astype(np.int64) // 8
            sig = np.frombuffer(b"".join(blob.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(batch.column(0).to_numpy(), size))], ["sig", "fp"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of signatures that more than one set has; repeated rows once. The input is sorted."""
        sig, fp, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the row held back, and whether one before it shares its signature

        def rows(keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig[: len(keep)][keep]), pa.array(fp[: len(keep)][keep])], ["sig", "fp"])

        for batch in batches:
            sig, fp = np.append(sig, batch.column(0).to_numpy()), np.append(fp, batch.column(1).to_numpy())
            if len(sig) == 0:
                continue
            new = np.append(True, (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1]))
            sig, fp = sig[new], fp[new]
            same = sig[1:] == sig[:-1]
            left = np.append(before, same)
            yield rows(left[:-1] | same)
            sig, fp, before = sig[-1:], fp[-1:], bool(left[-1])
        yield rows(np.full(len(sig), before))

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        key, centre, out = None, None, []

        def close() -> None:
            if len(held) > 1:
                out.extend((held[j][0], held[i][0]) for i, j in plausible_links([x[1] for x in held], [x[2] for x in held], rule))

        for batch in batches:
            for f, g, n, m in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != key:
                    close()
                    key, centre, held = g, None, []
                if centre is not None:  # too many for one comparison: all of them stay candidates
                    out.append((f, centre))
                    continue
                held.append((f, n, m))
                if len(held) > group_limit:
                    centre = held[0][0]
                    out.extend((x[0], centre) for x in held[1:])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    classes = per_doc.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = scratch.save(classes.where("doc_id is not null"), "classes")
    groups = (
        made.where("octet_length(sigs) > 0").select("fp", "sigs").mapInArrow(X.trimmed(parts), "sig long, fp long")
        .repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(X.trimmed(shared), "sig long, fp long")
    )
    figures = classes.agg(F.count("*"), F.sum(F.octet_length("sketch"))).first()
    marks = classes.select("fp", "n", "sketch")
    if (figures[0] or 0) * 48 + (figures[1] or 0) <= BROADCAST_BYTES:
        # A broadcast join leaves the rows of a signature together, in the order they came in.
        groups = groups.join(F.broadcast(marks), "fp")
    else:
        groups = groups.join(marks, "fp").repartition("sig").sortWithinPartitions("sig", "fp")
    candidates = groups.select("fp", "sig", "n", "sketch").mapInArrow(X.trimmed(plausible), "u long, v long").distinct()
    candidates = scratch.save(candidates, "candidates")
    cluster = scratch.save(connected_components(candidates), "cluster")
    cluster = cluster.unionByName(cluster.select(F.col("root").alias("node"), "root").distinct())

    members = scratch.save(classes.join(cluster, classes.fp == cluster.node).select("doc_id", "fp", "n", F.col("root").alias("cluster")), "members")
    scratch.drop("candidates")

    # Blocks: members of a cluster by running size, so that a block holds at most cluster_shingles / 2.
    half = cluster_shingles // 2
    total = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    blocks = members.join(total, "cluster").withColumn("blocks", F.ceil(F.col("total") / half).cast("int"))
    blocks = blocks.withColumn("block", F.when(F.col("blocks") <= 2, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    single = F.col("blocks") <= 2
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    tile = F.when(single, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(others, lambda o: F.struct(F.least("block", o).cast("int").alias("i"), F.greatest("block", o).cast("int").alias("j")))
    )
    sets = scratch.save(blocks.select("doc_id", "fp", "cluster", "block", tile.alias("tiles")), "tiles")
    texts = with_text(docs, sets, 64 * sets.count(), "inner")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count, data, off in X.steps(batch.column(3)):
                _, h, first = shingles(data, off, k, lower)
                same = pa.array(X.signed(fingerprints(h, first)) == batch.column(0).slice(at, count).to_numpy())  # else another text under a repeated doc_id
                blob = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, count) for i in range(3)] + [batch.column(4).slice(at, count), blob], ["fp", "cluster", "block", "tiles", "set"]).filter(same)

    loaded = (
        texts.select("fp", "cluster", "block", "text", "tiles")
        .mapInArrow(X.trimmed(load), "fp long, cluster long, block int, tiles array<struct<i:int,j:int>>, set binary")
        .select("fp", "cluster", "block", F.explode("tiles").alias("tile"), "set").select("cluster", "tile.i", "tile.j", "block", "fp", "set")
        .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "fp")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            unique = {f: (b, s) for b, f, s in held}  # a repeated row of a document brings its set twice
            if len(unique) > 1:
                fps = list(unique)
                sets = [np.frombuffer(unique[f][1], np.uint64) for f in fps]
                left = sum(unique[f][0] == key[1] for f in fps) if key[1] != key[2] else None
                links = list(t_occurrence(sets, rule, left))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i, _ in links], pa.int64()), pa.array([fps[j] for _, j in links], pa.int64())], ["u", "v"])

        for batch in batches:
            for c, i, j, b, f, s in zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True):
                if (c, i, j) != key:
                    yield from flush()
                    held, key = [], (c, i, j)
                held.append((b, f, s))
        if key is not None:
            yield from flush()

    links = scratch.save(loaded.mapInArrow(X.trimmed(search), "u long, v long"), "links")
    joined = scratch.save(connected_components(links), "joined")
    scratch.drop("tiles", "members", "cluster")
    label = classes.join(joined, classes.fp == joined.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = label.groupBy("root").agg(F.min("doc_id").alias("component"))
    label = label.join(least, "root").select("fp", "component")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return per_doc.join(label, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
