"""Token ids of documents as one wavelet matrix per shard file.

A shard holds the token ids of consecutive documents (ascending doc_id) as succinct bit-planes: plane b has
one bit for each id, and below it the ids whose bit is 0 come before those whose bit is 1. A plane is packed
in blocks of 2**17 bits, each compressed by itself; a directory in the file tells where a block begins and how many
ones stand before it. So access(i), rank(id, i) (counting) and select(id, k) (occurrence lookup) read one or two
blocks of each plane, and a document is read without its neighbours. All three work on arrays of positions.

File format, little-endian: magic "WMX2", u32 plane count, u64 document count, u64 id count, u64 packed length
of the document section; for each plane, highest bit first, its directory: for each block and the end, u64 place in
the file and u64 ones before it; the document section (zstd: doc_ids as i64, lengths as u64, a byte each for null doc_ids); the blocks (zstd;
bit i of a block is bit i % 64 of its 64-bit word i // 64).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Scratch

_MAGIC = b"WMX2"
_HEADER = struct.Struct("<4sIQQQ")
#: Bits of a block.
BLOCK = 1 << 17
_ONE = np.uint64(1)


def _ones(words: np.ndarray) -> np.ndarray:
    """Ones before each word, and in all."""
    return np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))


def dump(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, no_id: np.ndarray | None = None) -> bytes:
    """A shard file. Only one plane is held unpacked. no_id: where a doc_id is null."""
    packer = zstandard.ZstdCompressor(level=1)
    n, now = len(ids), ids
    documents = packer.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + (np.zeros(len(doc_ids), bool) if no_id is None else no_id).tobytes())
    blocks = -(-n // BLOCK)
    at = _HEADER.size + bits * (blocks + 1) * 16 + len(documents)
    directory, body = [], []
    for b in range(bits - 1, -1, -1):
        bit = (now & now.dtype.type(1 << b)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        before = 0
        for k in range(blocks):
            part = packed[k * BLOCK // 8 : (k + 1) * BLOCK // 8]
            squeezed = packer.compress(part.tobytes())
            directory.append((at, before))
            body.append(squeezed)
            at += len(squeezed)
            before += int(np.bitwise_count(part).sum(dtype=np.int64))
        directory.append((at, before))
        if b:
            now = np.concatenate([now[~bit], now[bit]])
    return b"".join([_HEADER.pack(_MAGIC, bits, len(doc_ids), n, len(documents)), np.array(directory, "<u8").tobytes(), documents, *body])


class Shard:
    """A shard file. read(place, size) gives bytes of it; blocks are unpacked when a question needs them, and ``keep``
    of them are held."""

    def __init__(self, read: Callable[[int, int], bytes], keep: int = 64):
        self.read, self.keep, self._held = read, keep, {}
        magic, self.bits, docs, self.n, packed = _HEADER.unpack(read(0, _HEADER.size))
        if magic != _MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self.blocks = -(-self.n // BLOCK)
        size = self.bits * (self.blocks + 1) * 16
        directory = np.frombuffer(read(_HEADER.size, size), "<u8").reshape(self.bits, self.blocks + 1, 2).astype(np.int64)
        self.place, self.before = directory[:, :, 0], directory[:, :, 1]
        self.zeros = self.n - self.before[:, -1]
        self._unpack = zstandard.ZstdDecompressor().decompress
        raw = self._unpack(read(_HEADER.size + size, packed), max_output_size=max(1, 17 * docs))
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.no_id = np.frombuffer(raw, bool, docs, 16 * docs)
        self.ends = np.cumsum(self.lengths)
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32

    @classmethod
    def of(cls, body: bytes) -> Shard:
        return cls(lambda at, n: body[at : at + n])

    def words(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's 64-bit words, and the ones before each of them."""
        if (level, block) not in self._held:
            while len(self._held) >= self.keep:
                self._held.pop(next(iter(self._held)))
            begin, end = self.place[level, block : block + 2]
            raw = self._unpack(self.read(int(begin), int(end - begin)), max_output_size=BLOCK // 8)
            words = np.frombuffer(raw + bytes(-len(raw) % 8 + 8), "<u8")  # a word more, for the place behind the end
            self._held[level, block] = words, _ones(words)
        return self._held[level, block]

    def _by_block(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        block = np.minimum(at // BLOCK, max(self.blocks - 1, 0))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(block[part[0]]), part

    def _bits_and_ones(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place of a plane (0 behind its end), and the ones before it."""
        bit, ones = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        if self.n:
            for block, part in self._by_block(at):
                words, before = self.words(level, block)
                inside = at[part] - block * BLOCK
                word, shift = inside >> 6, (inside & 63).astype(np.uint64)
                value = words[word]
                bit[part] = value >> shift & _ONE
                ones[part] = self.before[level, block] + before[word] + np.bitwise_count(value & ((_ONE << shift) - _ONE))
        return bit, ones

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.uint64)
        for level in range(self.bits):
            bit, ones = self._bits_and_ones(level, at)
            value = value << _ONE | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return value.astype(self.dtype)

    def _down(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places go, plane by plane, on the way of a value: its occurrences before them."""
        for level in range(self.bits):
            one = value >> np.uint64(self.bits - 1 - level) & _ONE == 1
            ones = self._bits_and_ones(level, at)[1]
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each value before its place."""
        value, at = np.broadcast_arrays(np.asarray(value, np.uint64), np.asarray(at, np.int64))
        known = value >> np.uint64(self.bits) == 0
        begin, end = self._down(value, np.zeros(len(at), np.int64)), self._down(value, at)
        return np.where(known, end - begin, 0)

    def _nth(self, level: int, one: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one, or the k-th zero, of a plane; found by the directory, then in a block and in a word."""
        out = np.zeros(len(k), np.int64)
        for kind in (False, True):
            mine = np.flatnonzero(one == kind)
            if not len(mine):
                continue
            ahead = self.before[level] if kind else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.before[level]
            block = np.searchsorted(ahead, k[mine], "right") - 1
            for b, part in ((int(b), mine[block == b]) for b in np.unique(block)):
                words, before = self.words(level, b)
                words, before = (words, before) if kind else (~words, np.arange(len(before)) * 64 - before)
                left = k[part] - ahead[b]
                word = np.searchsorted(before, left, "right") - 1
                bits = np.unpackbits(words[word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                inside = np.argmax(np.cumsum(bits, axis=1) > (left - before[word])[:, None], axis=1)
                out[part] = b * BLOCK + word * 64 + inside
        return out

    def select(self, value: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th occurrence (from 0) of each value, or -1."""
        value, k = np.broadcast_arrays(np.asarray(value, np.uint64), np.asarray(k, np.int64))
        there = (k >= 0) & (k < self.rank(value, np.full(len(k), self.n)))
        out = np.full(len(k), -1, np.int64)
        value, at = value[there], self._down(value[there], np.zeros(int(there.sum()), np.int64)) + k[there]
        for level in range(self.bits - 1, -1, -1):
            one = value >> np.uint64(self.bits - 1 - level) & _ONE == 1
            at = self._nth(level, one, np.where(one, at - self.zeros[level], at))
        out[there] = at
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: only the blocks that its ids pass through are read."""
        return self.access(np.arange(self.ends[k] - self.lengths[k], self.ends[k]))

    def sequence(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the lowest plane up."""
        now = np.zeros(self.n, self.dtype)
        for level in range(self.bits - 1, -1, -1):
            packed = b"".join(self.words(level, b)[0][: BLOCK // 64].tobytes() for b in range(self.blocks))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            if level < self.bits - 1:
                up, zero = np.empty_like(now), int(self.zeros[level])
                up[~bit], up[bit] = now[:zero], now[zero:]
                now = up
            now |= bit.astype(self.dtype) << self.dtype(self.bits - 1 - level)
        return now


def write_shards(docs: DataFrame, folder: str, encoder: Callable, bits: int, end_id: int, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode documents(doc_id, text) and write them in ascending doc_id order as shard files under ``folder``.

    encoder(): makes, in a worker, a function from a column of texts to runs of (ids, ids of each row). Each document gets
    end_id appended. Returns the manifest (shard, docs, ids), one row per file; shards ascend with doc_id. A file
    is written under another name and then renamed, so a task that runs again or twice leaves a whole file.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode, shard = encoder(), TaskContext.get().partitionId()
        doc_ids, no_id, lengths, ids = [], [], [], []
        kind = np.uint16 if bits <= 16 else np.uint32
        for batch in batches:
            if len(batch):
                doc_ids.append(batch.column(0).fill_null(0).to_numpy())
                no_id.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                for own, n in encode(batch.column(1)):
                    ids.append(np.insert(own.astype(kind, copy=False), np.cumsum(n), end_id))
                    lengths.append(n + 1)
        if not doc_ids:
            return
        all_ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        body = dump(np.concatenate(doc_ids), lengths, all_ids, bits, np.concatenate(no_id))
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{path}/shard-{shard:08d}.wmx"
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as f:
            f.write(body)
        system.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(lengths)], "ids": [len(all_ids)]})

    return Scratch(spark, "wavelet").save(ordered.mapInArrow(X.trimmed(write), "shard long, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids
    as little-endian u32), and, asked of the bit-planes: first_id (access), first_id_count (how often the document has its first
    id: a difference of ranks) and first_id_next (where in the document that comes again, by select; null if it doesn't); if
    asked for, ids (array of int)."""
    spark = manifest.sparkSession
    # Running sums in two levels: no task sees more than a group of shards or one row for each group.
    groups = manifest.withColumn("group", F.floor(F.col("shard") / 4096))
    totals = groups.groupBy("group").agg(F.sum("ids").alias("total"))
    totals = totals.select("group", (F.sum("total").over(W.orderBy("group")) - F.col("total")).alias("ahead"))
    within = F.sum("ids").over(W.partitionBy("group").orderBy("shard")) - F.col("ids")
    begin = groups.join(totals, "group").select("shard", (F.col("ahead") + within).alias("begin"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(folder)
    files = files.select(F.regexp_extract("path", r"shard-(\d+)\.wmx$", 1).cast("int").alias("shard"), "content")
    names = ["shard", "doc_id", "within", "n_tokens", "ids_crc32", "first_id", "first_id_count", "first_id_next"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                body = batch.column(1)[i].as_buffer()
                shard = Shard(lambda at, n, body=body: body[at : at + n].to_pybytes(), keep=1 << 20)
                ids, ends = shard.sequence(), shard.ends
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                begins = ends - shard.lengths
                crc = [zlib.crc32(raw[a * 4 : e * 4]) for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                some = shard.lengths > 0
                first = shard.access(begins[some])
                before = shard.rank(first, begins[some])
                count = shard.rank(first, ends[some]) - before
                again = shard.select(first, np.where(count > 1, before + 1, -1)) - begins[some]
                asked = np.zeros((3, len(ends)), np.int64)
                asked[:, some] = first, count, again
                columns = [pa.array(np.full(len(ends), batch.column(0)[i].as_py(), np.int32)), pa.array(shard.doc_ids, mask=shard.no_id), pa.array(begins), pa.array(shard.lengths), pa.array(crc, pa.int64())]
                columns += [pa.array(asked[0], mask=~some), pa.array(asked[1]), pa.array(asked[2], mask=asked[1] < 2)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                whole = pa.RecordBatch.from_arrays(columns, names)
                for at in range(0, len(whole), 10_000):
                    yield whole.slice(at, 10_000)

    schema = "shard int, doc_id long, within long, n_tokens long, ids_crc32 long, first_id long, first_id_count long, first_id_next long" + ", ids array<int>" * with_ids
    rows = files.mapInArrow(X.trimmed(read), schema).join(begin, "shard")
    return rows.select("doc_id", (F.col("begin") + F.col("within")).alias("start"), *names[3:])


def wavelet_store(docs: DataFrame, encoder: Callable, bits: int, end_id: int, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write documents(doc_id, text) as wavelet-matrix shards and read them back; see write_shards, read_shards.

    Null texts are empty and have the end id only. Ids must be under 2**bits. Rows repeated under one doc_id stay
    rows, in no stated order among themselves; null doc_ids come first. Other columns are ignored; an empty table
    gives no file and no rows. folder: where the files go; by default, a new one in the shared folder.
    """
    folder = folder or Scratch(docs.sparkSession, "shards").root
    manifest = write_shards(docs, folder, encoder, bits, end_id)
    if manifest.isEmpty():
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, first_id_count long, first_id_next long"
        return docs.sparkSession.createDataFrame([], schema + ", ids array<int>" * with_ids)
    return read_shards(manifest, folder, with_ids)
