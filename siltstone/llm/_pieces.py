"""Each different piece of text encoded once per worker: a hash table of pieces in plain arrays.

Texts are cut where a tokenizer never joins. Of the pieces of a whole column only those that the table lacks go through
the tokenizers library, as a list of chunks that it may spread over threads; the ids of the column are then gathered.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from . import _text as X

#: Pieces that a worker keeps (about 40 bytes each); beyond it starts anew.
TABLE_PIECES = 1_000_000
#: Pieces in one string of the list that the library gets.
CHUNK_PIECES = 2_000


def use_threads(n: int) -> None:
    """Threads of the tokenizers library in this process; a Spark task has one core unless told otherwise."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if n > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(n)


def task_threads() -> int:
    """Cores of the running Spark task (spark.task.cpus)."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return max(1, task.cpus()) if task else 1


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class PieceTable:
    """Hash of a piece -> its ids. Open addressing over whole arrays of hashes."""

    def __init__(self, dtype: type, limit: int = TABLE_PIECES) -> None:
        self.limit = limit
        self.flat = np.zeros(1 << 14, dtype)
        self.begin = np.zeros(1 << 12, np.int64)
        self._resize(13)
        self.count = 0

    def _resize(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.where = np.zeros(1 << bits, np.int32)

    def fresh(self) -> None:
        """Called between columns: an over-full table starts anew."""
        if self.count > self.limit:
            self._resize(13)
            self.count = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each piece, or -1."""
        out = np.full(len(h), -1, np.int64)
        live, slot, last = np.arange(len(h)), self._slot(h), len(self.keys) - 1
        while len(live):
            there = self.keys[slot]
            hit = there == h[live]
            out[live[hit]] = self.where[slot[hit]]
            on = ~hit & (there != 0)
            live, slot = live[on], (slot[on] + 1) & last
        return out

    def _place(self, h: np.ndarray, index: np.ndarray) -> None:
        slot, last = self._slot(h), len(self.keys) - 1
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one place one stays
            mine = self.keys[slot] == h
            self.where[slot[mine]] = index[mine]
            h, index, slot = h[~mine], index[~mine], (slot[~mine] + 1) & last

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> int:
        """New different pieces; returns the index of the first."""
        n, base = self.count, int(self.begin[self.count]) if self.count else 0
        self.count += len(h)
        self.begin = _room(self.begin, self.count + 1)
        self.begin[n : self.count + 1] = base + np.append(0, np.cumsum(size))
        self.flat = _room(self.flat, base + len(ids))
        self.flat[base : base + len(ids)] = ids
        bits = len(self.keys).bit_length() - 1
        if 2 * self.count > len(self.keys):
            old = self.keys != 0
            keys, where = self.keys[old], self.where[old]
            self._resize(max(bits + 1, (3 * self.count).bit_length()))
            self._place(keys, where)
        self._place(h, np.arange(n, self.count, dtype=np.int32))
        return n

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces with these indices, one after the other, and the number of each piece's."""
        begin = self.begin[at]
        size = self.begin[at + 1] - begin
        return self.flat[X.ranges(begin, size)], size


class PieceColumns:
    """Encodes columns of texts by pieces. A tokenizer's cutting and its strings are its subclass's."""

    #: The library's tokenizer for whole texts, and the one for chunks of pieces, which splits at ``separator``.
    full: Tokenizer
    bare: Tokenizer
    separator: int
    #: For each token, the bytes of text it stands for.
    length: np.ndarray

    def __init__(self, dtype: type, threads: int = 1) -> None:
        use_threads(threads)
        self.dtype, self.table = dtype, PieceTable(dtype)

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether a mark is put before it, of each piece; whether a row has to be encoded whole)."""
        raise NotImplementedError

    def strings(self, body: np.ndarray, ends: np.ndarray) -> list[str]:
        """Chunks of separated pieces, given as bytes, in the form that ``bare`` takes; ends: where chunks end."""
        raise NotImplementedError

    def encode_new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one after the other, and the number of each piece's."""
        size = end - start + marked
        width = size + 1
        at = np.cumsum(width) - width
        body = np.full(int(width.sum()), self.separator, np.uint8)
        body[at[marked]] = 0x20
        plain = end - start
        body[X.ranges(at + marked, plain)] = data[X.ranges(start, plain)]
        ends = np.append(at[CHUNK_PIECES::CHUNK_PIECES], len(body))
        made = self.bare.encode_batch_fast(self.strings(body, ends), add_special_tokens=False)
        ids = np.concatenate([np.array(m.ids, self.dtype) for m in made])
        upto = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size)) + 1
        return ids, np.diff(upto, prepend=0)

    def encode_bytes(self, data: np.ndarray, off: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of bytes, and the number of each row's. text_of(row): the row's string."""
        self.table.fresh()
        start, end, marked, odd = self.cut(data, off)
        row = np.searchsorted(off, start, "right") - 1
        keep = ~odd[row]
        start, end, marked, row = start[keep], end[keep], marked[keep], row[keep]
        h = X.spans(X.byte_prefix(data), start, end) ^ (marked.astype(np.uint64) << np.uint64(17)) | np.uint64(1)
        at = self.table.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one = np.unique(h[missing], return_index=True)
            one = missing[one]
            ids, size = self.encode_new(data, start[one], end[one], marked[one])
            at[missing] = self.table.add(new, size, ids) + np.searchsorted(new, h[missing])
        ids, size = self.table.ids(at)
        n = np.bincount(row, size, len(off) - 1).astype(np.int64)
        rows = np.flatnonzero(odd)
        if len(rows):
            ends, parts, begin = np.cumsum(n), [], 0
            for r, made in zip(rows.tolist(), self.full.encode_batch_fast([text_of(int(r)) for r in rows], add_special_tokens=False), strict=True):
                own = np.array(made.ids, self.dtype)
                parts += [ids[begin : ends[r]], own]
                begin, n[r] = int(ends[r]), len(own)
            ids = np.concatenate([*parts, ids[begin:]])
        return ids, n
