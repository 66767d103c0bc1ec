"""SentencePiece models run by the tokenizers library.

The model file is read as protobuf wire format, without a schema library: pieces with scores and kinds,
trainer and normaliser settings. From them a tokenizer is rebuilt: the normaliser (the model's own character
map, white-space folding, dummy prefix), the space marker, unigram scores or BPE merges ranked by piece score,
byte fallback. parity() compares with the sentencepiece library, ids for ids, on every text it is given.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from . import _text as X
from ._pieces import PieceColumns, task_threads

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, other kinds as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = body[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(body):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, body[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    whitespace_only: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def read(cls, body: bytes) -> Model:
        out = cls()
        for number, value in _fields(body):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                out.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                spec = dict(_fields(value))
                out.kind, out.byte_fallback, out.unknown = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
                if spec.get(24, 0):
                    raise ValueError("models that treat white space as suffix are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.fold_spaces, out.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return out

    def merges(self) -> list[tuple[str, str]]:
        """All ways to make a piece of two pieces, best piece score first."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
                pairs.sort(key=lambda p: (rank[p[0]], rank[p[1]]))
                found += [(-score, rank[piece], n, pair) for n, pair in enumerate(pairs)]
        found.sort(key=lambda x: x[:3])
        return [pair for *_, pair in found]

    def normalizer(self) -> normalizers.Normalizer:
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.fold_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def tokenizer(self, normalize: bool = True) -> Tokenizer:
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        if normalize:
            out.normalizer = self.normalizer()
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        return out

    def splits_at_marks(self) -> bool:
        """Whether no piece holds a space marker after another character."""
        return self.escape_spaces and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind != CONTROL)


class Encoder(PieceColumns):
    """Ids of whole texts as the sentencepiece library gives them, without control ids."""

    separator = 0  # texts that hold a NUL are encoded whole

    def __init__(self, path: str, threads: int = 1) -> None:
        with open(path, "rb") as f:
            self.model = Model.read(f.read())
        pieces = self.model.pieces
        super().__init__(np.uint16 if len(pieces) <= 1 << 16 else np.uint32, threads)
        self.full = self.model.tokenizer()
        self.bare = self.model.tokenizer(normalize=False)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\0", "removed")
        # What a token stands for: the marker is a blank, a byte piece that byte.
        spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.spelled, self.spelled_at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.length) - self.length
        # Byte lengths tell where a piece ends only if nothing becomes "unknown".
        self.by_piece = self.model.splits_at_marks() and self.model.byte_fallback and not self.model.charsmap and not self.model.fold_spaces

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces begin at the first blank of a run; that of a text gets the dummy prefix."""
        some = off[1:] > off[:-1]
        if not self.by_piece:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, bool), some
        gap = data == 0x20
        first = gap.copy()
        first[1:] &= ~gap[:-1]
        head = np.zeros(len(data), bool)
        head[off[:-1][some]] = True
        start = np.flatnonzero(first | head)
        e2 = np.flatnonzero(data[:-2] == 0xE2)
        mark = e2[(data[e2 + 1] == 0x96) & (data[e2 + 2] == 0x81)]
        odd = np.zeros(len(off) - 1, bool)
        odd[np.searchsorted(off, np.append(np.flatnonzero(data == 0), mark), "right") - 1] = True
        return start, np.append(start[1:], len(data)), head[start] & self.model.dummy_prefix, odd

    def strings(self, body: np.ndarray, ends: np.ndarray) -> list[str]:
        raw, begin = body.tobytes(), np.append(0, ends[:-1])
        return [raw[a:b].decode().replace(" ", MARK) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for _, _, data, off, ids, n in self.column(pa.array(texts, pa.large_string())):
            out += np.split(ids, np.cumsum(n)[:-1])
        return out

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of rows: first row, row count, bytes, their offsets, all ids, and the number of ids of each row."""
        for at, count, data, off in X.steps(column, 2 * X.STEP_BYTES):
            yield at, count, data, off, *self.encode_bytes(data, off, lambda r: column[at + r].as_py())  # noqa: B023 - called at once

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.full.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def decode_bytes(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row's ids: what their tokens stand for, without the dummy prefix."""
        if not self.by_piece:
            return [t.encode() for t in self.decode(np.split(ids, np.cumsum(n)[:-1]))] if len(n) else []
        size = self.length[ids]
        raw = self.spelled[X.ranges(self.spelled_at[ids], size)].tobytes()
        end = np.append(0, np.cumsum(size))[np.cumsum(n)]
        begin = np.append(0, end[:-1])
        lead = 1 if self.model.dummy_prefix else 0
        return [raw[a + lead if raw[a : a + 1] == b" " else a : b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def parity(path: str, texts: list[str]) -> list[int]:
    """Indices of the texts that the sentencepiece library encodes otherwise."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(Encoder(path)(texts), theirs, strict=True)) if a.tolist() != b]


def spm_encode(docs: DataFrame, path: str | Callable[[], str], threads: int | None = None) -> DataFrame:
    """Encode and decode documents(doc_id, text) with a SentencePiece model.

    path: of the model file, on every worker; threads: of the tokenizers library in a task, by default the task's cores
    (spark.task.cpus). Returns doc_id, ids (array of int), n_tokens, ids_crc32 (of the ids as little-endian u32), round_trip
    (decoding gives the text back; normalisation can change it), parity (whether the sentencepiece library gives the
    same ids; checked on every row). Null and empty texts have no ids. Repeated rows stay rows. Other columns are ignored;
    an empty table gives no rows. Texts are encoded whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        file, own = path() if callable(path) else path, threads or task_threads()
        run, theirs = Encoder(file, own), sentencepiece.SentencePieceProcessor(model_file=file)
        for batch in batches:
            for at, count, data, off, ids, n in run.column(batch.column(1)):
                raw = data.tobytes()
                text = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                back = [a == b for a, b in zip(run.decode_bytes(ids, n), text, strict=True)]
                ends = np.append(0, np.cumsum(n))
                places = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                same: list[bool] = []
                for k in range(0, count, 64):  # the other library's lists of numbers are large: a few rows at a time
                    for (a, b), x in zip(places[k : k + 64], theirs.encode([t.decode() for t in text[k : k + 64]], num_threads=own), strict=True):
                        same.append(ids[a:b].tolist() == x)
                wide = ids.astype("<u4")
                body = memoryview(wide.tobytes())
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in places]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(wide.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, count), lists, pa.array(n), pa.array(crc, pa.int64()), pa.array(back), pa.array(same)], ["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip", "parity"])

    return docs.mapInArrow(X.trimmed(encode), "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
