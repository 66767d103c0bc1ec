"""Byte-level BPE of whole Arrow columns: vectorised pre-tokenisation, one encoding for each different piece.

The pre-tokeniser's pattern is " ?letters | ?digits | ?others | white space". On a text whose white space is
single blanks and line ends between other characters, without apostrophes, and whose characters outside ASCII
are Latin letters, its pieces are the runs of a byte class, with the blank before them; those are found with
array operations, hashed, and encoded once per worker by the tokenizers library. Other texts are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from . import _text as X
from ._pieces import PieceColumns

_LETTER, _DIGIT, _OTHER, _BLANK, _LINE, _ODD = range(6)

_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(32), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC9, 256)]] = _ODD
_CLASS[0x20], _CLASS[0x0A] = _BLANK, _LINE


class ByteLevelColumns(PieceColumns):
    """Encodes columns of texts; strings of special tokens in a text are ordinary text."""

    separator = 0x0D  # a carriage return never is in a piece: texts that hold one are encoded whole

    def __init__(self, path: str, threads: int = 1) -> None:
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        spec = json.loads(self.full.to_str())
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level tokenizer")
        size = self.full.get_vocab_size()
        super().__init__(np.uint16 if size <= 1 << 16 else np.uint32, threads)
        # The model alone, on pieces that are already mapped to printable characters.
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\r", "removed")
        plain = np.array([33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)])
        self.printable = np.where(plain, np.arange(256), 255 + np.cumsum(~plain)).astype("<u2")
        self.printable[self.separator] = self.separator
        self.length = np.zeros(size, np.int64)
        for token, i in self.bare.get_vocab(False).items():
            self.length[i] = len(token)

    def strings(self, body: np.ndarray, ends: np.ndarray) -> list[str]:
        mapped, begin = self.printable[body].tobytes(), np.append(0, ends[:-1])
        return [mapped[2 * a : 2 * b].decode("utf-16-le") for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        gap = (kind == _BLANK) | (kind == _LINE)
        odd = kind == _ODD
        # Two bytes of C3 stand for signs, not letters.
        sign = np.flatnonzero(data == 0xC3)
        odd[sign[np.isin(data[np.minimum(sign + 1, len(data) - 1)], (0x97, 0xB7))]] = True
        odd[1:] |= gap[1:] & gap[:-1]
        some = off[1:] > off[:-1]
        odd[off[:-1][some]] |= gap[off[:-1][some]]
        odd[off[1:][some] - 1] |= gap[off[1:][some] - 1]
        bad = np.zeros(len(off) - 1, bool)
        bad[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = True
        first = np.zeros(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
        first[off[:-1][some]] = True
        start = np.flatnonzero(first)
        return start, np.append(start[1:], len(data)), np.zeros(len(start), bool), bad

    def column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows: all ids, and the number of ids of each row."""
        for at, _, data, off in X.steps(column, 2 * X.STEP_BYTES):
            yield self.encode_bytes(data, off, lambda r: column[at + r].as_py())  # noqa: B023 - called at once
