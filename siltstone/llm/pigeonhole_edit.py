"""Benchmark decontamination by pigeonhole edit matching.

Text and items are normalised alike: lower case, and every run of characters that are neither letters nor
digits one space. An item of n characters is leaked where a passage is within k = floor(rate * n) edits of it.
Of k + 1 pieces of the item one is then exact in the passage, so an automaton of all pieces (Aho-Corasick)
finds every place that has to be looked at. A place is dropped at once if over k of the item's disjoint
q-grams are missing there (an edit spoils one at most); the rest is decided by Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GAPS = re.compile(r"[\W_]+")
_Q = 5


def normalise(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def budget(n: int, rate: float) -> int:
    return int(n * rate + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their places, as equal as they go."""
    n = len(item)
    cuts = [n * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class Pattern:
    """Myers' automaton of one item; Python integers are its bit vectors of any length."""

    def __init__(self, item: str, k: int):
        self.item, self.k, n = item, k, len(item)
        self.mask, self.top = (1 << n) - 1, 1 << (n - 1)
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i
        self.grams = [item[i : i + _Q] for i in range(0, n - _Q + 1, _Q)]

    def plausible(self, window: str) -> bool:
        """Whether at most k of the item's disjoint q-grams miss in the window: k edits spoil no more than k."""
        left = self.k
        for g in self.grams:
            if g not in window:
                left -= 1
                if left < 0:
                    return False
        return True

    def best(self, window: str) -> tuple[int, int]:
        """(least distance of the item to a substring of the window, where that ends); the first of equal ones."""
        up, down, score = self.mask, 0, len(self.item)
        least, end = score, 0
        mask, top, at = self.mask, self.top, self.at
        for j, c in enumerate(window, 1):
            eq = at.get(c, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & mask
            plus = (down | ~(d0 | up)) & mask
            minus = up & d0
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = plus << 1 & mask  # a match may start anywhere, so nothing is carried in
            minus = minus << 1 & mask
            up = (minus | ~(d0 | plus)) & mask
            down = plus & d0
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    """All items against a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.ids: list[int | None] = []
        self.patterns: list[Pattern] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, item in dict.fromkeys((i, normalise(text)) for i, text in items):
            if item:
                k = budget(len(item), rate)
                for a, piece in pieces(item, k):
                    where.setdefault(piece, []).append((len(self.patterns), a))
                self.patterns.append(Pattern(item, k))
                self.ids.append(item_id)
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item, errors, end in the normalised text) of the best match of every leaked item; of the texts of one item,
        the best match of any."""
        if not self.patterns:
            return []
        text = normalise(text)
        looked: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for key, a in places:
                looked.setdefault(key, []).append((end + 1 - size - a, end + 1 - size - a))
        out: dict[int | None, tuple[int, int]] = {}
        for key, starts in looked.items():
            p = self.patterns[key]
            n, best = len(p.item), (p.k + 1, 0)
            # Windows of nearby places are one window: matches lie within k of the place on either side.
            starts.sort()
            merged = [list(starts[0])]
            for a, b in starts[1:]:
                if a - merged[-1][1] <= p.k:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            for a, b in merged:
                begin = max(0, a - p.k)
                window = text[begin : b + n + p.k]
                if p.plausible(window):
                    errors, end = p.best(window)
                    best = min(best, (errors, begin + end))
            if best[0] <= p.k:
                item_id = self.ids[key]
                out[item_id] = min(best, out.get(item_id, best))
        return [(item_id, *best) for item_id, best in out.items()]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes, dealt by hash of item_id, so that all texts of an item are in one; only one
    block is on the driver at a time."""
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    cut = items.withColumn("block", F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(blocks)))
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in cut.where(F.col("block") == block).collect()]
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leaked_items(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_bytes: int = 16 << 20) -> DataFrame:
    """Benchmark items(item_id, text) that documents(doc_id, text) hold within floor(rate * length) edits.

    Returns doc_id, item_id, errors (least distance of a passage) and end (where the first such passage ends in the
    normalised text), one row for each document row and item. Null and empty texts hold nothing; null texts of items and
    items without a letter or digit are never found; different texts under one item_id (or under a null one, which counts
    as an id) are all sought, and the best match of any counts; repeated document rows stay rows; a null doc_id stays null. Other columns are ignored; an empty table gives no
    rows. Every whole text is read; items over block_bytes are taken in blocks, one pass over the documents for each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    schema = "doc_id long, item_id long, errors int, end long"

    def search(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(block, rate)
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in match(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "errors", "end"])

        return run

    out = None
    for block in item_blocks(items, block_bytes):
        part = docs.mapInArrow(search(block), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of documents(text, ...) whose text holds no benchmark item; see leaked_items. Nothing is shuffled.
    Rows with a null text stay."""

    def clean(block: list[tuple[int, str]]):
        @F.arrow_udf("boolean")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            match = Matcher(block, rate)
            for column in batches:
                yield pa.array([not t or not match(t) for t in column.to_pylist()], pa.bool_())

        return run

    for block in item_blocks(items, block_bytes):
        docs = docs.where(clean(block)("text"))
    return docs
