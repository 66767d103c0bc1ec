"""URL filter by a bit-parallel automaton for glob rules.

All patterns are laid side by side in multiword bit masks, one bit for each pattern position. A step of the
automaton reads one byte of every URL of a batch at once: shift, AND with the byte's mask, and let "*" positions
loop. "?" is any one character of its part (its further UTF-8 bytes loop), "*" any run of them within its part: host and path
are kept apart by a symbol of its own, so no wildcard of a host reaches into a path.

A rule (host, path) becomes two patterns over host and path: its host with nothing or any subdomain before
it, and a path that starts with its own. The longest rule wins, by the length of its text; for equal ones,
the first given. URLs without a rule are judged by ``defaults``, glob patterns over the whole canonical URL
(host + path): block if one of them matches, else allow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUT = 256  # between host and path; outside the bytes
_END = 257
_MANY, _ONE = -1, -2


class GlobAutomaton:
    """Patterns are sequences of symbols: 0-257, _MANY ("*") or _ONE ("?"). A match covers the whole input."""

    def __init__(self, patterns: Sequence[Sequence[int]]):
        self.last: list[int] = []  # bit of each pattern's final position
        start, many, advance, rest = [], [], [], []
        masks: list[list[int]] = []
        bit = 0
        for p in patterns:
            # Bit "bit" is the state before the first symbol; a "*" adds a loop on the state before it.
            start.append(bit)
            for s in p:
                if s == _MANY:
                    many.append(bit)
                else:
                    bit += 1
                    advance.append((bit, s))
                    if s == _ONE:
                        rest.append(bit)
            self.last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        masks = np.zeros((258, self.words), np.uint64)
        one = lambda b: np.uint64(1 << (b % 64))
        for b, s in advance:
            for c in (*range(128), *range(192, 256)) if s == _ONE else (s,):
                masks[c, b // 64] |= one(b)
        self.masks = masks
        self.start, self.many, self.rest = (np.zeros(self.words, np.uint64) for _ in range(3))
        for b in start:
            self.start[b // 64] |= one(b)
        for b in many:
            self.many[b // 64] |= one(b)
        for b in rest:
            self.rest[b // 64] |= one(b)

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: one row for each input, filled up with _END. Returns [input, pattern]: whether it matches."""
        state = np.repeat(self.start[None, :], len(symbols), 0)
        top = np.uint64(63)
        for k in range(symbols.shape[1]):
            s = symbols[:, k]
            live = s != _END
            if not live.any():
                break
            up = state << np.uint64(1)
            up[:, 1:] |= state[:, :-1] >> top
            loop = np.where((s < 256)[:, None], self.many, np.uint64(0))
            loop |= np.where(((s >= 128) & (s < 192))[:, None], self.rest, np.uint64(0))
            new = (up & self.masks[s]) | (state & loop)
            state = np.where(live[:, None], new, state)
        bits = np.array(self.last, np.int64)
        return (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1) == 1


def _symbols(glob: str) -> list[int]:
    return [{ord("*"): _MANY, ord("?"): _ONE}.get(b, b) for b in glob.encode()]


def compile_rules(rules: Sequence[tuple[str, str, str]], defaults: Sequence[str]) -> tuple[GlobAutomaton, list[int]]:
    """The automaton over ["."] + host + [cut] + path, and for each of its patterns the rule (or -1)."""
    patterns, of = [], []
    for i, (host, path, _) in enumerate(rules):
        patterns.append([_MANY, ord("."), *_symbols(host), _CUT, *_symbols(path), _MANY])
        of.append(i)
    for glob in defaults:
        # Any place for the cut: within a "*", or between two symbols.
        body = _symbols(glob)
        for k in range(len(body) + 1):
            patterns.append([ord("."), *body[:k], _CUT, *body[k:]])
            of.append(-1)
        for k, s in enumerate(body):
            if s == _MANY:
                patterns.append([ord("."), *body[: k + 1], _CUT, *body[k:]])
                of.append(-1)
    return GlobAutomaton(patterns), of


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], defaults: Sequence[str] = ()) -> DataFrame:
    """Judge pages(page_id, url) by rules (host, path, allow or block).

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: what follows up to "?",
    "#" or the end. Returns page_id, host, path, rule (host + path of the longest that fits, else null) and
    verdict (the rule's; without one, block if a pattern of ``defaults`` matches host + path, else allow). A rule
    fits its host and all subdomains if the path starts with the rule's. Null urls and those without "://" have
    an empty host and path. Repeated rows stay rows, a null page_id stays null, other columns are ignored, an
    empty table gives no rows. Only the url column is read; nothing is shuffled; urls of any length are judged
    whole, in groups of like length.
    """
    automaton, of = compile_rules(rules, defaults)
    by_length = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0] + rules[i][1]), i))
    after = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern_of = np.array(of)
        for batch in batches:
            text = [[ord("."), *h.encode(), _CUT, *p.encode()] for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            size = np.array([len(t) for t in text], np.int64)
            hit = np.zeros((len(text), len(of)), bool)
            order = np.argsort(size, kind="stable")
            at = 0
            while at < len(order):  # like lengths together: a long url doesn't widen the others
                to = at + 1
                while to < len(order) and size[order[to]] <= 2 * size[order[at]] + 16 and (to - at + 1) * size[order[to]] <= 1 << 22:
                    to += 1
                own = order[at:to]
                grid = np.full((len(own), int(size[own[-1]])), _END, np.int64)
                for r, i in enumerate(own):
                    grid[r, : size[i]] = text[i]
                hit[own] = automaton.run(grid)
                at = to
            rule = np.full(len(text), -1)
            for i in reversed(by_length):
                rule[hit[:, pattern_of == i].any(1)] = i
            usual = np.where(hit[:, pattern_of == -1].any(1), "block", "allow")
            names = [rules[i][0] + rules[i][1] if i >= 0 else None for i in rule]
            verdict = [rules[i][2] if i >= 0 else str(u) for i, u in zip(rule, usual, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
