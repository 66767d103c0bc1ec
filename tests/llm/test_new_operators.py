"""Operators 11 to 13 against brute-force versions, on fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = "the and of thon Ering blest reThat sion tion Éire größe нет naïve on in at is it be by or 日本語 x9 42".split()


def line(r, k):
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", "-y"]) for _ in range(k))


def fixture(seed=3, n=70):
    r = random.Random(seed)
    out = [None, "", "  ", "One", "two words", "a" * 1000 + " b", "z" * 300 + " " + "Y" * 70_000 + " q", line(r, 5000), "\x00nul 1", "~~~"]
    out += [line(r, r.randrange(1, 60)) for _ in range(n)]
    return out + out[12:20] + [out[12].upper()]


# Operator 11


def n_grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_crc_of_every_feature():
    import pyarrow as pa

    from siltstone.llm import _text as X
    from siltstone.llm.byte_automaton import features

    texts = fixture()
    for limit in (1, 1 << 19):
        found, counts = defaultdict(list), {}
        for at, _, data, off in X.steps(pa.array(texts), limit):
            words, parts = features(data, off)
            counts |= {at + i: int(n) for i, n in enumerate(words)}
            for row, crc in parts:
                for i, c in zip(row.tolist(), crc.tolist(), strict=True):
                    found[at + i].append(c)
        for i, t in enumerate(texts):
            w, grams = n_grams(t)
            assert counts[i] == len(w)
            assert found[i] == [zlib.crc32(g.encode()) for g in grams]


def resampled(docs, target):
    buckets = lambda texts: Counter(zlib.crc32(g.encode()) % 10_000 for t in texts for g in n_grams(t)[1])
    s, t = buckets([x for _, x in docs]), buckets(target)
    big, small = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        w, grams = n_grams(text)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (big + 10_000)) / ((s[b] + 1) * (small + 10_000)))) for b in (zlib.crc32(g.encode()) % 10_000 for g in grams))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(grams), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[1], r[3]))
    fit = {id(r): n for n, r in enumerate(fit, 1) if n <= 5 * len(fit) // 100}
    return sorted(((*r, fit.get(id(r))) for r in rows), key=str)


def test_importance_resample(spark):
    from siltstone.llm.byte_automaton import importance_resample

    docs = [*enumerate(fixture()), (None, line(random.Random(8), 40)), (14, fixture()[14]), (14, fixture()[14])]
    target = [line(random.Random(1), 30), None, "", "x9 x9 x9"]
    rows = spark.createDataFrame([(i, t, 0.5, 1, "f", "p", True) for i, t in docs], "doc_id long, text string, score double, rank int, weight string, part string, fits boolean").repartition(3)
    wanted = spark.createDataFrame([(t, "q") for t in target], "text string, doc_id string")
    got = importance_resample(rows, wanted)
    assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target)
    assert importance_resample(rows.limit(0), wanted).collect() == []
    assert sorted((tuple(r) for r in importance_resample(rows, wanted.limit(0)).collect()), key=str) == resampled(docs, [])


def test_draw_of_many_ties(spark):
    """Half of all documents under one id: their scores tie, and ranks still are 1, 2, 3 ..."""
    from siltstone.llm.byte_automaton import importance_resample

    docs = [(7 if i % 2 else i, line(random.Random(0), 25)) for i in range(400)]
    got = importance_resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("on in",)], "text string"), percent=60)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[5] or 1000)[:240] == sorted(
        (tuple(r) for r in got.where("rank IS NOT NULL").collect()), key=lambda r: r[5]
    )
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 241))


# Operator 12


def linked(rows, least=0.93):
    rows = [r for r in rows if r[0] is not None]

    def unit(e, label):
        if not e or label is None or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            return None
        v = np.array(e, np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = [unit(e, label) for _, e, label in rows]
    n = len(rows)
    meet = lambda i, j: i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least
    near = [[j for j in range(n) if meet(i, j)] for i in range(n)]
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in near[i])])
            changed |= low < root[i]
            root[i] = low
    return sorted((rows[i][0], len(near[i]), root[i], rows[i][0] == root[i]) for i in range(n))


def some_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.25], c % 3))
    five, sixty = rows[5], rows[60]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [*[1.0] * 15, None], 1), (1004, five[1], None), (1016, [*[1.0] * 15, float("inf")], 1)]
    rows += [(1005, *five[1:]), (1006, *five[1:]), (None, *five[1:]), (1007, five[1][:7], five[2]), (1008, five[1][:7], five[2]), (3, *sixty[1:]), sixty]
    rows += [(1009, [], 1), (1010, [2.0], 1), (1011, [3.0], 1), (1012, [-3.0], 1)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"hashes": 2}, {"hashes": 3}, {"slice_rows": 7}, {"hashes": 2, "slice_rows": 3}])
def test_near_vectors(spark, options):
    from siltstone.llm.cross_polytope import near_vectors

    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS entry", "'x' AS code", "2 AS n_links", "3 AS k1", "4 AS root")
    got = near_vectors(df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == linked(rows)


def test_near_vectors_of_odd_tables(spark):
    from siltstone.llm.cross_polytope import near_vectors

    df = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<double>, label int")
    assert near_vectors(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pairs_at_the_threshold_are_found():
    """Of random pairs with a cosine of just 0.93, at most one in 1,000 meets in no table (64 and 50 dimensions)."""
    from siltstone.llm.cross_polytope import TABLES, codes

    rng = np.random.default_rng(2)
    for dims in (64, 50):
        a, r = rng.standard_normal((2, 4000, dims))
        a /= np.linalg.norm(a, axis=1)[:, None]
        r -= (r * a).sum(1)[:, None] * a
        b = 0.93 * a + math.sqrt(1 - 0.93**2) * r / np.linalg.norm(r, axis=1)[:, None]
        for hashes, (tables, probes) in TABLES.items():
            x, y = codes(a, hashes, tables, probes), codes(b, hashes, tables, probes)
            meet = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any((1, 2))
            assert meet.mean() >= 0.999


def test_the_first_meeting_is_one():
    """Over all buckets where a pair can meet, it is counted once."""
    from siltstone.llm.cross_polytope import codes, first_meeting

    rng = np.random.default_rng(4)
    a = rng.standard_normal((300, 16))
    b = a + rng.standard_normal((300, 16)) * 0.3
    x, y = codes(a, 1, 4, 4), codes(b, 1, 4, 4)
    for i in range(300):
        times = 0
        for t in range(4):
            places = {int(x[i, t, 0])} if x[i, t, 0] in y[i, t] else set()
            places |= {int(y[i, t, 0])} if y[i, t, 0] in x[i, t] else set()
            times += sum(int(first_meeting(x[i : i + 1], y[i : i + 1], t, c)[0]) for c in places)
        assert times == int(((x[i] == y[i][:, :1]) | (y[i] == x[i][:, :1])).any())


# Operator 13


def audited(rows, least, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, lang, source in rows]
    df, counts, every = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in docs:
        df[lang].update(set(w))
        counts[lang, source].update(w)
        every[lang].update(w)
    out = []
    for (lang, source), have in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * v)  # noqa: E731, B023
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        pairs = [(-sum(gap(p(have, t), p(other, t)) for t in kept), item) for (x, item), other in counts.items() if x == lang and item != source]
        terms = [(-gap(p(have, t), p(every[lang], t)), t) for t in kept if have[t] and p(have, t) > p(every[lang], t)]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [2, 10, 10_000])
def test_divergence_audit(spark, least):
    from siltstone.llm.divergence_audit import divergence_audit

    r = random.Random(6)
    rows = [(line(r, r.randrange(0, 40)), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "é", "日", None])) for _ in range(120)]
    rows += [(None, "en", "only null"), ("", "fr", "empty"), (line(r, 3000), "en", "long"), ("x" * 20_000, "en", "b"), (line(r, 9), "", "a")] + rows[:5]
    df = spark.createDataFrame([(*x, 1, "t", 2.0) for x in rows], "text string, lang string, source string, n int, term string, v double").repartition(3)
    got = divergence_audit(df, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(x) for x in got.collect()) == audited(rows, least)
    assert divergence_audit(df.limit(0)).collect() == []


def test_shares_of_huge_counts(spark):
    """Counts over 9 * 10^9 times 10^9 don't fit in a long; the share stays exact."""
    from siltstone.llm.divergence_audit import _share

    n, total, v = 987_654_321_987, 2_345_678_987_654, 7_000_000
    got = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(_share("n", "total", "v")).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_cross_polytope", "op13_divergence_audit"])
def test_registered_query_against_sql(spark, name):
    import duckdb

    from siltstone.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, made = QUERIES[name](spark, folder), con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows and sorted((tuple(r) for r in rows), key=str) == sorted(made.fetchall(), key=str)
