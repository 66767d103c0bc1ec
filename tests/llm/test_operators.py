"""Every operator against a brute-force version on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "the and of thon ering blest rethat sion tion éire größe нет naïve on in at is it be by or".split()


def texts(seed=5, n=60):
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", ".", ",", str(r.randrange(50))]) for _ in range(k))
    base = [line(r.randrange(1, 160)) for _ in range(n)]
    passage = line(70)
    out = [None, "", "   ", "one", "two words", "\t\n", "A" * 900, "ab " * 400, "x y z ~~~ ..,, 'quoted'  two"]
    out += base + base[:6] + [base[0].upper(), base[1] + " tail", passage, "head " + passage, passage + " " + line(30)]
    near = base[2].split() if len(base[2].split()) > 30 else line(80).split()
    out += [" ".join(near), " ".join([*near[:-1], "changed"]), " ".join(["first", *near]), line(3000)]
    return out


DOCS = list(enumerate(texts()))
SCHEMA = "doc_id long, text string, h long, score double, marks string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, 0.5, "m", 1) for i, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize(("k", "num", "tile", "limit"), [(3, 90, 4_000_000, 4096), (5, 80, 4_000_000, 4096), (3, 90, 300, 2)])
def test_ngram_jaccard_join(docs, none, k, num, tile, limit):
    from siltstone.llm.divide_skip import ngram_jaccard_join

    sets, root = {}, {}
    for i, t in DOCS:
        w = words_of(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs, k, num, 100, cluster_shingles=tile, group_limit=limit).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert ngram_jaccard_join(none).count() == 0


def test_long_lists_follow_divideskip():
    from siltstone.llm.divide_skip import MU, long_lists

    assert long_lists(1, 9) == 0 and long_lists(10, 2) == 9
    assert long_lists(900, 1 << 20) == int(900 / (MU * 20 + 1)) < 899


def test_jaccard_nulls_and_repeats(spark):
    from siltstone.llm.divide_skip import ngram_jaccard_join

    t = "a b c d e f g h"
    rows = ngram_jaccard_join(spark.createDataFrame([(None, t), (1, t), (1, t), (0, None), (2, t)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(0, 0), (1, 1), (1, 1), (2, 1), (None, None)]


def test_parts_lose_no_link():
    from siltstone.llm.divide_skip import Threshold, plausible_links, signatures, sketches

    r = random.Random(1)
    for num in (80, 90):
        rule = Threshold(num, 100)
        for _ in range(200):
            a = {r.getrandbits(64) for _ in range(r.randrange(1, 90))}
            b = set(list(a)[: r.randrange(1, len(a) + 1)]) | {r.getrandbits(64) for _ in range(r.randrange(0, 8))}
            if 100 * len(a & b) < num * len(a | b):
                continue
            h = np.array(sorted(a) + sorted(b), np.uint64)
            row = np.repeat([0, 1], [len(a), len(b)])
            at, sig = signatures(row, h, np.array([0, len(a), len(a) + len(b)]), rule)
            assert set(sig[at == 0]) & set(sig[at == 1])
            sizes = [len(a), len(b)]
            assert list(plausible_links(sizes, sketches(h, np.array(sizes)), rule)) == [(0, 1)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, none, hot):
    from siltstone.llm.bucket_pointer import suffix_dedup

    size, seen = 40, Counter()
    raw = {i: (t or "").encode() for i, t in DOCS}
    for b in raw.values():
        seen.update(b[s : s + size] for s in range(len(b) - size + 1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.h) for r in suffix_dedup(docs, size, 12, hot, keep=["h"]).collect()}
    for i, b in raw.items():
        m = [False] * len(b)
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                m[s : s + size] = [True] * size
        runs = sum(x and (k == 0 or not m[k - 1]) for k, x in enumerate(m))
        assert got[i] == (len(b), sum(m), runs, bytes(c for c, x in zip(b, m, strict=True) if not x), i)
    whole = suffix_dedup(docs, size, 12, whole_chars=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)
    assert suffix_dedup(none).count() == 0


def test_bucket_pointer_orders_like_sorting():
    from siltstone.llm.bucket_pointer import repeated_starts

    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400).astype(np.uint8)
    for length in (1, 5, 8, 9, 16, 40):
        starts = np.arange(len(data) - length + 1)
        p = repeated_starts(data, np.full(len(data), len(data)), starts, length)
        s = [data[i : i + length].tobytes() for i in starts]
        assert all((p[i] == p[j]) == (s[i] == s[j]) for i in range(0, len(s), 3) for j in range(0, len(s), 5))


@pytest.mark.parametrize("hot", [256, 1])
def test_rlz_dedup(docs, none, hot):
    from siltstone.llm.relative_lz import rlz_dedup

    size, least = 12, {}
    expected = {}
    for i, t in DOCS:
        w, m, own = words_of(t), None, []
        m = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in least:
                m[s : s + size] = [True] * size
            own.append(key)
        for key in own:
            least.setdefault(key, i)
        expected[i] = (len(w), sum(m), " ".join(x for x, g in zip(w, m, strict=True) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rlz_dedup(docs, size, 5, hot).collect()}
    assert got == expected
    assert rlz_dedup(none).count() == 0


def test_wavelet_matrix(docs, none):
    from tokenizers import Tokenizer

    from siltstone.llm.queries import _byte_level_encoder, tokenizer_file
    from siltstone.llm.wavelet_matrix import BLOCK, Shard, dump, wavelet_store

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r.doc_id: r for r in wavelet_store(docs, _byte_level_encoder, 16, 2, with_ids=True).collect()}
    start = 0
    for i, text in DOCS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, list(got[i].ids)) == (start, len(ids), crc, ids)
        again = ids.index(ids[0], 1) if ids[0] in ids[1:] else None
        assert (got[i].first_id, got[i].first_id_count, got[i].first_id_next) == (ids[0], ids.count(ids[0]), again)
        start += len(ids)
    assert wavelet_store(none, _byte_level_encoder, 16, 2).count() == 0

    # More than a block, and values that are rare, absent or too large.
    r = np.random.default_rng(0)
    for n in (0, 1, 3000, BLOCK, 2 * BLOCK + 777):
        ids = np.minimum(r.integers(0, 40, n), r.integers(0, 40_000, n)).astype(np.uint16)
        body = dump(np.array([7]), np.array([n]), ids, 16)
        m = Shard.of(body)
        assert (m.sequence() == ids).all() and m.doc_ids.tolist() == [7] and m.lengths.tolist() == [n]
        at = r.integers(0, max(n, 1), 50 if n else 0)
        assert (m.access(at) == ids[at]).all()
        ends = np.append(at, n)
        for v in (0, 5, 39, 41, 70_000):
            places = np.flatnonzero(ids == v)
            assert m.rank(v, ends).tolist() == [int((ids[:e] == v).sum()) for e in ends]
            ks = [0, 1, len(places) // 2, len(places) - 1, len(places), -1]
            assert m.select(v, ks).tolist() == [int(places[k]) if 0 <= k < len(places) else -1 for k in ks]


def test_wavelet_reads_one_document_alone():
    from siltstone.llm.wavelet_matrix import BLOCK, Shard, dump

    r = np.random.default_rng(1)
    lengths = np.full(40, BLOCK // 2)
    ids = r.integers(0, 50_000, int(lengths.sum())).astype(np.uint16)
    body, got = dump(np.arange(40), lengths, ids, 16), []

    def read(at, n):
        got.append(n)
        return body[at : at + n]

    shard = Shard(read)
    got.clear()
    assert (shard.document(17) == ids[17 * BLOCK // 2 : 18 * BLOCK // 2]).all()
    assert shard.select([int(ids[5])], [0])[0] == np.flatnonzero(ids == ids[5])[0]
    small = Shard(read)
    got.clear()
    assert small.access([3 * BLOCK]).tolist() == [ids[3 * BLOCK]]
    assert len(got) == 16 and sum(got) < len(body) / 15


def test_wavelet_null_and_repeated_ids(spark):
    from siltstone.llm.queries import _byte_level_encoder
    from siltstone.llm.wavelet_matrix import wavelet_store

    rows = [(None, "b"), (3, "x"), (3, "x"), (1, None), (2, ""), (9, "tail")]
    made = wavelet_store(spark.createDataFrame(rows, "doc_id long, text string"), _byte_level_encoder, 16, 2, with_ids=True).collect()
    made.sort(key=lambda r: r.start)
    assert [r.doc_id for r in made] == [None, 1, 2, 3, 3, 9]
    assert [r.start for r in made] == np.cumsum([0] + [r.n_tokens for r in made])[:-1].tolist()
    assert list(made[1].ids) == list(made[2].ids) == [2] and made[3].ids == made[4].ids


def test_spm_backend(docs, none):
    from siltstone.llm.queries import tokenizer_file
    from siltstone.llm.spm_backend import Encoder, parity, spm_encode

    path = tokenizer_file("piece_bpe_32k.model")
    own = [t or "" for _, t in DOCS] + ["  two  spaces ", "\n\n", "日本 語", "<s>", "a\0b", "▁▁x"]
    assert parity(path, own) == []
    run = Encoder(path)
    plain = [t for t in own if "▁" not in t and "\0" not in t]
    assert run.decode(run(plain)) == plain
    rows = spm_encode(docs, lambda: tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(rows) == len(DOCS) and all(r.parity for r in rows) and sum(not r.round_trip for r in rows) == 0
    assert spm_encode(none, path).count() == 0


def test_leaked_items(spark, docs, none):
    from siltstone.llm.pigeonhole_edit import Pattern, leaked_items, normalise, without_leaks

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    r = random.Random(2)
    for _ in range(100):
        p, t = ("".join(r.choice("ab ") for _ in range(r.randrange(lo, 40))) for lo in (1, 0))
        assert Pattern(p, 3).best(t)[0] == distance(p, t)
    source = DOCS[12][1]
    items = [(1, source[:90]), (2, source[10:80].upper().replace(" ", " - ")), (3, source[:20] + "zz" + source[22:100]), (4, None), (5, ""), (6, "never seen anywhere in here at all")]
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id, x.errors) for x in leaked_items(docs, table, 0.1).collect()}
    expected = set()
    for i, t in DOCS:
        for k, item in items:
            p = normalise(item or "")
            if p and t and len(normalise(t)) < 3000:
                e = distance(p, normalise(t))
                if e <= int(len(p) * 0.1):
                    expected.add((i, k, e))
    assert {g for g in got if len(DOCS[g[0]][1]) < 3000} == expected and expected
    assert {(x.doc_id, x.item_id, x.errors) for x in leaked_items(docs, table, 0.1, block_bytes=100).collect()} == got
    # Two texts under one id and texts without an id: all are sought, in blocks as well.
    twice = spark.createDataFrame([(1, source[:90]), (1, source[100:190]), (None, source[10:80]), (None, source[200:280])], "item_id long, text string")
    one = spark.createDataFrame([(5, source[100:190]), (6, source[10:80]), (None, source[200:280]), (5, None)], "doc_id long, text string")
    for size in (100, 1 << 20):
        assert sorted(((x.doc_id, x.item_id, x.errors) for x in leaked_items(one, twice, 0.1, block_bytes=size).collect()), key=str) == [(5, 1, 0), (6, None, 0), (None, None, 0)]
        assert without_leaks(one, twice, 0.1, block_bytes=size).count() == 1
    clean = without_leaks(docs, table, 0.1)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in DOCS} - {g[0] for g in got}
    assert leaked_items(none, table).count() == 0 and leaked_items(docs, table.limit(0)).count() == 0


def test_url_filter(spark):
    from siltstone.llm.glob_automaton import url_filter
    from siltstone.llm.queries import URL_DEFAULTS, URL_RULES

    r = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.www.Example.com", "xexample.com", "com", "net", "a.net", "adult-x.org", "b.org", "", "a.com:80"]
    paths = ["", "/", "/en/", "/en/1?x=/en/", "/es/a", "/fr/", "/fr", "#/es/", "?q", "/ads/1", "/a.exe", "/x.com/", "/é"]
    urls = [None, "", "no scheme", "http://", "://"] + [f"{r.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + ["http://x.net/" + "y" * 5000]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls + urls[:3])]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string"), URL_RULES, URL_DEFAULTS).collect()
    assert len(got) == len(rows)
    for g in got:
        u = rows[g.page_id][1]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fits = [(x, p, v) for x, p, v in URL_RULES if ("." + host).endswith("." + x) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        usual = "block" if any(s in host + path for s in ("adult", "casino", "/ads/")) or (host + path).endswith(".exe") else "allow"
        assert (g.host, g.path, g.rule, g.verdict) == (host, path, best[0] + best[1] if best else None, best[2] if best else usual)
    assert url_filter(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0

    # Globs with "?" and characters of several bytes, against the standard library's matching of one character each.
    globs = ["a.b/?", "a.b/x?y", "*/é?*z", "a.?/日??"]
    urls = [f"http://{h}/{p}" for h in ("a.b", "a.é", "c.d") for p in ("", "é", "日", "ab", "xéy", "xy", "xééy", "éaz", "éz", "q/ééé日z", "日éa", "日é", "日本語")]
    made = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [], globs).collect()
    parts = lambda g: "(?s)" + "".join({"*": "[^\\0]*", "?": "[^\\0]"}.get(c, re.escape(c)) for c in g)
    for g in made:
        assert (g.verdict == "block") == any(re.fullmatch(parts(p), g.host + g.path) for p in globs), (g.host, g.path)


def test_nearest(spark):
    from siltstone.llm.permutation_index import nearest

    r = np.random.default_rng(6)
    v = r.normal(size=(900, 24)).astype(np.float32)
    v[100:160] = v[100]  # copies
    v[200:260] = v[200] + r.normal(size=(60, 24)).astype(np.float32) * 0.01
    rows = [(i, x.tolist(), "e", 1.0) for i, x in enumerate(v)]
    rows += [(900, None, "e", 1.0), (950, [0.0] * 24, "e", 1.0), (1000, [float("nan")] * 24, "e", 1.0), (1050, [None] * 24, "e", 1.0), (1100, [], "e", 1.0), rows[7], (None, rows[3][1], "e", 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry string, score double").repartition(3)
    got: dict = {}
    for x in nearest(table, F.col("vec_id") % 50 == 0, block_rows=300).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert sorted(got) == list(range(0, 900, 50))
    d = v.astype(np.float64)
    norm = np.linalg.norm(d, axis=1)
    hits = 0
    for q, found in got.items():
        s = (d * d[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(900), -s))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(best))
        if q in (100, 150):
            assert [f[1] for f in found] == [i for i in range(100, 106) if i != q][:5]
    assert hits >= 0.9 * 5 * len(got)
    assert nearest(table.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(x.rank, x.vec_id) for x in sorted(nearest(few, F.col("vec_id") == 0).collect())] == [(1, 1), (2, 2)]


def _labelled(spark, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(900):
        toxic, bad = r.random() < 0.3, r.random() < 0.3
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randrange(20, 200))]
        for _ in range(max(1, len(w) // 25) * toxic):
            w[r.randrange(len(w))] = r.choice(["scumword", "vilester", "lowein" + r.choice(WORDS)])
        t = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        rows.append((i, t, 1.0, "q"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(5000, None, 1.0, "q"), (5001, "", 1.0, "q"), (None, "some text", 1.0, "q"), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, y string"), spark.createDataFrame([*labels, (77777, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_classifiers(spark):
    from siltstone.llm.compression_classifier import quality
    from siltstone.llm.kneser_ney import toxicity

    docs, labels, truth = _labelled(spark, 8)
    for made, column, rest, level in ((quality(docs, labels), 1, lambda i: zlib.crc32(str(i).encode()) % 4 == 2, 0.7), (toxicity(docs, labels), 2, lambda i: zlib.crc32(str(i).encode()) % 5 == 0, 0.5)):
        rows = made.collect()
        assert len(rows) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= level) for r in rows)
        by = {r.doc_id: r for r in rows}
        assert all(by[t[0]].held_out == rest(t[0]) for t in truth)
        held = [t for t in truth if rest(t[0])]
        assert sum(by[t[0]].predicted == t[column] for t in held) >= 0.95 * len(held)
    # The held-out labels have no influence.
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (r.doc_id is None, r.doc_id)
    assert sorted(toxicity(docs, flipped).collect(), key=key) == sorted(toxicity(docs, labels).collect(), key=key)
    assert quality(docs.limit(0), labels).count() == 0 and toxicity(docs, labels.limit(0)).count() == 904


def test_connected_components(spark):
    from siltstone.llm.components import connected_components

    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    root = {i: i for e in edges for i in e if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity_counts_all_documents(spark):
    from siltstone.llm.kneser_ney import toxicity, unit_counts, unit_ratios

    rows = [("alpha beta beta", 1, 1), ("alpha gamma", 0, 0), ("alpha", None, 1), ("gamma lonely", 1, 0), (None, 0, 1), ("gamma 12", None, 1), ("gamma", 1, 2)]
    counts = unit_counts(spark.createDataFrame(rows, "text string, y int, fold int").repartition(3))
    made = sorted(tuple(r)[3:10] for r in counts.where("level = 4").collect())
    # n, c0, c1, k00, k01, k10, k11 of alpha, beta, gamma, lonely
    assert made == sorted([(3, 1, 1, 1, 0, 0, 1), (1, 0, 1, 0, 0, 0, 1), (4, 1, 2, 1, 1, 0, 0), (1, 0, 1, 0, 1, 0, 0)])
    units, above = unit_ratios(counts)
    # A short word is its own beginning at every level: its counts must not run together.
    short = unit_counts(spark.createDataFrame([(w, 1, 0) for w in "abcdefghijklmnopqrstuvwxyz"] + [("ab cd ef gh ij kl mn op", 0, 1)], "text string, y int, fold int").coalesce(1))
    assert sorted((r["level"], r["count"]) for r in short.groupBy("level").count().collect()) == [(k, 34) for k in range(5)]
    # Only gamma has two documents of a class; without fold 0 one is left, and without fold 1 all are.
    assert units.where("level = 4").count() == 1
    gamma = units.where("level = 4").first()
    rest = {r.parent: r for r in above.where("level = 4").collect()}
    parent = counts.where("level = 4 and n = 4").first().parent
    # A unit with one document of each class has the ratio of what is unknown below its parent, so it needs no row.
    assert gamma.tried0 == rest[parent].tried0 and gamma.ratio != rest[parent].ratio

    # Each document ends in one of 60 rare expressions that alone tell its class: a sample of 20 documents a class shows few of them.
    r = random.Random(3)
    plain = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(200)]
    rare = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(60)]
    docs = [(i, " ".join(r.choice(plain) for _ in range(40)) + f" {rare[i % 60]}") for i in range(1200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels, max_docs=20).where("held_out").collect()
    caught = [x.predicted == x.doc_id % 2 for x in out]
    assert len(caught) > 150 and sum(caught) >= 0.98 * len(caught)


def test_toxicity_of_a_model_that_stays_a_table(spark, docs, none):
    from siltstone.llm.kneser_ney import toxicity

    r = random.Random(7)
    plain = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(120)]
    rows = [(i, " ".join(r.choice(plain) for _ in range(r.choice([0, 5, 40]))) + (" badword" if i % 3 == 0 else " fine")) for i in range(300)] + [(900, None), (901, ""), (None, "badword"), (5, "again badword badword")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).repartition(3)
    seen = lambda out: sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), r.held_out, r.predicted) for r in out.collect())
    assert seen(toxicity(df, labels)) == seen(toxicity(df, labels, model_bytes=0))
    assert toxicity(none, labels, model_bytes=0).count() == 0 and toxicity(docs, labels.limit(0), model_bytes=0).count() == len(DOCS)


def test_spm_parity_on_every_row(spark):
    from siltstone.llm.queries import tokenizer_file
    from siltstone.llm.spm_backend import Encoder, spm_encode

    rows = [(i if i % 7 else None, f"row {i} of größe {'x' * (i % 5)}") for i in range(70)]
    made = spm_encode(spark.createDataFrame(rows, "doc_id long, text string"), lambda: tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(made) == 70 and all(r.parity is True for r in made)

    # New pieces reach the library as one list, which it may spread over threads; the ids are the same.
    run, sizes = Encoder(tokenizer_file("piece_bpe_32k.model"), threads=3), []
    text, bare = " ".join(f"w{i}" for i in range(9000)), run.bare

    class Spy:
        def encode_batch_fast(self, parts, **options):
            sizes.append(len(parts))
            return bare.encode_batch_fast(parts, **options)

    run.bare = Spy()
    one = Encoder(tokenizer_file("piece_bpe_32k.model"))([text])[0]
    assert run([text])[0].tolist() == one.tolist() and run([text])[0].tolist() == one.tolist() and sizes == [5]
    assert run.decode_bytes(one, np.array([len(one)])) == [run.decode([one])[0].encode()] == [text.encode()]


def unigram_model(pieces, byte_fallback=True):
    """The bytes of a small unigram model file: pieces (text, score, kind), as the protobuf has them."""
    import struct

    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda k, body: varint(k << 3 | 2) + varint(len(body)) + body
    number = lambda k, n: varint(k << 3) + varint(n)
    out = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, kind)) for p, s, kind in pieces)
    trainer = number(3, 1) + number(4, len(pieces)) + number(35, int(byte_fallback)) + number(40, 0) + number(41, 1) + number(42, 2) + varint(43 << 3) + varint(2**64 - 1)
    normal = field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1)
    return out + field(2, trainer) + field(3, normal)


def test_unigram_scores(tmp_path):
    """A unigram model file made here: the best-scored segmentation, byte fallback and the marker, as the sentencepiece library has them."""
    import sentencepiece

    from siltstone.llm.spm_backend import Encoder, Model, parity

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "the", "th", "e", "er", "▁other", "o", "t", "h", "r", "▁größe", "gr", "öß", "s", "a", "n"]
    pieces += [(w, -1.0 - 0.37 * i + (len(w) > 3), 1) for i, w in enumerate(words)]
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(pieces))
    assert Model.read(path.read_bytes()).kind == 1
    own = ["the other", "there  then", "größe größer 日本", "", "  the", "the\nrest", "other " * 40, "aßn"]
    assert parity(str(path), own) == []
    run, theirs = Encoder(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert [x.tolist() for x in run(own)] == [theirs.encode(t) for t in own]
    ids = run(own)
    assert run.decode_bytes(np.concatenate(ids), np.array([len(x) for x in ids])) == [t.encode() for t in own]


def long_texts(seed=9):
    """Texts with passages of 50 words and 400 bytes that repeat, at their lengths and one short of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared, exact, short = line(90), "".join(r.choice("abcdefgh ") for _ in range(400)), "".join(r.choice("abcdefgh ") for _ in range(399))
    fifty, fewer = line(50), line(49)
    rows = [line(300), line(20) + " " + shared + " " + line(10), shared, shared + " " + line(200) + " " + shared, "p" + exact + "q", exact + "r", "s" + short + "t", "u" + short]
    rows += [line(5) + " " + fifty + " " + line(5), line(3) + " " + fifty, fewer + " " + line(9), line(9) + " " + fewer, "ab" * 300, "é" * 300, "", None]
    ids = [*range(len(rows)), None, None, 2, 12]
    return list(zip(ids, [*rows, shared, "é" * 300, rows[2], rows[12]], strict=True))


def test_suffix_dedup_at_production_parameters(spark):
    from siltstone.llm.bucket_pointer import suffix_dedup

    rows = long_texts()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = Counter(t[i : i + 400] for d, x in rows if d is not None for t in [(x or "").encode()] for i in range(len(t) - 399))
    for hot in (20_000, 1):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(table, hot=hot).collect())
        want: Counter = Counter()
        for d, x in rows:
            t = (x or "").encode()
            gone = [False] * len(t)
            for i in range(len(t) - 399) if d is not None else ():
                if seen[t[i : i + 400]] > 1:
                    gone[i : i + 400] = [True] * 400
            want[d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(t, gone, strict=True) if not g)] += 1
        assert got == want


def test_rlz_dedup_at_production_parameters(spark):
    from siltstone.llm.relative_lz import rlz_dedup

    rows = long_texts(10)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first: dict = {}
    for d, x in rows:
        w = words_of(x)
        for i in range(len(w) - 49) if d is not None else ():
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    for hot in (256, 1):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rlz_dedup(table, window=50, hot=hot).collect())
        want: Counter = Counter()
        for d, x in rows:
            w = words_of(x)
            gone = [False] * len(w)
            for i in range(len(w) - 49) if d is not None else ():
                if first[tuple(w[i : i + 50])] < d:
                    gone[i : i + 50] = [True] * 50
            want[d, len(w), sum(gone), " ".join(y for y, g in zip(w, gone, strict=True) if not g)] += 1
        assert got == want
