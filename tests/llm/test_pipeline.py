"""Every stage of the pipeline against a brute-force version of it, on the documents that the stage before it kept."""

import random
import re
from collections import Counter

import numpy as np
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "in", "st", "é", "ü"]) for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = [text(r.randrange(60, 200)) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in text(80).split()) for _ in range(40)]
    item, passage, short = text(30), text(52), text(20)
    edited = item[:40] + "x" + item[41:90] + item[91:]
    near = good[1].split()
    rows = good + bad + [good[0], good[1] + " more", " ".join([*near[:-1], "changed"]), item + " " + text(60), text(60) + " " + edited]
    rows += [text(70) + " " + passage, text(30) + " " + passage + " " + text(40), text(50) + " " + short, short + " " + text(50), "", good[5]]
    docs = [(i, t, "en", "src", len(t)) for i, t in enumerate(rows)] + [(None, text(40), "en", "src", 1), (len(rows), None, "en", "src", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item, passage


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(rows before, rows after) of every stage."""
    import corpus_pipeline as P

    docs, seen = spark.read.parquet(f"{folder[0]}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder[0])
        if k < 4:
            assert out.columns == COLUMNS
        kept = out.collect()
        seen.append((docs.collect(), kept))
        docs = spark.createDataFrame(kept, out.schema)
    return seen


def as_bag(rows):
    return Counter(tuple(r) for r in rows)


def test_names():
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]


def test_quality_keeps_what_scores_well(spark, folder, stages):
    """The score is computed again, text by text, with plain zstandard calls on the same labelled rows."""
    import zlib

    import zstandard

    from siltstone.llm._labels import fit_logistic, labelled_sample, logistic
    from siltstone.llm.compression_classifier import train_dictionary

    before, after = stages[0]
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    use = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    from pyspark.sql import functions as F

    texts, y = labelled_sample(docs, labels, "quality", F.col("doc_id").isin(use), 6000, 40 << 20)
    cal = np.arange(len(y)) % 2 == 1
    made = [zstandard.ZstdCompressionDict(train_dictionary([t for t, c, q in zip(texts, cal, y, strict=True) if not c and q == k])) for k in (1, 0)]

    def features(t):
        raw = t.encode()
        if not raw:
            return [0.0, 0.0, 0.0]
        a, b = (sum(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for d in made)
        return [(b - a) / (a + b), a / len(raw), np.log1p(len(t))]

    def matrix(ts):
        d, r, n = np.array([features(t) for t in ts]).T
        return np.column_stack([d, r, d * d, r * r, d * r, n, d * n, r * n, n * n])

    w = fit_logistic(matrix([t for t, c in zip(texts, cal, strict=True) if c]), y[cal], ridge=0.01)
    keep = [bool(r.text) and logistic(matrix([r.text]), w)[0] >= 0.7 for r in before]
    assert as_bag(after) == as_bag([r for r, k in zip(before, keep, strict=True) if k])
    ids = {r.doc_id for r in after}
    assert len(ids & set(range(120, 160))) == 0 and len(set(range(120)) - ids) <= 4


def test_join_keeps_the_least_of_each_group(stages):
    before, after = stages[1]
    sets = []
    for r in before:
        w = re.findall("[^\x20\x09-\x0d]+", r.text.lower() if r.text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if before[i].doc_id is not None and before[j].doc_id is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(before):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert as_bag(after) == as_bag([r for i, r in enumerate(before) if r.doc_id is None or least[find(i)] == r.doc_id])
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {160, 170} & {r.doc_id for r in before} <= gone


def test_repeats_are_cut(folder, stages):
    import corpus_pipeline as P

    before, after = stages[2]
    n = P.REPEAT_BYTES
    raw = [(r.text or "").encode() for r in before]
    seen = Counter(t[i : i + n] for r, t in zip(before, raw, strict=True) if r.doc_id is not None for i in range(len(t) - n + 1))
    want = {}
    for r, t in zip(before, raw, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1) if r.doc_id is not None else ():
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        at, kept = 0, []
        for c in (r.text or ""):  # only whole characters go
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        want[r.doc_id] = "".join(kept)
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after)
    assert sum(folder[2] in (r.text or "") for r in before) == 2 and not any(folder[2] in r.text for r in after)


def distance(item, text):
    """Least edit distance of item to a substring of text, by the quadratic recurrence."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_are_dropped(folder, stages):
    before, after = stages[3]
    clean = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    item = clean(folder[1])
    leaked = [distance(item, clean(r.text)) <= len(item) // 10 for r in before]
    assert sum(leaked) >= 1
    assert as_bag(after) == as_bag([r for r, bad in zip(before, leaked, strict=True) if not bad])


def test_encoding_is_sentencepieces(stages):
    import public_tokenizers
    import sentencepiece

    before, after = stages[4]
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: theirs.encode(r.text or "") for r in before}
    assert {r.doc_id: r.ids for r in after} == want and len(after) == len(before)
    assert all(r.parity and r.round_trip for r in after)


def test_run_matches_stages(spark, folder, stages):
    import corpus_pipeline as P

    out = P.run(spark, folder[0])
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in stages[4][1])
