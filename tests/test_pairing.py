"""Cross-document pairs against the builder that walks the list."""

import random

import pytest

from siltstone.operators.pairing import cross_document_pairs


def builder(candidates):
    out = []
    for domain in sorted({d for d, _, _ in candidates}):
        own, used, n = sorted((x for x in candidates if x[0] == domain), key=lambda x: x[2]), set(), 0
        for first in own:
            if first in used:
                continue
            second = next((x for x in own if x[1] != first[1] and x not in used), None)
            if second:
                used |= {first, second}
                n += 1
                out.append((domain, first[2], second[2], n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_cross_document_pairs(spark, seed):
    r = random.Random(seed)
    docs = {"a": [0, 0, 0, 1, 1, 2, 3], "b": range(30), "c": [0, 1], "d": [5]}
    rows = [(d, r.choice(list(docs[d])), k) for d in docs for k in r.sample(range(1000), r.choice([1, 7, 60, 200]))]
    rows += [("e", k // 9, k) for k in range(60)]  # runs of one document
    nulls = [(None, 1, 5), ("a", None, 5000), ("a", 1, None)]
    df = spark.createDataFrame(rows + nulls, "domain string, doc_id long, key long").repartition(3)
    got = cross_document_pairs(df).select("domain", "first_key", "second_key", "pair_no")
    assert sorted(tuple(x) for x in got.collect()) == builder(rows)


def test_no_candidates(spark):
    assert cross_document_pairs(spark.createDataFrame([], "domain string, doc_id long, key long")).collect() == []


@pytest.mark.parametrize("block", [1, 4, 64])
def test_blocks_find_the_beginnings_of_doubling(spark, block):
    from siltstone.operators import pairing

    r = random.Random(block)
    rows = [(d, p, None if r.random() < 0.05 else p + r.choice([0, 1, 1, 3, 9])) for d in ("a", "b") for p in range(1, 150)]
    ends = spark.createDataFrame(rows, "domain string, place long, till long").repartition(3)
    assert sorted(map(tuple, pairing.starts_of(ends, block).collect())) == sorted(map(tuple, pairing.beginnings(ends).collect()))


def test_doubling_follows_doors_only(spark, monkeypatch):
    from siltstone.operators import pairing

    seen, whole = [], pairing.beginnings
    monkeypatch.setattr(pairing, "beginnings", lambda ends, *a: (seen.append(ends.count()), whole(ends, *a))[1])
    df = spark.createDataFrame([("a", k // 3, k) for k in range(600)], "domain string, doc_id long, key long")
    assert cross_document_pairs(df).count() > 200 and seen[0] < 10
