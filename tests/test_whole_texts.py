"""Texts count in full: neither long lines nor long evidence are cut before they are searched or compared."""

import shutil
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.operators import support
from siltstone.plans import queries as Q

TABLES = Path("/root/testdata/sf0.001")


def _folder(to, **tables):
    """The smallest tables with some of them put in place."""
    for f in TABLES.glob("*.parquet"):
        shutil.copy(f, to / f.name)
    for name, rows in tables.items():
        (to / f"{name}.parquet").unlink()
        pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(TABLES / f"{name}.parquet")), to / f"{name}.parquet")
    return str(to)


def _sql(folder, name):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    made = con.execute(Q.ORACLE_SQL[name])
    return [c[0] for c in made.description], made.fetchall()


@pytest.fixture(scope="module")
def long_line(tmp_path_factory):
    words = " ".join(f"word{k}" for k in range(6_000))
    texts = [words, "the last word5999 and others", "word1 word2 word3 word4"]
    docs = [{"doc_id": k, "text": t, "lang": "en", "source": "src0", "n_chars": len(t)} for k, t in enumerate(texts)]
    asked = [{"item_id": 0, "text": "word5998 word5999"}, {"item_id": 1, "text": "word1 word2"}]
    return _folder(tmp_path_factory.mktemp("long"), documents=docs, benchmark=asked)


@pytest.mark.parametrize("name", ["term_index", "bm25_search", "weighted_search", "corpus_idf"])
def test_every_word_of_a_long_line_is_searched(spark, long_line, name):
    columns, theirs = _sql(long_line, name)
    rows = [tuple(r[c] for c in columns) for r in Q.QUERIES[name](spark, long_line).collect()]
    as_text = lambda rows: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert as_text(rows) == as_text(theirs)
    if name == "bm25_search":
        assert ("0-0", 0) in {(r[columns.index("chunk_id")], r[columns.index("query_id")]) for r in rows}  # words beyond the 4,096th


def test_evidence_counts_to_its_end(spark):
    claim, other = "the goblin jumps over seven dwarfs", "x" * 6_000
    rows = spark.createDataFrame([(1, claim, other + "the goblin jumps over"), (2, claim, "the goblin jumps over" + other)], "i int, claim string, content string")
    got = {r.i: r.score for r in support.claim_scores(rows).collect()}
    assert got[1] == got[2] and got[1] > 0
