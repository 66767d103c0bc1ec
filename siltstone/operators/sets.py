"""Set operations, first-wins dedupe and version differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def normalised_strings(values: Column) -> Column:
    """Trimmed, lower case, distinct, first order kept; nulls and empties dropped."""
    clean = F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(clean)


def first_wins(rows: DataFrame, key: Column, order: list[str], within: list[str] | None = None) -> DataFrame:
    """The first row of each key in the order given."""
    w = W.partitionBy(*(within or []), key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, columns): rows of new over those of old (insert), and the other way (delete), counting repeats."""
    return new.exceptAll(old).withColumn("change", F.lit("insert")).unionByName(old.exceptAll(new).withColumn("change", F.lit("delete")))


def set_counts(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per key: matched, missing and extra members of two (key, title) sets."""
    both = expected.distinct().withColumn("e", F.lit(1)).join(found.distinct().withColumn("f", F.lit(1)), [key, "title"], "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    e, f = F.col("e").isNotNull(), F.col("f").isNotNull()
    return both.groupBy(key).agg(count(e & f).alias("n_matched"), count(e & ~f).alias("n_missing"), count(~e & f).alias("n_extra"))


def paragraph_changes(pairs: DataFrame) -> DataFrame:
    """Paragraph-level changes between two texts: pairs(pair_id, old_text, new_text) gives one row for each block.

    change_type insert, delete or replace, 1-based paragraph ranges (null on the side without paragraphs) and texts. A
    sequence matcher has no column form, so this is one vectorised function over the pairs, without a shuffle.
    """
    schema = "pair_id {}, block int, change_type string, from_start int, from_end int, to_start int, to_end int, old_text string, new_text string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib
        import re

        def paragraphs(value: str | None) -> list[str]:
            value = (value or "").replace("\r\n", "\n").replace("\r", "\n")
            value = re.sub(r"[ \t]+", " ", re.sub(r"\n[ \t]+", "\n", value))
            return [p.strip() for p in re.split(r"\n{2,}", value) if p.strip()]

        names = {"insert": "insert", "delete": "delete", "replace": "replace"}
        for frame in frames:
            out = []
            for pair, old, new in zip(frame["pair_id"], frame["old_text"], frame["new_text"], strict=True):
                a, b = paragraphs(old), paragraphs(new)
                blocks = [x for x in difflib.SequenceMatcher(a=a, b=b).get_opcodes() if x[0] in names]
                for n, (tag, i, j, k, m) in enumerate(blocks):
                    left, right = (i + 1, j) if i < j else (None, None), (k + 1, m) if k < m else (None, None)
                    out.append((pair, n, tag, *left, *right, "\n\n".join(a[i:j]) or None, "\n\n".join(b[k:m]) or None))
            made = pd.DataFrame(out, columns=["pair_id", "block", "change_type", "from_start", "from_end", "to_start", "to_end", "old_text", "new_text"])
            yield made.astype({c: "Int32" for c in ("block", "from_start", "from_end", "to_start", "to_end")})

    kind = dict(pairs.dtypes)["pair_id"]
    return pairs.select("pair_id", "old_text", "new_text").mapInPandas(run, schema.format(kind))


def change_counts(changes: DataFrame) -> DataFrame:
    """Per pair: paragraphs added, deleted and modified."""
    n_new = F.coalesce(F.col("to_end") - F.col("to_start") + 1, F.lit(0))
    n_old = F.coalesce(F.col("from_end") - F.col("from_start") + 1, F.lit(0))
    total = lambda kind, n: F.coalesce(F.sum(F.when(F.col("change_type") == kind, n)), F.lit(0)).alias(f"n_{kind}")
    return changes.groupBy("pair_id").agg(total("insert", n_new), total("delete", n_old), total("replace", F.greatest(n_old, n_new)))


def lines_of(documents: DataFrame) -> DataFrame:
    """(document_id, line) of documents(document_id, content), empty lines dropped."""
    return documents.select("document_id", F.explode(F.split(T.text("content"), "\n")).alias("line")).where(F.trim("line") != "")
