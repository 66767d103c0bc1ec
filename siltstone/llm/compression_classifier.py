"""Quality by compression: which of two dictionaries helps more.

One zstandard dictionary is trained on good and one on bad labelled text. A text is compressed block by block
with each, so that its beginning doesn't become the dictionary of its rest; the difference of the compressed
sizes over their sum, with the plain compression ratio, becomes a calibrated score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labels import crc_remainder, fit_logistic, labelled_sample, logistic

#: Bytes of a compressed block and of a dictionary.
BLOCK, DICTIONARY = 1024, 112_640


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def train_dictionary(texts: list[str], most_blocks: int = 4000) -> bytes:
    """A dictionary from at most most_blocks blocks of whole texts, taken evenly; raw content where there is too little to train on."""
    pool = [b for t in texts for b in blocks(t.encode("utf-8", "replace"))]
    if len(pool) > most_blocks:
        pool = [pool[i] for i in np.linspace(0, len(pool) - 1, most_blocks).astype(int)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pool).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pool)[-DICTIONARY:] or b"\0" * 8


class DictionaryPair:
    """Compressors with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options) for d in (good, bad))

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: size difference over size sum, compression ratio, log length, and products of them."""
        out = np.zeros((len(texts), 2))
        good, bad = self.good.compress, self.bad.compress
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "replace")
            if raw:
                parts = blocks(raw)
                a, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
                out[i] = (b - a) / (a + b), a / len(raw)
        d, r = out.T
        size = np.log1p([len(t) for t in texts])  # how far sizes can be trusted
        return np.column_stack([d, r, d * d, r * r, d * r, size, d * size, r * size, size * size])


def quality_model(docs: DataFrame, labels: DataFrame, use: Column, max_docs: int = 6_000, max_bytes: int = 40 << 20, most_blocks: int = 4_000) -> Callable[[str], Column]:
    """Learn quality from labels(doc_id, quality) and the texts of documents(doc_id, text).

    use: condition on doc_id under which a label may be used. At most max_docs documents a class, chosen by hash, and
    about max_bytes of text are learned from: half trains the dictionaries (each from at most most_blocks blocks of 1 KiB,
    taken evenly), half the calibration. Returns a function
    from the name of a text column to its score: 0 to 1, higher for better text; 0 for null and empty texts. If one
    class has no labels, every other text gets the base rate.
    """
    texts, y = labelled_sample(docs, labels, "quality", use, max_docs, max_bytes)
    calibrate = np.arange(len(y)) % 2 == 1
    good, bad = (train_dictionary([t for t, c, q in zip(texts, calibrate, y, strict=True) if not c and q == k], most_blocks) for k in (1, 0))
    w = fit_logistic(DictionaryPair(good, bad).features([t for t, c in zip(texts, calibrate, strict=True) if c]), y[calibrate], ridge=0.01)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = DictionaryPair(good, bad)
        for column in batches:
            parts = []
            for at in range(0, len(column), 512):
                own = column.slice(at, 512).fill_null("").to_pylist()
                parts.append(np.where([bool(t) for t in own], logistic(pair.features(own), w), 0.0))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """Score documents(doc_id, text) for quality, learned from labels(doc_id, quality); see quality_model.

    Labels are used only from rows whose crc32(doc_id as text) modulo ``modulus`` is not ``held_out``. Returns doc_id,
    held_out (of a null doc_id: false), score and predicted (score >= threshold). Repeated rows stay rows; other
    columns are ignored; an empty table gives no rows. Every whole text is compressed.
    """
    rest = F.coalesce(crc_remainder(modulus) == held_out, F.lit(False))
    score = quality_model(docs, labels, ~rest, **bounds)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rest.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
