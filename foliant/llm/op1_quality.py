"""Quality classifier: hashed word n-gram logistic regression trained with FTRL, scored as sparse dot products.

N-grams of two streams are hashed: the words themselves, and the words' shapes (runs of letter case,
digits and symbols, with a mark where a word repeats the one before). Null and empty texts have no
features and score the bias alone; every row of the input, repeated or not, gets one row; columns other
than doc_id and text are ignored. An empty label table gives 0.5 throughout.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import hashed_lr
from foliant.llm.common import crc_bucket, hash_cache, mixed, sliced, table, texts, window_hashes, word_hashes, WordCache

BITS = 20
MAX_ROWS = 8_000
CACHED = 120_000  # words that a task remembers
THRESHOLD = 0.7
CLASS = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)
RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> int:
    return zlib.crc32(RUN.sub(rb"\1", word.translate(CLASS)))


class WordNgrams:
    """Buckets of the word 1- and 2-grams and of the shape 1- to 3-grams of a text."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.hashes, self.shapes = hash_cache(CACHED), WordCache(shape, CACHED)

    def buckets(self, words: list[bytes], h: np.ndarray | None = None) -> np.ndarray:
        """``h``: the words' hashes, if they are known already."""
        if not words:
            return np.empty(0, np.int64)
        h = word_hashes(words, self.hashes) if h is None else h
        s = word_hashes(words, self.shapes)
        s[1:] = s[1:] * np.uint64(2) + (h[1:] == h[:-1])
        tri = window_hashes(h, 3)
        spread = len(np.unique(tri)) * 10 // max(1, len(tri))  # tenths of the 3-grams that are distinct
        parts = [mixed(h), window_hashes(h, 2), mixed(s + np.uint64(1 << 40)), window_hashes(s, 2), window_hashes(s, 3), mixed(np.full(1, 77_000 + spread, np.uint64))]
        return (np.concatenate(parts) & self.mask).astype(np.int64)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return hashed_lr.unit(self.buckets(text.split()))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> hashed_lr.Model:
    """Train on labelled rows; the caller leaves out the rows that are held out."""
    return hashed_lr.train(docs, labels, "quality", WordNgrams, 1 << BITS, max_rows)


def score(docs: DataFrame, model: hashed_lr.Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score for every row of ``docs``, text read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = sent.value, WordNgrams()
        for b in sliced(batches):
            p = [m.probability(*f(t or b"")) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in cols) + ", score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2)
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
