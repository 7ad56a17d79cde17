"""Quality rules: counting rules, then a calibrated logistic regression over hashed word and character n-grams.

The rules' counts are exact and cover whole texts. A text that fails a rule is not kept; of the others
those are kept whose calibrated probability of good quality is at least KEEP. The regression is trained
on at most MAX_ROWS labelled rows; its weights are broadcast (the hash space bounds them), and rows are
scored in Arrow batches where they are. Null counts as a text without words; an empty label table gives
probability 0.5 throughout, which KEEP keeps (a probability of exactly KEEP is kept). Repeated rows are judged
alike, one row each; texts are read whole, however long; columns of docs keep their names and values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import hashed_lr
from foliant.llm.common import aside, sliced, table, texts, window_hashes, word_hashes
from foliant.llm.op1_quality import WordNgrams

BITS = 20
MAX_ROWS = 5_000  # labelled rows; four fifths train, one fifth calibrates
KEEP = 0.5
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
CHARS = 4  # characters (code points) in a character n-gram
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(flags: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a flagged window of ``width`` words."""
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_words(h: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    w = window_hashes(h, width)
    if len(w) < 2:
        return 0
    order = np.sort(w)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
    return int(covered(twice[at] == w, width, len(h)).sum())


def counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    body = sum(map(len, words))
    if not text.isascii():
        tail = np.frombuffer(text, np.uint8)
        body -= int(((tail & 0xC0) == 0x80).sum())  # continuation bytes are no code points
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), body, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


class WordCharNgrams(WordNgrams):
    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.both(text, text.split())

    def both(self, text: bytes, words: list[bytes], h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        i, v = hashed_lr.unit(self.buckets(words, h))
        a = np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        g = window_hashes(a.astype(np.uint64), CHARS)
        if not len(g):
            return i, v
        # the characters have their own half of the hash space, so that no bucket is listed twice
        ci, cv = hashed_lr.unit((g & self.mask).astype(np.int64) + (1 << BITS))
        return np.concatenate([i, ci]), np.concatenate([v, cv])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> hashed_lr.Model:
    return hashed_lr.train(docs, labels, "quality", WordCharNgrams, 2 << BITS, max_rows, calibrate=True)


def judge(docs: DataFrame, model: hashed_lr.Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts, base_failed, kept and probability for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    read = list(dict.fromkeys([*keep, "text"]))
    cols = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = sent.value, WordCharNgrams()
        for b in sliced(batches):
            rows, ps = [], []
            for t in texts(b, "text"):
                t = t or b""
                words = t.split()
                h = word_hashes(words, f.hashes)
                rows.append(counts(t, words, h))
                ps.append(m.probability(*f.both(t, words, h)))
            c = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PCT * c[:, 0])
            p = np.array(ps, np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), *(pa.array(c[:, j]) for j in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (p >= KEEP)), pa.array(p)],
                names=[*keep, *COUNTS, "base_failed", "kept", "probability"],
            )

    head = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in cols)
    return docs.select(*read).mapInArrow(run, head + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, probability double")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def clean(docs: DataFrame, model: hashed_lr.Model) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    docs, back = aside(docs, (*COUNTS, "base_failed", "probability", "kept"))
    return back(judge(docs, model, tuple(docs.columns)).where("kept").select(*docs.columns))
