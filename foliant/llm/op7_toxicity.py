"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Suspicious tokens (digits or symbols among letters, letters three times in a row, three or more single
letters set apart) become lattices of readings: leetspeak symbols as letters, separators dropped, repetitions
shortened. The Viterbi path under a character trigram model, smoothed by its bigrams, is the restored token,
however long it is: readings are linked back, so the time is in proportion to the length. The character
model is counted over all texts of the input; its size is that of the alphabet cubed. Words, and word
beginnings, of the restored text are hashed for a logistic regression trained with FTRL on at most MAX_ROWS
labelled rows and applied to every whole text. Null and empty texts score the bias alone; repeated rows
score alike; a score of exactly THRESHOLD is predicted toxic, so an empty label table, which gives 0.5 throughout,
predicts every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import hashed_lr
from foliant.llm.common import crc_bucket, sliced, table, WordCache

BITS = 20
MAX_ROWS = 12_000
THRESHOLD = 0.5
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 2  # 0: between words, last: anything else
#: What a symbol may stand for, and the costs (natural log) of the channel.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c"}
APART = "._-*~"
COST_LEET, COST_PLAIN, COST_DROP, COST_KEEP, COST_ONE, COST_TWO, COST_SINGLE = 0.7, 4.0, 0.3, 4.0, 0.5, 0.9, 2.5
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(]+[^\W\d_]|^[0-9@$!|+(]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|+(]$|([^\W\d_])\1\1|(?:[^\W_][._*~-]){2}[^\W_]")
SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\S)")
EDGES = "\"'.,;:?()[]{}<>#%&*/\\=~_-^`"


def symbol_table() -> np.ndarray:
    """Latin-1 byte -> symbol."""
    out = np.full(256, SIZE - 1, np.int64)
    for i, c in enumerate(LETTERS):
        out[ord(c)] = i + 1
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


SYMBOL = symbol_table()
INDEX = {chr(i): int(SYMBOL[i]) for i in range(256)}


def symbols(text: str) -> np.ndarray:
    return SYMBOL[np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8)]


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each three symbols follow each other, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SIZE**3, np.int64), [], 0

        def add() -> None:
            nonlocal size
            apart = np.zeros(2, np.int64)
            s = np.concatenate([apart, *(x for t in held for x in (t, apart))])
            if held:
                total[:] += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
            held.clear()
            size = 0

        for b in sliced(batches):
            for t in b.column(text).to_pylist():
                if t:
                    held.append(symbols(t))
                    size += len(t)
                if size > 4_000_000:
                    add()
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) as [a, b, c]; at most SIZE**3 counts reach the driver."""
    c3 = np.zeros(SIZE**3)
    for r in trigram_counts(docs).toPandas().itertuples():
        c3[r.code] = r.n
    c3 = c3.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 2 * p2[None]) / (c3.sum(2, keepdims=True) + 2)
    return -np.log(p3).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, its readings and their costs."""
    out = []
    for c, group in groupby(token):
        n = len(list(group))
        if c == " ":
            out.append([("", COST_DROP), (" ", COST_PLAIN / 4)])
        elif c in LEET:
            one = [(x, COST_LEET + (COST_SINGLE if n == 2 else 0)) for x in LEET[c]]
            two = [(x + x, COST_LEET + (0 if n == 2 else COST_TWO)) for x in LEET[c]] if n > 1 else []
            out.append([*one, *two, (c * min(n, 3), COST_PLAIN)])
        elif c in APART:
            out.append([("", COST_DROP), (c, COST_KEEP)])
        elif n == 1:
            out.append([(c, 0.0)])
        elif n == 2:
            out.append([(c + c, 0.0), (c, COST_SINGLE)])
        else:
            out.append([(c, COST_ONE), (c + c, COST_TWO)])
    return out


def viterbi(token: str, model: np.ndarray) -> str:
    """The cheapest reading of the token's lattice; ties go to the first in order of readings."""
    best: dict = {(0, 0): (0.0, None)}  # last two symbols -> cost, and readings linked from the last to the first
    for readings in lattice(token):
        following: dict = {}
        for (a, b), (cost, done) in best.items():
            for reading, extra in readings:
                x, y, total = a, b, cost + extra
                for c in reading:
                    k = INDEX.get(c, SIZE - 1)
                    total += float(model[x, y, k])
                    x, y = y, k
                old = following.get((x, y))
                if old is None or total < old[0]:
                    following[x, y] = (total, (done, reading))
        best = following
    ends = [(cost + float(model[a, b, 0]), done) for (a, b), (cost, done) in best.items()]
    least = min(cost for cost, _ in ends)
    return min(read(done) for cost, done in ends if cost == least)


def read(done: tuple | None) -> str:
    """The text of linked readings."""
    parts = []
    while done is not None:
        done, reading = done
        parts.append(reading)
    return "".join(reversed(parts))


class Restorer:
    def __init__(self, model: np.ndarray, cap: int = 100_000):
        self.model = model
        self.tokens = WordCache(self._token, cap)

    def _token(self, token: str) -> str:
        core = token.strip(EDGES)
        if not core or not SUSPECT.search(core):
            return token
        return token.replace(core, viterbi(core, self.model), 1)

    def joined(self, text: str) -> str:
        """The whole text, lower-cased, with single letters that stand apart read as words."""
        return SPACED.sub(lambda m: viterbi(m[0], self.model), text.lower())

    def restore(self, text: str) -> str:
        """The whole text, lower-cased, with every suspicious token restored."""
        return "".join(map(self.tokens.__getitem__, re.split(r"(\s+)", self.joined(text))))

    def words(self, text: str) -> set[str]:
        """The distinct words of restore(text); each token is restored once."""
        return set(map(self.tokens.__getitem__, set(self.joined(text).split())))


class ToxicFeatures:
    """Buckets of the distinct words, and word beginnings, of the restored text."""

    def __init__(self, model: np.ndarray):
        self.restorer = Restorer(model)
        self.mask = (1 << BITS) - 1
        self.cache = WordCache(self._word, 150_000)

    def _word(self, token: str) -> tuple[int, ...]:
        word = token.strip(EDGES + "!")
        if not word:
            return ()
        parts = {"w" + word, *("p" + word[:n] for n in (3, 4, 5, 6) if len(word) > n)}
        return tuple(xxhash.xxh3_64_intdigest(p) & self.mask for p in parts)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = self.restorer.words(text.decode("utf-8", "replace"))
        idx = np.unique(np.fromiter(chain.from_iterable(map(self.cache.__getitem__, words)), np.int64))
        return idx, np.ones(len(idx), np.float32)


def fit(docs: DataFrame, labels: DataFrame, chars: np.ndarray, max_rows: int = MAX_ROWS) -> hashed_lr.Model:
    sent = docs.sparkSession.sparkContext.broadcast(chars)
    return hashed_lr.train(docs, labels, "toxic", lambda: ToxicFeatures(sent.value), 1 << BITS, max_rows, epochs=12, alpha=1.0, l1=8.0, l2=0.01, weight_pos=2.0)


def score(docs: DataFrame, model: hashed_lr.Model, chars: np.ndarray) -> DataFrame:
    """doc_id and score for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((model, chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = sent.value
        f = ToxicFeatures(c)
        for b in sliced(batches):
            p = [m.probability(*f(t or b"")) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    chars = char_model(docs)
    scored = score(docs, fit(docs, labels, chars), chars)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
