"""Language-model scoring: a gated recurrent model (gru.py) and exact add-0.1 unigram scores of whole documents.

Tokens are words with A-Z lower-cased, then one end. Counts cover every training document. The recurrent model
knows the VOCABULARY most frequent tokens; every other word is one of ENDINGS classes by its last two bytes, times
the word's smoothed share of its class. A class keeps the share of one word that training has not seen, and any
unseen word gets that share: the score is a probability over the seen words and one unseen word a class.

Training: a first pass on a bounded seed (SEED_DOCS, in one task, by the order of a hash) leaves the symmetric
start; then the training documents are dealt by a hash of id and text into groups of about GROUP_TOKENS, whatever
files they came in; each group carries the state through all its tokens in the order of the hash and takes a
gradient step on every window, and the groups' weights are averaged by their numbers of tokens, in a tree of
tasks that sum in the order of the groups. So the same rows give the same model.

Texts are split twice: for the counts, and to write each document's ids (two bytes a token), which training and
scoring both read. The FREQUENT most frequent words' counts are broadcast there (a fixed number); the counts of
rarer words are joined by word. A scoring task holds HELD_TOKENS of waiting documents and one for each lane.
Null counts as empty (an end alone). A row is named by a hash of doc_id and text, so repeated rows score alike,
one row each. Without training documents the counts are zero and the base score is that of the formula; the
recurrent model then is its unigram start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_bucket, discard, released, sliced, stored, table
from foliant.llm.gru import Adagrad, Gru, scored, trained

VOCABULARY, ENDINGS, HIDDEN = 2_000, 64, 16
FREQUENT = 200_000
SEED_DOCS, SEED_RATE, RATE = 2_000, 0.1, 0.05
GROUP_TOKENS = 5_000_000  # tokens that one task trains on
SLICES, FAN_IN = 8, 64
ALPHA = 0.1
IDS = np.uint16  # ids of the recurrent model
ROWS = 10_000  # of a batch at most
END = b"\n"  # no word holds it


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column, A-Z lower-cased, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts)).fill_null("")
    each = pc.ascii_split_whitespace(trimmed)
    words, n = each.flatten(), pc.list_value_length(each).to_numpy()
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)  # split as one empty word
    if blank.any():
        words, n = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(blank, 0, n)
    return words, n.astype(np.int64)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


_PAIRS = np.array([ending(bytes([a, b])) for a in range(256) for b in range(256)], np.int64)
_SINGLE = np.array([ending(bytes([a])) for a in range(256)], np.int64)


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each word; no word is empty."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.empty(0, np.int64)
    _, at, data = words.buffers()
    to = np.frombuffer(at, np.int32, len(words) + 1, words.offset * 4)
    data, last = np.frombuffer(data, np.uint8), to[1:] - 1
    before = data[np.maximum(last - 1, 0)].astype(np.int64)
    return np.where(np.diff(to) > 1, _PAIRS[before * 256 + data[last]], _SINGLE[data[last]])


def word_counts(docs: DataFrame, limit: int = 500_000) -> DataFrame:
    """(word, c) over all texts; each task sums what it has before the shuffle."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in sliced(batches, ROWS):
            counts = pc.value_counts(split(b.column("text"))[0])
            held.append(pa.table({"word": counts.field(0).cast(pa.binary()), "c": counts.field(1)}))
            held.append(pa.table({"word": pa.array([END]), "c": pa.array([b.num_rows], pa.int64())}))
            if sum(map(len, held)) > 2 * limit:
                held = [summed(held)]
                if len(held[0]) > limit:
                    yield from held.pop().to_batches(ROWS)
        if held:
            yield from summed(held).to_batches(ROWS)
        del held
        released()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What scoring needs of the counts; its size does not depend on the corpus."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int, by_ending: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.words = pa.array([w for w, _ in frequent], pa.binary())
        c = np.array([n for _, n in frequent], np.float64)
        self.log_count = np.log10(c + ALPHA)
        own = min(VOCABULARY, len(frequent))
        self.end = [w for w, _ in frequent].index(END)  # it must be among the frequent tokens
        # classes hold the words beyond the vocabulary: of the frequent ones here, of the others in by_ending
        sums = np.array([by_ending.get(e, (0, 0)) for e in range(ENDINGS)], np.float64).reshape(ENDINGS, 2)
        self.endings = np.array([ending(w) for w, _ in frequent], np.int64)
        np.add.at(sums, (self.endings[own:], 0), c[own:])
        np.add.at(sums, (self.endings[own:], 1), 1)
        # within a class: (c + ALPHA) / (its tokens + ALPHA * (its words + 1)); nothing is left out for unseen words
        self.log_class = np.log10(sums[:, 0] + ALPHA * (sums[:, 1] + 1))
        mass = np.concatenate([c[:own], sums[:, 0]])
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.counts = mass[order]  # by token id of the recurrent model
        self.class_id = place[own:].astype(IDS)
        self.id = np.where(np.arange(len(c)) < own, place[np.minimum(np.arange(len(c)), own - 1)], self.class_id[self.endings]).astype(IDS)
        self.start = int(self.id[self.end])
        # by frequent index, and last, for -1, of a rarer word: what it adds beside what its class takes
        self.seen = np.append(c > 0, False)
        self.base = np.append(self.log_count, 0.0)
        self.within = np.append(np.where(np.arange(len(c)) < own, 0.0, self.log_count - self.log_class[self.endings]), 0.0)

    def places(self, words: pa.Array) -> np.ndarray:
        """Frequent indexes of words, -1 for rarer ones."""
        return pc.index_in(words.cast(pa.binary()), self.words).fill_null(-1).to_numpy()


def lexicon(vocab: DataFrame, frequent: int = FREQUENT) -> tuple[Lexicon, DataFrame]:
    """The lexicon of a stored (word, c) table, and the table of the rarer words."""
    sums = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    end = vocab.where(F.col("word") == F.lit(END)).first()
    words = vocab.where(F.col("word") != F.lit(END)).withColumn("level", F.floor(F.log2("c") * 8))
    # the least level of counts at which no more than ``frequent`` words are as frequent; there are some 500 levels
    total, least = 0, 1 << 30
    for r in words.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > frequent:
            break
        least = r.level
    top = [(bytes(r.word), r.c) for r in words.where(F.col("level") >= least).select("word", "c").collect()]
    rest = words.where(F.col("level") < least).select("word", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((ENDINGS, 2), np.int64)
        for b in batches:
            e = endings(b.column("word"))
            np.add.at(got, (e, 0), b.column("c").to_numpy())
            np.add.at(got, (e, 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["e", "n", "v"])

    ends = rest.mapInArrow(run, "e long, n long, v long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    top = sorted([*top, (END, end.c if end else 0)], key=lambda x: (-x[1], x[0]))
    return Lexicon(top, sums.n or 0, sums.v or 0, {r.e: (r.n, r.v) for r in ends}), rest


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): the ids of its tokens, and all of its scores that no model is needed for.

    _key names the row; n_seen, base and lm cover the ``frequent`` tokens and the shares within classes; words and
    counts are its rarer words, whose log10(count + ALPHA) is joined later.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        for b in sliced(batches, ROWS):
            words, n = split(b.column("text"))
            at = lex.places(words)
            rare = np.flatnonzero(at < 0)
            # every document's words, then its end
            to = np.cumsum(n + 1)
            first = to - n - 1
            is_word = np.ones(int(to[-1]), bool)
            is_word[to - 1] = False
            every = np.full(len(is_word), lex.end, np.int32)
            every[is_word] = at
            del at
            unknown = words.take(pa.array(rare)).dictionary_encode()
            ends = endings(unknown.dictionary)[unknown.indices.to_numpy()]
            ids, within = lex.id[every], lex.within[every]
            where = np.flatnonzero(every < 0)
            ids[where], within[where] = lex.class_id[ends], -lex.log_class[ends]
            # each document's rarer words, once each, and how often it has them
            kinds = max(1, len(unknown.dictionary))
            pairs, times = np.unique(np.searchsorted(to, where, "right") * kinds + unknown.indices.to_numpy(), return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * kinds), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, unknown.dictionary.cast(pa.binary()).take(pa.array(pairs % kinds)))
            add = lambda x, kind: pa.array(np.add.reduceat(x, first, dtype=kind))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_key"), pa.array([ids[i:j].tobytes() for i, j in zip(first.tolist(), to.tolist(), strict=True)], pa.binary()), pa.array(n + 1),
                 add(lex.seen[every], np.int64), add(every >= 0, np.int64), add(lex.base[every], np.float64), add(within, np.float64), lists, pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))],
                names=["doc_id", "_key", "ids", "n_tokens", "n_seen", "frequent", "base", "lm", "words", "counts"],
            )

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), "text")
    return stored(keyed.mapInArrow(run, f"doc_id {kind}, _key long, ids binary, n_tokens long, n_seen long, frequent long, base double, lm double, words array<binary>, counts array<int>"), "encoded")


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """Token-weighted mean of (id, slice, vector, weight) rows, summed FAN_IN at a time in executors."""
    many = parts.select("id").distinct().count()

    def summed(key, t):
        t, total, weight = t.sort_by("id"), None, 0.0
        for v, w in zip(t.column("vector").to_pylist(), t.column("weight").to_pylist(), strict=True):
            v = np.frombuffer(v, np.float64)
            total, weight = v if total is None else total + v, weight + w
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "slice": pa.array([key[1].as_py()], pa.int32()), "vector": pa.array([total.tobytes()], pa.binary()), "weight": pa.array([weight], pa.float64())})

    while many > 1:
        up = parts.withColumn("up", F.floor(F.col("id") / FAN_IN))
        level = up.groupBy("up", "slice").applyInArrow(summed, parts.schema)
        parts, many = stored(level, "weights"), -(-many // FAN_IN)
        many = parts.select("id").distinct().count() if many > 1 else 1
    rows = sorted(parts.collect(), key=lambda r: r.slice)  # one model
    if not rows or not rows[0].weight:
        return None
    return np.concatenate([np.frombuffer(bytes(r.vector), np.float64) / r.weight for r in rows])


def fit(docs: DataFrame, lex: Lexicon, seed_docs: int = SEED_DOCS) -> Gru:
    """The recurrent model, trained on all ``docs``: (doc_id, text), or rows of ``encoded``."""
    coded = encoded(docs, lex) if "text" in docs.columns else docs
    sc = docs.sparkSession.sparkContext
    model = Gru.new(lex.counts, HIDDEN)
    begin = lex.start
    out = "id long, slice int, vector binary, weight double"

    def passed(rows: DataFrame, groups: int, start: Gru, rate: float) -> np.ndarray | None:
        """The averaged weights after one pass over the rows of each group, from the same start."""
        sent = sc.broadcast(start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            every = ((g, d) for b in batches for g, d in zip(b.column("_g").to_pylist(), b.column("ids").to_pylist(), strict=True))
            for g, part in groupby(every, lambda r: r[0]):
                own = m.with_vector(m.vector())
                n = trained(own, (np.frombuffer(d, IDS) for _, d in part), begin, Adagrad(own, rate))
                cuts = np.array_split(own.vector().astype(np.float64) * n, SLICES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array([float(n)] * SLICES)],
                    names=["id", "slice", "vector", "weight"],
                )

        dealt = rows.withColumn("_g", F.pmod("_h", F.lit(groups)).cast("int")).select("_g", "_h", "ids")
        parts = stored(dealt.repartitionById(groups, "_g").sortWithinPartitions("_g", "_h").select("_g", "ids").mapInArrow(run, out), "weights")
        v = _averaged(parts)
        discard(parts)
        return v

    hashed = coded.select(F.col("_key").alias("_h"), F.xxhash64("doc_id").alias("_id"), "ids")
    ends = int(lex.counts[lex.start])  # one for each training document
    share = 1_000_000 if ends <= seed_docs else seed_docs * 1_000_000 // ends
    v = passed(hashed.where(F.pmod("_id", F.lit(1_000_000)) < share), 1, model, SEED_RATE)
    if v is not None:
        model = model.with_vector(v)
    v = passed(hashed, max(1, -(-lex.total // GROUP_TOKENS)), model, RATE)
    return model if v is None else model.with_vector(v)


def score(docs: DataFrame, lex: Lexicon, rest: DataFrame, model: Gru) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row: (doc_id, text), or rows of ``encoded``."""
    coded = encoded(docs, lex) if "text" in docs.columns else docs
    sent, begin = docs.sparkSession.sparkContext.broadcast(model), lex.start
    own = ["doc_id", "_key", "n_tokens", "n_seen", "frequent", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, gone, schema = {}, [], 0, []

        def ids() -> Iterator[np.ndarray]:
            for b in batches:
                schema[:] = [b.select([*own, "lm"]).schema]
                for *first, d in zip(*(b.column(c).to_pylist() for c in (*own, "lm", "ids")), strict=True):
                    waiting[len(waiting) + gone] = first
                    yield np.frombuffer(d, IDS)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema[0], strict=True)], schema=schema[0])

        for i, s in scored(sent.value, ids(), begin):  # in the order in which documents end
            *first, within = waiting.pop(i)
            gone += 1
            rows.append((*first, s / np.log(10) + within))
            if len(rows) == 1_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    some = coded.select(*own, "lm", "ids")
    part = stored(some.mapInArrow(run, some.drop("ids").schema), "scored")
    each = coded.select("_key", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("_key", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    met = each.join(rest, "word").groupBy("word", "_key").agg(F.first("n").alias("n"), F.first("c").alias("c"))  # repeated rows count once
    unseen = float(np.log10(ALPHA))
    rare = met.groupBy("_key").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * (F.log10(F.col("c") + ALPHA) - unseen)).alias("more"))
    out = part.join(rare, "_key", "left").fillna(0, ["seen"]).fillna(0.0, ["more"])
    whole = float(np.log10(lex.total + ALPHA * (lex.distinct + 1)))
    every = (F.col("n_tokens") - F.col("frequent")) * unseen + F.col("more")  # all rarer words
    return out.select(
        "doc_id", "n_tokens", (F.col("n_seen") + F.col("seen")).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + every - F.col("n_tokens") * whole).alias("base_score"), (F.col("lm") + every).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.where(crc_bucket("doc_id", 10) != 0)
    lex, rest = lexicon(stored(word_counts(train), "words"))
    coded = encoded(docs, lex)
    scored = score(coded, lex, rest, fit(coded.where(crc_bucket("doc_id", 10) != 0), lex))
    return scored.select("doc_id", (crc_bucket("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
