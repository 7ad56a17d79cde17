"""Substring dedup by relative Lempel-Ziv parsing: documents are factored greedily against indexed reference blocks.

The corpus is its own reference, dealt to blocks so that equal passages meet. Each window of N words has the least
of its Q-gram hashes as anchor, so equal windows have equal anchors. A run of windows with one anchor is a fragment;
fragments go, as hashes of their words, to the block of their anchor, unless the anchor occurs but once in the corpus,
which rules its windows out. A block is indexed by a suffix array: windows ranked by their hashes, ranks doubled until
they tell all continuations apart, so that the longest match of a place stands next to it. Each fragment is then
factored from left to right: at the first place whose window occurs elsewhere in the block, the longer match of the
two neighbours is extended word by word and becomes a factor; windows that begin in the factor's last N - 1 words
cross its boundary and are looked up again, so the next factor begins there if there is one. Factors have N words
at least; the words that they cover are removed. Every window lies in one fragment, so no repeat is lost.

An anchor of more than SPLIT occurrences is dealt by a salt to several blocks. These report each window's hashes (128
bits) and count, and a window that is alone in its block but not in all of them is a factor too. Hashes of words have
64 bits; a match compares them word by word. A row is named by a hash of its id and text. Every occurrence counts:
the same document twice, or twice in one document. Texts under N words, empty and null texts lose nothing; repeated
rows are judged alike. Whole texts are read; a fragment is cut at RUN windows, which costs no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import MIX, discard, hash_cache, mixed, sliced, stored, table, texts, window_hashes, word_hashes

N, Q = 35, 8
RUN = 1_024  # windows of a fragment at most
SPLIT = 2_000  # occurrences of an anchor that one block takes
CHUNK_WORDS = 500_000  # a task parses this many words of blocks together, or one block
CACHED = 60_000


def anchors(h: np.ndarray, n: int = N, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of n words, and the q-gram hashes that they were chosen from."""
    g = window_hashes(h, q)
    if len(h) < n:
        return np.empty(0, np.uint64), g
    need, size, low = n - q + 1, 1, g
    while 2 * size <= need:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = need - size
    return (np.minimum(low[: len(low) - rest], low[rest:]) if rest else low), g


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, key, n) for the distinct anchors of each document; n is how often they occur there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = hash_cache(CACHED)
        for b in sliced(batches):
            out, keys, counts = [], [], []
            for key, t in zip(b.column("_key").to_pylist(), texts(b, "text"), strict=True):
                a, g = anchors(word_hashes((t or b"").split(), cache))
                if len(a):
                    u = np.unique(a)
                    g = np.sort(g)
                    out.append(u)
                    keys.append(np.full(len(u), key, np.int64))
                    counts.append(np.searchsorted(g, u, "right") - np.searchsorted(g, u))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts).astype(np.int32))], names=["anchor", "key", "n"])

    return docs.select("_key", "text").mapInArrow(run, "anchor long, key long, n int")


def fragments(docs: DataFrame) -> DataFrame:
    """(block, hot, key, start, words) of rows with the lists ``anchors`` and ``parts`` (how many blocks share an anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = hash_cache(CACHED)
        for b in sliced(batches, 200):
            block, hot, keys, starts, words = [], [], [], [], []
            for key, t, known, parts in zip(b.column("_key").to_pylist(), texts(b, "text"), b.column("anchors"), b.column("parts"), strict=True):
                h = word_hashes((t or b"").split(), cache)
                a, _ = anchors(h)
                known, parts = known.values.to_numpy().view(np.uint64), parts.values.to_numpy()
                order = np.argsort(known)
                known, parts = known[order], parts[order]
                place = np.minimum(np.searchsorted(known, a), len(known) - 1)
                at = np.flatnonzero(known[place] == a)
                if not len(at):
                    continue
                new = np.concatenate([[True], (np.diff(at) > 1) | (a[at[1:]] != a[at[:-1]])])
                first = np.flatnonzero(new)
                since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                opens = np.flatnonzero(since % RUN == 0)
                s, e = at[opens], at[np.append(opens[1:], len(at)) - 1] + N
                n = parts[place[s]]
                salt = (np.uint64(key & (2**64 - 1)) + np.arange(len(s), dtype=np.uint64)) % n.astype(np.uint64)
                block.append(np.where(n > 1, mixed(a[s] + (salt + np.uint64(1)) * MIX), a[s]))
                hot.append(n > 1)
                keys.append(np.full(len(s), key, np.int64))
                starts.append(s)
                words += [h[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(block).view(np.int64)), pa.array(np.concatenate(hot)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(words, pa.binary())],
                    names=["block", "hot", "key", "start", "words"],
                )

    return docs.select("_key", "text", "anchors", "parts").mapInArrow(run, "block long, hot boolean, key long, start int, words binary")


class Block:
    """The suffix array over some fragments' windows, and the greedy parse of each fragment against the others.

    ``words`` are the fragments' word hashes one after the other, ``sizes`` their numbers of words.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, n: int = N):
        self.words, self.n = words, n
        many = sizes - (n - 1)
        self.total = int(many.sum())
        begin, opens = np.cumsum(sizes) - sizes, np.cumsum(many) - many
        self.fragment = np.repeat(np.arange(len(sizes)), many)
        self.end = (opens + many)[self.fragment]  # by window: the first window behind its fragment
        self.place = np.arange(self.total) + (begin - opens)[self.fragment]  # its first word
        self.stop = (begin + sizes)[self.fragment]  # the first word behind its fragment
        self.hash = window_hashes(words, n)[self.place] if self.total else np.empty(0, np.uint64)
        _, self.kind, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        self.count = count[self.kind] if self.total else np.empty(0, np.int64)
        self.repeated = np.flatnonzero(self.count > 1)

    def suffix_array(self) -> np.ndarray:
        """Windows in the order of their words and all that follow in their fragments."""
        rank, classes, step, at = self.kind.astype(np.int64), 0, 1, np.arange(self.total)
        while True:
            after = at + step
            follows = np.where(after < self.end, rank[np.minimum(after, self.total - 1)] + 1, 0)
            values, finer = np.unique(rank * (self.total + 1) + follows, return_inverse=True)
            if len(values) == classes:
                return np.argsort(rank, kind="stable")
            rank, classes, step = finer, len(values), step * 2

    def common(self, p: np.ndarray, p_stop: np.ndarray, q: np.ndarray, q_stop: np.ndarray) -> np.ndarray:
        """How many words are equal from the places p and q on, within their fragments."""
        most = np.minimum(p_stop - p, q_stop - q)
        out, alive, d = most.copy(), np.arange(len(p)), 0
        while len(alive):
            alive = alive[most[alive] > d]
            same = self.words[p[alive] + d] == self.words[q[alive] + d]
            out[alive[~same]] = d
            alive = alive[same]
            d += 1
        return out

    def factors(self) -> np.ndarray:
        """Rows (fragment, first word, number of words) of the factors; all fragments are parsed side by side."""
        if not len(self.repeated):
            return np.empty((0, 3), np.int64)
        order = self.suffix_array()
        near = np.full((2, self.total), -1)
        near[0, order[1:]], near[1, order[:-1]] = order[:-1], order[1:]
        own = self.fragment[self.repeated]
        at = self.repeated[np.concatenate([[True], own[1:] != own[:-1]])]  # the first such window of each fragment
        out = []
        while len(at):
            longest = np.zeros(len(at), np.int64)
            for side in near:
                other = side[at]
                ok = np.flatnonzero((other >= 0) & (self.kind[other] == self.kind[at]))
                x, y = at[ok], other[ok]
                longest[ok] = np.maximum(longest[ok], self.common(self.place[x], self.stop[x], self.place[y], self.stop[y]))
            found = longest >= self.n  # else only the hashes were equal
            out.append(np.stack([self.fragment[at], self.place[at], longest], 1)[found])
            # the next window to look up is the first one that crosses the factor's boundary
            onward = np.where(found, at + longest - (self.n - 1), at + 1)
            i = np.searchsorted(self.repeated, onward)
            following = self.repeated[np.minimum(i, len(self.repeated) - 1)]
            at = following[(i < len(self.repeated)) & (following < self.end[at])]
        return np.concatenate(out)


def parsed(pieces: DataFrame) -> DataFrame:
    """(key, start, stop) of factors; of windows of hot blocks (key, start, null, a, b, n), one for all n in the block."""
    seed = np.uint64(0x2545F4914F6CDD1D)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parse(t: pa.Table) -> pa.RecordBatch:
            raw = t.column("words").to_pylist()
            sizes = np.array([len(r) // 8 for r in raw], np.int64)
            block = Block(np.frombuffer(b"".join(raw), np.uint64), sizes)
            key, start, hot = (t.column(c).to_numpy() for c in ("key", "start", "hot"))
            begin = np.cumsum(sizes) - sizes
            f = block.factors()
            first = start[f[:, 0]] + f[:, 1] - begin[f[:, 0]]
            _, one = np.unique(block.kind, return_index=True)
            one = one[hot[block.fragment[one]]]
            again = window_hashes(mixed(block.words ^ seed), N)[block.place[one]] if len(one) else np.empty(0, np.uint64)
            frag = block.fragment[one]
            at = start[frag] + block.place[one] - begin[frag]
            lack = pa.nulls
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[f[:, 0]], key[frag]])), pa.array(np.concatenate([first, at]).astype(np.int32)),
                    pa.concat_arrays([pa.array((first + f[:, 2]).astype(np.int32)), lack(len(one), pa.int32())]),
                    *(pa.concat_arrays([lack(len(f), pa.int64()), pa.array(x.view(np.int64))]) for x in (block.hash[one], again, block.count[one].astype(np.int64))),
                ],
                names=["key", "start", "stop", "a", "b", "n"],
            )

        held, words = [], 0
        for b in sliced(batches):  # sorted by block
            block = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                piece = pa.Table.from_batches([b.slice(x, y - x)])
                if held and words >= CHUNK_WORDS and piece.column("block")[0] != held[-1].column("block")[-1]:
                    yield parse(pa.concat_tables(held))
                    held, words = [], 0
                held.append(piece)
                words += piece.column("words").nbytes // 8
        if held:
            yield parse(pa.concat_tables(held))

    return pieces.mapInArrow(run, "key long, start int, stop int, a long, b long, n long")


def repeats(docs: DataFrame) -> DataFrame:
    """(key, starts, stops): the factors of documents that have some, as word positions."""
    docs = keyed(docs.select("doc_id", "text"))
    every = stored(anchor_rows(docs), "anchors")
    twice = every.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    twice = stored(twice.select("anchor", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "twice")
    # both sides are stored, so the skew join can split a hot anchor
    lists = every.join(twice, "anchor").groupBy("key").agg(F.collect_set(F.struct("anchor", "parts")).alias("x"))
    lists = stored(lists.select(F.col("key").alias("_key"), F.col("x.anchor").alias("anchors"), F.col("x.parts").alias("parts")), "anchors")
    discard(every, twice)
    pieces = fragments(docs.join(lists, "_key"))
    found = stored(parsed(pieces.repartition("block").sortWithinPartitions("block")), "factors")
    discard(lists)
    hot = found.where("a is not null")
    again = stored(hot.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").select("a", "b"), "hot")
    across = hot.where("n = 1").join(again, ["a", "b"]).select("key", "start", (F.col("start") + N).alias("stop"))
    spans = found.where("a is null").select("key", "start", "stop").union(across)
    out = stored(spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("x")).select("key", F.col("x.start").alias("starts"), F.col("x.stop").alias("stops")), "factors")
    discard(found, again)
    return out


def merged(starts: np.ndarray, stops: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``total`` words no factor covers, and the covered spans (start, end)."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    stay = np.cumsum(edge[:-1]) == 0
    step = np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8))
    return stay, np.stack([np.flatnonzero(step == -1), np.flatnonzero(step == 1)], 1)


def cleaned(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word positions) and the kept words, joined by one space (or their digest)."""
    marks = repeats(docs)
    rows = keyed(docs.select("doc_id", "text")).join(marks.withColumnRenamed("key", "_key"), "_key", "left")
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            total, gone, spans, kept = [], [], [], []
            for t, starts, stops in zip(texts(b, "text"), b.column("starts"), b.column("stops"), strict=True):
                words = (t or b"").split()
                total.append(len(words))
                covered: list[int] = []
                if starts.is_valid:
                    stay, runs = merged(starts.values.to_numpy(), stops.values.to_numpy(), len(words))
                    words = list(compress(words, stay.tolist()))
                    covered = runs.ravel().tolist()
                gone.append(total[-1] - len(words))
                spans.append(covered)
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", last],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "starts", "stops").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<int>, {last} string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"), digest=True).drop("spans")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT rid, w, unnest(generate_series(1, len(w) - {N - 1})) AS i FROM d WHERE len(w) >= {N}),
g AS (SELECT rid, i, array_to_string(w[i:i + {N - 1}], ' ') AS g FROM i),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
p AS (SELECT DISTINCT rid, unnest(generate_series(i, i + {N - 1})) AS p FROM g WHERE g IN (SELECT g FROM r)),
x AS (SELECT rid, list(p) AS ps FROM p GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_transform(w, lambda v, k: {{'v': v, 'k': k}}), lambda s: NOT list_contains(ps, s.k)), lambda s: s.v) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x ON d.rid = x.rid
"""
