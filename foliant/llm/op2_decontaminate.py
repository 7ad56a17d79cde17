"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans training token windows.

Words are runs of digits, a-z and characters beyond ASCII after lower-casing A-Z. A test item gives its
windows of N words, or itself if it has fewer words than that. Windows whose hash is in the set are
verified word by word; every word inside a verified window is hit. Test items are read in blocks of at
most BLOCK_BYTES of text (one block unless the benchmark is larger), which bounds what is broadcast;
further blocks are scanned one after the other, for which the rows are written once a block. Null and wordless texts have no windows; items without
words or without an id match nothing; repeated items count once; repeated documents are reported row by row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import aside, discard, hash_cache, sliced, stored, table, texts, window_hashes, word_hashes

N = 10
BLOCK_BYTES = 16 << 20  # of item texts; a worker holds about five times as much
MAX_SHARE = 0.5  # a document of which more is hit goes as a whole
NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
TOKEN = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """The normalised windows of a block of test items: sorted hashes, and where their words stand in one buffer."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = N):
        cache = hash_cache(50_000)
        self.items = [item for item, _ in items]
        texts_, sizes = [], np.zeros(len(items), np.int64)
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            sizes[k] = len(words)
            texts_.append(b" ".join([*words, b""]))
        self.buffer = b"".join(texts_)  # words, each with one space behind it
        del texts_
        self.ends = np.flatnonzero(np.frombuffer(self.buffer, np.uint8) == 32).astype(np.int32)
        begin = np.cumsum(sizes) - sizes
        hashes = word_hashes(self.buffer.split(), cache) if len(items) else np.empty(0, np.uint64)
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        short = np.minimum(sizes, n)
        for size in np.unique(short[short > 0]).tolist():
            of = np.flatnonzero(short == size)
            count = sizes[of] - size + 1
            item = np.repeat(of, count)
            place = np.arange(len(item)) + np.repeat(begin[of] - (np.cumsum(count) - count), count)
            h = window_hashes(hashes, size)[place]
            order = np.lexsort((item, h))
            h, item, place = h[order], item[order], place[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])  # again in its item: no news
            self.sets[size] = h[once], item[once].astype(np.int32), place[once].astype(np.int32)

    def text(self, place: int, size: int) -> bytes:
        """The words from a place on, with one space between them."""
        return self.buffer[self.ends[place - 1] + 1 if place else 0 : self.ends[place + size - 1]]

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Runs of hit words as rows (start, end), and the items with an occurring window."""
        total, found = len(words), set()
        edge = None
        for size, (known, item, place) in self.sets.items():
            if total < size:
                continue
            h = window_hashes(hashes, size)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero(known[at] == h).tolist():
                own, k, hit = b" ".join(words[i : i + size]), int(at[i]), False
                while k < len(known) and known[k] == h[i]:  # one entry for each item that has the window
                    if self.text(int(place[k]), size) == own:
                        found.add(self.items[item[k]])
                        hit = True
                    k += 1
                if hit:
                    edge = np.zeros(total + 1, np.int32) if edge is None else edge
                    edge[i] += 1
                    edge[i + size] -= 1
        if edge is None:
            return np.empty((0, 2), np.int32), found
        on = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
        step = np.diff(on)
        return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).astype(np.int32), found


_built: dict[str, Windows] = {}


def windows_of(name: str, sent) -> Windows:
    """The windows of a broadcast block; a process keeps those of the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Windows(sent.value)
    return _built[name]


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // limit))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r.item_id, r.text.encode()) for r in part.collect()]  # at most about ``limit`` bytes


def union_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return a if len(a) else b
    runs = np.concatenate([a, b])
    out: list[list[int]] = []
    for s, e in runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array(out, np.int32)


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES, with_text: bool = True, finish=None) -> DataFrame:
    """Every row and column of ``docs`` with n_words, n_hit, runs (word positions) and items.

    ``finish``, if given, takes the batches of the last block, in the worker that found the hits, and returns batches
    of the schema of ``docs``: a second Python step of its own would hold a second worker for each task.
    """
    extra = "n_words long, n_hit long, runs array<int>, items array<string>"
    df, before = docs, None
    keep = docs.columns
    blocks = item_blocks(benchmark, limit)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        chained, text_out = before is not None, with_text or following is not None
        names = [c for c in keep if text_out or c != "text"]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex, chained=chained, names=names) -> Iterator[pa.RecordBatch]:
            windows, cache = windows_of(name, sent), hash_cache(50_000)
            for b in sliced(batches):
                old = zip(b.column("runs").to_pylist(), b.column("items").to_pylist(), strict=True) if chained else repeat(([], []))
                rows = []
                for t, (r0, i0) in zip(texts(b, "text"), old):
                    words = words_of(t or b"")
                    runs, found = windows.hits(words, word_hashes(words, cache))
                    runs = union_runs(np.array(r0, np.int32).reshape(-1, 2), runs)
                    rows.append((len(words), int((runs[:, 1] - runs[:, 0]).sum()), runs.ravel().tolist(), sorted(found | set(i0))))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*names, "n_words", "n_hit", "runs", "items"])

        head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
        if finish is not None and following is None:
            df = df.mapInArrow(lambda batches, run=run: finish(run(batches)), docs.schema)
        else:
            df = df.mapInArrow(run, f"{head}, {extra}")
        if following is not None:
            df = stored(df, "decontaminate")
            if before is not None:
                discard(before)
            before = df
        block = following
    return df


def cut(text: str | None, runs: list[int]) -> str | None:
    """The text without the runs of words and what stands between their words."""
    if not runs:
        return text
    raw = text.encode()
    at = [m.span() for m in TOKEN.finditer(raw.translate(NORMAL))]
    out, last = [], 0
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` without hit spans, and without documents of which more than ``max_share`` is hit.

    n_chars, if there is such a column, follows the text that is left.
    """
    docs, back = aside(docs, ("n_words", "n_hit", "runs", "items"))
    cols = docs.columns

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(b.column("n_hit").to_numpy() <= b.column("n_words").to_numpy() * max_share))
            old = b.column("text").to_pylist()
            runs = b.column("runs").to_pylist()
            new = [cut(t, r) if r else t for t, r in zip(old, runs, strict=True)]
            arrays = [pa.array(new, b.schema.field("text").type) if c == "text" else b.column(c) for c in cols]
            if "n_chars" in cols:
                kept = [len(n) if r and n is not None else c for n, r, c in zip(new, runs, b.column("n_chars").to_pylist(), strict=True)]
                arrays[cols.index("n_chars")] = pa.array(kept, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return back(scan(docs, benchmark, finish=without))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bi AS (SELECT item_id, w, least({N}, len(w)) AS l, unnest(generate_series(1, greatest(1, len(w) - {N - 1}))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, w[i:i + l - 1] AS g FROM bi),
ls AS (SELECT DISTINCT l FROM bw),
di AS (SELECT rid, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, ls WHERE len(w) >= l),
dw AS (SELECT rid, i, l, w[i:i + l - 1] AS g FROM di),
hit AS (SELECT rid, i, dw.l AS l, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
pos AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN its ON d.rid = its.rid
"""
