"""N-gram Jaccard join by PartEnum signatures: classes of equal sets, links, and connected components.

A text's set holds the distinct shingles of N lower-cased words (fewer words: the whole sequence). Texts with
equal sets form one class, named by a 64-bit hash of the set, and only classes are joined; a second hash tells
whether two sets have one name, and then all are named anew by another hash. Classes that share
a signature (partenum.py) are candidates. They are not paired off: first each class is tried against the
smallest one of each signature, which finds nearly all links; then, where a signature's classes are still in
several components, those of different components are compared, exactly, by size and by a parity sketch
whose distance never exceeds the sets' difference. A signature of many classes is dealt to tasks by pairs of
blocks of its classes. What these bounds leave is verified on the sets.
So no component between different texts is lost, and candidates that are connected already cost nothing.
The links themselves, all of them, are the output of links().

Null and wordless texts have empty sets and are linked with nothing; repeated rows and equal ids share a
class; a null doc_id never names a component unless all its members are null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import aside, discard, hash_cache, mixed, sliced, stored, table, texts, window_hashes, word_hashes
from foliant.llm.graph import components
from foliant.llm.partenum import signatures

N, PERCENT = 5, 80
BUCKET_ROWS = 250_000  # signatures that one task groups, 14 bytes each
CACHED = 60_000  # words whose hashes a task remembers
SKETCH, SKETCH_MOST = 1024, 1 << 16  # bits; twice to four times the set's size, within these bounds
KEYS_SENT = 2_000_000  # 64-bit names of rows that may be broadcast; beyond, a join picks the sets
BLOCK = 256
SEEN = 200_000  # classes that a task remembers to have signed
GROUP = 1_000  # classes of one signature that one task compares with each other


def shingles(text: bytes, cache, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = word_hashes(text.lower().split(), cache)
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def set_key(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """The name of a set, and a second hash that tells sets of one name apart."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16, salt=b"%d" % salt).digest())


def named(docs: DataFrame) -> DataFrame:
    """text and the rest, with _row: a hash that names the row by doc_id and text."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def sketch(s: np.ndarray) -> bytes:
    """The parity of the number of features in each cell; cells by the low bits of a hash, so that halves fold."""
    cells = min(SKETCH_MOST, max(SKETCH, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((mixed(s) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches as rows of 64-bit words, each folded to ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, raw in enumerate(sketches):
        x = np.frombuffer(raw, np.uint64)
        while len(x) > size // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many cells differ, for pairs of sketches; never more than the sets' difference."""
    size = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    out = np.empty(len(a), np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = np.bitwise_count(folded([a[i] for i in at], n) ^ folded([b[i] for i in at], n)).sum(1)
    return out


def described(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, _row, n_shingles, key, check and sketch (these null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = hash_cache(CACHED)
        for b in sliced(batches):
            rows = [(len(s), *set_key(s, salt), sketch(s)) if len(s) else (0, None, None, None) for s in (shingles(t or b"", cache) for t in texts(b, "text"))]
            n, key, check, sk = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_row"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(sk, pa.binary())],
                names=["doc_id", "_row", "n_shingles", "key", "check", "sketch"],
            )

    return docs.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _row long, n_shingles long, key long, check long, sketch binary")


def planes(x: np.ndarray, keep: int = 8) -> bytes:
    """The low ``keep`` bytes of 64-bit numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :keep]).tobytes()


def unplanes(raw: bytes, keep: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // keep, 8), np.uint8)
    out[:, :keep] = np.frombuffer(raw, np.uint8).reshape(-1, keep)
    return out.reshape(-1).view(np.uint64)


def signed(docs: DataFrame, buckets: int, salt: int = 0) -> DataFrame:
    """Packed rows (bucket, sigs, keys); a partition signs a class once, unless it has met very many others since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, held, size = hash_cache(CACHED), set(), [], 0

        def flush() -> pa.RecordBatch:
            sig, key = np.concatenate([s for s, _ in held]), np.concatenate([np.full(len(s), k, np.int64) for s, k in held]).view(np.uint64)
            at = (sig >> np.uint64(48)) % np.uint64(buckets) if buckets <= 1 << 16 else mixed(sig) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            sig, key, at = sig[order], key[order], at[order]
            cuts = np.flatnonzero(np.diff(at)) + 1
            ranges = list(zip([0, *cuts], [*cuts, len(at)], strict=True))
            cols = [[int(at[a]) for a, _ in ranges], [planes(sig[a:b], 6) for a, b in ranges], [planes(key[a:b]) for a, b in ranges]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "sigs", "keys"])

        for b in sliced(batches):
            for t in texts(b, "text"):
                s = shingles(t or b"", cache)
                if not len(s):
                    continue
                k, _ = set_key(s, salt)
                if k in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(k)
                sig = signatures(s, PERCENT)
                if len(sig):
                    held.append((sig, k))
                    size += len(sig)
                if size >= BUCKET_ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, sigs binary, keys binary")


def grouped(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows (sig, a, b) of signatures that classes share: a is the smallest class, b another.

    sig is null where there is only this pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in sliced(batches):
            for k, s, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "sigs", "keys")), strict=True):
                held.setdefault(k, []).append((s, x))
        for k in list(held):
            got = held.pop(k)
            sig = unplanes(b"".join(s for s, _ in got), 6)
            key = unplanes(b"".join(x for _, x in got)).view(np.int64)
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])  # copies that several partitions have signed
            sig, key = sig[new], key[new]
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(start, len(sig)))
            many = size > 1
            head = np.repeat(start, size)
            rest = np.repeat(many, size) & (np.arange(len(sig)) != head)
            a, x, pair = key[head][rest], key[rest], np.repeat(size, size)[rest] == 2
            full = sig[rest].view(np.int64) * np.int64(buckets) + np.int64(k)
            lone = np.unique(np.stack([a[pair], x[pair]], 1), axis=0) if pair.any() else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(full[~pair], np.zeros(len(lone), np.int64)), mask=np.append(np.zeros((~pair).sum(), bool), np.ones(len(lone), bool))), pa.array(np.append(a[~pair], lone[:, 0])), pa.array(np.append(x[~pair], lone[:, 1]))],
                names=["sig", "a", "b"],
            )

    return packed.repartition(buckets, "bucket").mapInArrow(run, "sig long, a long, b long")


def near_enough(xor_bits: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What sizes and sketches allow to be similar."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((100 + PERCENT) * xor_bits <= (100 - PERCENT) * (n + m))


def plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b, bits) that sizes and sketches allow; bits is the sketches' distance."""
    of = lambda x: info.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if b.num_rows:
                bits = distances(b.column("s_a").to_pylist(), b.column("s_b").to_pylist())
                ok = near_enough(bits, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(bits)], names=["a", "b", "bits"]).filter(pa.array(ok))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long, bits long")


def apart(members: DataFrame, info: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """Plausible pairs of classes that share a signature and are in different components so far.

    The classes of a signature are dealt by hash into blocks of about GROUP; each pair of blocks is compared by
    itself, so a signature of g classes makes about (g / GROUP)**2 / 2 pieces of work of equal size.
    """
    every = members.select("sig", F.col("b").alias("key")).union(members.select("sig", F.col("a").alias("key")).distinct())
    rooted = every.join(roots.select(F.col("u").alias("key"), "v"), "key", "left").select("sig", "key", F.coalesce("v", "key").alias("root"))
    mixed_sigs = rooted.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("g")).where("r0 <> r1")
    mixed_sigs = stored(mixed_sigs.select("sig", F.ceil(F.col("g") / GROUP).cast("int").alias("blocks")), "mixed")
    rows = rooted.join(mixed_sigs, "sig").join(info.select("key", "n", "sketch"), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "root", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(t: pa.Table) -> np.ndarray:
            t = t.sort_by([("own", "ascending"), ("root", "ascending")])
            key, root, n, own = (t.column(c).to_numpy() for c in ("key", "root", "n", "own"))
            raw = t.column("sketch").to_pylist()
            w = folded(raw, min(map(len, raw)))
            split = int(np.searchsorted(own, own[-1]))  # where the second of two blocks begins; 0: a block with itself
            if not split and t.column("x")[0].as_py() != t.column("y")[0].as_py():
                return np.empty((0, 2), np.int64)  # no class fell into the other block
            out = []
            for i in range(0, split or len(key), BLOCK):
                hi = min(i + BLOCK, split or len(key))
                for j in range(split or i, len(key), BLOCK):
                    e = min(j + BLOCK, len(key))
                    low, high = min(root[i], root[j]), max(root[hi - 1], root[e - 1])
                    if low == high:
                        continue  # one component only
                    bits = np.bitwise_count(w[i:hi, None] ^ w[None, j:e]).sum(2).astype(np.int64)
                    ok = near_enough(bits, n[i:hi, None], n[None, j:e]) & (root[i:hi, None] != root[None, j:e])
                    x, y = np.nonzero(ok)
                    out.append(np.stack([key[i + x], key[j + y]], 1))
            return np.unique(np.sort(np.concatenate(out), 1), axis=0) if out else np.empty((0, 2), np.int64)

        def emitted(found: list[np.ndarray]) -> pa.RecordBatch:
            p = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        last, found = None, []
        for b in sliced(batches):  # sorted by sig and blocks: a group may go on in the next batch
            t = pa.Table.from_batches([b])
            t = t if last is None else pa.concat_tables([last, t])
            sig, x, y = (t.column(c).to_numpy() for c in ("sig", "x", "y"))
            cuts = [0, *(np.flatnonzero((sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                found.append(compared(t.slice(s, e - s)))
            last = t.slice(cuts[-1])
            if sum(map(len, found)) > 500_000:
                yield emitted(found)
                found = []
        if last is not None and last.num_rows:
            found.append(compared(last))
        if found:
            yield emitted(found)

    dealt = rows.repartition(parts, "sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, keys: DataFrame, info: DataFrame, salt: int) -> DataFrame:
    """(key, shingles) of the classes whose key is in ``keys``, from the rows that stand for them.

    A row that occurs twice gives its class twice, which does no harm.
    """
    wanted = stored(info.join(keys, "key").select("_row").distinct(), "keys")
    few = wanted.count() <= KEYS_SENT
    picked = docs.join(F.broadcast(wanted) if few else wanted, "_row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = hash_cache(CACHED)
        for b in sliced(batches):
            rows = [(set_key(s, salt)[0], s.tobytes()) for s in (shingles(t or b"", cache) for t in texts(b, "text")) if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["key", "shingles"])

    return picked.select("text").mapInArrow(run, "key long, shingles binary")


def verified(docs: DataFrame, pairs: DataFrame, info: DataFrame, salt: int) -> DataFrame:
    """The pairs (a, b), as links (u, v), whose sets are similar."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    sets = stored(sets_of(docs, keys, info, salt), "sets")
    of = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 100):
            ok = []
            for x, y in zip(b.column("s_a"), b.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = stored(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "verified")
    discard(sets)
    return links


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs whose ends are in different components."""
    of = lambda x: roots.select(F.col("u").alias(x), F.col("v").alias(f"r_{x}"))
    tagged = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return tagged.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select(pairs.columns)


def grouped_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Described rows, classes, the signatures that classes share, the number of buckets, and the salt of the names."""
    for salt in range(8):
        rows = stored(described(docs, salt), "sets")
        info = rows.where("key is not null").groupBy("key").agg(
            F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.count("*").alias("copies"),
            F.min("_row").alias("_row"), F.min("check").alias("c0"), F.max("check").alias("c1"),
        )
        info = stored(info, "classes")
        seen = info.agg(F.sum("n").alias("total"), F.max(F.col("c0") != F.col("c1")).alias("clash")).first()
        if not seen.clash:
            buckets = max(1, -(-(seen.total or 0) // (2 * BUCKET_ROWS)))  # about one signature for two shingles
            return rows, info.drop("c0", "c1"), stored(grouped(signed(docs, buckets, salt), buckets), "shared"), buckets, salt
        discard(rows, info)
    raise RuntimeError("two sets had one name, eight times over")


def links(docs: DataFrame) -> DataFrame:
    """(a, b, doc_a, doc_b): every pair of similar classes, by key (a < b), each with the least doc_id of the class.

    All pairs that share a signature are tried, connected or not, and verified on the sets: a signature of g
    classes gives g(g - 1)/2 candidates, as the links themselves may. Rows of one class have equal sets.
    """
    docs = named(docs.select("doc_id", "text"))
    rows, info, shared, _, salt = grouped_classes(docs)
    others = shared.where("sig is not null").select("sig", "b")  # a is the smallest of each
    across = others.withColumnRenamed("b", "a").join(others, "sig").where("a < b").select("a", "b")
    pairs = stored(plausible(shared.select("a", "b").union(across).distinct(), info), "pairs")
    discard(rows, shared)
    of = lambda x: info.select(F.col("key").alias(x), F.col("least").alias(f"doc_{x}"))
    found = verified(docs, pairs, info, salt).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    discard(pairs)
    return found.join(of("a"), "a").join(of("b"), "b").select("a", "b", "doc_a", "doc_b")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key, root, component_id and _row (see named()) of every row of ``docs``.

    Rows of one component have one root; component_id is the component's least doc_id, for rows without any set
    their own.
    """
    docs = named(docs.select("doc_id", "text"))
    rows, info, shared, buckets, salt = grouped_classes(docs)
    pairs = stored(plausible(shared.select("a", "b").distinct(), info), "pairs")
    # first the nearest candidate of each class, then what these links have left in different components
    best = pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = verified(docs, best, info, salt)
    roots = components(links)
    left = stored(between(pairs, roots).join(best, ["a", "b"], "left_anti"), "pairs")
    if not left.isEmpty():
        links = stored(links.union(verified(docs, left, info, salt)), "links")
        roots = components(links)
    members = shared.where("sig is not null")
    for share in (16, 1):  # links that some signatures show spare the exact pass most of its comparisons
        more = apart(members.where(F.pmod("sig", F.lit(share)) == 0), info, roots, buckets)
        more = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            links = stored(links.union(verified(docs, more, info, salt)), "links")
            roots = components(links)
            pairs = pairs.select("a", "b").union(more)
    discard(shared)
    classes = info.join(roots.select(F.col("u").alias("key"), "v"), "key", "left").select("key", "least", F.coalesce("v", "key").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = stored(classes.join(least, "root").select("key", "root", "component_id"), "named")
    discard(info, links, roots, left)
    out = rows.join(of_class, "key", "left")  # both sides are stored: a class with very many copies is split by the skew join
    return out.select("doc_id", "n_shingles", "key", "root", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "_row")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one whose doc_id names it, of the least row hash if several do.

    Rows without words belong to no component and stay, equal ones once. Columns of any name are kept.
    """
    docs, back = aside(docs, ("copies", "_row"))
    found = join(docs).groupBy("root", F.when(F.col("root").isNull(), F.col("_row")).alias("alone"), "_row").agg(
        F.count("*").alias("copies"), F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), 0).otherwise(1)).alias("rank")
    )
    kept = found.groupBy("root", "alone").agg(F.min(F.struct("rank", "_row", "copies")).alias("x")).select("x._row", "x.copies")
    once = named(docs).join(kept, "_row")
    # a row that comes once needs no comparison with others
    several = once.where("copies > 1").dropDuplicates(["_row"])
    return back(once.where("copies = 1").unionByName(several).select(*docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
