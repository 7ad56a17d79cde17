"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token labels; a label sequence is accepted if and only if it is what the merges make
of its bytes. It starts as one state with a loop for each byte. Merge k of (u, v) adds one gadget: all arcs
labelled u lead to the same state s (so it was for bytes, and each gadget keeps it so), a copy of s without
the arc v takes over those arcs, and each state that had the arc u gets an arc uv to where v led from s.
States keep their rows of the transition table as ranges of labels, shared by all labels that lead to them.

A text is split by the pattern of the byte-level pre-tokenizer. A word is read byte by byte by a second table,
which tells the labels that end at each byte; exactly one of them is an arc from the state where it begins, as
the automaton accepts one label sequence for each string. So each byte has one state and one arc, nothing is
tried twice, and the labels are emitted from the last byte backwards. Decoding emits the labels' bytes.

Strings of special tokens in a text become those tokens, as in the tokenizers library. Null counts as empty: no
tokens. Each row is encoded by itself; repeated rows and other columns change nothing. The time is in proportion
to the text's length, however long it is.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import sliced, table, WordCache

VOCABULARY = "byte_bpe_50k.json"
#: The byte-level pre-tokenizer's pattern, with white space written as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORDS = regex.compile(SPLIT)
SPACE = regex.compile(r"\p{White_Space}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The states' rows, the labels' targets, and the byte automaton that finds which labels end at a byte.

    A label's number is its place in a tree whose edges lead from u to uv, children that came later first. What a
    state lacks because the arc v was taken away at time k is then one range of numbers: v, and all that grew on v
    at k or later; what grew on v before k had its arc already and keeps it. So a row is a sorted list of the ends
    of such ranges, and a label is missing if an odd number of ends is at or below its number.
    """

    def __init__(self, spec: dict):
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        spell = lambda s: bytes(letters[c] for c in s)
        self.bytes: dict[int, bytes] = {i: spell(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        single = [i for s, i in vocab.items() if len(s) == 1]
        merges = []
        for m in spec["model"]["merges"]:
            u, v = m.split(" ") if isinstance(m, str) else m
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        if len({uv for _, _, uv in merges}) < len(merges):
            raise ValueError("two merges make one token")
        self._number(single, merges)
        self._compile(single, merges)
        self._match()

    def _number(self, single: list[int], merges: list[tuple[int, int, int]]) -> None:
        grown: dict[int, list[tuple[int, int]]] = {}  # label -> (time, label) of those that begin with it
        for k, (u, _, uv) in enumerate(merges):
            grown.setdefault(u, []).append((k, uv))
        self.ids: list[int] = []
        self.number: dict[int, int] = {}
        after: dict[int, int] = {}  # the first number beyond a label's subtree
        todo = [(i, False) for i in reversed(single)]
        while todo:
            i, done = todo.pop()
            if done:
                after[i] = len(self.ids)
                continue
            self.number[i] = len(self.ids)
            self.ids.append(i)
            todo.append((i, True))
            todo += [(c, False) for _, c in grown.get(i, ())]  # the last one comes off first
        #: where the range of a label that is taken away at some time ends: birth times and numbers, both rising in time
        self._cut = {i: ([k for k, _ in g], [after[c] for _, c in g]) for i, g in grown.items()}

    def _compile(self, single: list[int], merges: list[tuple[int, int, int]]) -> None:
        """One gadget a merge, in order: a copy of the state behind u without the arc v; arcs uv to where v led."""
        start: list[int] = []
        number, born = self.number, bytearray(len(self.ids))
        target: list[list[int] | None] = [None] * len(self.ids)
        for i in single:
            target[number[i]] = start
            born[number[i]] = 1
        users = {id(start): len(single) + 1}  # labels that lead to a state; the start state is never changed
        for k, (u, v, uv) in enumerate(merges):
            nu, nv = number.get(u, -1), number.get(v, -1)
            if nu < 0 or nv < 0 or not born[nu] or not born[nv]:
                continue  # no word ever shows such a label
            row = target[nu]
            if bisect_right(row, nv) & 1:
                continue  # the labels never stand side by side
            led = target[nv]
            if u == v or users[id(row)] > 1:
                users[id(row)] -= 1
                row = row.copy()
                users[id(row)] = 1
                target[nu] = row
            times, ends = self._cut.get(v, ((), ()))
            old = bisect_left(times, k)  # children of v that are older than this gadget
            stop = self._first_old(v, old, ends)
            at = bisect_right(row, nv)
            row[at:at] = (nv, stop)
            users[id(led)] += 1
            target[number[uv]] = led
            born[number[uv]] = 1
        self.start, self.target, self.born = start, target, born
        del self._cut

    def _first_old(self, v: int, old: int, ends) -> int:
        """The number behind v's subtrees of labels that came at the gadget's time or later."""
        return ends[old] if old < len(ends) else self.number[v] + 1

    def _match(self) -> None:
        """Aho-Corasick over the labels' bytes: for each state of bytes read, the labels that end there, longest first."""
        self.goto: dict[int, int] = {}
        self.ends: list[tuple] = [()]
        fail = [0]
        for n, i in enumerate(self.ids):
            if not self.born[n]:
                continue
            node = 0
            for b in self.bytes[i]:
                key = node << 8 | b
                node = self.goto.get(key, 0)
                if not node:
                    node = self.goto[key] = len(self.ends)
                    self.ends.append(())
                    fail.append(0)
            self.ends[node] = ((n, len(self.bytes[i])),)
        kids: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.goto.items():
            kids.setdefault(key >> 8, []).append((key & 255, node))
        level = [0]
        while level:
            below = []
            for node in level:
                for b, c in kids.get(node, ()):
                    if node:
                        f = fail[node]
                        while f and f << 8 | b not in self.goto:
                            f = fail[f]
                        fail[c] = self.goto.get(f << 8 | b, 0)
                    self.ends[c] += self.ends[fail[c]]
                    below.append(c)
            level = below
        self.fail = fail
        self.moves: dict[int, int] = {}  # transitions by way of shorter suffixes, as they are met

    def move(self, node: int, b: int) -> int:
        key = node << 8 | b
        to = self.goto.get(key)
        if to is None:
            f = node
            while f and to is None:
                f = self.fail[f]
                to = self.goto.get(f << 8 | b)
            to = to or 0
            if len(self.moves) < 500_000:
                self.moves[key] = to
        return to

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels on the path that spells ``word``: byte by byte, the one label whose arc ends there."""
        rows, came, node, j = [self.start], [], 0, 0
        goto, moves, ends, target = self.goto.get, self.moves.get, self.ends, self.target
        for b in word:
            j += 1
            key = node << 8 | b
            node = goto(key) or moves(key) or self.move(node, b)
            for arc in ends[node]:
                if not bisect_right(rows[j - arc[1]], arc[0]) & 1:
                    break
            came.append(arc)
            rows.append(target[arc[0]])
        out = []
        while j:
            n, size = came[j - 1]
            out.append(self.ids[n])
            j -= size
        return tuple(reversed(out))


class Codec:
    def __init__(self, machine: Automaton, remembered: int = 80_000):
        self.machine = m = machine
        self.words = WordCache(lambda w: m.encode_word(w.encode()), remembered // 4)
        self.chunks = WordCache(self._chunk, remembered)
        self.marks = {c: m.encode_word(c.encode()) for c in ",.;:!?"}
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(m.special, key=len, reverse=True)) + ")") if m.special else None
        self.label = m.bytes
        self.decimal = {i: str(i) for i in m.bytes}

    def segment(self, s: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, WORDS.findall(s))))

    def _chunk(self, s: str) -> tuple[int, ...]:
        if s.isalpha():  # letters alone are one word of the pattern
            return self.machine.encode_word((" " + s).encode())
        if not s or SPACE.match(s):
            raise LookupError(s)
        mark = self.marks.get(s[-1])
        if mark and s[:-1].isalpha():  # one such mark behind letters is a word of its own
            return (self.chunks.get(s[:-1]) or self.machine.encode_word((" " + s[:-1]).encode())) + mark
        return self.segment(" " + s)

    def _plain(self, text: str) -> list[int]:
        """Splits at a space before other than white space always fall between words."""
        first, *rest = text.split(" ")
        try:
            got = list(chain.from_iterable(map(self.chunks.__getitem__, rest)))
        except LookupError:  # white space in a row: glue it to what stands before
            glued = [first]
            for c in rest:
                if not c or SPACE.match(c):
                    glued[-1] += " " + c
                else:
                    glued.append(" " + c)
            return list(chain.from_iterable(map(self.segment, glued)))
        return [*self.segment(first), *got]

    def encode(self, text: str) -> list[int]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[int] = []
        for piece in self.special.split(text):
            if piece in self.machine.special:
                out.append(self.machine.special[piece])
            elif piece:
                out += self._plain(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


_machines: dict[str, Automaton] = {}
_kept: dict[str, Codec] = {}


def codec(path: str, keep: bool = False) -> Codec:
    """A codec; a process compiles the automaton once. With ``keep`` what it remembers of words serves later tasks too."""
    if path not in _machines:
        with open(path, encoding="utf-8") as f:
            _machines[path] = Automaton(json.load(f))
    if not keep:
        return Codec(_machines[path])
    if path not in _kept:
        _kept[path] = Codec(_machines[path], 250_000)
    return _kept[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in sliced(batches):
            got = [c.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32()))], names=[*names, ids])
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{head}, `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; a null list gives null."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in sliced(batches):
            got = [c.decode(i.values.to_numpy().tolist()) if i.is_valid else None for i in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*names, text])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{head}, `{text}` string")


def tokenized(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with token ids and the text that they decode to, in one pass."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in sliced(batches):
            got = [c.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32())), pa.array([c.decode(i) for i in got], pa.string())], names=[*names, ids, decoded])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{head}, `{ids}` array<int>, `{decoded}` string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, keep=True)
        for b in sliced(batches):
            n, enc, dec = [], [], []
            for t in b.column("text").to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                enc.append(hashlib.sha256(c.joined(ids).encode()).hexdigest())
                dec.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
