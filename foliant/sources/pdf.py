"""PDF files as relations: object instances, cross-reference entries, references, and what content streams draw.

The byte-level parsers are here, one file at a time; liveness, revisions, graphs and classes are relational
(foliant.operators.pdf). All instances of an object are kept, current or not. Damage ends a piece, never a job.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
START = re.compile(rb"startxref\s+(\d+)")
SPACE, DELIMITER = b"\0\t\n\f\r ", b"()<>[]{}/%"
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12, ord("("): 40, ord(")"): 41, ord("\\"): 92}
FOLLOWED = ("Contents", "Resources", "XObject", "Font", "ToUnicode", "Annots", "Metadata", "PieceInfo", "StructParents", "AcroForm", "EmbeddedFiles", "EF", "F", "UF", "Thumb", "Alternates", "SMask", "Mask")
SHOWS = ("Tj", "TJ", "'", '"')
DARK = 0.08


class Name(str):
    """/Name"""


class Word(str):
    """An operator or keyword."""


class Ref(tuple):
    """(object id, generation)"""


def inflate(data: bytes) -> bytes | None:
    """zlib, raw or gzip data, in this order of trial."""
    for bits in (15, -15, 31):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data)
        except zlib.error:
            continue
        if out or d.eof:  # a file may have lost the last bytes of the checksum to an end of line
            return out
    return None


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(token, offset): numbers, bytes for strings, Name, Word; [ ] << >> as Words; comments are skipped."""
    n = len(data)
    while at < n:
        c = data[at : at + 1]
        if c in (b"%",):
            while at < n and data[at] not in b"\r\n":
                at += 1
        elif data[at] in SPACE:
            at += 1
        elif c == b"(":
            out, depth, k = bytearray(), 1, at + 1
            while k < n and depth:
                b = data[k]
                if b == 92 and k + 1 < n:
                    e = data[k + 1]
                    m = re.compile(rb"[0-7]{1,3}").match(data, k + 1)
                    if m:
                        out.append(int(m[0], 8) & 255)
                        k = m.end()
                    else:
                        if e in ESCAPES:
                            out.append(ESCAPES[e])
                        k += 2
                    continue
                depth += (b == 40) - (b == 41)
                if depth:
                    out.append(b)
                k += 1
            yield bytes(out), at
            at = k
        elif data[at : at + 2] in (b"<<", b">>"):
            yield Word(data[at : at + 2].decode()), at
            at += 2
        elif c == b"<":
            k = data.find(b">", at)
            k = n if k < 0 else k
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : k])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
            at = k + 1
        elif c in (b"[", b"]", b"{", b"}", b")", b">"):
            yield Word(c.decode()), at
            at += 1
        else:
            k = at + 1
            while k < n and data[k] not in SPACE and data[k] not in DELIMITER:
                k += 1
            raw = data[at:k].decode("latin-1")
            if raw.startswith("/"):
                yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), raw[1:])), at
            elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", raw):
                yield (float(raw) if "." in raw else int(raw)), at
            else:
                yield Word(raw), at
            at = k


def value(data: bytes, at: int = 0):
    """The value at an offset: dict, list, bytes, Name, number, Ref, bool or None."""
    stack: list[list] = [[]]
    for t, _ in tokens(data, at):
        top = stack[-1]
        if isinstance(t, Word):
            if t in ("<<", "["):
                stack.append([t])
                continue
            if t in (">>", "]") and len(stack) > 1:
                kind, *items = stack.pop()
                t = dict(zip((str(k) for k in items[::2]), items[1::2], strict=False)) if kind == "<<" else items
                top = stack[-1]
            elif t == "R" and len(top) >= 2 and isinstance(top[-1], int) and isinstance(top[-2], int):
                g, i = top.pop(), top.pop()
                t = Ref((i, g))
            elif t in ("true", "false", "null"):
                t = {"true": True, "false": False, "null": None}[t]
            elif t in ("endobj", "stream"):
                break
        top.append(t)
        if len(stack) == 1 and not isinstance(t, int):
            return t
        if len(stack) == 1 and isinstance(t, int) and not re.compile(rb"\s*[+-]?\d*\.?\d*\s+\d+\s+R\b").match(data, at):
            return t
    return stack[0][0] if stack[0] else None


def stream_of(body: bytes, head: dict) -> bytes | None:
    """The payload of an object's stream, inflated if that is its first filter."""
    a, b = body.find(b"stream"), body.rfind(b"endstream")
    if a < 0 or b < a + 6:
        return None
    raw = body[a + 6 : b]
    raw = raw[2:] if raw.startswith(b"\r\n") else raw[1:] if raw[:1] in (b"\n", b"\r") else raw
    raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw
    f = head.get("Filter")
    f = f[0] if isinstance(f, list) and f else f
    return (inflate(raw) or raw) if f == "FlateDecode" else raw


def objects(data: bytes) -> list[dict]:
    """Every instance: id, gen, offset, end, head (its dictionary), stream, and the members of object streams."""
    out = []
    for m in OBJECT.finditer(data):
        stop = data.find(b"endobj", m.end())
        if stop < 0:
            continue
        body = data[m.end() : stop]
        head = value(body)
        head = head if isinstance(head, dict) else {"": head}
        o = {"id": int(m[1]), "gen": int(m[2]), "offset": m.start(), "end": stop + 6, "head": head, "stream": stream_of(body, head), "parent": None, "slot": None, "body": body}
        out.append(o)
        if head.get("Type") == "ObjStm" and o["stream"]:
            nums = [t for t, _ in tokens(o["stream"][: int(head.get("First") or 0)]) if isinstance(t, int)]
            for k, (i, at) in enumerate(zip(nums[::2], nums[1::2], strict=False)):
                inner = value(o["stream"], int(head.get("First") or 0) + at)
                out.append({"id": i, "gen": 0, "offset": m.start(), "end": stop + 6, "head": inner if isinstance(inner, dict) else {"": inner}, "stream": None, "parent": o["id"], "slot": k, "body": b""})
    return out


def xrefs(data: bytes, objs: list[dict]) -> list[dict]:
    """Revisions in order of offset: kind, offset, startxref, prev and entries (id, flag, offset, gen, objstm, slot)."""
    out = []
    for m in re.finditer(rb"(?<!start)xref\b", data):
        entries, at = [], m.end()
        head = re.compile(rb"\s*(\d+)\s+(\d+)(?=\s)")
        row = re.compile(rb"\s*(\d{10})\s+(\d{5})\s+([nf])")
        while h := head.match(data, at):
            at, first = h.end(), int(h[1])
            if row.match(data, h.start(1)):
                break
            for k in range(int(h[2])):
                r = row.match(data, at)
                if not r:
                    break
                entries.append((first + k, r[3].decode(), int(r[1]), int(r[2]), None, None))
                at = r.end()
        t = re.compile(rb"\s*trailer").match(data, at)
        trailer = value(data, t.end()) if t else {}
        s = START.search(data, at)
        out.append({"kind": "table", "offset": m.start(), "startxref": int(s[1]) if s else None, "prev": trailer.get("Prev") if isinstance(trailer, dict) else None, "entries": entries})
    for o in objs:
        head, raw = o["head"], o["stream"]
        w = head.get("W")
        if head.get("Type") != "XRef" or not raw or not isinstance(w, list):
            continue
        index = head.get("Index") or [0, head.get("Size") or 0]
        ids = [i for a, n in zip(index[::2], index[1::2], strict=False) for i in range(a, a + n)]
        step, entries = sum(w), []
        for k, i in enumerate(ids):
            cell = raw[k * step : (k + 1) * step]
            if len(cell) < step:
                break
            parts, at = [], 0
            for n in w:
                parts.append(int.from_bytes(cell[at : at + n], "big") if n else None)
                at += n
            kind = 1 if parts[0] is None else parts[0]
            a, b = parts[1] or 0, parts[2] or 0
            entries.append((i, "f", 0, b, None, None) if kind == 0 else (i, "n", a, b, None, None) if kind == 1 else (i, "n", 0, 0, a, b))
        s = START.search(data, o["end"])
        out.append({"kind": "stream", "offset": o["offset"], "startxref": int(s[1]) if s else None, "prev": head.get("Prev"), "entries": entries})
    return sorted(out, key=lambda r: r["offset"])


def references(node, via: str = "") -> Iterator[tuple[str, int, int]]:
    """(key, id, gen) of every reference below a value; the key is the nearest one above."""
    if isinstance(node, Ref):
        yield via, node[0], node[1]
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from references(v, k)
    elif isinstance(node, list):
        for v in node:
            yield from references(v, via)


def cmap(data: bytes) -> dict[int, str]:
    """Codes to text by bfchar and bfrange."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"(?s)begin(bfchar|bfrange)(.*?)end\1", data):
        seq = [t for t, _ in tokens(body)]
        if kind == b"bfchar":
            pairs = [t for t in seq if isinstance(t, bytes)]
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(pairs[::2], pairs[1::2], strict=False)}
            continue
        i = 0
        while i + 2 < len(seq):
            lo, hi, to = seq[i], seq[i + 1], seq[i + 2]
            i += 3
            if to == "[":
                stop = seq.index("]", i) if "]" in seq[i:] else len(seq)
                out |= {int.from_bytes(lo, "big") + k: text(b) for k, b in enumerate(seq[i:stop]) if isinstance(b, bytes)}
                i = stop + 1
            elif isinstance(to, bytes) and isinstance(lo, bytes) and isinstance(hi, bytes):
                base = int.from_bytes(to, "big")
                for k in range(min(65536, int.from_bytes(hi, "big") - int.from_bytes(lo, "big") + 1)):
                    out[int.from_bytes(lo, "big") + k] = text((base + k).to_bytes(len(to), "big"))
    return out


def fonts(objs: list[dict]) -> dict[str, tuple[str, Callable[[bytes], str]]]:
    """Resource name -> (kind of map, decoder), by the last instance of each object."""
    last = {o["id"]: o for o in objs}

    def follow(v):
        return last[v[0]]["head"] if isinstance(v, Ref) and v[0] in last else v

    out = {}
    for o in objs:
        res = follow(o["head"].get("Resources")) if o["head"].get("Type") == "Page" else o["head"]
        table = follow(res.get("Font")) if isinstance(res, dict) else None
        for name, v in table.items() if isinstance(table, dict) else ():
            f = follow(v)
            if not isinstance(f, dict):
                continue
            uni = f.get("ToUnicode")
            enc = follow(f.get("Encoding"))
            if isinstance(uni, Ref) and uni[0] in last and last[uni[0]]["stream"]:
                codes = cmap(last[uni[0]]["stream"])
                wide = f.get("Subtype") == "Type0"

                def by_map(b, codes=codes, wide=wide):
                    n = 2 if wide else 1
                    return "".join(codes.get(int.from_bytes(b[i : i + n], "big"), "") for i in range(0, len(b), n))

                out[name] = ("tounicode", by_map)
            elif isinstance(enc, dict) and isinstance(enc.get("Differences"), list):
                names, at = {}, 0
                for x in enc["Differences"]:
                    if isinstance(x, int):
                        at = x
                    else:
                        names[at] = x if len(x) == 1 else GLYPHS.get(x, "")
                        at += 1
                out[name] = ("differences", lambda b, names=names: "".join(names.get(c, bytes([c]).decode("cp1252", "replace")) for c in b))
            else:
                codec = "mac_roman" if enc == "MacRomanEncoding" else "cp1252"
                out[name] = ({"MacRomanEncoding": "macroman", "WinAnsiEncoding": "winansi"}.get(enc if isinstance(enc, str) else "", "standard"), lambda b, codec=codec: b.decode(codec, "replace"))
    return out


# Names of glyphs that stand for one character; letters stand for themselves, unknown names for nothing.
GLYPHS = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "slash": "/", "quotesingle": "'", "quotedbl": '"', "exclam": "!", "question": "?", "ampersand": "&", "at": "@", "numbersign": "#", "dollar": "$", "percent": "%", "plus": "+", "equal": "=", "underscore": "_", "asterisk": "*", "endash": "–", "emdash": "—", "bullet": "•", "fi": "fi", "fl": "fl", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def drawn(stream: bytes, fonts_: dict) -> Iterator[tuple[str, int, str, str]]:
    """(kind, offset, operator, text) of a content stream: text shown, dark boxes painted, path steps, images.

    A text run's text is decoded by its font's map; a box is an overlay when it is filled at most DARK bright.
    """
    args: list = []
    font, dark, boxes, saved = "", True, 0, []
    for t, at in tokens(stream):
        if not isinstance(t, Word) or t in ("[", "]", "<<", ">>", "true", "false", "null"):
            args.append(t)
            continue
        nums = [a for a in args if isinstance(a, (int, float))]
        if t in SHOWS:
            raw = [a for a in args if isinstance(a, bytes)]
            kind, decode = fonts_.get(font, ("none", lambda b: "".join(chr(c) if 32 <= c < 127 else "" for c in b)))
            if raw:
                yield "text", at, str(t), "".join(map(decode, raw))
        elif t == "Tf":
            font = next((str(a) for a in args if isinstance(a, Name)), "")
        elif t in ("q", "Q"):
            if t == "q":
                saved.append((font, dark))
            elif saved:
                font, dark = saved.pop()
        elif t in ("rg", "g", "k"):
            dark = bool(nums) and (max(nums) <= DARK if t != "k" else min(nums[-1:] or [0]) >= 1 - DARK)
        elif t == "re":
            boxes += 1
            yield "path", at, "re", ""
        elif t in ("f", "F", "f*"):
            if boxes and dark:
                yield "overlay", at, str(t), ""
            boxes = 0
        elif t in ("m", "l", "c", "v", "y", "h"):
            yield "path", at, str(t), ""
        elif t in ("n", "S", "s", "B", "b"):
            boxes = 0
        elif t == "Do":
            yield "xobject", at, "Do", next((str(a) for a in args if isinstance(a, Name)), "")
        args = []


# ---------------------------------------------------------------- tables

SCHEMAS = {
    "objects": "filename string, id int, gen int, place long, end_offset long, type string, subtype string, has_stream boolean, stream_bytes long, stream_sha256 string, parent int, slot int",
    "xref": "filename string, rev int, kind string, table_offset long, startxref long, prev long, id int, flag string, place long, gen int, objstm int, slot int",
    "refs": "filename string, src_id int, src_gen int, src_offset long, via string, dst_id int, dst_gen int",
    "drawn": "filename string, id int, gen int, place long, seq int, kind string, pos long, operator string, text string",
    "after": "filename string, kind string, pos long, bytes long",
}


def _rows(table: str, name: str, data: bytes) -> Iterator[tuple]:
    objs = objects(data)
    text = lambda v: str(v) if isinstance(v, str) else None
    if table == "objects":
        for o in objs:
            s = o["stream"]
            yield name, o["id"], o["gen"], o["offset"], o["end"], text(o["head"].get("Type")), text(o["head"].get("Subtype")), s is not None, None if s is None else len(s), None if s is None else hashlib.sha256(s).hexdigest(), o["parent"], o["slot"]
    elif table == "xref":
        for k, r in enumerate(xrefs(data, objs)):
            prev = r["prev"] if isinstance(r["prev"], int) else None
            for i, flag, at, gen, stm, slot in r["entries"]:
                yield name, k, r["kind"], r["offset"], r["startxref"], prev, i, flag, at, gen, stm, slot
    elif table == "refs":
        for o in objs:
            for via, i, g in references(o["head"]):
                yield name, o["id"], o["gen"], o["offset"], via, i, g
    elif table == "drawn":
        known = fonts(objs)
        for o in objs:
            if o["stream"] is not None and o["head"].get("Type") in (None, "XObject") and o["head"].get("Subtype") in (None, "Form") and b"begincmap" not in o["stream"]:
                for k, (kind, at, op, t) in enumerate(drawn(o["stream"], known)):
                    yield name, o["id"], o["gen"], o["offset"], k, kind, at, op, t
    else:
        end = data.rfind(b"%%EOF")
        end = len(data) if end < 0 else end + 5
        tail = data[end:]
        if tail.strip():
            yield name, "tail", end, len(tail)
        for o in objs:
            if o["offset"] >= end and o["parent"] is None:
                yield name, "object", o["offset"], o["end"] - o["offset"]


def table(files: DataFrame, which: str) -> DataFrame:
    """One of the relations of SCHEMAS over PDF files (filename, content); other files give no rows."""
    schema = SCHEMAS[which]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, c in zip(b.column("filename").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(_rows(which, n, c)) if c and c.startswith(b"%PDF") else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("filename", "content").mapInArrow(run, schema)


def build(bodies: list[tuple[int, bytes]], base: bytes = b"%PDF-1.4\n", prev: int | None = None, root: int = 1) -> bytes:
    """A file, or one more revision of ``base``, with a classic cross-reference table; for tests and demonstrations."""
    out, at = bytearray(base), {}
    for i, body in bodies:
        at[i] = len(out)
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n"
    for i in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (i, at[i])
    out += b"trailer\n<< /Size %d /Root %d 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (max(at) + 1, root, b"/Prev %d " % prev if prev is not None else b"", start)
    return bytes(out)
