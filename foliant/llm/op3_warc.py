"""WARC records in ZIP packages: written in parallel, read back by ranges without extraction.

A package is a ZIP file with two stored members: archive/data.warc.gz, one gzip member for each WARC record,
and indexes/index.cdxj, one line for each record with its offset and length. The reader parses the end
record, the ZIP64 records if there are any, and the central directory, finds where the stored members
begin, reads the index, and then each record by its own byte range.

Of records with equal payloads of at least MIN_REVISIT bytes, those of the smallest page_id are responses and
the others revisit records. Null html is an empty payload; a null page_id counts as larger than any other
and, if all of a group are null, all are responses; rows with the same page_id as the first are responses
too; a null url leaves out the target. An empty table gives no packages and no rows. Packages go to the
shared folder under names of their own for each attempt, and only those of finished tasks are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import shared_dir, sliced, stored, table

MIN_REVISIT = 100
PACKAGE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
#: ZIP signatures and the marks that send a reader to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
BLANK = re.compile(r"[\x00-\x20]")


# ---------------------------------------------------------------- ZIP


def zipped(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` forces the large forms, which big files get anyway."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, at, n, crc = name.encode(), len(out), len(data), zlib.crc32(data)
        big = zip64 or n >= FULL32 or at >= FULL32
        local = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 33, crc, FULL32 if big else n, FULL32 if big else n, len(raw), len(local)) + raw + local + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, FULL32 if big else n, FULL32 if big else n, len(raw), len(extra), 0, 0, 0, 0, FULL32 if big else at) + raw + extra
    start, size, count = len(out), len(directory), len(members)
    out += directory
    big = zip64 or start >= FULL32 or count >= FULL16
    if big:
        tail = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
        out += LOCATOR + struct.pack("<IQI", 0, tail, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, FULL16 if big else count, FULL16 if big else count, FULL32 if big else size, FULL32 if big else start, 0)
    return bytes(out)


class StoredZip:
    """Members of a ZIP file, located and read through ``read(offset, length)`` alone."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 22 - FULL16)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(END)
        ends = lambda i: i + 22 <= len(tail) and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail)
        while at >= 0 and not ends(at):
            at = tail.rfind(END, 0, at)  # those bytes stood in a comment or in data
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        if (count == FULL16 or length == FULL32 or start == FULL32) and tail_at + at >= 20:
            locator = read(tail_at + at - 20, 20)
            if locator[:4] == LOCATOR:
                end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != END64:
                    raise ValueError("bad ZIP64 end record")
                count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, i = read(start, length), 0
        for _ in range(count):
            if directory[i : i + 4] != CENTRAL:
                raise ValueError("bad central directory")
            flags, method, crc, packed, plain, n, m, k = struct.unpack_from("<HH4xIIIHHH", directory, i + 8)
            offset = struct.unpack_from("<I", directory, i + 42)[0]
            name = directory[i + 46 : i + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            j, stop = i + 46 + n, i + 46 + n + m
            while j + 4 <= stop:
                tag, width = struct.unpack_from("<HH", directory, j)
                if tag == 1:  # in this order, and only those that did not fit
                    wide = list(struct.unpack_from(f"<{width // 8}Q", directory, j + 4))
                    plain = wide.pop(0) if plain == FULL32 else plain
                    packed = wide.pop(0) if packed == FULL32 else packed
                    offset = wide.pop(0) if offset == FULL32 else offset
                j += 4 + width
            self.members[name] = (method, offset, packed, crc)
            i = stop + k

    def span(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, offset, packed, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("bad local header")
        n, m = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n + m, packed


# ---------------------------------------------------------------- WARC


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record, as a gzip member."""
    name = lambda k: f"<urn:page:{'' if k is None else k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {REVISIT}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parsed(member: bytes) -> dict:
    """The fields of a record; a response's payload is measured and hashed, and must match its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    number = lambda s: int(s.removeprefix("<urn:page:").removesuffix(">")) if s != "<urn:page:>" else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": "revisit" if revisit else "response", "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
    }


def package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of (url, gzip member) pairs with its index."""
    at, lines = 0, []
    for url, member in records:
        lines.append(f"{BLANK.sub(lambda m: f'%{ord(m[0]):02X}', url) or '-'} {json.dumps({'offset': at, 'length': len(member), 'filename': 'data.warc.gz'})}")
        at += len(member)
    return zipped([(DATA, b"".join(m for _, m in records)), (INDEX, "\n".join(sorted(lines)).encode())], zip64)


def records_of(read: Callable[[int, int], bytes], size: int) -> Iterator[dict]:
    """Every record that the package's index names, each by its own range."""
    z = StoredZip(read, size)
    at, length = z.span(INDEX)
    base, total = z.span(DATA)
    for line in read(at, length).decode().split("\n"):
        if line:
            where = json.loads(line[line.index(" {") + 1 :])
            if where["offset"] + where["length"] > total:
                raise ValueError("the index points beyond the archive")
            yield parsed(read(base + where["offset"], where["length"]))


# ---------------------------------------------------------------- Spark


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the response's page_id, if several share the payload)."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    long = p.where(F.octet_length("payload") >= MIN_REVISIT)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # the right side is stored, so that the skew join can split a hot digest; short payloads need no join
    linked = long.join(stored(first, "first"), "digest", "left").select(*p.columns, "first")
    short = p.where(F.octet_length("payload") < MIN_REVISIT)
    return linked.union(short.withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))


def write_packages(pages: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages as packages below ``folder`` (a URI) and return their paths and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            data = package(held)
            with fs.open_output_stream(path) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [len(data)], "records": [len(held)]})

        for b in sliced(batches):
            for k, url, payload, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                member = record(k, url, payload, digest, first, first is not None and k != first)
                held.append((url or "", member))
                size += len(member)
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return stored(planned(pages).mapInArrow(run, "path string, bytes long, records long"), "packages")


def read_packages(packages: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the packages that ``packages`` lists, each file opened once and read by ranges."""
    names = ["page_id", "url", *(["payload"] if payload else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in names], names=names)

        for b in sliced(batches):
            for path, size in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    rows, held = [], 0
                    for r in records_of(lambda at, n, f=f: f.read_at(n, at), size):
                        rows.append(r)
                        held += r["payload_bytes"] if payload else 100
                        if held >= 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    sql = {"payload": "binary", "page_id": "long", "payload_bytes": "long", "refers_to": "long"}
    spread = packages.repartition(max(1, min(10_000, packages.count())))
    return spread.select("path", "bytes").mapInArrow(run, ", ".join(f"{c} {sql.get(c, 'string')}" for c in names))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/foliant-warc-{uuid.uuid4().hex}"
    packages = write_packages(table(spark, sf_dir, "pages"), folder)
    return read_packages(packages, folder, payload=False).drop("url")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
