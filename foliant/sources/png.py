"""PNG files: chunks, an 8-bit decoder (gray, rgb, palette, with or without alpha) and an rgb encoder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes, most: int = 80) -> Iterator[tuple[str, int, bytes]]:
    """(type, offset, payload) of at most ``most`` chunks; stops at damage."""
    at = len(MAGIC)
    for _ in range(most if data.startswith(MAGIC) else 0):
        if at + 12 > len(data):
            return
        (n,) = struct.unpack_from(">I", data, at)
        kind = data[at + 4 : at + 8]
        if at + 12 + n > len(data) or not kind.isalpha():
            return
        yield kind.decode("ascii"), at, data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IEND":
            return


def end(data: bytes) -> int | None:
    """Offset just behind the IEND chunk."""
    return next((at + 12 + len(p) for k, at, p in chunks(data, 1 << 20) if k == "IEND"), None)


def texts(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(keyword, offset, text) of tEXt, zTXt and iTXt chunks."""
    for kind, at, p in chunks(data):
        key, _, rest = p.partition(b"\0")
        if kind == "tEXt":
            yield key.decode("latin-1"), at, rest.decode("latin-1")
        elif kind == "zTXt" and rest[:1] == b"\0":
            try:
                yield key.decode("latin-1"), at, zlib.decompress(rest[1:]).decode("latin-1")
            except zlib.error:
                continue
        elif kind == "iTXt" and len(rest) > 2:
            packed, body = rest[0], rest[2:].split(b"\0", 2)[-1]
            try:
                yield key.decode("latin-1"), at, (zlib.decompress(body) if packed else body).decode("utf-8", "replace")
            except zlib.error:
                continue


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        line = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        rule, row = int(line[0]), line[1:].copy()
        if rule == 1:
            row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif rule == 2:
            row += above
        elif rule in (3, 4):
            cur = [0] * step + row.tolist()
            up = [0] * step + above.tolist()
            for i in range(step, len(cur)):
                a, b, c = cur[i - step], up[i], up[i - step]
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                cur[i] = (cur[i] + guess) & 255
            row = np.array(cur[step:], np.uint8)
        elif rule:
            raise ValueError(f"unknown row filter {rule}")
        out[y], above = row, row
    return out


def decode(data: bytes) -> np.ndarray:
    """[height, width, 3] in 0..1; alpha is dropped. Raises ValueError for what is no such file."""
    if not data:
        raise ValueError("empty file")
    if not data.startswith(MAGIC):
        raise ValueError("not a PNG file")
    parts = list(chunks(data, 1 << 20))
    head = next((p for k, _, p in parts if k == "IHDR"), b"")
    if len(head) != 13:
        raise ValueError("no header")
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlace or color not in CHANNELS or not width or not height:
        raise ValueError("only 8-bit files without interlace")
    n = CHANNELS[color]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(p for k, _, p in parts if k == "IDAT")), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged image data") from e
    if len(raw) < height * (width * n + 1):
        raise ValueError("image data too short")
    px = _unfilter(raw, height, width * n, n).reshape(height, width, n)
    if color == 3:
        table = np.frombuffer(next(p for k, _, p in parts if k == "PLTE"), np.uint8).reshape(-1, 3)
        px = table[px[..., 0]]
    elif n < 3:
        px = np.repeat(px[..., :1], 3, axis=2)
    return px[..., :3] / 255.0


def quantized(rgb: np.ndarray) -> np.ndarray:
    """Bytes of 0..1 values, ties to even."""
    return np.rint(np.clip(rgb, 0, 1) * 255).astype(np.uint8)


def encode(rgb: np.ndarray) -> bytes:
    px = quantized(rgb)
    height, width, _ = px.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), px.reshape(height, -1)], 1).tobytes()
    part = lambda k, p: struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p))
    return MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def save(pictures, folder: str) -> None:
    """Write each row (image_id, lens, png, receipt) to folder/lens/image_id.png, and its receipt beside it, from the executors.

    The folder is one that all executors share. A file appears under its name when it is whole, so a task that is run
    again replaces its files; rows of one name replace each other.
    """

    def run(rows) -> None:
        import json
        import os

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for r in rows:
            place = f"{root}/{r.lens}"
            system.create_dir(place, recursive=True)
            for ending, body in ((".png", bytes(r.png)), (".json", (json.dumps(json.loads(r.receipt), indent=2, ensure_ascii=False) + "\n").encode())):
                part = f"{place}/.{r.image_id}{ending}.{os.urandom(4).hex()}"
                with system.open_output_stream(part) as out:
                    out.write(body)
                system.move(part, f"{place}/{r.image_id}{ending}")

    pictures.select("image_id", "lens", "png", "receipt").foreachPartition(run)
