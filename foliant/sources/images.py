"""Image files as packed images or pixels: PNG and JPEG by Spark's reader, or PNG bytes of any column by our codec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.constants import MAX_PIXELS
from foliant.sources import png

NOT_IMAGE = "That file is not a picture. Use a PNG or JPEG photo."
EMPTY = "No picture in the upload."


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            path, sha, error, h, w, n, data = (b.column(c)[i].as_py() for c in ("path", "sha256", "error", "height", "width", "channels", "data"))
            bands: list = [None] * 3
            if error is None:
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                px = px[..., :3][..., ::-1] if n >= 3 else np.repeat(px, 3, axis=2)  # the reader stores blue first
                bands = [px[..., k].ravel() / 255.0 for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([sha]), pa.array([error], pa.string()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), *(pa.array([x], pa.list_(pa.float64())) for x in bands)],
                names=["path", "sha256", "error", "height", "width", "r", "g", "b"],
            )


SCHEMA = "path string, sha256 string, error string, height int, width int, r array<double>, g array<double>, b array<double>"


def read_images(spark: SparkSession, path: str, most: int = MAX_PIXELS) -> DataFrame:
    """One row a file; ``error`` says why a file gave no pixels. Type is told by content, never by name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 8))
    raw = raw.select("path", F.sha2("content", 256).alias("sha256"), (F.startswith(head, F.lit("89504E470D0A1A0A")) | F.startswith(head, F.lit("FFD8FF"))).alias("known"))
    img = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    both = raw.join(img, F.regexp_replace("origin", "^file:/+", "file:/") == F.regexp_replace("path", "^file:/+", "file:/"), "left")
    size = F.col("height").cast("long") * F.col("width")
    error = F.when(~F.col("known") | F.col("height").isNull() | (F.col("height") <= 0), NOT_IMAGE).when(size > most, f"Over {most} pixels.")
    rows = both.select("path", "sha256", error.alias("error"), "height", "width", F.col("nChannels").alias("channels"), F.when(error.isNull(), F.col("data")).alias("data"))
    return rows.mapInArrow(_unpacked, SCHEMA)


def decode_png(df: DataFrame, content: str = "content", key: str = "image_id") -> DataFrame:
    """Packed images of a binary column of PNG files, with an error column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, error, px = b.column(content)[i].as_py(), None, None
                try:
                    px = png.decode(data) if data else None
                    error = None if data else EMPTY
                except ValueError as e:
                    error = str(e)
                bands = [None if px is None else px[..., k].ravel() for k in range(3)]
                h, w = px.shape[:2] if px is not None else (None, None)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(i, 1), pa.array([error], pa.string()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), *(pa.array([x], pa.list_(pa.float64())) for x in bands)], names=[key, "error", "height", "width", "r", "g", "b"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInArrow(run, f"{key} {kind}, error string, height int, width int, r array<double>, g array<double>, b array<double>")


def synthetic_page(spark: SparkSession, height: int = 96, width: int = 96, image_id: int = 0) -> DataFrame:
    """A deterministic page as pixels: paper with strokes, faint and coloured marks; later marks cover earlier ones."""
    # The paper, and in order of painting (rows, columns, share of the paper, colour, least height, least width).
    paper = (0.93, 0.88, 0.76)
    marks = (
        ((42, 50), (8, width - 8), 0.0, (0.12, 0.09, 0.06), 0, 0),
        ((18, 22), (12, width // 2), 0.0, (0.16, 0.12, 0.08), 0, 0),
        ((62, 67), (10, width - 12), 0.78, (0.10, 0.72, 0.62), 0, 0),
        ((24, 30), (20, width - 18), 0.0, (0.78, 0.08, 0.42), 0, 0),
        ((74, 79), (14, width - 14), 0.70, (0.58, 0.36, 0.16), 80, 28),
    )
    groove, depth = ((84, 86), (8, width - 8), 88, 16), 0.88
    inside = lambda ys, xs: F.col("y").between(ys[0], ys[1] - 1) & F.col("x").between(xs[0], xs[1] - 1)
    px = spark.range(height * width).select(F.lit(image_id).cast("long").alias("image_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    bands = {c: F.lit(v) for c, v in zip("rgb", paper, strict=True)}
    for ys, xs, share, color, least_h, least_w in marks:
        if height >= least_h and width >= least_w:
            bands = {c: F.when(inside(ys, xs), share * v + (1 - share) * k).otherwise(bands[c]) for c, v, k in zip("rgb", paper, color, strict=True)}
    if height >= groove[2] and width >= groove[3]:
        bands = {c: F.when(inside(*groove[:2]), e * depth).otherwise(e) for c, e in bands.items()}
    return px.select("*", *(e.alias(c) for c, e in bands.items()))
