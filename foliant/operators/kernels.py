"""Array kernels for whole images: blur, distance, components, and the full-profile lenses.

These have sequential dependencies or large neighbourhoods that relations express badly. Each runs on one packed
image (image_id, height, width, r, g, b arrays) in an Arrow batch; images are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.constants import EPS, LUMA, MODES, PAPERS, WEIGHTS, paint

PACKED = "image_id long, height int, width int, r array<double>, g array<double>, b array<double>"
SQRT2 = 1.414  # the distance's diagonal step
MOST, LEAST_AREA = 48, 8


# ---------------------------------------------------------------- arrays


def clip(x):
    return np.clip(x, 0.0, 1.0)


def finite(x: np.ndarray) -> np.ndarray:
    return clip(np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=0.0))


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array(LUMA)


def normal(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return (x - lo) / (hi - lo) if hi - lo >= EPS else np.zeros_like(x)


def blur(gray: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian by three extended box passes (Gwosdek and others, 2011), on bytes, edges repeated."""
    var = radius * radius / 3
    half = int((np.sqrt(12 * var + 1) - 1) // 2)
    part = (2 * half + 1) * (half * (half + 1) - 3 * var) / (6 * (var - (half + 1) ** 2))
    x = np.rint(clip(gray) * 255)
    for axis in (0, 1):
        x = np.moveaxis(x, axis, -1)
        n = x.shape[-1]
        for _ in range(3):
            wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half + 1, half + 1)], mode="edge")
            total = np.concatenate([np.zeros((*wide.shape[:-1], 1)), np.cumsum(wide, -1)], -1)
            inner = total[..., 2 * half + 2 : 2 * half + 2 + n] - total[..., 1 : 1 + n]
            x = (inner + part * (wide[..., :n] + wide[..., 2 * half + 2 : 2 * half + 2 + n])) / (2 * half + 1 + 2 * part)
        x = np.moveaxis(x, -1, axis)
    return np.rint(np.clip(x, 0, 255)) / 255


def unsharp(g: np.ndarray, amount: float = 0.7, radius: float = 1.2) -> np.ndarray:
    return clip(g + amount * (g - blur(g, radius)))


def equalize(g: np.ndarray) -> np.ndarray:
    g = clip(g)
    share = np.cumsum(np.bincount(np.minimum((g * 256).astype(int), 255).ravel(), minlength=256)) / g.size
    return share[np.minimum((g * 255).astype(int), 255)]


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = np.moveaxis(rgb, -1, 0)
    v = rgb.max(-1)
    d = v - rgb.min(-1)
    safe = np.maximum(d, EPS)
    h = np.select([d <= EPS, v == r, v == g], [0.0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4)
    return h * 60, np.where(v > EPS, d / np.maximum(v, EPS), 0.0), v


def from_hsv(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each band falls linearly with the hue's distance from it."""
    k = (np.array([5.0, 3.0, 1.0]) + h[..., None] / 60) % 6
    return clip(v[..., None] - (v * s)[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


def hue_weight(h: np.ndarray, at: float, sigma: float) -> np.ndarray:
    d = np.abs(h - at)
    return np.exp(-0.5 * (np.minimum(d, 360 - d) / sigma) ** 2)


def gray3(g: np.ndarray) -> np.ndarray:
    return np.repeat(g[..., None], 3, axis=-1)


def tinted(g: np.ndarray, color: tuple, amount: float = 0.28) -> np.ndarray:
    return clip(g[..., None] * ((1 - amount) + amount * np.array(color) * 1.6))


def parchment(rgb: np.ndarray) -> np.ndarray:
    l = luma(rgb)
    return rgb[l >= np.quantile(l, 0.8)].mean(0)


def relief(rgb: np.ndarray, radius: float) -> np.ndarray:
    l = luma(rgb)
    return l - blur(l, radius)


def capped(rgb: np.ndarray, side: int) -> tuple[np.ndarray, float]:
    """Bilinear reduction to a longest side."""
    h, w, _ = rgb.shape
    scale = min(1.0, side / max(h, w))
    if scale == 1.0:
        return rgb, scale
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))

    def taps(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = at.astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = taps(h, nh)
    x0, x1, fx = taps(w, nw)
    rows = rgb[y0] * (1 - fy)[:, None, None] + rgb[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None], scale


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance of set pixels to the nearest clear one: steps 1 and SQRT2, down-right, then up-left; the outside is not clear."""
    far = float(mask.size + sum(mask.shape))
    d = np.where(mask, far, 0.0)
    for _ in range(2):
        x = np.arange(d.shape[1])
        for y in range(len(d)):
            row = d[y]
            if y:
                row = np.minimum(row, d[y - 1] + 1)
                row[1:] = np.minimum(row[1:], d[y - 1][:-1] + SQRT2)
            d[y] = np.minimum.accumulate(row - x) + x  # each pixel from its left neighbour, plus 1
        d = d[::-1, ::-1].copy()
    return d


def components(mask: np.ndarray, most: int = MOST) -> list[dict]:
    """8-connected groups of at least LEAST_AREA pixels, from runs of rows joined by a forest.

    In scan order until there are ``most`` (the rest is left out); otherwise by centre.
    """
    root: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            root.append(k)
            here.append(k)
            for j in above:
                if runs[j][1] <= b and a <= runs[j][2]:
                    i, m = sorted((find(j), find(k)))
                    root[m] = i
        above = here
    groups: dict[int, list[int]] = {}
    for k in range(len(runs)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for members in groups.values():  # by first run: scan order
        y, a, b = np.array([runs[k] for k in members]).T
        n = b - a
        area = int(n.sum())
        if area < LEAST_AREA:
            continue
        w, h = int(b.max() - a.min()), int(y.max() - y.min() + 1)
        out.append({"x0": int(a.min()), "y0": int(y.min()), "x1": int(b.max() - 1), "y1": int(y.max()), "area": area, "cx": float(((a + b - 1) / 2 * n).sum() / area), "cy": float((y * n).sum() / area), "aspect": w / max(1, h)})
        if len(out) == most:
            return out
    return sorted(out, key=lambda c: (c["cx"], c["cy"]))


# ---------------------------------------------------------------- full-profile lenses


def _zero(rgb):
    g = equalize(luma(rgb))
    band = clip(0.5 + (blur(g, 0.8) - blur(g, 7)) * 1.35)
    return gray3(unsharp(clip(0.55 * g + 0.45 * band), 0.85, 1.0))


def _tazel(rgb, inject=True):
    h, s, v = hsv(rgb)
    w = hue_weight(h, 170, 24)
    s, v = clip(s * (1 + 0.65 * w) + 0.10 * w), clip(v * (1 + 0.28 * w) + 0.06 * w)
    v = unsharp(clip(v + 0.16 * 4 * v * (1 - v)), 0.55, 0.8)
    low = blur(v, 11)
    v = clip(low * 0.88 + 0.06 + 1.55 * (v - low))
    plain = from_hsv(h, s, v)
    if not inject:
        return plain
    return clip(plain * (1 - 0.18 * w)[..., None] + np.array(paint("tazel")) * (v * 0.18 * w)[..., None])


def _vyrn(rgb, inject=True):
    h, s, v = hsv(rgb)
    w, cyan = hue_weight(h, 350, 28), hue_weight(h, 160, 32)
    s, v = clip(s * (1 + 0.7 * w) * (1 - 0.55 * cyan) + 0.08 * w), clip(v * (1 + 0.22 * w) * (1 - 0.18 * cyan))
    v = unsharp(v, 0.95, 0.9)
    low = blur(v, 10)
    v = clip(1.45 * (v - low) + 0.42 + 0.25 * v)
    plain = from_hsv(h, s, v)
    if not inject:
        return plain
    out = clip(plain * (1 - 0.22 * w)[..., None] + np.array(paint("vyrn")) * (v * 0.22 * w)[..., None])
    out[..., 1] = clip(out[..., 1] * (1 - 0.25 * cyan))
    return out


def _uv(rgb):
    l = luma(rgb)
    t, hp = normal(l), l - blur(l, 1.15)
    glow = clip(clip(1.18 * t**0.72) * (1 - 0.42 * (1 - t)) + 0.9 * hp)
    bands = clip(np.stack([0.70 * glow + 0.04, 0.62 * glow + 0.03, 1.18 * glow + 0.35 * hp], -1))
    return bands * (1 - 0.35 * (t < 0.42))[..., None]


def _candle(rgb):
    t = normal(luma(rgb))
    flame = np.linspace(1, 0.58, rgb.shape[1])[None]
    glow, ink = clip(t**0.82 * (0.78 + 0.28 * flame)), clip((0.44 - t) / 0.44)[..., None]
    lit = clip(rgb * np.array([0.42, 0.40, 0.22]) + glow[..., None] * np.array([1.16, 0.70, 0.26]) + np.array([0.05, 0.02, 0.0]))
    return clip(lit * (1 - 0.40 * ink) + rgb * 0.28 * ink)


def _indent(rgb):
    l = luma(rgb)
    ink = (0.84 * clip((0.52 - normal(l)) / 0.52))[..., None]
    washed = rgb * (1 - ink) + parchment(rgb) * ink
    rel = normal(np.abs(blur(l, 0.7) - blur(l, 5.5)))
    mix = unsharp(clip(0.58 * luma(washed) + 0.62 * rel + 0.90 * (l - blur(l, 1.3)) + 0.16), 0.78, 0.9)
    return clip(0.42 * washed + 0.58 * mix[..., None])


def _lemon(rgb):
    h, s, v = hsv(rgb)
    gain = clip(0.65 * hue_weight(h, 36, 22) + 0.35 * hue_weight(h, 28, 30)) * clip(1.85 * s) * clip(1 - np.abs(v - 0.42) / 0.45)
    s = clip(s * (1 + 0.58 * gain) + 0.04 * gain)
    v = unsharp(clip(v * (1 + 0.10 * gain) - 0.07 * gain), 0.42, 1.0)
    return clip(from_hsv(h, s, v) * (1 - 0.22 * gain)[..., None] + np.array(paint("lemon")) * (v * 0.22 * gain)[..., None])


SIMPLE = {"zero": _zero, "tazel": _tazel, "vyrn": _vyrn, "uv": _uv, "candle": _candle, "indent": _indent, "lemon": _lemon}


def lens(rgb: np.ndarray, mode: str, inject: bool = True) -> np.ndarray:
    """One full-profile lens over [h, w, 3]; the base channels of composites are computed once."""
    rgb = finite(rgb)
    if mode in SIMPLE:
        out = SIMPLE[mode](rgb, inject) if mode in ("tazel", "vyrn") else SIMPLE[mode](rgb)  # these tint last
        return out if inject or mode == "zero" else gray3(luma(out))
    ch = {n: normal(luma(SIMPLE[n](rgb))) for n in ("zero", "tazel", "vyrn", "uv")}
    mix = lambda n: clip(sum(w * ch[k] for k, w in WEIGHTS[n].items()))
    show = lambda n: tinted(mix(n), paint(n)) if inject else gray3(mix(n))
    if mode in WEIGHTS:
        return show(mode)
    if mode != "balance":
        raise ValueError(f"unknown mode {mode!r}")
    zen, chaos = show("zen"), show("chaos")
    z, c = normal(luma(zen)), normal(luma(chaos))
    a = ((1 + (z - c) / (z + c + EPS)) / 2)[..., None]
    out = clip(a * zen + (1 - a) * chaos)
    return out if inject else gray3(luma(out))


def target(rgb: np.ndarray, to: str = "ink") -> np.ndarray:
    t, base = normal(luma(rgb)), parchment(rgb)
    if to == "page":
        k = (0.72 * clip((0.50 - t) / 0.50))[..., None]
        return clip(rgb * (1 - k) + base * k + 0.35 * relief(rgb, 1.4)[..., None])
    k = (0.50 * clip((t - 0.38) / 0.40))[..., None]
    return clip((rgb * (1 - k) + base * k) * (1 - 0.28 * (t < 0.48))[..., None])


def residual_enhance(rgb: np.ndarray) -> np.ndarray:
    return gray3(unsharp(equalize(luma(finite(rgb))), 0.9, 1.0))


def ink_mask(rgb: np.ndarray) -> np.ndarray:
    """Dark pixels with at least two dark neighbours."""
    l = luma(finite(rgb))
    ink = l < max(0.08, float(np.percentile(l, 88)) - 0.16)
    wide = np.pad(ink.astype(int), 1)
    h, w = ink.shape
    near = sum(wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    return ink & (near >= 2)


# ---------------------------------------------------------------- DataFrames


def packed(px: DataFrame) -> DataFrame:
    """Packed images of a pixel relation; a last row that is not full is filled up with its last pixel.

    ``pixels`` tells how many pixels there were; unpacked() leaves out the others.
    """
    rows = px.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"), (F.max("x") + 1).alias("width"))
    rows = rows.withColumn("height", F.ceil(F.size("p") / F.col("width")).cast("int"))
    lack = (F.col("height") * F.col("width") - F.size("p")).cast("int")
    full = F.concat("p", F.array_repeat(F.element_at("p", -1), lack))
    return rows.select("image_id", "height", F.col("width").cast("int").alias("width"), full.alias("c"), F.size("p").alias("pixels")).select(
        "image_id", "height", "width", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"), "pixels"
    )


def unpacked(images: DataFrame) -> DataFrame:
    """The pixel relation of packed images."""
    e = _counted(images).select("image_id", "width", "pixels", F.posexplode(F.arrays_zip("r", "g", "b")).alias("k", "p"))
    return e.where("k < pixels").select("image_id", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).alias("x"), "p.r", "p.g", "p.b")


def _counted(images: DataFrame) -> DataFrame:
    """``images`` with their numbers of pixels; all that are there, if no column tells."""
    return images if "pixels" in images.columns else images.withColumn("pixels", F.col("height") * F.col("width"))


def _image(b: pa.RecordBatch, i: int) -> np.ndarray:
    h, w = b.column("height")[i].as_py(), b.column("width")[i].as_py()
    return np.stack([b.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(h, w) for c in "rgb"], -1)


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` over every packed image, [h, w, 3] to [h, w, 3]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # images may be large: one row a batch
                out = kernel(_image(b, i))
                bands = [pa.array([out[..., k].ravel()], pa.list_(pa.float64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([b.column("image_id").slice(i, 1), pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), *bands, b.column("pixels").slice(i, 1)], names=["image_id", "height", "width", "r", "g", "b", "pixels"])

    return _counted(images).select("image_id", "height", "width", "r", "g", "b", "pixels").mapInArrow(run, PACKED + ", pixels int")


def full_lens(images: DataFrame, mode: str, inject: bool = True) -> DataFrame:
    return per_image(images, partial(lens, mode=mode, inject=inject))


def full_target(images: DataFrame, to: str = "ink") -> DataFrame:
    return per_image(images, partial(target, to=to))


def strokes(images: DataFrame, side: int = 640) -> DataFrame:
    """Ink components and the stroke width statistics of each packed image, capped to a longest side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                ink = ink_mask(capped(finite(_image(b, i)), side)[0])
                wide = 2 * chamfer(ink)[ink]
                head = {"image_id": b.column("image_id")[i].as_py(), "ink_pixels": int(ink.sum()), "width_mean": float(wide.mean()) if wide.size else 0.0, "width_std": float(wide.std()) if wide.size else 0.0}
                found = components(ink)
                out += [head | c | {"seq": k, "components": len(found)} for k, c in enumerate(found)] or [head | {"seq": None, "components": 0}]
            names = [f.split(" ")[0] for f in STROKES.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds[f.split(" ")[1]]) for n, f in zip(names, STROKES.split(", "), strict=True)], names=names)

    return images.select("image_id", "height", "width", "r", "g", "b").mapInArrow(run, STROKES)


STROKES = "image_id long, ink_pixels int, width_mean double, width_std double, components int, seq int, x0 int, y0 int, x1 int, y1 int, area int, cx double, cy double, aspect double"


def encoded(images: DataFrame) -> DataFrame:
    """image_id, png and its SHA-256."""
    from foliant.sources import png

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column("image_id").slice(i, 1), pa.array([png.encode(_image(b, i))], pa.binary())], names=["image_id", "png"])

    return images.select("image_id", "height", "width", "r", "g", "b").mapInArrow(run, "image_id long, png binary").withColumn("sha256", F.sha2("png", 256))


def batch(images: DataFrame, modes: tuple[str, ...] = tuple(MODES), to: str = "ink", inject: bool = True) -> DataFrame:
    """(image_id, lens, png, sha256, receipt): every image through every mode to a target, one picture after another.

    The receipt is JSON: lens, target, paper, inject flags, size and digest. Each image is read once for all modes.
    """
    from foliant.sources import png

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rgb, ids = _image(b, i), b.column("image_id").slice(i, 1)
                for m in modes:
                    out = target(lens(rgb, m, inject), to)
                    columns = [ids, pa.array([m]), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[0]], pa.int32()), pa.array([png.encode(out)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["image_id", "lens", "width", "height", "png"])

    papers = F.create_map(*(F.lit(x) for m in modes for x in (m, PAPERS[m])))
    applied = F.lit(inject) & (F.col("lens") != "zero")
    done = images.select("image_id", "height", "width", "r", "g", "b").mapInArrow(run, "image_id long, lens string, width int, height int, png binary").withColumn("sha256", F.sha2("png", 256))
    fields = ("lens", F.lit(to).alias("target"), papers[F.col("lens")].alias("paper"), F.lit(inject).alias("inject"), applied.alias("inject_applied"), (F.lit(inject) & ~applied).alias("inject_ignored"), "width", "height", "sha256", F.lit(False).alias("invented"))
    return done.select("image_id", "lens", "png", "sha256", F.to_json(F.struct(*fields)).alias("receipt"))
