"""Pixel, lens, pigment, cover and ink operators on hand-made pages."""

import random

import numpy as np
import pytest

from foliant.constants import MODES, PIGMENT_GONE
from foliant.operators import cover, ink, kernels, lens, neighbour, pigment, reduce
from foliant.sources import images, png

CREAM = (0.93, 0.88, 0.76)
PX = "image_id long, y int, x int, r double, g double, b double"


def page(spark, a: np.ndarray, image_id: int = 0):
    h, w, _ = a.shape
    return spark.createDataFrame([(image_id, y, x, *map(float, a[y, x])) for y in range(h) for x in range(w)], PX)


def flat(h, w, color=CREAM):
    return np.tile(np.array(color, float), (h, w, 1))


def gray(spark, l: np.ndarray):
    return spark.createDataFrame([(0, y, x, float(l[y, x])) for y in range(l.shape[0]) for x in range(l.shape[1])], "image_id long, y int, x int, l double")


@pytest.fixture(scope="module")
def synthetic(spark):
    return images.synthetic_page(spark).cache()


def test_lenses_stay_in_range_and_off_is_gray(spark, synthetic):
    bad = flat(4, 4)
    bad[0, 0, 0], bad[1, 1, 1], bad[2, 2, 2] = np.nan, np.inf, -np.inf
    for src in (synthetic, page(spark, bad)):
        for m in MODES:
            on = lens.overlay(src, (m,), "ink", True).selectExpr("min(least(r,g,b)) lo", "max(greatest(r,g,b)) hi", "count(*) n", "count(r) k").first()
            assert 0 <= on.lo and on.hi <= 1 and on.n == on.k
    for m in MODES:
        assert reduce.is_achromatic(lens.apply_mode(synthetic, m, False)).first().achromatic


def one_by_one(rgb, mode, inject=True):
    """The published formulas of four lenses, one pixel at a time, over blurs that are given."""
    h, w = rgb.shape[:2]
    lum = [[sum(c * k for c, k in zip(p, (0.2126, 0.7152, 0.0722), strict=True)) for p in row] for row in rgb.tolist()]
    lo, hi = min(map(min, lum)), max(map(max, lum))
    clip = lambda v: min(1.0, max(0.0, v))
    out = np.zeros_like(rgb)
    near = kernels.blur(np.array(lum), 1.15)
    for y in range(h):
        for x in range(w):
            p, l = rgb[y, x], lum[y][x]
            t = (l - lo) / (hi - lo)
            if mode == "uv":
                hp = l - near[y, x]
                glow = clip(clip(1.18 * t**0.72) * (1 - 0.42 * (1 - t)) + 0.9 * hp)
                dark = 0.65 if t < 0.42 else 1.0
                out[y, x] = [clip(glow * 0.70 + 0.04) * dark, clip(glow * 0.62 + 0.03) * dark, clip(glow * 1.18 + 0.35 * hp) * dark]
            else:
                flame = 1 - 0.42 * x / (w - 1)
                glow, ink = clip(t**0.82 * (0.78 + 0.28 * flame)), clip((0.44 - t) / 0.44)
                for k, (own, amber, more) in enumerate(((0.42, 1.16, 0.05), (0.40, 0.70, 0.02), (0.22, 0.26, 0.0))):
                    out[y, x, k] = clip(clip(p[k] * own + glow * amber + more) * (1 - 0.40 * ink) + p[k] * 0.28 * ink)
    return out


@pytest.mark.parametrize("mode", ["uv", "candle"])
def test_full_lenses_follow_the_formulas(mode):
    rgb = np.random.default_rng(3).random((24, 24, 3))
    assert np.allclose(kernels.lens(rgb, mode), one_by_one(rgb, mode), atol=1e-9)


def test_gray_of_tinting_lenses_is_taken_before_the_tint():
    rgb = np.random.default_rng(4).random((12, 12, 3))
    rgb[:6] = [0.1, 0.8, 0.65]  # in the band of tazel
    rgb[6:9] = [0.75, 0.0, 0.4]  # in the band of vyrn
    for mode, fn in (("tazel", kernels._tazel), ("vyrn", kernels._vyrn)):
        plain, tinted = fn(rgb, False), fn(rgb, True)
        assert np.abs(plain - tinted).max() > 0.02
        assert np.allclose(kernels.lens(rgb, mode, inject=False), kernels.gray3(kernels.luma(plain)), atol=1e-12)


def test_no_pixel_of_a_short_last_row_is_lost(spark):
    src = page(spark, np.random.default_rng(5).random((5, 4, 3))).where("not (y = 4 and x > 1)")
    back = kernels.unpacked(kernels.full_lens(kernels.packed(src), "candle"))
    assert {(r.y, r.x) for r in back.collect()} == {(r.y, r.x) for r in src.collect()} and back.count() == 18


def test_solid_hues_are_in_band(spark):
    got = {c: reduce.gate_inband(page(spark, flat(4, 4, tuple(int(c[i : i + 2], 16) / 255 for i in (0, 2, 4))))).first() for c in ("1EC9A5", "C00066")}
    assert got["1EC9A5"].tazel_inband_pct == 100.0 and got["C00066"].vyrn_inband_pct == 100.0


def test_centre_of_mass(spark):
    a = np.zeros((20, 30, 3))
    assert tuple(reduce.center_of_mass(page(spark, a)).select("com_x", "com_y").first()) == (15.0, 10.0)
    a[:4, :4] = 1
    assert tuple(reduce.center_of_mass(page(spark, a)).select("com_x", "com_y").first()) == (1.5, 1.5)


def test_kernels_against_brute_force(spark):
    rng = np.random.default_rng(0)
    g = rng.random((12, 9))
    eq = {(r.y, r.x): r.g for r in reduce.equalized(page(spark, np.repeat(g[..., None], 3, 2))).collect()}
    assert np.allclose([[eq[y, x] for x in range(9)] for y in range(12)], kernels.equalize(g), atol=1e-9)
    for k in range(20):
        mask = rng.random((20, 25)) < 0.55
        seen, want = np.zeros(mask.shape, bool), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            if not seen[y, x]:
                stack, cells = [(y, x)], []
                seen[y, x] = True
                while stack:
                    a, b = stack.pop()
                    cells.append((a, b))
                    for u in range(max(0, a - 1), min(20, a + 2)):
                        for v in range(max(0, b - 1), min(25, b + 2)):
                            if mask[u, v] and not seen[u, v]:
                                seen[u, v] = True
                                stack.append((u, v))
                if len(cells) >= 8:
                    want.append((len(cells), round(np.mean([c[1] for c in cells]), 6)))
        assert sorted((c["area"], round(c["cx"], 6)) for c in kernels.components(mask)) == sorted(want)
    h, s, v = kernels.hsv(rng.random((50, 3)))
    a = rng.random((50, 3))
    assert np.allclose(kernels.from_hsv(*kernels.hsv(a)), a)
    b = kernels.blur(np.pad(np.ones((1, 1)), 20), 3.0)
    assert abs(b.sum() - 1) < 0.6 and b[20, 20] == b.max() and np.allclose(b, b.T)
    assert np.all(kernels.blur(np.full((8, 8), 0.5), 5) == 128 / 255)


def test_png_files(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (7, 5, 3)) / 255
    data = png.encode(a)
    assert np.allclose(png.decode(data), a) and png.end(data) == len(data)
    import struct
    import zlib

    def file(color, rows, extra=b""):
        part = lambda k, p: struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p))
        return png.MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, color, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")

    raw = rng.integers(0, 256, (5, 3, 4), dtype=np.uint8)

    def filtered(px, n):
        out, above = b"", np.zeros(3 * n, np.uint8)
        for y, row in enumerate(px.reshape(5, -1)):
            left = np.concatenate([np.zeros(n, np.uint8), row[:-n]])
            corner = np.concatenate([np.zeros(n, np.uint8), above[:-n]])
            p = left.astype(int) + above - corner
            d = np.abs(np.stack([p - left, p - above, p - corner]))
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
            guess = [0, left, above, (left.astype(int) + above) // 2, paeth][y]
            out += bytes([y]) + (row.astype(int) - guess).astype(np.uint8).tobytes()
            above = row
        return out

    assert np.allclose(png.decode(file(6, filtered(raw, 4))), raw[..., :3] / 255)
    assert np.allclose(png.decode(file(2, filtered(raw[..., :3], 3))), raw[..., :3] / 255)
    assert np.allclose(png.decode(file(0, filtered(raw[..., :1], 1))), np.repeat(raw[..., :1], 3, 2) / 255)
    d = spark.createDataFrame([(0, bytearray(data)), (1, bytearray(b"")), (2, bytearray(b"junk")), (3, bytearray(data[:40])), (4, None)], "image_id long, content binary")
    errors = {r.image_id: r.error for r in images.decode_png(d).collect()}
    assert errors[0] is None and errors[1] == errors[4] == images.EMPTY and errors[2] and errors[3]


def test_read_images_by_content(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(png.encode(flat(6, 4)))
    (tmp_path / "b.png").write_bytes(b"not-an-image")
    got = {r.path[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got["a.bin"].error is None and (got["a.bin"].height, got["a.bin"].width) == (6, 4) and abs(got["a.bin"].r[0] - 237 / 255) < 1e-9
    assert got["b.png"].error == images.NOT_IMAGE and got["b.png"].r is None
    small = images.read_images(spark, str(tmp_path), 10).where("path like '%a.bin'").first()
    assert small.error and small.r is None


def test_pigment_restores_and_refuses(spark):
    blank = pigment.pigment_decision(page(spark, flat(32, 32))).first()
    assert not blank.recovered and blank.refuse_code == PIGMENT_GONE and blank.changed_pixels == 0
    a = flat(64, 64)
    a[20:36, 12:48] = 0.72 * np.array(CREAM) + 0.28 * np.array((0.45, 0.62, 0.28))
    ok = pigment.pigment_decision(page(spark, a)).first()
    assert ok.recovered and ok.evidence_pixels >= 24 and ok.refuse_code is None
    assert not pigment.pigment_decision(page(spark, a), "refuse").first().recovered
    b = flat(48, 48)
    b[16:28, 8:40] = (0.08, 0.06, 0.05)
    inked = pigment.pigment_decision(page(spark, b)).first()
    assert not inked.recovered and inked.visible_ink_pixels > 0


def test_covers(spark):
    a = flat(32, 48, (0.93,) * 3)
    a[8:24, 6:42] = 0
    got = cover.classify_cover(page(spark, a)).first()
    assert got.opaque_replace and got.flattened_screenshot_replace and (got.x0, got.y0, got.x1, got.y1) == (6, 8, 42, 24)
    b = flat(32, 48, (0.90,) * 3)
    for x in range(6, 42):
        b[8:24, x] = 0.18 + 0.22 * ((x % 9) / 9)
    soft = cover.classify_cover(page(spark, b)).first()
    assert soft.residual_usable and not soft.opaque_replace
    assert not cover.classify_cover(page(spark, flat(8, 8))).first().opaque_replace


def test_ink(spark):
    def strokes(half, dark):
        l = np.full((64, 96), 0.92)
        l[20 - half : 20 + half, 10:80] = dark
        l[44 - half : 44 + half, 10:80] = dark
        return l

    heavy, light = (ink.ink_features(gray(spark, strokes(*a))).first() for a in ((4, 0.08), (1, 0.42)))
    assert heavy.weight_mean > light.weight_mean and heavy.density > light.density and heavy.refuse_code is None
    assert ink.ink_features(gray(spark, np.full((64, 96), 0.92))).first().refuse_code == "SL-HANDWRITING-NO-INK"
    rng = np.random.default_rng(3)
    l = np.full((80, 120), 0.92)
    patch = rng.random((8, 8)) * 0.5
    l[8:16, 8:16] = patch
    l[40:48, 72:80] = patch
    pairs = {(r.y0, r.x0, r.y1, r.x1) for r in neighbour.clone_tiles(gray(spark, l), 16, 10_000, False).collect()}
    assert (8, 8, 40, 72) in pairs
    white = strokes(4, 0.1)
    white[24:42, 36:62] = 0.995
    assert ink.ink_features(gray(spark, white)).first().bright_frac > 0


def test_neighbourhoods_against_numpy(spark):
    rng = np.random.default_rng(4)
    l = rng.random((9, 11))
    pad = np.pad(l, 1, mode="edge")
    at = lambda dy, dx: pad[1 + dy : 10 + dy, 1 + dx : 12 + dx]
    gx = sum(w * at(*k) for k, w in neighbour.SOBEL_X.items())
    got = {(r.y, r.x): r for r in neighbour.sobel_gradient(gray(spark, l)).collect()}
    assert all(abs(got[y, x].gx - gx[y, x]) < 1e-9 for y in range(9) for x in range(11))
    mask = rng.random((9, 11)) < 0.6
    m = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "image_id long, y int, x int")
    wide = {(r.y, r.x): r.width for r in neighbour.stroke_width(m).collect()}
    for (y, x), w in wide.items():
        best = 8
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            d = 1
            while d < best and 0 <= y + dy * d < 9 and 0 <= x + dx * d < 11 and mask[y + dy * d, x + dx * d]:
                d += 1
            best = min(best, d)
        assert w == 2 * best
    random.seed(0)


def test_batch_writes_every_mode_beside_its_receipt(spark, tmp_path):
    import hashlib
    import json

    from foliant.sources import png

    rgb = np.random.default_rng(3).random((5, 7, 3))
    done = kernels.batch(kernels.packed(page(spark, rgb)), to="page")
    assert sorted(r.lens for r in done.select("lens").collect()) == sorted(MODES)
    for _ in range(2):  # files are replaced
        png.save(done, str(tmp_path))
    for m in MODES:
        assert sorted(f.name for f in (tmp_path / m).iterdir() if not f.name.startswith(".")) == ["0.json", "0.png"]
        body, text = (tmp_path / m / "0.png").read_bytes(), (tmp_path / m / "0.json").read_text()
        want = png.quantized(kernels.target(kernels.lens(rgb, m), "page"))
        assert (np.rint(png.decode(body) * 255) == want).all()
        receipt = json.loads(text)
        assert text.endswith("}\n") and receipt["sha256"] == hashlib.sha256(body).hexdigest()
        assert (receipt["lens"], receipt["target"], receipt["width"], receipt["height"], receipt["inject_ignored"]) == (m, "page", 7, 5, m == "zero")


def test_ink_features_shuffle_pixels_by_image_only(spark):
    """Every exchange of pixels is by image: places are looked up in windows."""
    px = spark.createDataFrame([(1, 0, 0, 0.1)], "image_id long, y int, x int, l double")
    plan = ink.ink_features(px)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and not [line for line in joins if "y#" in line and "x#" in line]


def test_ink_features_of_small_and_torn_images(spark):
    """One row, one column, missing pixels and an image without ink, against the plan of joins in DuckDB."""
    from foliant.plans.sql import DUCK, SPARK, Plan

    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    rows = [(i, y, x, float(rng.choice([0.05, 0.3, 0.6, 0.7, 0.9, 0.99]))) for i, (h, w) in enumerate([(1, 9), (9, 1), (24, 24), (17, 30), (2, 2)]) for y in range(h) for x in range(w) if i != 3 or rng.random() < 0.8]
    rows += [(9, y, x, 0.9) for y in range(8) for x in range(8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE src (image_id BIGINT, y INT, x INT, l DOUBLE)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?, ?)", rows)
    p = Plan(DUCK)
    want = con.execute(p.text(ink.features(p, "src"))).fetchall()
    p = Plan(SPARK)
    got = p.frame(spark, ink.features(p, "src"), src=spark.createDataFrame(rows, "image_id long, y int, x int, l double")).collect()
    assert len(got) == len(want) == 6
    for a, b in zip(sorted(got), sorted(want), strict=True):
        for c, u, v in zip(got[0].__fields__, a, b, strict=True):
            assert u == v or (isinstance(u, float) and abs(u - v) < 1e-9), (a[0], c, u, v)
