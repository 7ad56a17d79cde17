"""Ink on paper, preview profile: stroke, density, bleed, tremor, drift, erasure and copy features of gray images.

Input is a gray relation (image_id, y, x, l). Every finding is a pixel heuristic; nothing here identifies a writer.
"""

from __future__ import annotations

from foliant.constants import NO_INK
from foliant.operators import neighbour as nb
from foliant.plans.sql import Plan, as_frame

MIN_INK = 0.004
#: Places of an image in one order: rows are this far apart.
STRIDE = 1 << 32


def mask(p: Plan, src: str, interpolated: bool = False) -> str:
    """(image_id, y, x) of ink: darker than the paper (the .88 quantile) by .16, and than .08 at least."""
    if interpolated:
        q = p.add("paper", f"SELECT image_id, {p.d.pct('l', 0.88)} AS paper FROM {src} GROUP BY image_id")
    else:
        k = p.add("rank", f"SELECT image_id, l, row_number() OVER (PARTITION BY image_id ORDER BY l) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM {src}")
        q = p.add("paper", f"SELECT image_id, l AS paper FROM {k} WHERE k = least(floor(n * 0.88e0) + 1, n)")
    return p.add("ink", f"SELECT s.image_id AS image_id, y, x, l, paper FROM {src} s JOIN {q} q ON s.image_id = q.image_id WHERE l < greatest(0.08e0, paper - 0.16e0)")


def _hood(p: Plan, src: str) -> str:
    """src with the image's size and paper, is_ink, 3 x 3 mean m, Sobel gx, gy, mag and beside (ink among four neighbours).

    Windows over places in one order an image, so that pixels are shuffled by image only; a missing place adds nothing.
    """
    a = p.add("at", f"SELECT image_id, y, x, l, CAST(y AS BIGINT) * {STRIDE} + x AS pos, max(y) OVER (PARTITION BY image_id) AS y1, max(x) OVER (PARTITION BY image_id) AS x1, count(*) OVER (PARTITION BY image_id) AS n FROM {src}")
    k = p.add("rank", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l) AS k FROM {a}")
    q = p.add("paper", f"SELECT *, max(CASE WHEN k = least(floor(n * 0.88e0) + 1, n) THEN l END) OVER (PARTITION BY image_id) AS paper FROM {k}")
    i = p.add("isink", f"SELECT image_id, y, x, l, pos, y1, x1, n, paper, coalesce(l < greatest(0.08e0, paper - 0.16e0), false) AS is_ink FROM {q}")

    def seen(what: str, dy: int, dx: int) -> str:
        to = dy * STRIDE + dx
        side = f"{abs(to)} {'PRECEDING' if to < 0 else 'FOLLOWING'}"
        return f"max({what}) OVER (PARTITION BY image_id ORDER BY pos RANGE BETWEEN {side} AND {side})"

    name = lambda dy, dx: f"l{dy + 1}{dx + 1}"
    around = [d for d in nb.RING if d != (0, 0)]
    beside = " OR ".join(f"coalesce({seen('is_ink', *d)}, false)" for d in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    h = p.add("hood", f"SELECT *, l AS l11, {', '.join(f'{seen("l", *d)} AS {name(*d)}' for d in around)}, {beside} AS beside FROM {i}")

    def inside(dy: int, dx: int) -> str:
        """The neighbour, or what is next to it on the border."""
        if not dy and not dx:
            return "l11"
        out = " ".join(f"WHEN {' AND '.join(t for t in (v, w) if t)} THEN {name(0 if v else dy, 0 if w else dx)}" for v, w in (
            (f"y = {'y1' if dy > 0 else 0}" if dy else "", f"x = {'x1' if dx > 0 else 0}" if dx else ""), (f"y = {'y1' if dy > 0 else 0}" if dy else "", ""), ("", f"x = {'x1' if dx > 0 else 0}" if dx else ""),
        ) if v or w)
        return f"(CASE {out} ELSE {name(dy, dx)} END)"

    slope = lambda kernel: " + ".join(f"coalesce({inside(*d)} * {w}e0, 0e0)" for d, w in kernel.items())
    total, number = " + ".join(f"coalesce({name(*d)}, 0e0)" for d in nb.RING), " + ".join(f"CASE WHEN {name(*d)} IS NULL THEN 0 ELSE 1 END" for d in nb.RING)
    g = p.add("slopes", f"SELECT image_id, y, x, l, y1, x1, n, paper, is_ink, beside, ({total}) / ({number}) AS m, {slope(nb.SOBEL_X)} AS gx, {slope(nb.SOBEL_Y)} AS gy FROM {h}")
    return p.add("hoods", f"SELECT *, CASE WHEN y = 0 OR x = 0 OR y = y1 OR x = x1 THEN 0e0 ELSE sqrt(gx * gx + gy * gy) END AS mag FROM {g}")


def _parts(p: Plan, src: str) -> tuple[str, str, str]:
    """For features(): images with size, bleed and erasure; ink with width, wobble and angle; ink."""
    h = _hood(p, src)
    bright, ghost = "NOT is_ink AND l > least(0.97e0, paper + 0.04e0)", "NOT is_ink AND l > 0.55e0 AND l < 0.78e0 AND mag > 0.08e0"
    box = ", ".join(f"CASE WHEN bool_or(is_ink) THEN {f}(CASE WHEN {bright} THEN {c} END) END AS {a}" for f, c, a in (("min", "x", "bx0"), ("min", "y", "by0"), ("max", "x", "bx1"), ("max", "y", "by1")))
    size = p.add(
        "size",
        f"""SELECT image_id, max(y1) AS y1, max(x1) AS x1, count(*) AS n, avg(CASE WHEN l < 0.12e0 THEN 1e0 ELSE 0e0 END) AS dark_frac,
        avg(CASE WHEN beside AND NOT is_ink AND y BETWEEN 1 AND y1 - 1 AND x BETWEEN 1 AND x1 - 1 THEN mag END) AS bleed,
        CASE WHEN bool_or(is_ink) THEN count(CASE WHEN {bright} THEN 1 END) END AS bright, CASE WHEN bool_or(is_ink) THEN count(CASE WHEN {ghost} THEN 1 END) END AS ghost, {box} FROM {h} GROUP BY image_id""",
    )
    ink = p.add("ink", f"SELECT image_id, y, x, l, abs(l - m) AS wobble, atan2(round(gy, 9) + 0e0, round(gx, 9) + 1e-6) AS rad FROM {h} WHERE is_ink")
    run = ink
    for along, other in (("x", "y"), ("y", "x")):
        g = p.add("isl", f"SELECT *, {along} - row_number() OVER (PARTITION BY image_id, {other} ORDER BY {along}) AS grp FROM {run}")
        part = f"OVER (PARTITION BY image_id, {other}, grp)"
        run = p.add("run", f"SELECT * EXCEPT (grp), least({along} - min({along}) {part}, max({along}) {part} - {along}) + 1 AS d{along} FROM {g}")
    px = p.add("inkpx", f"SELECT *, 2e0 * least(dx, dy, 8) AS width, degrees(rad) AS angle FROM {run}")
    return size, px, ink


def features(p: Plan, src: str) -> str:
    """One row an image with all native features; features of ink are null where there is none."""
    if spark := p.d.name == "spark":
        (size, px, ink), own = _parts(p, src), ()
    else:
        size = p.add("size", f"SELECT image_id, max(y) AS y1, max(x) AS x1, count(*) AS n, avg(CASE WHEN l < 0.12e0 THEN 1e0 ELSE 0e0 END) AS dark_frac FROM {src} GROUP BY image_id")
        ink = mask(p, src)
        at = p.add("inkat", f"SELECT image_id, y, x FROM {ink}")
        w = nb.width(p, at)
        g, g0, box = nb.sobel(p, src), nb.sobel(p, src, replicate=False), nb.box_mean(p, src)
        ring = nb.ring(p, at)
        on = lambda a, b: f"{a}.image_id = {b}.image_id AND {a}.y = {b}.y AND {a}.x = {b}.x"
        px = p.add(
            "inkpx",
            f"""SELECT i.image_id AS image_id, i.y AS y, i.x AS x, i.l AS l, width, abs(i.l - m) AS wobble, degrees(atan2(round(gy, 9) + 0e0, round(gx, 9) + 1e-6)) AS angle, atan2(round(gy, 9) + 0e0, round(gx, 9) + 1e-6) AS rad
        FROM {ink} i JOIN {w} w ON {on('i', 'w')} JOIN {g} g ON {on('i', 'g')} JOIN {box} x ON {on('i', 'x')}""",
        )
    agg = p.add(
        "inkagg",
        f"""SELECT image_id, count(*) AS ink_pixels, avg(width) AS weight_mean, stddev_pop(width) AS weight_std, max(width) - min(width) AS taper, avg(1e0 - l) AS density, avg(wobble) AS tremor,
        stddev_pop(angle) AS slant_std, sqrt(pow(avg(cos(rad)), 2e0) + pow(avg(sin(rad)), 2e0)) AS ductus FROM {px} GROUP BY image_id""",
    )
    rows = p.add("rows", f"SELECT image_id, {p.d.idiv('y', '4')} AS band, avg(y) AS c FROM {ink} GROUP BY 1, 2 HAVING count(*) > 6")
    drift = p.add("drift", f"SELECT image_id, stddev_pop(c) AS drift FROM {rows} GROUP BY image_id HAVING count(*) >= 3")
    if not spark:
        bleed = p.add(
            "bleed",
            f"""SELECT r.image_id AS image_id, avg(mag) AS bleed FROM {ring} r JOIN {g0} g ON {on('r', 'g')} JOIN {size} z ON r.image_id = z.image_id
        WHERE r.y BETWEEN 1 AND y1 - 1 AND r.x BETWEEN 1 AND x1 - 1 GROUP BY r.image_id""",
        )
        off = p.add("off", f"SELECT g.*, paper FROM {g0} g JOIN (SELECT DISTINCT image_id, paper FROM {ink}) q ON g.image_id = q.image_id LEFT JOIN {at} i ON {on('g', 'i')} WHERE i.x IS NULL")
        bright, ghost = "l > least(0.97e0, paper + 0.04e0)", "l > 0.55e0 AND l < 0.78e0 AND mag > 0.08e0"
        erased = p.add("erased", f"SELECT image_id, count(CASE WHEN {bright} THEN 1 END) AS bright, count(CASE WHEN {ghost} THEN 1 END) AS ghost, min(CASE WHEN {bright} THEN x END) AS bx0, min(CASE WHEN {bright} THEN y END) AS by0, max(CASE WHEN {bright} THEN x END) AS bx1, max(CASE WHEN {bright} THEN y END) AS by1 FROM {off} GROUP BY image_id")
        own = (bleed, erased)
    tiles = p.add("tiles", f"SELECT image_id, stddev_pop(l) AS s FROM {src} GROUP BY image_id, {p.d.idiv('y', '8')}, {p.d.idiv('x', '8')} HAVING count(*) = 64")
    spread = p.add("spread", f"SELECT image_id, stddev_pop(s) AS block_std FROM {tiles} GROUP BY image_id")
    cl = p.add("ncl", f"SELECT image_id, count(*) AS clones FROM {nb.clones(p, src, first_only=False)} GROUP BY image_id")
    join = " ".join(f"LEFT JOIN {t} ON z.image_id = {t}.image_id" for t in (agg, drift, *own, spread, cl))
    return p.add(
        "features",
        f"""SELECT z.image_id AS image_id, x1 + 1 AS width, y1 + 1 AS height, n AS pixels, coalesce(ink_pixels, 0) AS ink_pixels, coalesce(ink_pixels, 0) * 1e0 / n AS ink_frac, weight_mean, weight_std,
        weight_std / greatest(weight_mean, 1e-3) AS weight_cv, taper, density, tremor, slant_std, ductus, drift, bleed, coalesce(bright, 0) * 1e0 / n AS bright_frac, bx0, by0, bx1, by1,
        coalesce(ghost, 0) * 1e0 / n AS ghost_frac, block_std, coalesce(clones, 0) AS clones, dark_frac,
        CASE WHEN coalesce(ink_pixels, 0) * 1e0 / n < {MIN_INK} THEN '{NO_INK}' END AS refuse_code FROM {size} z {join}""",
    )


#: Indicator rules: name, condition, confidence (before clipping), over the columns of features().
RULES = (
    ("tremor-slow-copy", "tremor > 0.04e0 AND weight_std < 0.85e0", "least(0.85e0, 0.35e0 + tremor * 8e0)"),
    ("retouch-overwrite", "dark_frac > 0.01e0 AND density > 0.55e0", "0.55e0"),
    ("baseline-misalign", "drift > 3.5e0", "least(0.7e0, 0.3e0 + drift / 20e0)"),
    ("clone-stamp", "clones > 0", "least(0.9e0, 0.5e0 + 0.06e0 * clones)"),
    ("compression-paste", "block_std > 0.045e0", "least(0.65e0, 0.25e0 + block_std * 4e0)"),
    ("ductus-inconsistent", "ductus < 0.18e0 AND ink_frac > 0.02e0", "0.45e0"),
)


def indicators(p: Plan, feats: str) -> str:
    """(image_id, kind, confidence): the rules that fire, confidence clipped and rounded half-even to three digits."""
    arms = [f"SELECT image_id, '{k}' AS kind, {p.d.half_even(f'least(greatest({c}, 0e0), 1e0)', 3)} AS confidence FROM {feats} WHERE refuse_code IS NULL AND {t}" for k, t, c in RULES]
    return p.add("indicators", " UNION ALL ".join(arms))


#: Rules over an image's stroke components (components, aspect_min, aspect_max) and stroke colours (sat_mean, hue_std).
STROKE_RULES = (
    ("pen-lifts", "components >= 8", "least(0.7e0, 0.25e0 + components * 0.03e0)"),
    ("style-shift", "components >= 6 AND aspect_max - aspect_min > 3.5e0", "0.4e0"),
    ("dual-ink-patch", "sat_mean > 0.08e0 AND hue_std > 28e0", "least(0.75e0, 0.3e0 + hue_std / 80e0)"),
)


def stroke_indicators(p: Plan, facts: str) -> str:
    """(image_id, kind, confidence): the rules that fire over facts of strokes; null facts fire none."""
    arms = [f"SELECT image_id, '{k}' AS kind, {p.d.half_even(c, 3)} AS confidence FROM {facts} WHERE {t}" for k, t, c in STROKE_RULES]
    return p.add("strokeind", " UNION ALL ".join(arms))


def hues(p: Plan, src: str) -> str:
    """(image_id, sat_mean, hue_std): mean saturation and plain (not circular) deviation of hue of ink in a pixel relation."""
    from foliant.functions.pixel import luma
    from foliant.operators import lens

    gray = p.add("gray", f"SELECT image_id, y, x, {luma()} AS l FROM {src}")
    ink, h = mask(p, gray), lens.with_hsv(p, src)
    return p.add("hues", f"SELECT h.image_id AS image_id, avg(s) AS sat_mean, stddev_pop(h) AS hue_std FROM {h} h JOIN {ink} i ON h.image_id = i.image_id AND h.y = i.y AND h.x = i.x GROUP BY h.image_id")


def tracing(p: Plan, facts: str) -> str:
    """(image_id, kind, cv): tracing flags of facts (image_id, weight_mean, weight_std, components, interior).

    ``interior`` is the mean change of ink's luminance by a slight blur.
    """
    cv = "weight_std / greatest(weight_mean, 1e-3)"
    return p.add(
        "tracing",
        f"""SELECT image_id, 'unnatural-width-uniformity' AS kind, {p.d.half_even(cv, 3)} AS cv, false AS invented FROM {facts} WHERE weight_mean > 0 AND {cv} < 0.18e0 AND components >= 4
        UNION ALL SELECT image_id, 'doubled-edge-candidate' AS kind, CAST(NULL AS DOUBLE) AS cv, false AS invented FROM {facts} WHERE interior > 0.06e0 AND weight_mean >= 2.2e0""",
    )


#: Names of operations.
OPS = {
    "": "analyze", "analyze": "analyze", "handwriting": "analyze", "handwrite": "analyze", "ink-hand": "analyze", "forgery-scan": "forgery-indicators", "compare": "compare", "side-by-side": "side-by-side",
    "sidebyside": "side-by-side", "graph": "graph", "forgery-indicators": "forgery-indicators", "forgery": "forgery-indicators", "refuse": "refuse",
}


def op_of(name: str | None) -> str:
    key = (name or "").strip().lower().replace("_", "-")
    if key not in OPS:
        raise ValueError(f"unknown handwriting op {name!r}; known: {', '.join(sorted(o for o in OPS if o))}")
    return OPS[key]


def edges(p: Plan, strokes: str, side: str = "side") -> str:
    """Sequence edges over strokes (image_id, seq, cx, cy, aspect, side): distance, and whether it stands out."""
    nxt = lambda c: f"lead({c}) OVER (PARTITION BY image_id ORDER BY seq) AS n{c}"
    e = p.add("lead", f"SELECT *, {nxt('seq')}, {nxt('cx')}, {nxt('cy')}, {nxt('aspect')} FROM {strokes}")
    d = p.add("dist", f"SELECT *, sqrt(pow(cx - ncx, 2e0) + pow(cy - ncy, 2e0)) AS d FROM {e} WHERE nseq IS NOT NULL")
    return p.add("edges", f"SELECT image_id, seq, nseq, {p.d.half_even('d', 2)} AS distance_px, (d > 0.35e0 * {side} OR abs(aspect - naspect) > 2.2e0) AS anomalous FROM {d}")


def compare(p: Plan, feats: str, pairs: str) -> str:
    """Feature deltas of image pairs (a, b)."""
    delta = lambda c: f"{p.d.half_even(f'coalesce(fa.{c}, 0e0) - coalesce(fb.{c}, 0e0)', 4)} AS {c}_delta"
    return p.add("compare", f"SELECT a, b, {delta('weight_mean')}, {delta('density')}, {delta('bleed')}, false AS invented FROM {pairs} q JOIN {feats} fa ON fa.image_id = a JOIN {feats} fb ON fb.image_id = b")


def heatmaps(p: Plan, src: str) -> str:
    """Density on ink, stretched to 0..1 (0 elsewhere)."""
    from foliant.functions.pixel import normal

    ink = mask(p, src)
    d = p.add("d", f"SELECT s.image_id AS image_id, s.y AS y, s.x AS x, CASE WHEN i.x IS NULL THEN 0e0 ELSE 1e0 - s.l END AS d FROM {src} s LEFT JOIN {ink} i ON s.image_id = i.image_id AND s.y = i.y AND s.x = i.x")
    return p.add("heat", f"SELECT image_id, y, x, {normal('d')} AS heat FROM {d}")


ink_mask, ink_features, ink_indicators, stroke_edges = map(as_frame, (mask, features, indicators, edges))
