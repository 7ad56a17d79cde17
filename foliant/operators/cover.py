"""Covers and twins: is a dark region opaque, does it hold residual signal, what differs between two rasters."""

from __future__ import annotations

from foliant.constants import COVER, TWIN_DELTA
from foliant.functions.pixel import luma
from foliant.plans.sql import Plan, as_frame

C = COVER


def classify(p: Plan, src: str) -> str:
    """One row an image: the box around all dark pixels, its statistics, and opaque / residual flags."""
    l = p.add("l", f"SELECT image_id, y, x, {luma()} AS l FROM {src}")
    d = p.add("d", f"SELECT image_id, count(*) AS n, max(x) + 1 AS width, max(y) + 1 AS height, count(CASE WHEN l <= {C['luma']}e0 THEN 1 END) AS dark, {', '.join(f'{f}(CASE WHEN l <= {C['luma']}e0 THEN {a} END) AS {a}{i}' for f, i in (('min', 0), ('max', 1)) for a in 'xy')} FROM {l} GROUP BY image_id")
    box = p.add("box", f"SELECT * FROM {d} WHERE dark * 1e0 / n >= {C['frac']}e0 AND dark >= {C['pixels']}")
    s = p.add(
        "s",
        f"""SELECT b.image_id AS image_id, avg(l) AS mean, stddev_pop(l) AS std, max(l) AS mx, min(l) AS mn, avg(CASE WHEN l <= {C['opaque_luma']}e0 THEN 1e0 ELSE 0e0 END) AS near, count(*) AS size
        FROM {box} b JOIN {l} l ON b.image_id = l.image_id AND l.x BETWEEN b.x0 AND b.x1 AND l.y BETWEEN b.y0 AND b.y1 GROUP BY b.image_id""",
    )
    opaque = f"coalesce(size >= {C['pixels']} AND near >= {C['opaque_share']}e0 AND std <= {C['opaque_std']}e0 AND mx <= {C['opaque_max']}e0, false)"
    f = p.add("f", f"SELECT d.*, mean, std, mx, mn, size, {opaque} AS opaque FROM {d} d LEFT JOIN {s} s ON d.image_id = s.image_id")
    return p.add(
        "cover",
        f"""SELECT image_id, width, height, {p.d.half_even('dark * 1e0 / n', 4)} AS dark_frac, CASE WHEN size IS NOT NULL THEN x0 END AS x0, CASE WHEN size IS NOT NULL THEN y0 END AS y0,
        CASE WHEN size IS NOT NULL THEN x1 + 1 END AS x1, CASE WHEN size IS NOT NULL THEN y1 + 1 END AS y1, {p.d.half_even('mean', 4)} AS mean, {p.d.half_even('std', 4)} AS std, opaque AS opaque_replace,
        coalesce(NOT opaque AND std >= {C['std']}e0 AND mx - mn >= {C['range']}e0, false) AS residual_usable, opaque AS flattened_screenshot_replace, false AS invented FROM {f}""",
    )


def twin(p: Plan, a: str, b: str) -> str:
    """Difference of two gray relations (pair_id, y, x, l) with the same keys; not comparable if sizes differ."""
    size = lambda t: f"SELECT pair_id, max(y) + 1 AS h, max(x) + 1 AS w, count(*) AS n FROM {t} GROUP BY pair_id"
    za, zb = p.add("za", size(a)), p.add("zb", size(b))
    j = p.add("j", f"SELECT a.pair_id AS pair_id, a.y AS y, a.x AS x, abs(a.l - b.l) AS d FROM {a} a JOIN {b} b ON a.pair_id = b.pair_id AND a.y = b.y AND a.x = b.x")
    hit = f"CASE WHEN d >= {TWIN_DELTA}e0 THEN "
    g = p.add("g", f"SELECT pair_id, {p.d.half_even(f'avg({hit}1e0 ELSE 0e0 END)', 4)} AS changed_frac, {p.d.half_even('max(d)', 4)} AS max_abs, {p.d.half_even('avg(d)', 5)} AS mean_abs, min({hit}x END) AS x0, min({hit}y END) AS y0, max({hit}x END) + 1 AS x1, max({hit}y END) + 1 AS y1 FROM {j} GROUP BY pair_id")
    same = "(za.h = zb.h AND za.w = zb.w AND za.n = zb.n)"
    cols = ", ".join(f"CASE WHEN {same} THEN g.{c} END AS {c}" for c in ("changed_frac", "max_abs", "mean_abs", "x0", "y0", "x1", "y1"))
    return p.add("twin", f"SELECT za.pair_id AS pair_id, {same} AS comparable, {cols}, false AS heatmap_is_transcript, false AS invented FROM {za} za JOIN {zb} zb ON za.pair_id = zb.pair_id LEFT JOIN {g} g ON za.pair_id = g.pair_id")


classify_cover = as_frame(classify)
