"""Per-image reductions of the pixel relation."""

from __future__ import annotations

from foliant.constants import TAZEL_HUE, TAZEL_SIGMA, VYRN_HUE, VYRN_SIGMA
from foliant.functions.pixel import clamp, inband, luma, normal
from foliant.operators.lens import KEYS, with_hsv
from foliant.plans.sql import Plan, as_frame


def center(p: Plan, src: str) -> str:
    """Centre of mass of the luminance; the middle of the image if there is none."""
    l = p.add("l", f"SELECT image_id, y, x, greatest({luma()}, 0e0) AS l FROM {src}")
    s = p.add("s", f"SELECT image_id, sum(l) AS t, sum(l * x) AS sx, sum(l * y) AS sy, max(x) + 1 AS w, max(y) + 1 AS h FROM {l} GROUP BY image_id")
    return p.add("com", f"SELECT image_id, w AS width, h AS height, CASE WHEN t <= 1e-6 THEN w / 2e0 ELSE sx / t END AS com_x, CASE WHEN t <= 1e-6 THEN h / 2e0 ELSE sy / t END AS com_y FROM {s}")


def gate(p: Plan, src: str) -> str:
    """Percent of pixels inside each hue band, half-even to two digits."""
    h = with_hsv(p, src)
    pct = lambda hue, sigma: p.d.half_even(f"100e0 * avg(CASE WHEN {inband('h', 's', 'v', hue, sigma)} THEN 1e0 ELSE 0e0 END)", 2)
    return p.add("gate", f"SELECT image_id, {pct(TAZEL_HUE, TAZEL_SIGMA)} AS tazel_inband_pct, {pct(VYRN_HUE, VYRN_SIGMA)} AS vyrn_inband_pct FROM {h} GROUP BY image_id")


def achromatic(p: Plan, src: str, atol: float = 2e-3) -> str:
    near = lambda a, b: f"abs({a} - {b}) <= {atol!r} + 1e-5 * abs({b})"
    return p.add("achro", f"SELECT image_id, bool_and({near('r', 'g')} AND {near('g', 'b')}) AS achromatic FROM {src} GROUP BY image_id")


def equalize(p: Plan, src: str) -> str:
    """Histogram equalisation of the luminance: bins floor(256 l), looked up at floor(255 l)."""
    l = p.add("l", f"SELECT {KEYS}, {clamp(luma())} AS l FROM {src}")
    b = p.add("bins", f"SELECT image_id, CAST(least(floor(l * 256e0), 255e0) AS INT) AS bin, count(*) AS n FROM {l} GROUP BY 1, 2")
    every = p.add("every", f"SELECT image_id, CAST(id AS INT) AS bin FROM (SELECT DISTINCT image_id FROM {b}) i CROSS JOIN {p.d.numbers(256)} n")
    cdf = p.add(
        "cdf",
        f"""SELECT image_id, bin, sum(n) OVER (PARTITION BY image_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1e0 / sum(n) OVER (PARTITION BY image_id) AS c
        FROM (SELECT e.image_id AS image_id, e.bin AS bin, coalesce(b.n, 0) AS n FROM {every} e LEFT JOIN {b} b ON e.image_id = b.image_id AND e.bin = b.bin) q""",
    )  # 256 rows an image
    return p.add("eq", f"SELECT l.image_id AS image_id, y, x, c AS g FROM {l} l JOIN {cdf} c ON l.image_id = c.image_id AND CAST(floor(l.l * 255e0) AS INT) = c.bin")


def normalized(p: Plan, src: str) -> str:
    return p.add("nl", f"SELECT {KEYS}, {normal('l')} AS t FROM (SELECT {KEYS}, {luma()} AS l FROM {src}) q")


def receipt(p: Plan, source: str, out: str, mode: str, to: str, inject: bool, paper: str, hosted: bool = False) -> str:
    """One row an image: the lens applied, centre and in-band shares of the source, mean of the output.

    The ``hosted`` form takes the centre from the output.
    """
    applied = inject and any(m != "zero" for m in mode.split("+"))
    c, g = center(p, out if hosted else source), gate(p, source)
    m = p.add("m", f"SELECT image_id, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b, count(*) AS pixels FROM {out} GROUP BY image_id")
    flag = lambda x: "true" if x else "false"
    return p.add(
        "receipt",
        f"""SELECT c.image_id AS image_id, '{mode}' AS lens, '{to}' AS target, '{paper}' AS paper, {flag(inject)} AS inject, {flag(applied)} AS inject_applied,
        {flag(inject and not applied)} AS inject_ignored, false AS invented, c.width AS width, c.height AS height, com_x, com_y, tazel_inband_pct, vyrn_inband_pct, mean_r, mean_g, mean_b, pixels
        FROM {c} c JOIN {g} g ON c.image_id = g.image_id JOIN {m} m ON c.image_id = m.image_id""",
    )


center_of_mass, gate_inband, is_achromatic, equalized, normalized01 = map(as_frame, (center, gate, achromatic, equalize, normalized))
