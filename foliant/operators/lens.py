"""Lenses over the pixel relation (image_id, y, x, r, g, b), preview profile: native expressions only.

Every lens keeps the relation's shape. With ``inject`` off, the result is its own luminance in all three bands;
the lens zero is always gray. Composites use the four base channels, computed once.
"""

from __future__ import annotations

from foliant.constants import MODES, PAGE_TARGETS, WEIGHTS, paint
from foliant.functions.pixel import band, clamp, finite, from_hsv, hsv, luma, normal, num, tint
from foliant.plans.sql import Plan, as_frame

KEYS = "image_id, y, x"


def clean(p: Plan, src: str) -> str:
    return p.add("clean", f"SELECT {KEYS}, {finite('r')} AS r, {finite('g')} AS g, {finite('b')} AS b FROM {src}")


def with_hsv(p: Plan, src: str) -> str:
    e = p.add("ext", f"SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM {src}")
    return p.add("hsv", f"SELECT {KEYS}, r, g, b, {hsv(p.d)} FROM {e}")


def gray(p: Plan, src: str, x: str = luma()) -> str:
    g = p.add("gray", f"SELECT {KEYS}, {clamp(x)} AS g0 FROM {src}")
    return p.add("gray", f"SELECT {KEYS}, g0 AS r, g0 AS g, g0 AS b FROM {g}")


def _repainted(p: Plan, src: str, color: tuple, share: str, more: dict[str, str] | None = None) -> str:
    """Back from h, s2, v2, mixed with ``color`` by ``share``."""
    back = p.add("back", "SELECT *, " + ", ".join(f"{e} AS n{k}" for k, e in zip("rgb", from_hsv(p.d, "h", "s2", "v2"), strict=True)) + f" FROM {src}")
    more = more or {}
    cols = [f"{clamp(f'n{k} * (1e0 - {share}) {more.get(k, chr(32))} + {num(c)} * v2 * {share}')} AS {k}" for k, c in zip("rgb", color, strict=True)]
    return p.add("painted", f"SELECT {KEYS}, {', '.join(cols)} FROM {back}")


def zero(p: Plan, src: str) -> str:
    n = p.add("norm", f"SELECT {KEYS}, {normal('l')} AS t FROM (SELECT *, {luma()} AS l FROM {src}) q")
    return gray(p, n, "t")


def tazel(p: Plan, src: str) -> str:
    w = p.add("w", f"SELECT *, {band('h', 170, 24)} AS w FROM {with_hsv(p, src)}")
    s = p.add("s", f"SELECT *, {clamp('s * (1e0 + 0.65e0 * w) + 0.10e0 * w')} AS s2, {clamp('v * (1e0 + 0.28e0 * w) + 0.06e0 * w + 0.12e0 * 4e0 * v * (1e0 - v)')} AS v2 FROM {w}")
    return _repainted(p, s, paint("tazel"), "0.18e0 * w")


def vyrn(p: Plan, src: str) -> str:
    w = p.add("w", f"SELECT *, {band('h', 350, 28)} AS w, {band('h', 160, 32)} AS cyan FROM {with_hsv(p, src)}")
    s = p.add("s", f"SELECT *, {clamp('s * (1e0 + 0.7e0 * w) * (1e0 - 0.55e0 * cyan) + 0.08e0 * w')} AS s2, {clamp('v * (1e0 + 0.22e0 * w) * (1e0 - 0.18e0 * cyan)')} AS v2 FROM {w}")
    return _repainted(p, s, paint("vyrn"), "0.22e0 * w", {"g": "* (1e0 - 0.25e0 * cyan)"})


def uv(p: Plan, src: str) -> str:
    t = p.add("t", f"SELECT {KEYS}, {normal('l')} AS t FROM (SELECT *, {luma()} AS l FROM {src}) q")
    glow = p.add("glow", f"SELECT *, {clamp('pow(t, 0.72e0) * 1.18e0')} * (1e0 - 0.42e0 * (1e0 - t)) AS glow, CASE WHEN t < 0.42e0 THEN 0.65e0 ELSE 1e0 END AS k FROM {t}")
    return p.add("uv", f"SELECT {KEYS}, {clamp('(glow * 0.70e0 + 0.04e0) * k')} AS r, {clamp('(glow * 0.62e0 + 0.03e0) * k')} AS g, {clamp('(glow * 1.18e0) * k')} AS b FROM {glow}")


def candle(p: Plan, src: str) -> str:
    l = p.add("l", f"SELECT *, {luma()} AS l, 1e0 - 0.42e0 * x / greatest(1, max(x) OVER (PARTITION BY image_id)) AS flame FROM {src}")
    g = p.add("g", f"SELECT *, {clamp('pow(l, 0.82e0) * (0.78e0 + 0.28e0 * flame)')} AS glow, {clamp('(0.44e0 - l) / 0.44e0')} AS ink FROM {l}")
    mixes = {"r": (0.42, 1.16, 0.05), "g": (0.40, 0.70, 0.02), "b": (0.22, 0.26, 0.0)}
    cols = [f"{clamp(f'({k} * {num(a)} + glow * {num(m)} + {num(c)}) * (1e0 - 0.40e0 * ink) + {k} * 0.28e0 * ink')} AS {k}" for k, (a, m, c) in mixes.items()]
    return p.add("candle", f"SELECT {KEYS}, {', '.join(cols)} FROM {g}")


def bright(p: Plan, l: str, exact: bool = False) -> str:
    """The .80 quantile q of l in each image: by nearest rank (rank floor(.8 n) from 0), or interpolated with ``exact``."""
    if exact:
        return p.add("q", f"SELECT image_id, {p.d.pct('l', 0.8)} AS q FROM {l} GROUP BY image_id")
    k = p.add("k", f"SELECT image_id, l, row_number() OVER (PARTITION BY image_id ORDER BY l) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM {l}")
    return p.add("q", f"SELECT image_id, l AS q FROM {k} WHERE k = floor(n * 0.8e0) + 1")


def parchment(p: Plan, src: str, exact: bool = False) -> str:
    """Mean colour of the bright pixels: luminance at least the .80 quantile, by nearest rank or ``exact``."""
    l = p.add("l", f"SELECT image_id, r, g, b, {luma()} AS l FROM {src}")
    q = bright(p, l, exact)
    return p.add("parch", f"SELECT {l}.image_id AS image_id, avg(r) AS pr, avg(g) AS pg, avg(b) AS pb FROM {l} JOIN {q} ON {l}.image_id = {q}.image_id WHERE l >= q GROUP BY {l}.image_id")


def _washed(p: Plan, src: str, share: str, exact: bool = False) -> str:
    """src with l, t and the parchment, and wr, wg, wb: mixed to the parchment by ``share`` (of t)."""
    t = p.add("t", f"SELECT *, {normal('l')} AS t FROM (SELECT *, {luma()} AS l FROM {src}) q")
    k = p.add("k", f"SELECT *, {share} AS k FROM {t}")
    pa = parchment(p, src, exact)
    return p.add("washed", f"SELECT {k}.*, " + ", ".join(f"{c} * (1e0 - k) + p{c} * k AS w{c}" for c in "rgb") + f" FROM {k} JOIN {pa} ON {k}.image_id = {pa}.image_id")


def indent(p: Plan, src: str) -> str:
    w = _washed(p, src, f"0.84e0 * {clamp('(0.52e0 - t) / 0.52e0')}")
    g = p.add("relief", f"SELECT *, {luma('wr', 'wg', 'wb')} AS gw FROM {w}")
    return p.add("indent", f"SELECT {KEYS}, " + ", ".join(f"{clamp(f'w{c} * 0.42e0 + 0.58e0 * ' + clamp('0.18e0 + gw * 0.62e0 + abs(l - gw) * 0.9e0'))} AS {c}" for c in "rgb") + f" FROM {g}")


def lemon(p: Plan, src: str) -> str:
    h = with_hsv(p, src)
    gain = clamp(f"(0.65e0 * {band('h', 36, 22)} + 0.35e0 * {band('h', 28, 30)}) * {clamp('s * 1.85e0')} * greatest(0e0, 1e0 - abs(v - 0.42e0) / 0.45e0)")
    w = p.add("w", f"SELECT *, {gain} AS w FROM {h}")
    s = p.add("s", f"SELECT *, {clamp('s * (1e0 + 0.58e0 * w) + 0.04e0 * w')} AS s2, {clamp('v * (1e0 + 0.10e0 * w) - 0.07e0 * w')} AS v2 FROM {w}")
    return _repainted(p, s, paint("lemon"), "0.22e0 * w")


SIMPLE = {"zero": zero, "tazel": tazel, "vyrn": vyrn, "uv": uv, "candle": candle, "indent": indent, "lemon": lemon}


def channels(p: Plan, src: str, names: tuple[str, ...] = ("zero", "tazel", "vyrn", "uv"), inject: bool = True) -> str:
    """One normalised luminance column for each lens, side by side."""
    parts = []
    for n in names:
        out = mode(p, src, n, inject) if n not in SIMPLE or not inject else SIMPLE[n](p, src)
        parts.append(p.add("ch", f"SELECT {KEYS}, {normal('l')} AS c_{n} FROM (SELECT *, {luma()} AS l FROM {out}) q"))
    joins = " ".join(f"JOIN {o} USING (image_id, y, x)" for o in parts[1:])
    return p.add("channels", f"SELECT {KEYS}, {', '.join(f'c_{n}' for n in names)} FROM {parts[0]} {joins}")


def blend(p: Plan, ch: str, weights: dict[str, float], color: tuple | None) -> str:
    mix = p.add("mix", f"SELECT {KEYS}, {clamp(' + '.join(f'{num(w)} * c_{n}' for n, w in weights.items()))} AS m FROM {ch}")
    bands = tint("m", color) if color else ["m"] * 3
    return p.add("blend", f"SELECT {KEYS}, " + ", ".join(f"{e} AS {k}" for k, e in zip("rgb", bands, strict=True)) + f" FROM {mix}")


def balance(p: Plan, ch: str, inject: bool) -> str:
    zen, chaos = (blend(p, ch, WEIGHTS[n], paint(n) if inject else None) for n in ("zen", "chaos"))
    both = p.add("both", f"SELECT image_id, y, x, a.r AS ar, a.g AS ag, a.b AS ab, c.r AS cr, c.g AS cg, c.b AS cb FROM {zen} a JOIN {chaos} c USING (image_id, y, x)")
    n = p.add("n", f"SELECT *, {normal('la')} AS zn, {normal('lc')} AS cn FROM (SELECT *, {luma('ar', 'ag', 'ab')} AS la, {luma('cr', 'cg', 'cb')} AS lc FROM {both}) q")
    a = p.add("alpha", f"SELECT *, (1e0 + (zn - cn) / (zn + cn + 1e-6)) / 2e0 AS alpha FROM {n}")
    return p.add("balance", f"SELECT {KEYS}, " + ", ".join(f"{clamp(f'alpha * a{k} + (1e0 - alpha) * c{k}')} AS {k}" for k in "rgb") + f" FROM {a}")


def mode(p: Plan, src: str, name: str, inject: bool = True) -> str:
    """Apply one lens by its id."""
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; known: {', '.join(MODES)}")
    if name in SIMPLE:
        out = SIMPLE[name](p, src)
        return out if inject or name == "zero" else gray(p, out)
    ch = channels(p, src)
    if name == "balance":
        out = balance(p, ch, inject)
        return out if inject else gray(p, out)
    return blend(p, ch, WEIGHTS[name], paint(name) if inject else None)


def compose(p: Plan, src: str, lenses: tuple[str, ...], inject: bool = True) -> str:
    """Equal mix of several lenses' normalised luminance, tinted by their mean paint."""
    if len(lenses) == 1:
        return mode(p, src, lenses[0], inject)
    ch = channels(p, src, lenses, inject)
    color = None
    if inject and any(n != "zero" for n in lenses):
        color = tuple(sum(paint(n)[i] for n in lenses) / len(lenses) for i in range(3))
    return blend(p, ch, {n: 1 / len(lenses) for n in lenses}, color)


def target(p: Plan, src: str, name: str = "ink") -> str:
    """Reweight towards the page or the ink."""
    if name.strip().lower() in PAGE_TARGETS:
        w = _washed(p, src, f"0.72e0 * {clamp('(0.50e0 - t) / 0.50e0')}")
        cols = [f"{clamp(f'w{c}')} AS {c}" for c in "rgb"]
    else:
        w = _washed(p, src, f"0.50e0 * {clamp('(t - 0.38e0) / 0.40e0')}")
        cols = [f"{clamp(f'w{c} * (CASE WHEN t < 0.48e0 THEN 0.72e0 ELSE 1e0 END)')} AS {c}" for c in "rgb"]
    return p.add("target", f"SELECT {KEYS}, {', '.join(cols)} FROM {w}")


def analyze(p: Plan, src: str, lenses: tuple[str, ...] = ("rosetta",), to: str = "ink", inject: bool = True) -> str:
    """Lenses, then target."""
    return target(p, compose(p, clean(p, src), lenses, inject), to)


apply_mode, apply_target, compose_lenses, overlay = map(as_frame, (mode, target, compose, analyze))
