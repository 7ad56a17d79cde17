"""Per-pixel expressions, as SQL text over double columns r, g, b in 0..1."""

from __future__ import annotations

from foliant.constants import EPS, LUMA, SAT_MIN, VAL_MIN


def num(x: float) -> str:
    """A double literal in both dialects."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0e0), 1e0)"


def finite(x: str) -> str:
    """NaN and null to 0, then 0..1 (which brings infinities in)."""
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 0e0 ELSE {clamp(x)} END"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"({num(LUMA[0])}*({r}) + {num(LUMA[1])}*({g}) + {num(LUMA[2])}*({b}))"


def hue_distance(h: str, t: float) -> str:
    return f"least(abs({h} - {num(float(t))}), 360e0 - abs({h} - {num(float(t))}))"


def band(h: str, t: float, sigma: float) -> str:
    return f"exp(-0.5e0 * pow(({hue_distance(h, t)}) / {num(float(sigma))}, 2e0))"


def hsv(d, v: str = "mx", delta: str = "mx - mn") -> str:
    """Columns h, s, v from r, g, b and mx, mn (their largest and smallest)."""
    dl = f"({delta})"
    return f"""CASE WHEN {dl} <= {num(EPS)} THEN 0e0
      WHEN {v} = r THEN 60e0 * ({d.pmod(f"(g - b) / {dl}", "6e0")})
      WHEN {v} = g THEN 60e0 * ((b - r) / {dl} + 2e0)
      ELSE 60e0 * ((r - g) / {dl} + 4e0) END AS h,
      CASE WHEN {v} > {num(EPS)} THEN {dl} / {v} ELSE 0e0 END AS s, {v} AS v"""


def from_hsv(d, h: str, s: str, v: str) -> tuple[str, str, str]:
    """Expressions for r, g, b."""
    c, m = f"({v} * {s})", f"({v} - {v} * {s})"
    hp = f"(({d.pmod(h, '360e0')}) / 60e0)"
    x = f"({c} * (1e0 - abs(({d.pmod(hp, '2e0')}) - 1e0)))"
    zero = "0e0"
    order = {"r": (c, x, zero, zero, x, c), "g": (x, c, c, x, zero, zero), "b": (zero, zero, x, c, c, x)}

    def pick(k: str) -> str:
        arms = " ".join(f"WHEN {hp} < {i + 1}e0 THEN {order[k][i]}" for i in range(5))
        return clamp(f"(CASE {arms} ELSE {order[k][5]} END) + {m}")

    return pick("r"), pick("g"), pick("b")


def inband(h: str, s: str, v: str, hue: float, sigma: float) -> str:
    return f"({hue_distance(h, hue)} <= {num(float(sigma))} AND {s} >= {num(SAT_MIN)} AND {v} >= {num(VAL_MIN)})"


def lift(g: str, amount: float) -> str:
    return clamp(f"{g} + {num(amount)} * 4e0 * {g} * (1e0 - {g})")


def tint(g: str, color: tuple[float, float, float], amount: float = 0.28) -> list[str]:
    return [clamp(f"{g} * ({num(1 - amount)} + {num(amount)} * {num(c)} * 1.6e0)") for c in color]


def normal(x: str, key: str = "image_id") -> str:
    """Stretched to 0..1 within the image; 0 where it is flat."""
    lo, hi = f"min({x}) OVER (PARTITION BY {key})", f"max({x}) OVER (PARTITION BY {key})"
    return f"CASE WHEN {hi} - {lo} < {num(EPS)} THEN 0e0 ELSE ({x} - {lo}) / ({hi} - {lo}) END"
