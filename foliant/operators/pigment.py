"""Faded pigment: evidence, restoration, density and the decision, over the pixel relation."""

from __future__ import annotations

from foliant.constants import PIGMENT, PIGMENT_GONE
from foliant.functions.pixel import clamp, luma, num
from foliant.operators.lens import KEYS, bright, parchment
from foliant.operators.neighbour import neighbours
from foliant.plans.sql import Plan, as_frame

T = PIGMENT
EXTRA = round(T["gain"] - 1, 6)
OPS = {"restore": "restore", "restore-pigment": "restore", "estimate": "estimate", "density": "estimate", "estimate-density": "estimate", "refuse": "refuse", "locate": "estimate", "": "restore"}


def evidence(p: Plan, src: str, hosted: bool = False) -> str:
    """src with residuals from the parchment (dr, dg, db), mag, faded, strong, support and the image's threshold.

    The quantile is interpolated, or by nearest rank in the ``hosted`` form, whose threshold keeps the mean of fewer
    than 8 bright pixels.
    """
    l = p.add("l", f"SELECT {KEYS}, r, g, b, {luma()} AS l FROM {src}")
    pa = parchment(p, src, exact=not hosted)
    q = bright(p, l, exact=not hosted)
    few = f"{'avg(CASE WHEN l >= q THEN mag END) + ' if hosted else ''}{T['noise_k']}e0 * 0.02e0"
    res = p.add("res", f"SELECT {l}.*, q, pr - r AS dr, pg - g AS dg, pb - b AS db, {luma('pr', 'pg', 'pb')} AS pl FROM {l} JOIN {pa} ON {l}.image_id = {pa}.image_id JOIN {q} ON {l}.image_id = {q}.image_id")
    mag = p.add("mag", f"SELECT *, sqrt(dr * dr + dg * dg + db * db) AS mag, greatest(dr, dg, db) - least(dr, dg, db) AS chroma, pl - l AS gap FROM {res}")
    th = p.add(
        "th",
        f"""SELECT image_id, greatest({T['floor']}e0, CASE WHEN count(CASE WHEN l >= q THEN 1 END) < 8 THEN {few}
        ELSE avg(CASE WHEN l >= q THEN mag END) + {T['noise_k']}e0 * stddev_pop(CASE WHEN l >= q THEN mag END) END) AS thresh FROM {mag} GROUP BY image_id""",
    )
    f = p.add(
        "faded",
        f"""SELECT m.*, thresh, gap > {T['gap_max']}e0 AS strong, (mag >= thresh AND gap >= {T['gap_min']}e0 AND gap <= {T['gap_max']}e0 AND chroma >= {T['chroma']}e0) AS faded
        FROM {mag} m JOIN {th} t ON m.image_id = t.image_id""",
    )
    near = neighbours(p, p.add("fm", f"SELECT image_id, y, x FROM {f} WHERE faded"), centre=True)
    return p.add("evidence", f"SELECT f.*, (faded AND coalesce(n.n, 0) >= {T['near']}) AS support FROM {f} f LEFT JOIN {near} n ON f.image_id = n.image_id AND f.y = n.y AND f.x = n.x")


def restored(p: Plan, ev: str) -> str:
    cols = [f"CASE WHEN support THEN {clamp(f'{c} - {num(EXTRA)} * d{c}')} ELSE {c} END AS {c}" for c in "rgb"]
    return p.add("restored", f"SELECT {KEYS}, {', '.join(cols)} FROM {ev}")


def density(p: Plan, ev: str) -> str:
    """Magnitude on support relative to its largest, else 0."""
    pk = p.add("pk", f"SELECT *, max(CASE WHEN support THEN mag END) OVER (PARTITION BY image_id) AS peak FROM {ev}")
    return p.add("density", f"SELECT {KEYS}, CASE WHEN support AND peak > 1e-6 THEN {clamp('mag / peak')} ELSE 0e0 END AS d FROM {pk}")


def decision(p: Plan, src: str, op: str = "restore", hosted: bool = False) -> str:
    """One row an image: whether the pigment can be recovered, and the refusal code if not."""
    ev = evidence(p, src, hosted)
    re = restored(p, ev)
    ch = p.add(
        "ch",
        f"""SELECT e.image_id AS image_id, count(*) AS pixels, count(CASE WHEN support THEN 1 END) AS evidence_pixels, count(CASE WHEN strong THEN 1 END) AS visible_ink_pixels,
        max(thresh) AS thresh, count(CASE WHEN greatest(abs(r.r - e.r), abs(r.g - e.g), abs(r.b - e.b)) > 1e-6 THEN 1 END) AS moved
        FROM {ev} e JOIN {re} r ON e.image_id = r.image_id AND e.y = r.y AND e.x = r.x GROUP BY e.image_id""",
    )
    ok = f"(evidence_pixels >= {T['pixels']} AND evidence_pixels * 1e0 / pixels BETWEEN {T['frac_min']}e0 AND {T['frac_max']}e0)"
    live = "false" if op == "refuse" else f"({ok} AND moved > 0)"
    return p.add(
        "decision",
        f"""SELECT image_id, '{op}' AS op, pixels, evidence_pixels, visible_ink_pixels, thresh, {ok} AS supported, {live} AS recovered, CASE WHEN {live} THEN moved ELSE 0 END AS changed_pixels,
        CASE WHEN {live} THEN NULL ELSE '{PIGMENT_GONE}' END AS refuse_code, true AS pigment_recovery, false AS invented FROM {ch}""",
    )


def op_of(name: str) -> str:
    """The operation that a name stands for; unknown names raise."""
    key = name.strip().lower()
    if key not in OPS:
        raise ValueError(f"unknown pigment op {name!r}; known: {', '.join(sorted(o for o in OPS if o))}")
    return OPS[key]


pigment_evidence, pigment_decision = as_frame(evidence), as_frame(decision)
