"""Requests in plain text: modes, lenses, targets, switches and file names resolved to what operators take."""

from __future__ import annotations

from foliant.constants import ALIASES, INJECT_OFF, INJECT_ON, MODES, PAGE_TARGETS, PAPERS, STUBS, paint
from foliant.plans.sql import Plan, as_frame


def _in(x: str, words) -> str:
    return f"{x} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def mode_of(x: str) -> str:
    """The mode that a name stands for; null if there is none."""
    key = f"lower(trim({x}))"
    return f"CASE WHEN {_in(key, MODES)} THEN {key} " + " ".join(f"WHEN {key} = '{a}' THEN '{m}'" for a, m in ALIASES.items()) + " END"


def modes(p: Plan, src: str) -> str:
    """mode and error of requests (.., name); stubs and unknown names are refused in words."""
    key = "lower(trim(coalesce(name, '')))"
    known = ", ".join(MODES)
    return p.add("modes", f"SELECT *, {mode_of('name')} AS mode, CASE WHEN {mode_of('name')} IS NOT NULL THEN NULL WHEN {_in(key, STUBS)} THEN concat({key}, ' is a stub and stays refused.') ELSE concat('unknown mode ', coalesce(name, ''), '. Known: {known}') END AS error FROM {src}")


def target_of(x: str) -> str:
    return f"CASE WHEN {_in(f'lower(trim({x}))', PAGE_TARGETS)} THEN 'page' ELSE 'ink' END"


def inject_of(x: str, default: bool = True) -> str:
    """A switch in text; what is neither on nor off is the default."""
    key = f"lower(trim({x}))"
    return f"CASE WHEN {_in(key, INJECT_OFF)} THEN false WHEN {_in(key, INJECT_ON)} THEN true ELSE {'true' if default else 'false'} END"


def inject_resolved(inject: str, tint: str) -> str:
    """The switch of a request: inject if it is given, else the older name tint, else on."""
    return f"coalesce({inject}, {tint}, true)"


def catalogue(p: Plan) -> str:
    """(kind, name, seq, paper, alias_of): modes with their papers, targets, and the other names of modes."""
    rows = [("mode", m, i, PAPERS[m], None) for i, m in enumerate(MODES)] + [("target", t, i, None, None) for i, t in enumerate(("page", "ink"))]
    rows += [("alias", a, i, PAPERS[m], m) for i, (a, m) in enumerate(ALIASES.items())]
    lit = lambda v: "CAST(NULL AS VARCHAR(40))" if v is None else f"'{v}'"
    values = " UNION ALL ".join(f"SELECT {lit(k)} AS kind, {lit(n)} AS name, {i} AS seq, {lit(paper)} AS paper, {lit(a)} AS alias_of" for k, n, i, paper, a in rows)
    return p.add("catalogue", values)


def lenses(p: Plan, src: str) -> str:
    """(id, lenses, lens_id, inject_applied, unknown) of requests (id, text, inject): names parted by + or commas, each once, in order.

    No names: rosetta. The switch applies unless every lens is zero.
    """
    d = p.d
    s = p.add("s", f"SELECT id, inject, {d.split(f'replace(coalesce(text, {chr(39) * 2}), {chr(39)}+{chr(39)}, {chr(39)},{chr(39)})', ',')} AS names FROM {src}")
    e = p.add("e", f"SELECT id, inject, pos, val, {mode_of('val')} AS mode FROM {d.each(s, 'names')}")
    f = p.add("f", f"SELECT id, mode, min(pos) AS pos FROM {e} WHERE mode IS NOT NULL GROUP BY id, mode")
    g = p.add("g", f"SELECT id, {d.text_agg('mode', 'pos', '+')} AS lens_id, max(CASE WHEN mode <> 'zero' THEN 1 ELSE 0 END) AS painted FROM {f} GROUP BY id")
    u = p.add("u", f"SELECT id, {d.text_agg('val', 'pos')} AS unknown FROM {e} WHERE mode IS NULL AND trim(val) <> '' GROUP BY id")
    return p.add("lenses", f"SELECT s.id AS id, coalesce(lens_id, 'rosetta') AS lens_id, (inject AND coalesce(painted, 1) = 1) AS inject_applied, (inject AND coalesce(painted, 1) = 0) AS inject_ignored, unknown FROM {s} s LEFT JOIN {g} g ON s.id = g.id LEFT JOIN {u} u ON s.id = u.id")


def sidecar_name(d, x: str) -> str:
    """The JSON file beside a picture: its suffix swapped, or .json appended."""
    return f"CASE WHEN {d.like(f'lower({x})', '[.](?:png|jpe?g)$')} THEN concat({d.sub(x, '[.][^.]*$', '')}, '.json') ELSE concat({x}, '.json') END"


def paints(p: Plan) -> str:
    """(mode, r, g, b): membership paints."""
    rows = ", ".join("('" + m + "', " + ", ".join(f"{v!r}e0" for v in paint(m)) + ")" for m in (*MODES, "other"))
    return p.add("paints", f"SELECT * FROM (VALUES {rows}) AS t(mode, r, g, b)")


def resized(p: Plan, src: str, side: int) -> str:
    """Nearest-neighbour reduction of a pixel relation to a longest side; smaller images stay."""
    z = p.add("z", f"SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM {src} GROUP BY image_id")
    scale = f"least(1e0, {side}e0 / greatest(h, w))"
    n = p.add("n", f"SELECT image_id, h, w, CAST(greatest(1, round(h * {scale})) AS INT) AS nh, CAST(greatest(1, round(w * {scale})) AS INT) AS nw FROM {z}")
    g = p.d.numbers(side)
    grid = p.add("grid", f"SELECT image_id, CAST(a.id AS INT) AS y, CAST(b.id AS INT) AS x, CAST(least(h - 1, floor((a.id + 0.5e0) * h / nh)) AS INT) AS sy, CAST(least(w - 1, floor((b.id + 0.5e0) * w / nw)) AS INT) AS sx FROM {n} JOIN {g} a ON a.id < nh JOIN {g} b ON b.id < nw")
    return p.add("resized", f"SELECT q.image_id AS image_id, q.y AS y, q.x AS x, r, g, b FROM {grid} q JOIN {src} s ON q.image_id = s.image_id AND q.sy = s.y AND q.sx = s.x")


resolve_modes, normalize_lenses, resize_nearest = map(as_frame, (modes, lenses, resized))
