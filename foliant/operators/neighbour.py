"""Neighbourhood operators on relations of pixels: each pixel is sent to the places that see it, and summed there."""

from __future__ import annotations

from foliant.plans.sql import Plan, as_frame

RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: Sobel kernels by (dy, dx).
SOBEL_X = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
SOBEL_Y = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}


def offsets(p: Plan, which: list[tuple[int, int]]) -> str:
    return p.add("off", "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in which) + ") AS t(dy, dx)")


def neighbours(p: Plan, mask: str, centre: bool = False) -> str:
    """(image_id, y, x, n): set pixels of ``mask`` around each place, the place itself included with ``centre``."""
    o = offsets(p, [d for d in RING if centre or d != (0, 0)])
    return p.add("near", f"SELECT image_id, y + dy AS y, x + dx AS x, count(*) AS n FROM {mask} CROSS JOIN {o} GROUP BY image_id, y + dy, x + dx")


def speckle(p: Plan, ink: str, least: int = 2) -> str:
    """Ink pixels with at least ``least`` of their eight neighbours set."""
    n = neighbours(p, ink)
    return p.add("ink", f"SELECT i.image_id AS image_id, i.y AS y, i.x AS x FROM {ink} i JOIN {n} n ON i.image_id = n.image_id AND i.y = n.y AND i.x = n.x WHERE n.n >= {least}")


def ring(p: Plan, ink: str) -> str:
    """Places beside ink (four neighbours) that are not ink themselves."""
    o = offsets(p, [(-1, 0), (1, 0), (0, -1), (0, 1)])
    d = p.add("dil", f"SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {ink} CROSS JOIN {o}")
    return p.add("ring", f"SELECT d.image_id AS image_id, d.y AS y, d.x AS x FROM {d} d LEFT JOIN {ink} i ON d.image_id = i.image_id AND d.y = i.y AND d.x = i.x WHERE i.x IS NULL")


def sobel(p: Plan, src: str, replicate: bool = True) -> str:
    """(image_id, y, x, l, gx, gy, mag) of a gray relation (image_id, y, x, l).

    With ``replicate`` the border repeats outwards; without, border pixels have magnitude 0.
    """
    o = offsets(p, RING)
    size = p.add("size", f"SELECT image_id, max(y) AS y1, max(x) AS x1 FROM {src} GROUP BY image_id")
    at = p.add(
        "at",
        f"""SELECT s.image_id AS image_id, y, x, l, dy, dx, least(greatest(y + dy, 0), y1) AS sy, least(greatest(x + dx, 0), x1) AS sx, (y = 0 OR x = 0 OR y = y1 OR x = x1) AS edge
        FROM {src} s JOIN {size} z ON s.image_id = z.image_id CROSS JOIN {o}""",
    )
    weight = lambda k: "CASE " + " ".join(f"WHEN dy = {a} AND dx = {b} THEN {w}e0" for (a, b), w in k.items()) + " ELSE 0e0 END"
    g = p.add(
        "grad",
        f"""SELECT a.image_id AS image_id, a.y AS y, a.x AS x, max(a.l) AS l, bool_or(edge) AS edge, sum(b.l * {weight(SOBEL_X)}) AS gx, sum(b.l * {weight(SOBEL_Y)}) AS gy
        FROM {at} a JOIN {src} b ON a.image_id = b.image_id AND a.sy = b.y AND a.sx = b.x GROUP BY a.image_id, a.y, a.x""",
    )
    m = "sqrt(gx * gx + gy * gy)"
    return p.add("sobel", f"SELECT image_id, y, x, l, gx, gy, {m if replicate else f'CASE WHEN edge THEN 0e0 ELSE {m} END'} AS mag FROM {g}")


def box_mean(p: Plan, src: str) -> str:
    """(image_id, y, x, l, m): mean of the 3 x 3 pixels that exist around each."""
    o = offsets(p, RING)
    sent = p.add("sent", f"SELECT image_id, y + dy AS y, x + dx AS x, sum(l) AS s, count(*) AS n FROM {src} CROSS JOIN {o} GROUP BY image_id, y + dy, x + dx")
    return p.add("box", f"SELECT a.image_id AS image_id, a.y AS y, a.x AS x, l, s / n AS m FROM {src} a JOIN {sent} b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x")


def runs(p: Plan, ink: str, along: str) -> str:
    """Each ink pixel's distance to the first non-ink place (or image edge) before and after it, along y or x."""
    other = "x" if along == "y" else "y"
    isl = p.add("isl", f"SELECT image_id, y, x, {along} - row_number() OVER (PARTITION BY image_id, {other} ORDER BY {along}) AS grp FROM {ink}")
    return p.add("run", f"SELECT image_id, y, x, least({along} - min({along}) OVER (PARTITION BY image_id, {other}, grp), max({along}) OVER (PARTITION BY image_id, {other}, grp) - {along}) + 1 AS d FROM {isl}")


def width(p: Plan, ink: str, most: int = 8) -> str:
    """Stroke width at each ink pixel: twice the least distance in four directions, capped."""
    a, b = runs(p, ink, "x"), runs(p, ink, "y")
    return p.add("width", f"SELECT a.image_id AS image_id, a.y AS y, a.x AS x, 2e0 * least(a.d, b.d, {most}) AS width FROM {a} a JOIN {b} b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x")


def tile_keys(p: Plan, src: str, side: int = 8, levels: int = 15) -> str:
    """(image_id, ty, tx, code): the quantised luminance of each full tile; equal codes, equal tiles."""
    q = p.add("qt", f"SELECT image_id, {p.d.idiv('y', str(side))} AS ty, {p.d.idiv('x', str(side))} AS tx, (y % {side}) * {side} + x % {side} AS k, CAST(floor(least(greatest(l, 0e0), 1e0) * {levels}e0) AS INT) AS v FROM {src}")
    return p.add("tiles", f"SELECT image_id, ty * {side} AS y0, tx * {side} AS x0, {p.d.sha(p.d.text_agg('CAST(v AS VARCHAR(4))', 'k'))} AS code FROM {q} GROUP BY image_id, ty, tx HAVING count(*) = {side * side}")


def clones(p: Plan, src: str, apart: int = 16, most: int = 6, first_only: bool = True) -> str:
    """Pairs of equal tiles at least ``apart`` away (city-block), in scan order, at most ``most`` an image.

    ``first_only`` keeps the first partner of each tile.
    """
    t = tile_keys(p, src)
    j = p.add(
        "pairs",
        f"""SELECT a.image_id AS image_id, a.y0 AS y0, a.x0 AS x0, b.y0 AS y1, b.x0 AS x1, row_number() OVER (PARTITION BY a.image_id, a.y0, a.x0 ORDER BY b.y0, b.x0) AS k
        FROM {t} a JOIN {t} b ON a.image_id = b.image_id AND a.code = b.code AND (b.y0 > a.y0 OR (b.y0 = a.y0 AND b.x0 > a.x0)) AND abs(a.y0 - b.y0) + abs(a.x0 - b.x0) >= {apart}""",
    )
    n = p.add("nth", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, y1, x1) AS nth FROM {j} WHERE {'k = 1' if first_only else 'true'}")
    return p.add("clones", f"SELECT image_id, y0, x0, y1, x1 FROM {n} WHERE nth <= {most}")


speckle_filter, dilation_ring, sobel_gradient, mean3, stroke_width, clone_tiles = map(as_frame, (speckle, ring, sobel, box_mean, width, clones))
