"""Relations that stand in for images, files and requests, derived from the test tables."""

from __future__ import annotations

from foliant.plans.sql import Plan

SIDE = 16
CREAM, INK, FADED = (0.93, 0.88, 0.76), (0.12, 0.09, 0.06), (0.45, 0.62, 0.28)


def _sequence(p: Plan) -> str:
    if p.d.name == "spark":  # named before the window: what follows knows that rows lie together by image_id
        i = p.add("item", "SELECT l_suppkey AS image_id, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem")
        return p.add("seq", f"SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k, l_quantity, l_discount, l_tax, l_returnflag FROM {i}")
    return p.add(
        "seq",
        """SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k,
        l_quantity, l_discount, l_tax, l_returnflag FROM lineitem""",
    )


def pixels(p: Plan) -> str:
    """Noisy colour pixels, SIDE wide; one image for each supplier (table lineitem)."""
    s = _sequence(p)
    return p.add("px", f"SELECT image_id, CAST({p.d.idiv('k', str(SIDE))} AS INT) AS y, CAST(k % {SIDE} AS INT) AS x, least(l_quantity / 50e0, 1e0) AS r, least(l_discount * 10e0, 1e0) AS g, least(l_tax * 12.5e0, 1e0) AS b FROM {s}")


def paper(p: Plan) -> str:
    """Cream pages with dark ink and faded green marks (table lineitem)."""
    s = _sequence(p)
    cols = [f"CASE WHEN l_quantity > 45 THEN {i}e0 WHEN l_returnflag = 'R' THEN {0.72 * c + 0.28 * f!r}e0 ELSE {c}e0 END AS {k}" for k, c, i, f in zip("rgb", CREAM, INK, FADED, strict=True)]
    return p.add("pg", f"SELECT image_id, CAST({p.d.idiv('k', str(SIDE))} AS INT) AS y, CAST(k % {SIDE} AS INT) AS x, {', '.join(cols)} FROM {s}")


def tiles(p: Plan) -> str:
    """8 x 8 gray tiles: the 64 values of an embedding stretched to 0..1 (table embeddings)."""
    e = p.add("e", f"SELECT vec_id AS image_id, label, CAST(pos AS INT) AS pos, CAST(val AS DOUBLE) AS val FROM {p.d.each('embeddings', 'embedding')}")
    n = p.add("n", f"SELECT *, min(val) OVER (PARTITION BY image_id) AS lo, max(val) OVER (PARTITION BY image_id) AS hi FROM {e}")
    return p.add("tile", f"SELECT image_id, label, CAST({p.d.idiv('pos', '8')} AS INT) AS y, CAST(pos % 8 AS INT) AS x, CASE WHEN hi > lo THEN (val - lo) / (hi - lo) ELSE 0e0 END AS l FROM {n}")
