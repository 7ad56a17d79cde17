"""Revisions of documents as relations: liveness, versions, snapshots, reachability, leftovers, classes, twins.

Inputs are the tables of foliant.sources.pdf, or any relations of the same columns. Distances are in bytes.
"""

from __future__ import annotations

from foliant.constants import OPAQUE
from foliant.operators.text import IDENTIFIERS
from foliant.plans.sql import Plan, as_frame

LIVE_WITHIN, OBJECT_WITHIN, XREF_WITHIN = 8, 16, 32
# The classes, in order of precedence.
CLASSES = ("text_under_vector_overlay", "old_revision_survives", "object_deleted_bytes_remain", "text_converted_to_outlines", "text_rasterized_into_image", "sanitized_rewrite")
OUTLINE_STEPS = 8
OPS = {"locate": "locate", "unredact": "locate", "redact-locate": "locate", "lift": "lift", "lift-overlay": "lift", "recover": "recover", "leftover": "recover", "leftover-bytes": "recover", "refuse": "refuse", "": "locate"}


def live(p: Plan, xref: str) -> str:
    """(filename, id, place, objstm, slot): per object the entry of its last revision, unless only freed there."""
    r = p.add("r", f"SELECT *, row_number() OVER (PARTITION BY filename, id ORDER BY rev DESC, CASE WHEN flag = 'n' THEN 0 ELSE 1 END, place DESC) AS k FROM {xref}")
    return p.add("live", f"SELECT filename, id, place, objstm, slot FROM {r} WHERE k = 1 AND flag = 'n'")


def instances(p: Plan, objects: str, xref: str) -> str:
    """Object instances with is_live: at the live entry's place, within LIVE_WITHIN bytes, or in its object stream."""
    l = live(p, xref)
    return p.add(
        "inst",
        f"""SELECT o.*, (l.id IS NOT NULL AND ((o.parent IS NULL AND l.objstm IS NULL AND abs(o.place - l.place) <= {LIVE_WITHIN}) OR (o.parent IS NOT NULL AND o.parent = l.objstm))) AS is_live
        FROM {objects} o LEFT JOIN {l} l ON o.filename = l.filename AND o.id = l.id""",
    )


def leftovers(p: Plan, objects: str, xref: str) -> str:
    """Instances that are not live, by kind."""
    i = instances(p, objects, xref)
    w = p.add("w", f"SELECT *, max(CASE WHEN is_live THEN 1 ELSE 0 END) OVER (PARTITION BY filename, id) AS has_live, max(gen) OVER (PARTITION BY filename, id) AS last_gen FROM {i}")
    return p.add(
        "leftover",
        f"""SELECT filename, id, gen, place, CASE WHEN parent IS NOT NULL THEN 'unused-objstm-member' WHEN gen < last_gen THEN 'prior-generation' WHEN has_live = 1 AND has_stream THEN 'prior-stream'
        WHEN has_live = 1 THEN 'incremental-revision' WHEN has_stream THEN 'orphan-stream' ELSE 'unused-object' END AS kind, stream_bytes, stream_sha256, false AS invented FROM {w} WHERE NOT is_live""",
    )


def first_last(p: Plan, versions: str) -> str:
    """(id, n, first_value, last_value, changed): the first and last version (id, pos, value) of each object with several."""
    w = p.add("w", f"SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY pos) AS a, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS z, count(*) OVER (PARTITION BY id) AS n FROM {versions}")
    return p.add("fl", f"SELECT id, max(n) AS n, max(CASE WHEN a = 1 THEN value END) AS first_value, max(CASE WHEN z = 1 THEN value END) AS last_value, max(CASE WHEN a = 1 THEN value END) <> max(CASE WHEN z = 1 THEN value END) AS changed FROM {w} WHERE n > 1 GROUP BY id")


def nearest(p: Plan, wants: str, have: str, within: int = OBJECT_WITHIN) -> str:
    """For each want (id, at), the nearest place (id, pos) of the same id within so many bytes, the first of equals."""
    j = p.add("j", f"SELECT w.id AS id, w.at AS at, h.pos AS pos, row_number() OVER (PARTITION BY w.id, w.at ORDER BY abs(h.pos - w.at), h.pos) AS k FROM {wants} w JOIN {have} h ON w.id = h.id AND h.pos BETWEEN w.at - {within} AND w.at + {within}")
    return p.add("nearest", f"SELECT w.id AS id, w.at AS at, j.pos AS pos FROM {wants} w LEFT JOIN {j} j ON w.id = j.id AND w.at = j.at AND j.k = 1")


def snapshot_diff(p: Plan, a: str, b: str, within: int = LIVE_WITHIN) -> str:
    """(id, change, pos_a, pos_b) between snapshots (id, pos) of two revisions."""
    j = p.add("fo", f"SELECT coalesce(a.id, b.id) AS id, a.pos AS pos_a, b.pos AS pos_b FROM {a} a FULL OUTER JOIN {b} b ON a.id = b.id")
    return p.add("diff", f"SELECT id, CASE WHEN pos_a IS NULL THEN 'added' WHEN pos_b IS NULL THEN 'deleted' WHEN abs(pos_a - pos_b) > {within} THEN 'replaced' ELSE 'same' END AS change, pos_a, pos_b FROM {j}")


def cumulative(p: Plan, xref: str) -> str:
    """(filename, rev, objects, added, freed): live objects after each revision."""
    e = p.add("e", f"SELECT filename, rev, id, max(CASE WHEN flag = 'n' THEN 1 ELSE 0 END) AS is_n FROM {xref} GROUP BY filename, rev, id")
    s = p.add("s", f"SELECT *, lag(is_n) OVER (PARTITION BY filename, id ORDER BY rev) AS was FROM {e}")
    c = p.add("c", f"SELECT filename, rev, count(CASE WHEN is_n = 1 AND coalesce(was, 0) = 0 THEN 1 END) AS added, count(CASE WHEN is_n = 0 AND was = 1 THEN 1 END) AS freed, count(CASE WHEN is_n = 1 AND was = 1 THEN 1 END) AS replaced FROM {s} GROUP BY filename, rev")
    return p.add("cum", f"SELECT *, CAST(sum(added - freed) OVER (PARTITION BY filename ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS objects FROM {c}")


def reach(p: Plan, refs: str, roots: str, depth: int = 32) -> str:
    """(grp, id, depth) of all that roots (grp, id) reach over refs (grp, src, dst), at its least depth; cycles end."""
    p.recursive = True
    name = p.add("walk", "")
    p.steps[-1] = (
        name,
        f"""SELECT grp, id, 0 AS depth, concat('|', CAST(id AS VARCHAR(20)), '|') AS path FROM {roots}
        UNION ALL SELECT w.grp AS grp, r.dst AS id, w.depth + 1 AS depth, concat(w.path, CAST(r.dst AS VARCHAR(20)), '|') AS path FROM {name} w JOIN {refs} r ON w.grp = r.grp AND w.id = r.src
        WHERE w.depth < {depth} AND {p.d.find('w.path', "concat('|', CAST(r.dst AS VARCHAR(20)), '|')")} = 0""",
    )
    return p.add("reach", f"SELECT grp, id, min(depth) AS depth FROM {name} GROUP BY grp, id")


def under_overlay(p: Plan, drawn: str) -> str:
    """Text runs with the first dark box painted after them in the same stream; places on the page are not compared."""
    o = p.add("o", f"SELECT filename, id, place, pos FROM {drawn} WHERE kind = 'overlay'")
    j = p.add("j", f"SELECT t.filename AS filename, t.id AS id, t.place AS place, t.seq AS seq, t.text AS text, t.pos AS pos, min(o.pos) AS overlay_pos FROM {drawn} t JOIN {o} o ON t.filename = o.filename AND t.id = o.id AND t.place = o.place AND o.pos > t.pos WHERE t.kind = 'text' GROUP BY t.filename, t.id, t.place, t.seq, t.text, t.pos")
    return p.add("under", f"SELECT *, false AS invented FROM {j}")


def redaction_class(p: Plan, facts: str) -> str:
    """class of files (.., under, old_revision, deleted, has_text, path_steps, images) by precedence."""
    tests = ("under > 0", "old_revision", "deleted", f"NOT has_text AND path_steps >= {OUTLINE_STEPS}", "NOT has_text AND images > 0")
    arms = " ".join(f"WHEN {t} THEN '{c}'" for t, c in zip(tests, CLASSES, strict=False))
    return p.add("classed", f"SELECT *, CASE {arms} WHEN has_text THEN '{CLASSES[0]}' ELSE '{CLASSES[-1]}' END AS class FROM {facts}")


def decide(p: Plan, facts: str) -> str:
    """Outcome and refusal code of requests (.., op, leftover, recovered, opaque, residual, flattened).

    Leftover bytes can be recovered; a cover that is not opaque can be lifted; a lift that cannot falls back to
    recovery; an opaque cover with nothing left is refused.
    """
    refuse = "((opaque OR flattened) AND NOT leftover)"
    can_recover, can_lift = "(leftover AND recovered)", "(residual AND NOT opaque)"
    return p.add(
        "decided",
        f"""SELECT *, CASE WHEN op = 'refuse' THEN 'refuse' WHEN op = 'recover' THEN CASE WHEN {can_recover} THEN 'recover' ELSE 'refuse' END
        WHEN op = 'lift' THEN CASE WHEN {refuse} THEN 'refuse' WHEN {can_lift} THEN 'lift' WHEN {can_recover} THEN 'recover' ELSE 'refuse' END ELSE 'locate' END AS outcome,
        CASE WHEN (op = 'recover' AND NOT {can_recover}) OR (op = 'lift' AND ({refuse} OR NOT ({can_lift} OR {can_recover}))) OR (op IN ('refuse', 'locate') AND {refuse}) THEN '{OPAQUE}' END AS refuse_code, false AS inject FROM {facts}""",
    )


def op_of(name: str) -> str:
    key = name.strip().lower().replace("_", "-")
    if key not in OPS:
        raise ValueError(f"unknown unredact op {name!r}; known: {', '.join(sorted(o for o in OPS if o))}")
    return OPS[key]


def previous(p: Plan, tables: str) -> str:
    """(filename, rev, prev, prev_rev): the table that each table's /Prev means, of tables (filename, rev, place, startxref, prev).

    The table at that place, else the nearest by place or startxref within XREF_WITHIN bytes, the earliest of equals;
    null if there is none. A pointer to the startxref word itself is not followed.
    """
    if p.d.name == "spark":  # one pass over the tables
        spots = p.add("spots", f"SELECT filename, rev, spot, kind FROM {tables} LATERAL VIEW stack(2, CAST(place AS BIGINT), 0, CAST(startxref AS BIGINT), 1) e AS spot, kind WHERE spot IS NOT NULL")
    else:
        spots = p.add("spots", f"SELECT filename, rev, place AS spot, 0 AS kind FROM {tables} UNION ALL SELECT filename, rev, startxref AS spot, 1 AS kind FROM {tables} WHERE startxref IS NOT NULL")
    j = p.add(
        "prevs",
        f"""SELECT t.filename AS filename, t.rev AS rev, s.rev AS prev_rev, row_number() OVER (PARTITION BY t.filename, t.rev ORDER BY CASE WHEN s.kind = 0 AND s.spot = t.prev THEN 0 ELSE 1 END, abs(s.spot - t.prev), s.rev, s.kind) AS k
        FROM {tables} t JOIN {spots} s ON t.filename = s.filename AND s.spot BETWEEN t.prev - {XREF_WITHIN} AND t.prev + {XREF_WITHIN}""",
    )
    return p.add("previous", f"SELECT t.filename AS filename, t.rev AS rev, t.prev AS prev, j.prev_rev AS prev_rev FROM {tables} t LEFT JOIN {j} j ON t.filename = j.filename AND t.rev = j.rev AND j.k = 1")


def _chain_in_arrays(p: Plan, prevs: str, block: int = 1000) -> str:
    """chain() with one array a file. Places seen are kept by blocks of steps, so that long files are not copied at each step.

    Values used more than once are bound by a lambda: Spark copies a column's expression to where it is used, and would
    compute it at each step.
    """
    let = lambda name, x, body: f"transform(array({x}), {name} -> {body})[0]"
    state = "named_struct('at', {}, 'seen', {})".format
    place = lambda x: f"CASE WHEN dense THEN {x} - lo + 1 ELSE CAST(array_position(revs, {x}) AS INT) END"
    inner = f"aggregate(sequence(1, least({block}, size(t) - b * {block})), {state('s.at', 'CAST(array() AS ARRAY<INT>)')}, (u, i) -> CASE WHEN u.at IS NULL THEN u ELSE {state('nexts[u.at - 1]', 'array_append(u.seen, u.at)')} END)"
    walk = f"aggregate(sequence(0, (size(t) - 1) div {block}), {state(place('array_max(revs)'), 'CAST(array() AS ARRAY<ARRAY<INT>>)')}, (s, b) -> CASE WHEN s.at IS NULL THEN s ELSE {let('c', inner, state('c.at', 'array_append(s.seen, c.seen)'))} END, s -> flatten(s.seen))"
    rows = "transform(CASE WHEN walked THEN reverse(seen) ELSE sequence(1, size(t)) END, (at, i) -> named_struct('rev', revs[at - 1], 'node', i, 'walked', walked))"
    body = let("seen", walk, let("walked", "size(array_distinct(seen)) = size(t)", rows))
    body = let("lo", "array_min(revs)", let("dense", "array_max(revs) - lo = size(t) - 1 AND size(array_distinct(revs)) = size(t) AND revs[0] IS NOT NULL", let("nexts", f"transform(t, x -> {place('x.prev_rev')})", body)))
    f = p.add("files", f"SELECT filename, collect_list(struct(rev, prev_rev)) AS tables FROM {prevs} GROUP BY filename")
    return p.add("chain", f"SELECT filename, rev, node, walked FROM {f} LATERAL VIEW inline({let('t', 'sort_array(tables)', let('revs', 't.rev', body))}) e AS rev, node, walked")


def chain(p: Plan, prevs: str) -> str:
    """(filename, rev, node, walked): a file's revisions in order, from previous(); the tip is the last one.

    The chain of /Prev from the tip, reversed; all tables in their order if the chain misses some. A file's walk has as
    many steps as it has tables at most, so a loop of pointers ends. Spark walks each file in an array, as its recursion
    stops at a million rows in all and at 100 steps.
    """
    if p.d.name == "spark":
        return _chain_in_arrays(p, prevs)
    p.recursive = True
    n = p.add("n", f"SELECT filename, max(rev) AS tip, count(*) AS tables FROM {prevs} GROUP BY filename")
    walk = p.add("walk", "")
    p.steps[-1] = (
        walk,
        f"""SELECT n.filename AS filename, n.tip AS rev, 0 AS step FROM {n} n
        UNION ALL SELECT w.filename AS filename, v.prev_rev AS rev, w.step + 1 AS step FROM {walk} w JOIN {prevs} v ON w.filename = v.filename AND w.rev = v.rev JOIN {n} n ON w.filename = n.filename
        WHERE v.prev_rev IS NOT NULL AND w.step + 1 < n.tables""",
    )
    first = p.add("seen", f"SELECT filename, rev, min(step) AS step FROM {walk} GROUP BY filename, rev")
    met = p.add("met", f"SELECT filename, count(*) AS met FROM {first} GROUP BY filename")
    return p.add(
        "chain",
        f"""SELECT v.filename AS filename, v.rev AS rev, CAST(row_number() OVER (PARTITION BY v.filename ORDER BY CASE WHEN m.met = n.tables THEN -f.step ELSE v.rev END) - 1 AS INT) AS node, m.met = n.tables AS walked
        FROM {prevs} v JOIN {n} n ON v.filename = n.filename JOIN {met} m ON v.filename = m.filename LEFT JOIN {first} f ON v.filename = f.filename AND v.rev = f.rev""",
    )


def revision_edges(p: Plan, xref: str, objects: str) -> str:
    """(filename, rev, id, change): what each revision does to each object that it lists.

    added; replaced (moved by more than LIVE_WITHIN bytes, or another object stream or slot); kept; deleted, or
    detached if an instance's bytes still stand at the former place.
    """
    one = p.add("one", f"SELECT *, row_number() OVER (PARTITION BY filename, rev, id ORDER BY CASE WHEN flag = 'n' THEN 0 ELSE 1 END, place DESC) AS k FROM {xref}")
    lag = lambda c: f"lag({c}) OVER (PARTITION BY filename, id ORDER BY rev) AS was_{c}"
    s = p.add("steps", f"SELECT *, {lag('flag')}, {lag('place')}, {lag('objstm')}, {lag('slot')} FROM {one} WHERE k = 1")
    gone = p.add("gone", f"SELECT DISTINCT s.filename AS filename, s.rev AS rev, s.id AS id FROM {s} s JOIN {objects} o ON s.filename = o.filename AND s.id = o.id AND abs(o.place - s.was_place) <= {LIVE_WITHIN} WHERE s.flag = 'f' AND s.was_flag = 'n'")
    moved = f"abs(s.place - s.was_place) > {LIVE_WITHIN} OR coalesce(s.objstm, -1) <> coalesce(s.was_objstm, -1) OR coalesce(s.slot, -1) <> coalesce(s.was_slot, -1)"
    return p.add(
        "edges",
        f"""SELECT s.filename AS filename, s.rev AS rev, s.id AS id, CASE WHEN s.flag = 'n' AND coalesce(s.was_flag, 'f') = 'f' THEN 'added' WHEN s.flag = 'n' AND ({moved}) THEN 'replaced' WHEN s.flag = 'n' THEN 'kept'
        WHEN s.was_flag = 'n' AND g.id IS NOT NULL THEN 'detached' WHEN s.was_flag = 'n' THEN 'deleted' ELSE 'free' END AS change
        FROM {s} s LEFT JOIN {gone} g ON s.filename = g.filename AND s.rev = g.rev AND s.id = g.id""",
    )


#: The keys of a page whose references a revision may change.
PAGE_KEYS = ("Contents", "Resources", "Annots", "XObject", "Parent")


def page_keys(p: Plan, refs: str) -> str:
    """(filename, page, key, refs): the references of a page's keys, in order, of refs (filename, page, key, seq, id, gen)."""
    keys = ", ".join(f"'{k}'" for k in PAGE_KEYS)
    one = p.add("refs", f"SELECT filename, page, key, seq, concat(CAST(id AS VARCHAR(20)), ' ', CAST(gen AS VARCHAR(20))) AS ref FROM {refs} WHERE key IN ({keys})")
    return p.add("keys", f"SELECT filename, page, key, {p.d.text_agg('ref', 'seq', ', ')} AS refs FROM {one} GROUP BY filename, page, key")


def change_kind(p: Plan, facts: str) -> str:
    """kind of changes (.., has_old, has_new, old_stream, new_stream, remain, under, old_text, new_overlays, equal)."""
    stays = "CASE WHEN remain THEN 'replaced' ELSE 'sanitized_rewrite' END"
    return p.add(
        "kinds",
        f"""SELECT *, CASE WHEN has_old AND NOT has_new THEN CASE WHEN remain THEN 'detached' ELSE 'sanitized_rewrite' END WHEN has_new AND NOT has_old THEN 'replaced' WHEN NOT has_old THEN 'sanitized_rewrite'
        WHEN NOT old_stream AND NOT new_stream AND equal THEN 'replaced' WHEN old_stream AND new_stream AND under THEN 'overlaid' ELSE {stays} END AS kind FROM {facts}""",
    )


def xref_revision(p: Plan, objects: str, xref: str) -> str:
    """(filename, id, place, xref_rev): the last revision whose table lists an instance; null if none does."""
    m = p.add("listed", f"SELECT o.filename AS filename, o.id AS id, o.place AS place, max(x.rev) AS xref_rev FROM {objects} o JOIN {xref} x ON o.filename = x.filename AND o.id = x.id AND x.flag = 'n' AND ((o.parent IS NULL AND x.objstm IS NULL AND abs(o.place - x.place) <= {LIVE_WITHIN}) OR o.parent = x.objstm) GROUP BY o.filename, o.id, o.place")
    return p.add("xrev", f"SELECT DISTINCT o.filename AS filename, o.id AS id, o.place AS place, m.xref_rev AS xref_rev FROM {objects} o LEFT JOIN {m} m ON o.filename = m.filename AND o.id = m.id AND o.place = m.place")


def embeds(p: Plan, objects: str, refs: str, xref: str, cap: int | None = None) -> str:
    """Embedded files of every revision in which they are live, one row each, with digest and type.

    objects (filename, id, gen, place, marked, name, head, bytes, sha256): instances, marked if they speak of embedded
    files; head, the first four bytes as Latin letters, bytes and sha256 are null without a stream. refs (filename,
    id, seq, child): what a marked object without a stream points at; the first with a stream counts. xref (filename,
    rev, id, flag, place). Payloads above ``cap`` bytes are marked as omitted. A listing spans the revisions up to the
    next one of its id, and means the nearest instance.
    """
    e = p.add("entries", f"SELECT filename, id, rev, flag, place, lead(rev) OVER (PARTITION BY filename, id ORDER BY rev) AS until FROM {xref}")
    v = p.add("revs", f"SELECT DISTINCT filename, rev FROM {xref}")
    n = p.add(
        "near",
        f"""SELECT o.*, e.rev AS since, e.until AS until, row_number() OVER (PARTITION BY o.filename, o.id, e.rev ORDER BY abs(o.place - e.place), o.place) AS k
        FROM {objects} o JOIN {e} e ON o.filename = e.filename AND o.id = e.id AND e.flag = 'n' AND abs(o.place - e.place) <= {LIVE_WITHIN}""",
    )
    at = p.add("at", f"SELECT n.*, v.rev AS rev FROM {n} n JOIN {v} v ON n.filename = v.filename AND v.rev >= since AND (until IS NULL OR v.rev < until) WHERE k = 1 AND (marked OR bytes IS NOT NULL)")
    c = p.add(
        "pointed",
        f"""SELECT a.filename AS filename, a.rev AS rev, a.id AS id, a.gen AS gen, a.place AS place, a.name AS name, c.head AS head, c.bytes AS bytes, c.sha256 AS sha256,
        row_number() OVER (PARTITION BY a.filename, a.rev, a.id ORDER BY r.seq) AS first
        FROM {at} a JOIN {refs} r ON a.filename = r.filename AND a.id = r.id JOIN {at} c ON a.filename = c.filename AND a.rev = c.rev AND r.child = c.id WHERE a.marked AND a.bytes IS NULL AND c.bytes IS NOT NULL""",
    )
    cols = "filename, rev, id, gen, place, name, head, bytes, sha256"
    u = p.add("u", f"SELECT {cols} FROM {at} WHERE marked AND bytes IS NOT NULL UNION ALL SELECT {cols} FROM {c} WHERE first = 1")
    office = "application/vnd.openxmlformats-officedocument."
    kind = (
        f"CASE WHEN head = '%PDF' THEN 'application/pdf' WHEN head = {p.d.lit(chr(137) + 'PNG')} THEN 'image/png' WHEN substr(head, 1, 3) = {p.d.lit(chr(255) + chr(216) + chr(255))} THEN 'image/jpeg' "
        f"WHEN substr(head, 1, 2) = 'PK' THEN CASE WHEN low LIKE '%.docx' THEN '{office}wordprocessingml.document' WHEN low LIKE '%.xlsx' THEN '{office}spreadsheetml.sheet' ELSE 'application/zip' END "
        "WHEN low LIKE '%.txt' THEN 'text/plain' WHEN low LIKE '%.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END"
    )
    named = p.add("titled", f"SELECT *, lower(title) AS low FROM (SELECT *, coalesce(nullif(name, ''), concat('embed-', CAST(id AS VARCHAR(20)))) AS title FROM {u}) q")
    omitted = f"CASE WHEN bytes > {cap} THEN 'hosted-preview-cap' END" if cap else "CAST(NULL AS VARCHAR(40))"
    return p.add(
        "embeds",
        f"""SELECT filename, rev AS source_revision, concat(CAST(id AS VARCHAR(20)), ' ', CAST(gen AS VARCHAR(20))) AS object_id, place, title AS embed_name, {kind} AS media_type,
        bytes AS byte_length, sha256, {omitted} AS omitted, false AS invented FROM {named}""",
    )


def stream_compare(p: Plan, streams: str, parts: str) -> str:
    """(id, bytes_differ, bytes_old, bytes_new, sha256_old, sha256_new, and what only one side has, in order and comma-joined).

    ``streams`` (id, side, bytes, sha256) and ``parts`` (id, side, kind, value), side old or new, kind string, glyph or xobject.
    """
    one = p.add("sides", f"SELECT id, max(CASE WHEN side = 'old' THEN bytes END) AS bytes_old, max(CASE WHEN side = 'new' THEN bytes END) AS bytes_new, max(CASE WHEN side = 'old' THEN sha256 END) AS sha256_old, max(CASE WHEN side = 'new' THEN sha256 END) AS sha256_new FROM {streams} GROUP BY id")
    lone = p.add("lone", f"SELECT id, kind, value, min(side) AS side FROM {parts} GROUP BY id, kind, value HAVING min(side) = max(side)")
    only = lambda k, s: f"SELECT id, {p.d.text_agg('value', 'value')} AS v FROM {lone} WHERE kind = '{k}' AND side = '{s}' GROUP BY id"
    found = {f"{k}s_only_in_{s}": p.add("only", only(k, s)) for k, s in (("string", "old"), ("string", "new"), ("glyph", "old"), ("xobject", "old"))}
    joins = " ".join(f"LEFT JOIN {t} ON s.id = {t}.id" for t in found.values())
    return p.add("streams", f"SELECT s.id AS id, sha256_old <> sha256_new AS bytes_differ, bytes_old, bytes_new, sha256_old, sha256_new, {', '.join(f'{t}.v AS {c}' for c, t in found.items())}, false AS invented FROM {one} s {joins}")


def image_compare(p: Plan, versions: str) -> str:
    """(id, aligned, same_bytes, raster_in_old): first against last version of image objects (id, pos, width, height, sha256)."""
    w = p.add("v", f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS a, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS z FROM {versions}")
    same = "o.sha256 IS NOT NULL AND n.sha256 IS NOT NULL AND o.sha256 = n.sha256"
    return p.add("images", f"SELECT o.id AS id, o.width = n.width AND o.height = n.height AS aligned, {same} AS same_bytes, o.sha256 IS NOT NULL AND NOT ({same}) AS raster_in_old, false AS invented FROM {w} o JOIN {w} n ON o.id = n.id WHERE o.a = 1 AND n.z = 1")


def page_boxes(p: Plan, objects: str) -> str:
    """(id, k, x0, y0, x1, y1): the MediaBox of each page object, of bodies (id, t)."""
    from foliant.operators.text import matches

    number = r"-?[0-9]+(?:[.][0-9]+)?"
    pages = p.add("pages", f"SELECT id, t FROM {objects} WHERE {p.d.like('t', '/Type */Page[^a-zA-Z]')}")
    m = matches(p, pages, rf"/MediaBox *[\[] *({number} +{number} +{number} +{number}) *[\]]", 1)
    parts = p.add("nums", f"SELECT id, k, {p.d.all('part', number)} AS v FROM {m}")
    at = ", ".join(f"CAST({p.d.at('v', str(i))} AS DOUBLE) AS {c}" for i, c in enumerate(("x0", "y0", "x1", "y1"), 1))
    return p.add("boxes", f"SELECT id, k, {at} FROM {parts}")


def twins(p: Plan, a: str, b: str) -> str:
    """(side, value): strings (t) that only one of two documents has, and identifiers that both have."""
    d = p.d
    only = [p.add("only", f"SELECT DISTINCT t FROM {x} EXCEPT SELECT t FROM {y}") for x, y in ((a, b), (b, a))]
    found = []
    for x in (a, b):
        arms = " UNION ALL ".join(f"SELECT '{kind}' AS kind, val AS value FROM {d.each(x, d.all('t', pattern))}" for kind, pattern in IDENTIFIERS)
        found.append(p.add("ids", f"SELECT DISTINCT kind, value FROM ({arms}) q"))
    return p.add("twins", f"SELECT 'only_in_first' AS side, t AS value FROM {only[0]} UNION ALL SELECT 'only_in_second' AS side, t AS value FROM {only[1]} UNION ALL SELECT concat('shared:', x.kind) AS side, x.value AS value FROM {found[0]} x JOIN {found[1]} y ON x.kind = y.kind AND x.value = y.value")


def eof_spans(p: Plan, src: str) -> str:
    """(id, k, pos, next_pos): ends of revisions in texts (id, t) that hold %%EOF marks, each with the next one."""
    from foliant.operators.text import matches

    m = matches(p, src, "%%EOF")
    return p.add("eof", f"SELECT id, k, pos, lead(pos) OVER (PARTITION BY id ORDER BY k) AS next_pos FROM {m}")


live_objects, object_leftovers, text_under_overlay, redaction_classes, decisions, reachable = map(as_frame, (live, leftovers, under_overlay, redaction_class, decide, reach))
