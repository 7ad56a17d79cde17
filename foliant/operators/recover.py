"""Recovered items, files and revisions as relations: dedup, diffs, sidecars, correlation, provenance, decisions."""

from __future__ import annotations

from foliant.operators.text import FLAG_NAME
from foliant.plans.sql import Plan, as_frame

# Suffixes of sidecar files, confidence by state, and the formats with their status.
SIDECARS = (".json", ".xml", ".xmp", ".txt", ".csv", ".log", ".bak", ".old", ".tmp", ".autosave", ".manifest", ".rels")
CONFIDENCE = {
    "present_current": 1.00, "present_prior_revision": 0.90, "present_sidecar": 0.85, "present_attachment": 0.85, "present_embedded": 0.95, "present_thumbnail": 0.95,
    "present_metadata": 0.95, "present_orphan": 0.95, "present_database_freelist": 0.95,
}
FORMATS = {
    "pdf": "live", "docx": "live", "xlsx": "live", "pptx": "live", "odt": "live", "ods": "live", "odp": "live", "epub": "live", "doc": "live", "xls": "live", "ppt": "live",
    "rtf": "live", "txt": "live", "csv": "live", "tsv": "live", "md": "live", "html": "live", "htm": "live", "xml": "live", "svg": "live", "json": "live", "jsonl": "live",
    "yaml": "live-scan", "yml": "live-scan", "zip": "live", "tar": "live", "gz": "live", "7z": "slot", "png": "live", "jpeg": "live", "jpg": "live", "tiff": "slot", "tif": "slot",
    "gif": "slot", "bmp": "live", "webp": "slot", "heic": "slot", "heif": "slot", "eml": "live", "mbox": "live", "msg": "live-ole", "sqlite": "live", "db": "live", "ipynb": "live",
    "source": "live", "log": "live", "git": "live", "bin": "live-carve",
}
SOURCE = ("py", "js", "ts", "tsx", "jsx", "java", "c", "cc", "cpp", "h", "go", "rs", "rb", "php", "sh", "bash", "env", "ini", "cfg", "toml", "lock", "gradle")
HTML = r"(?is)<(?:!doctype\s+html|html|head|body)\b"
EML = r"(?im)^(?:from|to|subject|message-id|mime-version):"
JSON = r"^\s*[\[{]"
OPS = {
    "locate": "locate", "deep": "deep-recover", "deep-recover": "deep-recover", "revision-graph": "revision-graph", "compare": "cross-compare", "cross-compare": "cross-compare",
    "extract-embedded": "extract-embedded", "scan-orphans": "scan-orphans", "scan-metadata": "scan-metadata", "scan-sidecars": "scan-sidecars", "scan-history": "scan-history",
    "refuse": "refuse", "production": "locate", "redactions": "deep-recover",
}


def op_of(name: str | None) -> str:
    """The operation that a name stands for, locate by default; unknown names raise."""
    key = (name or "locate").strip().lower().replace("_", "-")
    if key not in OPS:
        raise ValueError(f"unknown recover op {name!r}; known: {', '.join(sorted(set(OPS.values())))}")
    return OPS[key]


def formats(p: Plan) -> str:
    return p.add("formats", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}')" for k, s in FORMATS.items()) + ") AS t(kind, status)")


def extension(d, name: str) -> str:
    """Lower-cased letters after the last dot of the last path part; '' if there is none."""
    return f"lower({d.one(name, '[.]([^./' + chr(92) * 2 + ']*)$', 1)})"


def detect(p: Plan, src: str) -> str:
    """Kind, status and evidence of text artifacts (id, filename, t) by their content first; a name alone confirms nothing.

    Binary kinds are found by magic bytes in foliant.sources.artifacts.
    """
    d = p.d
    e = p.add("e", f"SELECT id, filename, t, {extension(d, 'filename')} AS ext, substr(t, 1, 4096) AS head FROM {src}")
    named = lambda *xs: "ext IN (" + ", ".join(f"'{x}'" for x in xs) + ")"
    rules = (
        ("substr(t, 1, 4) = '%PDF'", "'pdf'", "'magic:%PDF'"),
        (f"substr(t, 1, 5) = {d.lit('{' + chr(92) + 'rtf')}", "'rtf'", "'magic:rtf'"),
        ("ltrim(head) LIKE '<?xml%' AND head LIKE '%<svg%' OR ltrim(head) LIKE '<svg%'", "'svg'", "'parser:svg'"),
        ("ltrim(head) LIKE '<?xml%'", "'xml'", "'parser:xml-decl'"),
        (f"head LIKE 'From %' AND {d.find('substr(t, 1, 8000)', d.lit(chr(10) + 'From '))} > 0", "'mbox'", "'parser:mbox-from'"),
        (d.like("head", EML), "'eml'", "'parser:rfc822-headers'"),
        (d.like("substr(t, 1, 2000)", HTML), "'html'", "'parser:html'"),
        (f"{named('ipynb')}", "'ipynb'", "'parser:ipynb'"),
        (f"{named('jsonl')}", "'jsonl'", "'ext+text'"),
        (f"{d.like('head', JSON)} AND ext IN ('json', '')", "'json'", "'parser:json'"),
        (named("yaml", "yml"), "'yaml'", "'ext+text-scan'"),
        (named("csv", "tsv"), "ext", "concat('ext:', ext)"),
        (named("md", "markdown"), "'md'", "'ext:md'"),
        (named(*SOURCE), "'source'", "'ext:source'"),
        (named("log"), "'log'", "'ext:text'"),
        (named("txt"), "'txt'", "'ext:text'"),
    )
    kind = "CASE " + " ".join(f"WHEN {t} THEN {k}" for t, k, _ in rules) + " END"
    evidence = "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, _, v in rules) + " END"
    k = p.add("k", f"SELECT id, filename, ext, {kind} AS found, {evidence} AS evidence, CAST(length(t) AS BIGINT) AS chars, {d.sha('t')} AS sha256 FROM {e}")
    f = formats(p)
    n = p.add("n", f"SELECT k.*, CASE WHEN found IS NOT NULL THEN found WHEN f.kind IS NOT NULL THEN ext ELSE 'bin' END AS kind, CASE WHEN found IS NOT NULL THEN evidence WHEN f.kind IS NOT NULL THEN concat('ext-only:', ext) END AS why FROM {k} k LEFT JOIN {f} f ON k.ext = f.kind")
    return p.add("detected", f"SELECT id, filename, ext AS extension, n.kind AS kind, f.status AS status, found IS NOT NULL AS confirmed, why AS evidence, chars, sha256, false AS invented FROM {n} n JOIN {f} f ON n.kind = f.kind")


def dedup(p: Plan, items: str) -> str:
    """The first (by seq) of items (file, seq, kind, path, preview, pos) that agree in kind, path, preview and place."""
    r = p.add("r", f"SELECT *, row_number() OVER (PARTITION BY file, kind, path, preview, pos ORDER BY seq) AS k FROM {items}")
    return p.add("dedup", f"SELECT file, seq, kind, path, preview, pos FROM {r} WHERE k = 1")


def revision_diff(p: Plan, old: str, new: str, cap: int = 80) -> str:
    """(side, preview): what previews (preview) of one revision lack in the other, sorted, at most ``cap`` a side."""
    parts = []
    for side, a, b in (("removed", old, new), ("added", new, old)):
        only = p.add(side, f"SELECT DISTINCT trim(preview) AS preview FROM {a} WHERE trim(preview) <> '' EXCEPT SELECT trim(preview) AS preview FROM {b}")
        parts.append(p.add("top", f"SELECT '{side}' AS side, preview, CAST(row_number() OVER (ORDER BY preview) AS BIGINT) AS k FROM (SELECT preview FROM {only} ORDER BY preview LIMIT {cap}) q"))
    return p.add("diff", " UNION ALL ".join(f"SELECT side, k, preview FROM {t}" for t in parts))


def sidecars(p: Plan, files: str) -> str:
    """Pairs of files (name, stem) where the second, a sidecar by suffix or flag word, holds the first's stem in its name.

    Each sidecar's name is cut into the pieces whose length some stem has, and these are equi-joined with the
    stems, so that no file is compared with every other.
    """
    d = p.d
    suffix = " OR ".join(f"lower(name) LIKE '%{s}'" for s in SIDECARS)
    side = p.add("side", f"SELECT name AS sidecar FROM {files} WHERE {suffix} OR {d.like('name', FLAG_NAME)}")
    sizes = p.add("sizes", f"SELECT DISTINCT length(stem) AS n FROM {files} WHERE stem <> ''")
    at = p.add("at", f"SELECT CAST(id + 1 AS INT) AS i FROM {d.numbers(255)} q")  # a file name has 255 bytes at most
    cuts = p.add("cuts", f"SELECT DISTINCT sidecar, substr(lower(sidecar), i, CAST(n AS INT)) AS piece FROM {side} JOIN {sizes} ON n <= length(sidecar) JOIN {at} ON i <= length(sidecar) - n + 1")
    return p.add("sidecars", f"SELECT name AS primary_name, sidecar, 'basename/suffix' AS reason, false AS invented FROM {files} JOIN {cuts} ON lower(stem) = piece AND sidecar <> name")


def correlate(p: Plan, files: str) -> str:
    """(production, a, b, reasons) of files (production, seq, name, stem, kind, sha256): pairs of one production that share something.

    Reasons: same kind, same content, equal first 8 letters of different stems, a flag word in either name. A
    production is a folder of files; files of different productions are never paired.
    """
    d = p.d
    j = p.add(
        "j",
        f"""SELECT a.production AS production, a.seq AS sa, a.name AS a, b.name AS b, a.kind = b.kind AS k1, a.sha256 = b.sha256 AS k2,
        (substr(a.stem, 1, 8) = substr(b.stem, 1, 8) AND a.stem <> b.stem AND a.stem <> '') AS k3, (a.flagged OR b.flagged) AS k4
        FROM (SELECT *, {d.like('name', FLAG_NAME)} AS flagged FROM {files}) a JOIN (SELECT *, {d.like('name', FLAG_NAME)} AS flagged FROM {files}) b ON a.production = b.production AND a.seq < b.seq""",
    )
    names = ("same-kind", "same-sha256", "bates-stem", "flag-name")
    reasons = "concat(" + ", ".join(f"CASE WHEN k{i + 1} THEN '{n},' ELSE '' END" for i, n in enumerate(names)) + ")"
    return p.add("correlated", f"SELECT production, a, b, {reasons} AS reasons, false AS invented FROM {j} WHERE k1 OR k2 OR k3 OR k4")


#: Kinds of hits that hide or delete text.
HIDING = ("tracked-deletion", "ooxml-hidden-or-deleted", "hidden-css", "rtf-hidden", "json-tombstone")


def regions(p: Plan, classes: str, hits: str) -> str:
    """(place, covering_kind, prior_revisions, recovery_route, preview): redacted regions by page classes (page, class, leftover)
    and by hits (path, kind, state, preview) of kinds that hide text."""
    kinds = ", ".join(f"'{k}'" for k in HIDING)
    return p.add(
        "regions",
        f"""SELECT CAST(page AS VARCHAR(40)) AS place, class AS covering_kind, leftover AS prior_revisions, CASE WHEN leftover THEN 'old-revision' END AS recovery_route, CAST(NULL AS VARCHAR(40)) AS preview, false AS invented FROM {classes}
        UNION ALL SELECT path AS place, kind AS covering_kind, state = 'present_prior_revision' AS prior_revisions, kind AS recovery_route, preview, false AS invented FROM {hits} WHERE kind IN ({kinds})""",
    )


def provenance(p: Plan, items: str, cap: int = 200) -> str:
    """Ledger rows of items (file, seq, path, state, raw): digests and the confidence of each state, at most ``cap`` a file."""
    d = p.d
    states = p.add("states", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in CONFIDENCE.items()) + ") AS t(state, confidence)")
    r = p.add("r", f"SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS k FROM {items}")
    return p.add("ledger", f"SELECT file, seq, path, r.state AS state, coalesce(confidence, 1e0) AS confidence, {d.sha('raw')} AS recovered_sha256, true AS human_verification_required, false AS invented FROM {r} r LEFT JOIN {states} s ON r.state = s.state WHERE k <= {cap}")


def found(p: Plan, items: str, query: str) -> str:
    """Items whose preview or path holds the query, in any case."""
    d = p.d
    q = d.lit(query.lower())
    return p.add("found", f"SELECT * FROM {items} WHERE {d.find('lower(preview)', q)} > 0 OR {d.find('lower(path)', q)} > 0")


detect_text, dedup_items, discover_sidecars, production_correlate, provenance_ledger = map(as_frame, (detect, dedup, sidecars, correlate, provenance))


#: The parts of an artifact whose findings count as recovered, in order; states of earlier and of enclosed content.
RECOVERED = ("hit", "thumb", "carved", "history")
PRIOR = ("present_prior_revision", "present_orphan", "present_database_freelist", "present_thumbnail", "present_embedded")
ENCLOSED = ("present_embedded", "present_attachment", "present_thumbnail")


def _in(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def findings(p: Plan, items: str) -> str:
    """items (file, seq, bucket, kind, path, preview, pos, state) with ``recovered``: the first of equal ones in hit, thumb, carved or history.

    Findings of the other buckets (metadata, embed, orphan, sidecar, secret) are all kept, and are not recovered.
    """
    rank = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(RECOVERED)) + " END"
    own = _in("bucket", RECOVERED)
    r = p.add("r", f"SELECT *, {own} AS own, row_number() OVER (PARTITION BY file, {own}, kind, path, preview, pos ORDER BY {rank}, seq) AS k FROM {items}")
    return p.add("findings", f"SELECT file, seq, bucket, kind, path, preview, pos, state, (own AND k = 1) AS recovered FROM {r}")


def outcome(p: Plan, files: str, found: str) -> str:
    """One row a file and operation: how much it returns, whether it stops, and the refusal code and warning if any.

    files: (file, kind, status, bytes, leftover_bytes, others); found: findings(). Findings are counted once a file,
    before the operations are laid beside them. A file without findings counts as one with none.
    """
    tests = {
        "n_recovered": "recovered", "n_prior": f"recovered AND {_in('state', PRIOR)}", "n_enclosed": f"recovered AND {_in('state', ENCLOSED)}", "n_carved": "bucket = 'carved'",
        "n_orphans": "bucket IN ('orphan', 'carved')", "n_metadata": "bucket = 'metadata'", "n_embeds": "bucket IN ('embed', 'thumb')", "n_sidecars": "bucket = 'sidecar'", "n_secrets": "bucket = 'secret'",
    }
    n = p.add("n", "SELECT file, " + ", ".join(f"count(CASE WHEN {t} THEN 1 END) AS {c}" for c, t in tests.items()) + f" FROM {found} GROUP BY file")
    c = p.add("c", "SELECT f.file AS file, kind, status = 'slot' AS slot, bytes, leftover_bytes, others, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in tests) + f" FROM {files} f LEFT JOIN {n} n ON f.file = n.file")
    left = p.add("left", f"SELECT *, (n_recovered > 0 OR n_carved > 0) AS present, (kind = 'pdf' AND NOT leftover_bytes AND n_recovered = 0 AND n_carved = 0) AS sanitized FROM {c}")
    ops = p.d.gaps(p.d.lit(",".join(sorted(set(OPS.values())))), ",")
    o = p.add("o", f"SELECT q.*, val AS op FROM {p.d.each(f'{left} q', ops)}")
    early = "(bytes = 0 OR op = 'refuse' AND slot)"
    size = (
        f"CASE WHEN {early} THEN 0 WHEN op = 'extract-embedded' THEN CASE WHEN n_enclosed > 0 THEN n_enclosed ELSE n_embeds END WHEN op = 'scan-orphans' THEN n_orphans "
        "WHEN op = 'scan-metadata' THEN n_metadata WHEN op = 'scan-sidecars' THEN n_sidecars WHEN op = 'scan-history' THEN n_prior ELSE n_recovered END"
    )
    code = (
        "CASE WHEN bytes = 0 THEN 'SL-RECOVER-NO-BYTES' WHEN slot THEN 'SL-RECOVER-UNSUPPORTED' "
        "WHEN op IN ('refuse', 'locate', 'deep-recover') AND NOT present THEN CASE WHEN sanitized THEN 'SL-RECOVER-SANITIZED' ELSE 'SL-RECOVER-NO-BYTES' END END"
    )
    warning = "CASE WHEN bytes = 0 THEN NULL WHEN slot THEN 'slot' WHEN op = 'scan-sidecars' AND n_sidecars = 0 THEN 'no-sidecars' WHEN op = 'cross-compare' AND others = 0 THEN 'needs-second-file' END"
    return p.add(
        "outcome",
        f"""SELECT file, op, {size} AS recovered_count, CASE WHEN {early} THEN 0 ELSE n_prior END AS prior_count, {code} AS refuse_code, {warning} AS warning,
        (op = 'refuse' AND bytes > 0 AND NOT slot AND NOT present) AS stop, (bytes > 0 AND n_secrets > 0) AS secret_material_present, false AS invented FROM {o}""",
    )


def selected(p: Plan, found: str, op: str) -> str:
    """The findings that one operation returns; enclosed content falls back on the embeds of files that recovered none."""
    op = op_of(op)
    keep = {
        "scan-orphans": "bucket IN ('orphan', 'carved')", "scan-metadata": "bucket = 'metadata'", "scan-sidecars": "bucket = 'sidecar'", "scan-history": f"recovered AND {_in('state', PRIOR)}",
    }.get(op, "recovered")
    if op != "extract-embedded":
        return p.add("selected", f"SELECT * FROM {found} WHERE {keep}")
    own = f"(recovered AND {_in('state', ENCLOSED)})"
    w = p.add("w", f"SELECT *, {own} AS enclosed, max(CASE WHEN {own} THEN 1 ELSE 0 END) OVER (PARTITION BY file) AS has FROM {found}")
    return p.add("selected", f"SELECT file, seq, bucket, kind, path, preview, pos, state, recovered FROM {w} WHERE enclosed OR (has = 0 AND bucket IN ('embed', 'thumb'))")
