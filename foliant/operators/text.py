"""Text of artifacts: previews, text tests, secrets, identifiers, markup, comments and citations.

Relations of texts are (id, t). Hits are rows (id, kind, preview, pos, state): pos counts code points from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.sql import Plan, as_frame

PREVIEW = 240
NOT_PRINTABLE = r"[^\x20-\x7E]"
VALUE_FOLLOWS = r"[:=]\s*\S"
COMMENT, HASH = r"^\s*(?:#|//)", r"^\s*#"
# Patterns that results depend on. RE2 and Java read them alike.
SECRET_NAMES = r"password|passwd|secret|api[_-]?key|access[_-]?token|\btoken\b|authorization|cookie|private[_-]?key|aws_secret|bearer|session[_-]?id"
SECRET_VALUE = rf"(?i)((?:{SECRET_NAMES})[^\s:=]*)\s*[:=]\s*\S+"
SECRET_KEY = r"(?i)(?:password|passwd|secret|api[_-]?key|access[_-]?token|\btoken\b|auth(?:orization)?|cookie|private[_-]?key|aws_secret|bearer|session[_-]?id)"
PEM = r"-----BEGIN (?:RSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
PEM_BLOCK = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
IDENTIFIERS = (
    ("fbi-doc-id", r"\b(?:FBI|EFTA|FOIA)[-_A-Z0-9]{4,}\b"),
    ("bates", r"\b[A-Z]{2,10}[-_ ]?\d{5,}\b"),
    ("iso-date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("pdf-date", r"D:\d{8,14}"),
    ("serial", r"\b[A-Z]{1,4}\d{6,}\b"),
)
IDENTIFIER_CAP = 40
TOMBSTONES = ("_deleted", "_old", "_previous", "_history", "_backup", "_draft", "deleted", "previous", "tombstone", "isDeleted", "hidden")
FLAG_NAME = r"(?i)(backup|old|final2?|copy|draft|original|tmp|autosave|recovered|previous|archive)"
HIDDEN_CSS = r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\b)"
MARKUP = (
    ("markup-comment", r"(?s)<!--(.*?)-->", 1, "present_orphan"),
    ("hidden-css", HIDDEN_CSS, 0, "present_current"),
    ("hidden-attr", r"(?i)\b(?:aria-hidden|data-hidden|hidden)\s*=\s*['\"][^'\"]*['\"]", 0, "present_current"),
    ("json-script", r"(?is)<script[^>]*>(\s*\{.*?)</script>", 1, "present_embedded"),
    ("inline-base64", r"(?i)data:[^;]+;base64,([A-Za-z0-9+/=]+)", 0, "present_embedded"),
    ("a11y-or-form", r"(?is)<title[^>]*>(.*?)</title>", 1, "present_current"),
)


def decoded(files: DataFrame) -> DataFrame:
    """``files`` (.., content) with text and encoding: by byte-order mark, else UTF-8 if valid, else Latin-1."""
    head = F.hex(F.substring("content", 1, 4))
    marks = (("FFFE0000", 0, "UTF-32", "utf-32-le"), ("0000FEFF", 0, "UTF-32", "utf-32-be"), ("FFFE", 2, "UTF-16LE", "utf-16-le"), ("FEFF", 2, "UTF-16BE", "utf-16-be"))
    rest = lambda n: F.expr(f"substring(content, {n + 1})")
    utf8 = F.col("content").cast("string")
    text = F.when(F.startswith(head, F.lit("EFBBBF")), F.make_valid_utf8(rest(3).cast("string"))).when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode("content", "ISO-8859-1"))
    name = F.when(F.startswith(head, F.lit("EFBBBF")), "utf-8-bom").when(F.is_valid_utf8(utf8), "utf-8").otherwise("latin-1")
    for mark, skip, charset, label in reversed(marks):
        on = F.startswith(head, F.lit(mark))
        text, name = F.when(on, F.decode(rest(skip), charset)).otherwise(text), F.when(on, label).otherwise(name)
    return files.withColumn("text", text).withColumn("encoding", F.when(F.col("content").isNotNull(), name))


def printable(d, x: str, limit: int = PREVIEW) -> str:
    """Printable ASCII, newlines and tabs; blanks run together, trimmed, cut with an ellipsis."""
    s = d.sub(d.sub(x, r"[^\x20-\x7E\n\t]", " "), r"[ \t]+", " ")
    s = d.sub(s, r"^[ \n\t]+|[ \n\t]+$", "")
    return f"(CASE WHEN length({s}) > {limit} THEN concat(substr({s}, 1, {limit}), '…') ELSE {s} END)"


def text_like(d, x: str) -> str:
    """At least two characters that are not blank, and 55 % printable ASCII."""
    return f"(length(trim({x})) >= 2 AND length({d.sub(x, NOT_PRINTABLE, '')}) * 1e0 / greatest(length({x}), 1) >= 0.55e0)"


def suppressed(d, x: str) -> str:
    """Values of secrets replaced, keys kept; private keys replaced whole."""
    return d.sub(d.sub(x, SECRET_VALUE, "$1=<suppressed>"), PEM_BLOCK, "[private-key-suppressed]")


def matches(p: Plan, src: str, pattern: str, group: int = 0, more: str = "") -> str:
    """(id, k, pos, hit, part): every match of ``pattern`` in t, with its code point offset."""
    d = p.d
    a = p.add("m", f"SELECT id, {more} {d.gaps('t', pattern)} AS gaps, {d.all('t', pattern, 0)} AS hits, {d.all('t', pattern, group)} AS parts FROM {src} WHERE {d.like('t', pattern)}")
    e = p.add("e", f"SELECT *, CAST(pos AS BIGINT) AS k FROM {d.each(a, 'hits')}")
    col = more or ""
    w = p.add("w", f"SELECT id, {col} k, {d.at('gaps', 'CAST(k AS INT) + 1')} AS gap, {d.at('hits', 'CAST(k AS INT) + 1')} AS hit, {d.at('parts', 'CAST(k AS INT) + 1')} AS part FROM {e}")
    return p.add("at", f"SELECT id, {col} k, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(hit) AS BIGINT) AS pos, hit, part FROM {w}")


def secrets(p: Plan, src: str) -> str:
    """One row for each text with a secret: a private key, else the first key that a value follows."""
    d = p.d
    m = matches(p, src, SECRET_KEY)
    w = p.add("win", f"SELECT m.id AS id, m.pos AS pos, substr(t, CAST(m.pos AS INT) + 1, 80) AS win FROM {m} m JOIN {src} s ON m.id = s.id")
    bearer = d.find("lower(win)", "'bearer '")
    first = p.add("first", f"SELECT id, min(pos) AS pos FROM {w} WHERE {d.like('win', VALUE_FOLLOWS)} OR {bearer} > 0 GROUP BY id")
    pem = d.like("t", PEM)
    return p.add(
        "secrets",
        f"""SELECT s.id AS id, CASE WHEN {pem} THEN 'private-key-pem' ELSE 'credential-key' END AS kind, CASE WHEN {pem} THEN 0 ELSE pos END AS pos, true AS secret_material_present, true AS value_suppressed, false AS invented
        FROM {src} s LEFT JOIN {first} f ON s.id = f.id WHERE {pem} OR pos IS NOT NULL""",
    )


def identifiers(p: Plan, src: str, cap: int = IDENTIFIER_CAP) -> str:
    """(id, kind, value, pos): identifiers in order of pattern and place, at most ``cap`` a text."""
    parts = []
    for i, (kind, pattern) in enumerate(IDENTIFIERS):
        m = matches(p, src, pattern)
        parts.append(f"SELECT id, {i} AS rule, '{kind}' AS kind, hit AS value, pos FROM {m}")
    u = p.add("ids", " UNION ALL ".join(parts))
    r = p.add("r", f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule, pos) AS k FROM {u}")
    return p.add("identifiers", f"SELECT id, kind, value, pos, false AS invented FROM {r} WHERE k <= {cap}")


def markup(p: Plan, src: str) -> str:
    """(id, kind, preview, pos, state): comments, hidden styles and attributes, JSON scripts, data URIs, titles."""
    parts = []
    for kind, pattern, group, state in MARKUP:
        m = matches(p, src, pattern, group)
        shown = "'data-uri'" if kind == "inline-base64" else printable(p.d, suppressed(p.d, "part"))
        parts.append(f"SELECT id, '{kind}' AS kind, {shown} AS preview, pos, '{state}' AS state FROM {m}")
    return p.add("markup", " UNION ALL ".join(parts))


def _lines(p: Plan, src: str) -> str:
    d = p.d
    a = p.add("ls", f"SELECT id, {d.lines('t')} AS ls FROM {src}")
    return p.add("lines", f"SELECT id, CAST(pos AS BIGINT) AS line, val AS t FROM {d.each(a, 'ls')}")


def plain(p: Plan, src: str, cap: int = 80) -> str:
    """Hits of plain text: its beginning, conflict marks, and comment lines until more than ``cap`` hits."""
    d = p.d
    l = _lines(p, src)
    head = f"SELECT id, 0 AS rank, CAST(-1 AS BIGINT) AS line, 'text' AS kind, substr(t, 1, 400) AS raw, 'present_current' AS state FROM {src}"
    conflict = f"SELECT id, 1 AS rank, CAST(-1 AS BIGINT) AS line, 'conflict-marker' AS kind, 'git-conflict' AS raw, 'present_prior_revision' AS state FROM {src} WHERE {d.find('t', d.lit('<<<<<<<'))} > 0 OR {d.find('t', d.lit('>>>>>>> '))} > 0"
    comments = f"SELECT id, 2 AS rank, line, 'commented-value' AS kind, t AS raw, 'present_orphan' AS state FROM {l} WHERE {d.like('t', COMMENT)}"
    u = p.add("u", f"{head} UNION ALL {conflict} UNION ALL {comments}")
    r = p.add("r", f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, line) AS k FROM {u}")
    return p.add("plain", f"SELECT id, kind, {printable(d, suppressed(d, 'raw'))} AS preview, line, state FROM {r} WHERE k <= {cap + 1}")


def yaml(p: Plan, src: str) -> str:
    """Comments and tombstone words, line by line; a line gives one hit for each word it holds."""
    d = p.d
    l = _lines(p, src)
    keys = p.add("keys", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(TOMBSTONES)) + ") AS t(rule, word)")
    return p.add(
        "yaml",
        f"""SELECT id, 'yaml-comment' AS kind, '' AS word, {printable(d, suppressed(d, 't'))} AS preview, line FROM {l} WHERE {d.like('t', HASH)}
        UNION ALL SELECT id, 'yaml-tombstone' AS kind, word, {printable(d, suppressed(d, 't'))} AS preview, line FROM {l} CROSS JOIN {keys} WHERE {d.find('t', 'word')} > 0""",
    )


def rtf(p: Plan, src: str, cap: int = 40) -> str:
    """Hidden runs and the first literals of rich text."""
    d = p.d
    h = matches(p, src, r"(?s)\\v\s+(.+?)(?:\\v0|\})", 1)
    t = matches(p, src, r"(?:^|[{}\s])([A-Za-z][A-Za-z0-9 .:_-]{3,})", 1)
    return p.add(
        "rtf",
        f"""SELECT id, 'rtf-hidden' AS kind, {printable(d, suppressed(d, 'part'))} AS preview, k FROM {h} UNION ALL
        SELECT id, 'rtf-text' AS kind, {printable(d, suppressed(d, 'part'))} AS preview, k FROM {t} WHERE k < {cap} AND lower(part) NOT IN ('rtf', 'ansi', 'fonttbl', 'colortbl')""",
    )


def cite(p: Plan, src: str, query: str, around: int = 24, limit: int = 160) -> str:
    """The first place, in any case, where ``query`` stands in each text, with what stands around it."""
    d = p.d
    f = p.add("f", f"SELECT id, t, {d.find('lower(t)', d.lit(query.lower()))} - 1 AS pos FROM {src}")
    a = f"greatest(0, pos - {around})"
    return p.add("cite", f"SELECT id, CAST(pos AS BIGINT) AS pos, {printable(d, f'substr(t, CAST({a} AS INT) + 1, CAST(pos + {len(query) + around} - {a} AS INT))', limit)} AS excerpt FROM {f} WHERE pos >= 0")


def needles(p: Plan, src: str, words: tuple[tuple[str, str], ...]) -> str:
    """(id, kind, pos) of every place of each needle, not overlapping."""
    parts = []
    for i, (word, kind) in enumerate(words):
        quoted = "".join("\\" + c if c in r".|*+?()[]{}^$\/" else c for c in word)
        parts.append(f"SELECT id, {i} AS rule, '{kind}' AS kind, pos FROM {matches(p, src, quoted)}")
    u = p.add("u", " UNION ALL ".join(parts))
    return p.add("needles", f"SELECT id, kind, pos, min(rule) AS rule FROM {u} GROUP BY id, kind, pos")


#: What producers leave in files, and the kind of each.
PRODUCERS = (
    ("Acrobat", "acrobat"), ("Distiller", "acrobat-distiller"), ("PDFMaker", "acrobat-pdfmaker"), ("Microsoft Word", "microsoft-word"), ("Word for", "microsoft-word"), ("Mac OS X", "macos-quartz"),
    ("Tesseract", "tesseract-ocr"), ("ABBYY", "abbyy"), ("OmniPage", "omnipage"), ("ScanSnap", "scanner"), ("HP Scan", "scanner"), ("Canon", "scanner"), ("iText", "itext"), ("ReportLab", "reportlab"),
    ("/OCG", "ocg-layer"), ("/OCProperties", "ocg-properties"), ("/StructTreeRoot", "structure-tree"), ("/MarkInfo", "markinfo"), ("/PieceInfo", "pieceinfo"), (".tmp", "temp-filename"), (".TMP", "temp-filename"),
    ("~$", "temp-filename"), ("/LastModified", "revision-id"),
)
PRODUCERS_LISTED = 64


def producers(p: Plan, src: str) -> str:
    """(id, kind, pos, rule, listed): every trace of a producer; ``listed`` marks the first PRODUCERS_LISTED of a text."""
    n = needles(p, src, PRODUCERS)
    return p.add("producers", f"SELECT id, kind, pos, rule, row_number() OVER (PARTITION BY id ORDER BY rule, pos) <= {PRODUCERS_LISTED} AS listed, false AS invented FROM {n}")


#: The keys of a document's information dictionary; a literal string; a name of an attachment.
INFO = r"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate|ModDate)\s*(?:\([^\\)]*(?:\\.[^\\)]*)*\)|<[^>]*>)"
ATTACHED, ATTACHED_NAME = "/EmbeddedFile|/Filespec|/EF", r"/(?:F|UF|Desc)\s*\(([^\\)]*(?:\\.[^\\)]*)*)\)"


def _unescaped(d, x: str) -> str:
    """A literal string without the backslashes before its brackets and before themselves."""
    for a, b in (("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return x


def info(p: Plan, src: str) -> str:
    """(id, key, value, encoding, pos): entries of information dictionaries in texts (id, t); hex strings as they stand."""
    d = p.d
    m = matches(p, src, INFO, 1)
    v = p.add("token", f"SELECT id, part AS key, pos, {d.sub('hit', '^/[A-Za-z]+[ ]*', '')} AS token FROM {m}")
    inner = "substr(token, 2, length(token) - 2)"
    return p.add("info", f"SELECT id, key, CASE WHEN token LIKE '(%' THEN {_unescaped(d, inner)} ELSE {inner} END AS value, CASE WHEN token LIKE '(%' THEN 'literal' ELSE 'hex' END AS encoding, pos, false AS invented FROM {v} WHERE length(token) > 2")


def attachments(p: Plan, objects: str) -> str:
    """(id, names, has_stream): objects (id, t, has_stream) that attach files, with the names that they give, in order."""
    d = p.d
    own = p.add("own", f"SELECT id, t, has_stream FROM {objects} WHERE {d.like('t', ATTACHED)}")
    m = matches(p, own, ATTACHED_NAME, 1)
    names = p.add("names", f"SELECT id, {d.text_agg(_unescaped(d, 'part'), 'k')} AS names FROM {m} WHERE part <> '' GROUP BY id")
    return p.add("attached", f"SELECT o.id AS id, n.names AS names, o.has_stream AS has_stream, 'attachment' AS recovered_from, false AS invented FROM {own} o LEFT JOIN {names} n ON o.id = n.id")


def merged(p: Plan, *findings: tuple[str, str, str]) -> str:
    """(id, source, seq, value): findings (table, source, value expression) of a container, in the order given, each value once."""
    arms = " UNION ALL ".join(f"SELECT id, '{source}' AS source, {i} AS seq, {value} AS value FROM {t}" for i, (t, source, value) in enumerate(findings))
    u = p.add("found", f"SELECT *, row_number() OVER (PARTITION BY id, value ORDER BY seq) AS k FROM ({arms}) q WHERE value IS NOT NULL")
    return p.add("merged", f"SELECT id, source, seq, value FROM {u} WHERE k = 1")


secret_hits, identifier_hits, markup_hits, plain_hits, yaml_hits, rtf_hits, citations = map(as_frame, (secrets, identifiers, markup, plain, yaml, rtf, cite))
