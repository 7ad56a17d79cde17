"""Registered queries of the image, file and counter operators, over carriers derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from foliant.constants import MODES, PAPERS
from foliant.functions.pixel import luma
from foliant.operators import counters, cover, ink, kernels, lens, neighbour, pdf, pigment, recover, reduce, request, text
from foliant.plans import carriers
from foliant.plans.sql import Plan, Query

ALL: dict[str, Query] = {}
R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


def query(*tables: str) -> Callable:
    def add(build: Callable[[Plan], tuple[str, str]]) -> Callable:
        ALL[build.__name__] = Query(build.__name__, tables, build)
        return build

    return add


def each_mode(inject: bool) -> None:
    for m in MODES:
        def build(p: Plan, m=m) -> tuple[str, str]:
            return lens.mode(p, lens.clean(p, carriers.pixels(p)), m, inject), f"{lens.KEYS}, {R6('r', 'g', 'b')}"

        name = f"lens_{m}" if inject else f"lens_{m}_gray"
        ALL[name] = Query(name, ("lineitem",), build)


each_mode(True)
each_mode(False)


@query("lineitem")
def pixel_scalars(p: Plan):
    """Luminance, hue distances, HSV, bands, midtone lift and in-band predicates."""
    from foliant.functions.pixel import band, hue_distance, inband, lift, luma

    h = lens.with_hsv(p, lens.clean(p, carriers.pixels(p)))
    s = p.add(
        "scalars",
        f"""SELECT {lens.KEYS}, {luma()} AS l, h, s, v, {hue_distance('h', 170)} AS d_tazel, {band('h', 170, 24)} AS w_tazel, {lift('v', 0.16)} AS lifted,
        {inband('h', 's', 'v', 170, 24)} AS in_tazel, {inband('h', 's', 'v', 350, 28)} AS in_vyrn FROM {h}""",
    )
    return s, f"{lens.KEYS}, {R6('l', 'h', 's', 'v', 'd_tazel', 'w_tazel', 'lifted')}, in_tazel, in_vyrn"


@query("lineitem")
def hsv_round_trip(p: Plan):
    """Back from HSV; the largest error of an image is 0."""
    from foliant.functions.pixel import from_hsv

    h = lens.with_hsv(p, lens.clean(p, carriers.pixels(p)))
    r, g, b = from_hsv(p.d, "h", "s", "v")
    e = p.add("err", f"SELECT image_id, greatest(abs(r - {r}), abs(g - {g}), abs(b - {b})) AS err FROM {h}")
    return p.add("worst", f"SELECT image_id, count(*) AS pixels, round(max(err), 6) AS worst FROM {e} GROUP BY image_id"), "*"


@query("lineitem")
def image_reductions(p: Plan):
    """Size, centre of mass, in-band percents, achromatic test, parchment both ways."""
    src = lens.clean(p, carriers.pixels(p))
    c, g, a = reduce.center(p, src), reduce.gate(p, src), reduce.achromatic(p, src)
    e, n = lens.parchment(p, src, exact=True), lens.parchment(p, src)
    j = p.add("j", f"SELECT c.*, tazel_inband_pct, vyrn_inband_pct, achromatic, e.pr AS pr, e.pg AS pg, e.pb AS pb, n.pr AS nr, n.pg AS ng, n.pb AS nb FROM {c} c JOIN {g} g ON c.image_id = g.image_id JOIN {a} a ON c.image_id = a.image_id JOIN {e} e ON c.image_id = e.image_id JOIN {n} n ON c.image_id = n.image_id")
    return j, f"image_id, width, height, {R6('com_x', 'com_y')}, tazel_inband_pct, vyrn_inband_pct, achromatic, {R6('pr', 'pg', 'pb', 'nr', 'ng', 'nb')}"


@query("lineitem")
def histogram_equalize(p: Plan):
    """R05."""
    return reduce.equalize(p, lens.clean(p, carriers.pixels(p))), f"{lens.KEYS}, {R6('g')}"


@query("lineitem")
def normalize_luma(p: Plan):
    """R01, R07."""
    return reduce.normalized(p, lens.clean(p, carriers.pixels(p))), f"{lens.KEYS}, {R6('t')}"


@query("lineitem")
def base_channels(p: Plan):
    """The four normalised channels and their weighted sums."""
    ch = lens.channels(p, lens.clean(p, carriers.pixels(p)))
    return ch, f"{lens.KEYS}, {R6('c_zero', 'c_tazel', 'c_vyrn', 'c_uv')}, round(0.40e0 * c_zero + 0.35e0 * c_tazel + 0.25e0 * c_vyrn, 6) AS rosetta"


@query("lineitem")
def target_page(p: Plan):
    """L13, towards the page."""
    return lens.target(p, lens.clean(p, carriers.paper(p)), "page"), f"{lens.KEYS}, {R6('r', 'g', 'b')}"


@query("lineitem")
def target_ink(p: Plan):
    """L13, towards the ink."""
    return lens.target(p, lens.clean(p, carriers.paper(p)), "ink"), f"{lens.KEYS}, {R6('r', 'g', 'b')}"


@query("lineitem")
def lens_multi(p: Plan):
    """Equal mix of three lenses."""
    return lens.compose(p, lens.clean(p, carriers.pixels(p)), ("tazel", "vyrn", "candle")), f"{lens.KEYS}, {R6('r', 'g', 'b')}"


@query("lineitem")
def overlay_receipt(p: Plan):
    """Rosetta to ink, one receipt an image (the flagship)."""
    src = lens.clean(p, carriers.pixels(p))
    out = lens.target(p, lens.mode(p, src, "rosetta"), "ink")
    r = reduce.receipt(p, src, out, "rosetta", "ink", True, PAPERS["rosetta"])
    return r, f"image_id, lens, target, paper, inject, inject_applied, inject_ignored, invented, width, height, {R6('com_x', 'com_y')}, tazel_inband_pct, vyrn_inband_pct, {R6('mean_r', 'mean_g', 'mean_b')}, pixels"


@query("lineitem")
def hosted_receipt(p: Plan):
    """The hosted receipt takes the centre from the output."""
    src = lens.clean(p, carriers.pixels(p))
    out = lens.target(p, lens.mode(p, src, "lemon"), "page")
    r = reduce.receipt(p, src, out, "lemon", "page", True, PAPERS["lemon"], hosted=True)
    return r, f"image_id, lens, target, inject_applied, {R6('com_x', 'com_y')}, tazel_inband_pct, vyrn_inband_pct, {R6('mean_r', 'mean_g', 'mean_b')}, pixels"


@query("lineitem")
def pigment_evidence(p: Plan):
    """G01, K07."""
    return pigment.evidence(p, carriers.paper(p)), f"{lens.KEYS}, {R6('mag', 'gap', 'chroma', 'thresh')}, strong, faded, support"


@query("lineitem")
def pigment_restore(p: Plan):
    """Restored colours and density."""
    ev = pigment.evidence(p, carriers.paper(p))
    r, d = pigment.restored(p, ev), pigment.density(p, ev)
    return p.add("both", f"SELECT image_id, y, x, r, g, b, d FROM {r} JOIN {d} USING (image_id, y, x)"), f"{lens.KEYS}, {R6('r', 'g', 'b', 'd')}"


@query("lineitem")
def pigment_decision(p: Plan):
    """G04."""
    return pigment.decision(p, carriers.paper(p)), f"image_id, op, pixels, evidence_pixels, visible_ink_pixels, {R6('thresh')}, supported, recovered, changed_pixels, refuse_code, pigment_recovery, invented"


@query("lineitem")
def pigment_hosted(p: Plan):
    """The hosted form, by nearest rank."""
    return pigment.decision(p, carriers.paper(p), hosted=True), f"image_id, op, pixels, evidence_pixels, visible_ink_pixels, {R6('thresh')}, supported, recovered, changed_pixels, refuse_code, pigment_recovery, invented"


@query("lineitem")
def pigment_refused(p: Plan):
    """Noise gives no support."""
    return pigment.decision(p, carriers.pixels(p)), f"image_id, op, pixels, evidence_pixels, visible_ink_pixels, {R6('thresh')}, supported, recovered, changed_pixels, refuse_code, pigment_recovery, invented"


@query("lineitem")
def cover_classify(p: Plan):
    """U01."""
    return cover.classify(p, carriers.pixels(p)), "*"


@query("embeddings")
def raster_twin(p: Plan):
    """Neighbouring vectors as two issues of a page."""
    t = carriers.tiles(p)
    a = p.add("a", f"SELECT image_id AS pair_id, y, x, l FROM {t}")
    b = p.add("b", f"SELECT image_id - 1 AS pair_id, y, x, l FROM {t}")
    return cover.twin(p, a, b), "*"


@query("embeddings")
def neighbour_sobel(p: Plan):
    """K05, H26."""
    t = carriers.tiles(p)
    a, b = neighbour.sobel(p, t), neighbour.sobel(p, t, replicate=False)
    j = p.add("j", f"SELECT a.image_id AS image_id, a.y AS y, a.x AS x, a.gx AS gx, a.gy AS gy, a.mag AS mag, b.mag AS inner_mag FROM {a} a JOIN {b} b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x")
    return j, f"{lens.KEYS}, {R6('gx', 'gy', 'mag', 'inner_mag')}"


@query("embeddings")
def neighbour_ink(p: Plan):
    """Speckle-free ink and the ring beside it."""
    t = carriers.tiles(p)
    q = p.add("q", f"SELECT image_id, {p.d.pct('l', 0.88)} AS q FROM {t} GROUP BY image_id")
    raw = p.add("raw", f"SELECT t.image_id AS image_id, y, x FROM {t} t JOIN {q} q ON t.image_id = q.image_id WHERE l < greatest(0.08e0, q - 0.16e0)")
    ink = neighbour.speckle(p, raw)
    ring = neighbour.ring(p, ink)
    return p.add("both", f"SELECT 'ink' AS kind, image_id, y, x FROM {ink} UNION ALL SELECT 'ring' AS kind, image_id, y, x FROM {ring}"), "*"


@query("lineitem")
def neighbour_clones(p: Plan):
    """Equal tiles of the papers' coarse luminance."""
    from foliant.functions.pixel import luma

    src = p.add("flat", f"SELECT image_id, y, x, CASE WHEN y % 16 < 8 THEN {luma()} * 0e0 + 0.5e0 ELSE {luma()} END AS l FROM {carriers.paper(p)}")
    return neighbour.clones(p, src), "*"


# ---------------------------------------------------------------- ink


@query("lineitem")
def ink_features(p: Plan):
    """One row of stroke features an image."""
    f = ink.features(p, p.add("gray", f"SELECT image_id, y, x, {luma()} AS l FROM {carriers.paper(p)}"))
    cols = ("ink_frac", "weight_mean", "weight_std", "weight_cv", "taper", "density", "tremor", "slant_std", "ductus", "drift", "bleed", "bright_frac", "ghost_frac", "block_std", "dark_frac")
    return f, f"image_id, width, height, pixels, ink_pixels, {R6(*cols)}, bx0, by0, bx1, by1, clones, refuse_code"


@query("lineitem")
def ink_indicators(p: Plan):
    """Indicator rules."""
    return ink.indicators(p, ink.features(p, p.add("gray", f"SELECT image_id, y, x, {luma()} AS l FROM {carriers.paper(p)}"))), "*"


@query("lineitem")
def ink_compare(p: Plan):
    """Feature deltas of neighbouring images."""
    f = ink.features(p, p.add("gray", f"SELECT image_id, y, x, {luma()} AS l FROM {carriers.paper(p)}"))
    pairs = p.add("pairs", f"SELECT image_id AS a, image_id + 1 AS b FROM {f}")
    return ink.compare(p, f, pairs), "*"


@query("embeddings")
def ink_mask(p: Plan):
    """Hosted ink mask by nearest rank."""
    return ink.mask(p, carriers.tiles(p)), "image_id, y, x"


@query("embeddings")
def ink_heatmap(p: Plan):
    """Density heatmap."""
    return ink.heatmaps(p, carriers.tiles(p)), f"image_id, y, x, {R6('heat')}"


@query("orders")
def stroke_edges(p: Plan):
    """H14, DM16: sequence edges over a customer's orders as strokes."""
    s = p.add("strokes", f"SELECT o_custkey AS image_id, o_orderkey AS seq, o_totalprice / 1000e0 AS cx, CAST(o_orderkey % 97 AS DOUBLE) AS cy, 1e0 + (o_orderkey % 7) / 2e0 AS aspect, 400e0 AS side FROM orders")
    return ink.edges(p, s), "*"


@query("orders")
def stroke_indicators(p: Plan):
    """Rules over strokes: pen lifts, style shifts, two inks."""
    f = p.add("facts", f"SELECT o_custkey AS image_id, count(*) AS components, min(o_orderkey % 9) / 2e0 AS aspect_min, max(o_orderkey % 9) / 1e0 AS aspect_max, {p.d.mean('o_totalprice')} / 2000000e0 AS sat_mean, {p.d.spread('o_orderkey % 101')} AS hue_std FROM orders GROUP BY o_custkey")
    return ink.stroke_indicators(p, f), "*"


@query("lineitem")
def ink_hues(p: Plan):
    """Saturation and hue of ink."""
    return ink.hues(p, lens.clean(p, carriers.paper(p))), f"image_id, {R6('sat_mean', 'hue_std')}"


@query("orders")
def tracing_flags(p: Plan):
    """Signs of tracing."""
    f = p.add("facts", "SELECT o_custkey AS image_id, avg(o_orderkey % 7) AS weight_mean, stddev_pop(o_orderkey % 7) / 4e0 AS weight_std, count(*) AS components, avg(o_totalprice) / 2000000e0 AS interior FROM orders GROUP BY o_custkey")
    return ink.tracing(p, f), "*"


@query("lineitem")
def helper_modes(p: Plan):
    """How much the helper lenses move the luminance, inject off."""
    src = lens.clean(p, carriers.paper(p))
    parts = []
    for m, bound in (("indent", 0.02), ("lemon", 0.01), ("uv", 0.01), ("candle", 0.01)):
        out = lens.mode(p, src, m, False)
        parts.append(p.add("d", f"SELECT a.image_id AS image_id, '{m}' AS mode, avg(abs({luma('a.r', 'a.g', 'a.b')} - {luma('b.r', 'b.g', 'b.b')})) AS delta, {bound}e0 AS bound FROM {src} a JOIN {out} b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x GROUP BY a.image_id"))
    u = p.add("u", " UNION ALL ".join(f"SELECT * FROM {t}" for t in parts))
    return u, "image_id, mode, round(delta, 6) AS delta, delta > bound AS contributed, false AS invented"


# ---------------------------------------------------------------- text of artifacts

LITERAL = (
    ".env: API_KEY=abcdef123456 and password : hunter2secret", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "EFTA-00012345 issued 2021-03-04 D:20210304120000 AB123456",
    "# note\n// old value\nplain\n<<<<<<< HEAD\n>>>>>>> branch\n  # later", "name: x\n_deleted: true\n# hidden\nprevious: 3", "DOC-00001234 then SMITH_9876543 token bearer abc",
    "<html><!-- draft --><p style=\"display:none\">x</p><p hidden=\"1\">y</p><script type=\"application/ld+json\">{\"a\":1}</script><title>T</title><img src=\"data:image/png;base64,AAAA\"></html>",
    "{\\rtf1 \\v secret words\\v0 Visible Literal text}", "  caf\u00e9   au\t\tlait  ", "",
)


def artifacts(p: Plan) -> str:
    """Texts (id, t): the documents, and literals with what they lack (ids from -1 down)."""
    rows = " UNION ALL ".join(f"SELECT CAST({-1 - i} AS BIGINT) AS id, {p.d.lit(s)} AS t" for i, s in enumerate(LITERAL))
    return p.add("art", f"SELECT doc_id AS id, text AS t FROM documents UNION ALL {rows}")


@query("documents")
def text_previews(p: Plan):
    """Previews, the text test, suppressed secrets and digests."""
    a = artifacts(p)
    d = p.d
    return p.add("prev", f"SELECT id, {text.printable(d, 't')} AS preview, {text.text_like(d, 't')} AS text_like, {d.sha(text.suppressed(d, 't'))} AS suppressed_sha256, {text.printable(d, text.suppressed(d, 't'), 60)} AS suppressed_preview, {d.sha('t')} AS sha256 FROM {a}"), "*"


@query("documents")
def secret_hits(p: Plan):
    """V08."""
    return text.secrets(p, artifacts(p)), "*"


@query("documents")
def identifier_hits(p: Plan):
    """D37."""
    return text.identifiers(p, artifacts(p)), "*"


@query("documents")
def plain_text_hits(p: Plan):
    """V10, V18."""
    return text.plain(p, artifacts(p)), "*"


@query("documents")
def yaml_hits(p: Plan):
    """V16."""
    return text.yaml(p, artifacts(p)), "*"


@query("documents")
def rtf_hits(p: Plan):
    """V17."""
    return text.rtf(p, artifacts(p)), "*"


@query("documents")
def cite_query(p: Plan):
    """U04."""
    return text.cite(p, artifacts(p), "the"), "*"


@query("documents")
def producer_needles(p: Plan):
    """Places of fixed needles."""
    words = (("the", "article"), ("***", "mark"), ("D:", "pdf-date"), ("-----BEGIN", "pem"))
    return text.needles(p, artifacts(p), words), "*"


def containers(p: Plan) -> str:
    """Documents (id, t, has_stream) as bodies of objects with an information dictionary, attachments and page boxes."""
    plain = p.d.sub("text", r"[()\\<>/]", " ")
    parts = (
        r"'<< /Title (about \(' || doc_id || '\)) /Author <48656C6C6F> /Producer(' || source || ')'", f"' /Subject (' || {plain} || ') >>'",
        "CASE WHEN doc_id % 3 = 0 THEN ' << /Type /Filespec /F (a' || doc_id || '.txt) /UF (b.txt) /Desc () >>' ELSE '' END",
        "CASE WHEN doc_id % 2 = 0 THEN ' << /Type /Page /MediaBox [0 0 612 ' || doc_id || '.5] >> << /Type /Pages >>' ELSE ' /MediaBox [0 0 1 1]' END",
        "CASE doc_id % 5 WHEN 0 THEN ' Acrobat Distiller 4 /OCG ~$x.tmp Word for Microsoft Word' WHEN 1 THEN ' iText' ELSE '' END",
    )
    if p.d.name == "spark":
        parts = tuple(x.replace("\\", "\\\\") if "about" in x else x for x in parts)
    return p.add("body", f"SELECT doc_id AS id, {' || '.join(parts)} AS t, doc_id % 4 = 0 AS has_stream FROM documents")


@query("documents")
def producer_artifacts(p: Plan):
    """Traces of producers."""
    return text.producers(p, containers(p)), "*"


@query("documents")
def info_hits(p: Plan):
    """Entries of information dictionaries."""
    return text.info(p, containers(p)), "*"


@query("documents")
def attachment_hits(p: Plan):
    """Objects that attach files, and the names that they give."""
    return text.attachments(p, containers(p)), "*"


@query("documents")
def container_findings(p: Plan):
    """Findings of a container in one relation, each value once."""
    c = containers(p)
    i, a, n = text.info(p, c), text.attachments(p, c), text.producers(p, c)
    return text.merged(p, (i, "info", "value"), (a, "attachment", "names"), (n, "producer", "kind")), "*"


@query("documents")
def page_boxes(p: Plan):
    """Page geometry."""
    return pdf.page_boxes(p, containers(p)), "*"


@query("pages", "documents")
def markup_hits(p: Plan):
    """V15, over web pages and the literals."""
    a = artifacts(p)
    src = p.add("both", f"SELECT page_id AS id, html AS t FROM pages UNION ALL SELECT id, t FROM {a} WHERE id < 0")
    return text.markup(p, src), "*"


# ---------------------------------------------------------------- files and revisions


def files(p: Plan) -> str:
    """Files (seq, name, stem, kind, sha256, t): a document each, named by its source and id."""
    d = p.d
    ext = "CASE WHEN doc_id % 7 = 0 THEN 'json' WHEN doc_id % 7 = 1 THEN 'bak' WHEN doc_id % 7 = 2 THEN 'md' WHEN doc_id % 7 = 3 THEN 'py' WHEN doc_id % 7 = 4 THEN 'heic' ELSE 'txt' END"
    third = f"lpad(CAST({d.idiv('doc_id', '3')} AS VARCHAR(20)), 8, '0')"
    stem = f"CASE WHEN doc_id % 50 = 0 THEN concat({third}, '-backup') WHEN doc_id % 3 = 2 THEN concat({third}, '-2') ELSE {third} END"
    return p.add("files", f"SELECT {d.idiv('seq', '30')} AS production, seq, concat(stem, '.', kind) AS name, stem, kind, sha256, t FROM (SELECT doc_id AS seq, {stem} AS stem, {ext} AS kind, {d.sha('text')} AS sha256, text AS t FROM documents) q")


@query("documents")
def detect_kinds(p: Plan):
    """Kinds of text artifacts by content and name."""
    f = files(p)
    a = artifacts(p)
    src = p.add("named", f"SELECT seq AS id, name AS filename, t FROM {f} UNION ALL SELECT id, CASE WHEN id = -1 THEN '.env' WHEN id = -7 THEN 'x.html' ELSE '' END AS filename, t FROM {a} WHERE id < 0")
    return recover.detect(p, src), "*"


@query("documents")
def recovered_dedup(p: Plan):
    """The first of equal items."""
    items = p.add("items", "SELECT source AS file, doc_id AS seq, lang AS kind, 'text' AS path, text AS preview, CAST(NULL AS BIGINT) AS pos FROM documents")
    return recover.dedup(p, items), "*"


@query("documents")
def revision_diff(p: Plan):
    """Previews only in one of two revisions."""
    a = p.add("old", "SELECT text AS preview FROM documents WHERE doc_id % 10 < 8")
    b = p.add("new", "SELECT text AS preview FROM documents WHERE doc_id % 10 > 1")
    return recover.revision_diff(p, a, b), "*"


@query("documents")
def sidecar_pairs(p: Plan):
    """V42."""
    return recover.sidecars(p, files(p)), "*"


@query("documents")
def production_pairs(p: Plan):
    """V43."""
    return recover.correlate(p, files(p)), "*"


def found(p: Plan) -> tuple[str, str]:
    """Files of three documents each, and a finding for every document, in a bucket and state by its place."""
    d = p.d
    docs = p.add("placed", f"SELECT doc_id, {d.idiv('doc_id', '3')} AS file, lang, text FROM documents")
    rest = "CASE doc_id % 5 WHEN 0 THEN 'metadata' WHEN 1 THEN 'embed' WHEN 2 THEN 'orphan' WHEN 3 THEN 'sidecar' ELSE 'secret' END"
    own = "CASE doc_id % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'thumb' WHEN 2 THEN 'carved' ELSE 'history' END"
    state = "CASE doc_id % 7 WHEN 0 THEN 'present_prior_revision' WHEN 1 THEN 'present_embedded' WHEN 2 THEN 'present_thumbnail' ELSE 'present_current' END"
    items = p.add("items", f"SELECT file, doc_id AS seq, CASE WHEN file % 5 < 2 OR doc_id % 9 = 0 THEN {rest} ELSE {own} END AS bucket, lang AS kind, 'text' AS path, text AS preview, CAST(NULL AS BIGINT) AS pos, {state} AS state FROM {docs}")
    kind = "CASE file % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'heic' ELSE 'txt' END"
    f = p.add("f", f"SELECT file, {kind} AS kind, CASE WHEN file % 4 = 1 THEN 'slot' ELSE 'live' END AS status, sum(coalesce(length(text), 0)) AS bytes, file % 8 = 0 AS leftover_bytes, file % 2 AS others FROM {docs} GROUP BY file")
    return f, recover.findings(p, items)


@query("documents")
def recover_outcome(p: Plan):
    """Counts, refusals and warnings of every operation on every file."""
    return recover.outcome(p, *found(p)), "*"


@query("documents")
def recover_embedded(p: Plan):
    """What extract-embedded returns."""
    return recover.selected(p, found(p)[1], "extract_embedded"), "*"


@query("documents")
def recover_history(p: Plan):
    """What scan-history returns."""
    return recover.selected(p, found(p)[1], "scan-history"), "*"


@query("documents")
def provenance_rows(p: Plan):
    """Ledger rows."""
    state = "CASE WHEN doc_id % 4 = 0 THEN 'present_current' WHEN doc_id % 4 = 1 THEN 'present_prior_revision' WHEN doc_id % 4 = 2 THEN 'present_orphan' ELSE 'present_sidecar' END"
    return recover.provenance(p, p.add("items", f"SELECT source AS file, doc_id AS seq, 'text' AS path, {state} AS state, text AS raw FROM documents")), "*"


@query("documents")
def query_filter(p: Plan):
    """V40."""
    items = p.add("items", "SELECT doc_id AS seq, text AS preview, source AS path FROM documents")
    return recover.found(p, items, "SRC1"), "*"


# ---------------------------------------------------------------- counters

AGENTS = ("Mozilla/5.0", "curl/8.1", "Googlebot/2.1", "CF-Healthchecks/1.0", "", "  ", "Safari/605 (iPhone)", "python-requests/2.31")


def requests(p: Plan) -> str:
    """Requests (request_id, ua, score, verified) from events."""
    arms = " ".join(f"WHEN {i} THEN {p.d.lit(a)}" for i, a in enumerate(AGENTS))
    return p.add("req", f"SELECT event_id AS request_id, CASE event_id % 9 {arms} END AS ua, CASE WHEN event_id % 5 < 3 THEN CAST(user_id % 100 AS DOUBLE) + 0.5e0 END AS score, CASE WHEN event_id % 11 = 0 THEN true WHEN event_id % 11 = 1 THEN false END AS verified FROM events")


@query("events")
def classify_requests(p: Plan):
    """C01, C02."""
    return counters.classify(p, requests(p)), "*"


@query("events")
def split_counters(p: Plan):
    """Downloads and views by bucket."""
    c = counters.classify(p, requests(p))
    e = p.add("kinds", f"SELECT event_type AS kind, bucket FROM {c} JOIN events ON event_id = request_id")
    return counters.split_counts(p, e), "*"


@query("events")
def count_keys(p: Plan):
    """Dimensions, keys and exact counts."""
    src = p.add("req", "SELECT event_id AS request_id, CASE WHEN user_id % 5 = 0 THEN 'other' ELSE '' END AS owner, CASE WHEN user_id % 7 = 0 THEN 'acme/tools' WHEN user_id % 7 = 1 THEN '' ELSE 'repo' END AS repo, CASE WHEN user_id % 3 = 0 THEN 'dev' END AS branch, CASE WHEN user_id % 11 = 0 THEN 'me/copy' WHEN user_id % 11 = 1 THEN 'true' WHEN user_id % 11 = 2 THEN '0' END AS fork FROM events")
    return counters.counted(p, counters.dims(p, src)), "*"


@query("events")
def counter_stats(p: Plan):
    """Grouping sets over counters, with reserved and short keys."""
    src = p.add("req", "SELECT event_id AS request_id, CASE WHEN user_id % 5 = 0 THEN 'other' ELSE '' END AS owner, CASE WHEN user_id % 7 = 0 THEN 'acme/tools' ELSE 'repo' END AS repo, CASE WHEN user_id % 3 = 0 THEN 'dev' END AS branch, CASE WHEN user_id % 11 = 1 THEN 'true' END AS fork FROM events")
    c = counters.counted(p, counters.dims(p, src))
    more = p.add("more", f"SELECT key, n FROM {c} UNION ALL SELECT 'project|__views__' AS key, 999 AS n UNION ALL SELECT 'a|b' AS key, 5 AS n UNION ALL SELECT 'project|o|r|b|1' AS key, 0 AS n")
    return counters.stats(p, more), "*"


@query("events")
def display_remainder(p: Plan):
    """Counts read from text, and the remainder."""
    d = p.d
    src = p.add("raw", f"SELECT user_id AS name, {counters.as_count(d, 'CAST(sum(event_id) AS VARCHAR(40))')} AS views, count(*) AS downloads, {counters.as_count(d, 'concat(CAST(min(event_id) AS VARCHAR(40)), ' + chr(39) + 'x' + chr(39) + ')')} AS views_human, {counters.as_count(d, chr(39) + '-3' + chr(39))} AS downloads_human FROM events GROUP BY user_id")
    return counters.remainder(p, src), "*"


@query("events")
def mesh_rollup(p: Plan):
    """The first usable number of each alternative, zero if disabled."""
    src = p.add("docs", """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN concat('{"enabled":true,"rollup":{"live":', CAST(user_id AS VARCHAR(20)), '},"locked":"1,204"}')
      WHEN event_id % 4 = 1 THEN concat('{"status":"on","live_nodes":', CAST(user_id AS VARCHAR(20)), ',"isolated":-1,"isolated_count":2}') WHEN event_id % 4 = 2 THEN '{"live":5}' ELSE '{"mesh_enabled":"live","mesh_live_nodes":3.7}' END AS doc FROM events""")
    return counters.mesh(p, src), "*"


# ---------------------------------------------------------------- revisions


@query("orders")
def versions_first_last(p: Plan):
    """First and last version of each object."""
    return pdf.first_last(p, p.add("v", "SELECT o_custkey AS id, o_orderkey AS pos, o_orderstatus AS value FROM orders")), "*"


@query("orders")
def nearest_object(p: Plan):
    """Nearest place of the same id within some bytes."""
    w = p.add("w", "SELECT o_custkey AS id, o_orderkey + 7 AS at FROM orders")
    return pdf.nearest(p, w, p.add("h", "SELECT o_custkey AS id, o_orderkey AS pos FROM orders"), 400), "*"


@query("orders")
def snapshot_diff(p: Plan):
    """Full outer diff of two revisions' snapshots."""
    half = p.add("half", f"SELECT {p.d.idiv('max(o_orderkey)', '2')} AS h FROM orders")
    a, b = (p.add("snap", f"SELECT o_custkey AS id, max(o_orderkey) AS pos FROM orders CROSS JOIN {half} WHERE o_orderkey {op} h GROUP BY o_custkey") for op in ("<=", ">"))
    return pdf.snapshot_diff(p, a, b), "*"


def xref_carrier(p: Plan) -> str:
    return p.add("xref", "SELECT concat('f', CAST(o_custkey % 50 AS VARCHAR(20))) AS filename, CAST(o_orderkey % 6 AS INT) AS rev, CAST(o_custkey AS INT) AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'f' ELSE 'n' END AS flag, o_orderkey * 40 AS place, CASE WHEN o_orderkey % 17 = 0 THEN 5 END AS objstm, CAST(NULL AS INT) AS slot FROM orders")


@query("orders")
def live_map(p: Plan):
    """The live entry of each object."""
    return pdf.live(p, xref_carrier(p)), "*"


@query("orders")
def object_leftovers(p: Plan):
    """Instances that are not live, by kind."""
    o = p.add("obj", "SELECT concat('f', CAST(o_custkey % 50 AS VARCHAR(20))) AS filename, CAST(o_custkey AS INT) AS id, CAST(CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS INT) AS gen, o_orderkey * 40 + o_orderkey % 12 AS place, o_orderkey % 2 = 0 AS has_stream, CAST(floor(o_totalprice) AS BIGINT) AS stream_bytes, o_orderpriority AS stream_sha256, CASE WHEN o_orderkey % 17 = 0 THEN 5 WHEN o_orderkey % 19 = 0 THEN 6 END AS parent FROM orders")
    return pdf.leftovers(p, o, xref_carrier(p)), "*"


@query("orders")
def revision_counts(p: Plan):
    """Added, freed, replaced and live objects after each revision."""
    return pdf.cumulative(p, xref_carrier(p)), "*"


def objects_carrier(p: Plan) -> str:
    return p.add("obj", "SELECT concat('f', CAST(o_custkey % 50 AS VARCHAR(20))) AS filename, CAST(o_custkey AS INT) AS id, o_orderkey * 40 + o_orderkey % 12 AS place, CASE WHEN o_orderkey % 17 = 0 THEN 5 WHEN o_orderkey % 19 = 0 THEN 6 END AS parent FROM orders")


def tables_carrier(p: Plan) -> str:
    """Cross-reference tables of a customer's file: pointers that meet, that miss a little, and that miss."""
    if p.d.name == "spark":  # one key for both windows: orders are shuffled once
        o = p.add("o", "SELECT concat('f', CAST(o_custkey AS VARCHAR(20))) AS filename, o_orderkey AS k FROM orders")
        t = p.add("t", f"SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY k) - 1 AS rev, k, k * 400 AS place FROM {o}")
    else:
        t = p.add("t", "SELECT concat('f', CAST(o_custkey AS VARCHAR(20))) AS filename, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rev, o_orderkey AS k, o_orderkey * 400 AS place FROM orders")
    l = "lag(place) OVER (PARTITION BY filename ORDER BY rev)"
    return p.add("tables", f"SELECT filename, CAST(rev AS INT) AS rev, place, CASE WHEN k % 5 = 0 THEN place + 60 END AS startxref, {l} + CASE WHEN k % 3 = 0 THEN 20 WHEN k % 23 = 0 THEN 100 WHEN k % 7 = 0 THEN -32 ELSE 0 END AS prev FROM {t}")


@query("orders")
def previous_tables(p: Plan):
    """The table that each /Prev means."""
    return pdf.previous(p, tables_carrier(p)), "*"


@query("orders")
def revision_chain(p: Plan):
    """The chain of revisions from the tip, or all tables if it misses some."""
    return pdf.chain(p, pdf.previous(p, tables_carrier(p))), "*"


@query("orders")
def revision_edges(p: Plan):
    """What each revision does to each object."""
    return pdf.revision_edges(p, xref_carrier(p), objects_carrier(p)), "*"


@query("orders")
def xref_revisions(p: Plan):
    """The last revision that lists an instance."""
    return pdf.xref_revision(p, objects_carrier(p), xref_carrier(p)), "*"


@query("orders")
def revision_embeds(p: Plan):
    """Embedded files of each revision, over orders as instances of a customer's object."""
    d = p.d
    o = p.add(
        "o",
        f"""SELECT concat('f', CAST(o_custkey % 50 AS VARCHAR(20))) AS filename, o_custkey AS id, 0 AS gen, o_orderkey * 40 AS place, o_orderkey % 3 < 2 AS marked,
        CASE o_orderkey % 5 WHEN 0 THEN 'a.docx' WHEN 1 THEN 'A.TXT' WHEN 2 THEN '' WHEN 3 THEN 'b.xlsx' END AS name,
        CASE WHEN o_orderkey % 2 = 0 THEN CASE o_custkey % 4 WHEN 0 THEN '%PDF' WHEN 1 THEN {d.lit(chr(255) + chr(216) + chr(255) + 'x')} WHEN 2 THEN 'PK34' ELSE 'text' END END AS head,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 END AS bytes, CASE WHEN o_orderkey % 2 = 0 THEN {d.sha('CAST(o_orderkey AS VARCHAR(20))')} END AS sha256, o_orderkey % 4 AS rev FROM orders""",
    )
    x = p.add("x", f"SELECT filename, rev, id, CASE WHEN max(place) % 520 = 0 THEN 'f' ELSE 'n' END AS flag, max(place) AS place FROM {o} GROUP BY filename, rev, id")
    r = p.add("ref", f"SELECT DISTINCT filename, id, 1 AS seq, id + 50 AS child FROM {o} UNION ALL SELECT DISTINCT filename, id, 2 AS seq, id - 50 AS child FROM {o}")
    return pdf.embeds(p, p.add("inst", f"SELECT filename, id, gen, place, marked, name, head, bytes, sha256 FROM {o}"), r, x, 24000), "*"


@query("lineitem")
def page_keys(p: Plan):
    """References of a page's keys."""
    r = p.add("src", "SELECT concat('f', CAST(l_suppkey AS VARCHAR(20))) AS filename, l_orderkey AS page, CASE l_linenumber % 4 WHEN 0 THEN 'Contents' WHEN 1 THEN 'Annots' WHEN 2 THEN 'Resources' ELSE 'Thumb' END AS key, l_linenumber * 1000000 + l_partkey AS seq, l_partkey AS id, 0 AS gen FROM lineitem")
    return pdf.page_keys(p, r), "*"


@query("events")
def change_kinds(p: Plan):
    """Kind of change of an object between revisions, over combinations of facts."""
    bit = lambda n: f"floor(event_id / {n}) % 2 = 1"
    names = ("has_old", "has_new", "old_stream", "new_stream", "remain", "under", "old_text", "new_overlays", "equal")
    return pdf.change_kind(p, p.add("facts", f"SELECT event_id, {', '.join(f'{bit(2**i)} AS {n}' for i, n in enumerate(names))} FROM events")), "*"


@query("lineitem")
def stream_compare(p: Plan):
    """Old against new stream of an object."""
    s = p.add("s", "SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 1 THEN 'old' ELSE 'new' END AS side, count(*) AS bytes, min(l_returnflag) AS sha256 FROM lineitem GROUP BY 1, 2")
    q = p.add("q", "SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 1 THEN 'old' ELSE 'new' END AS side, CASE l_suppkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'glyph' ELSE 'xobject' END AS kind, concat(l_returnflag, CAST(l_linenumber % 3 AS VARCHAR(20))) AS value FROM lineitem")
    return pdf.stream_compare(p, s, q), "*"


@query("orders")
def image_compare(p: Plan):
    """First against last version of image objects."""
    return pdf.image_compare(p, p.add("v", "SELECT o_custkey AS id, o_orderkey AS pos, o_orderkey % 2 AS width, o_orderkey % 3 AS height, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS sha256 FROM orders")), "*"


@query("part")
def page_reach(p: Plan):
    """What a root reaches, cycles included, with the least depth."""
    refs = p.add("refs", f"SELECT 1 AS grp, {p.d.idiv('p_partkey', '2')} AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT 1 AS grp, p_partkey AS src, {p.d.idiv('p_partkey', '4')} AS dst FROM part WHERE p_partkey % 16 = 0")
    roots = p.add("roots", "SELECT 1 AS grp, p_partkey AS id FROM part WHERE p_partkey = 3")
    return pdf.reach(p, refs, roots), "*"


@query("lineitem")
def text_under_overlay(p: Plan):
    """Text runs with the first overlay painted after them."""
    d = p.add("drawn", "SELECT concat('f', CAST(l_suppkey AS VARCHAR(20))) AS filename, l_orderkey AS id, CAST(0 AS BIGINT) AS place, l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 'overlay' ELSE 'text' END AS kind, CAST(l_linenumber AS BIGINT) * 10 AS pos, l_linestatus AS text FROM lineitem")
    return pdf.under_overlay(p, d), "*"


@query("events")
def redaction_classes(p: Plan):
    """Classes by precedence."""
    f = p.add("facts", "SELECT event_id, event_id % 7 AS under, event_id % 5 = 0 AS old_revision, event_id % 11 = 0 AS deleted, event_id % 3 = 0 AS has_text, event_id % 13 AS path_steps, event_id % 2 AS images FROM events")
    return pdf.redaction_class(p, f), "*"


@query("events")
def unredact_decisions(p: Plan):
    """Outcome and refusal of every combination of facts."""
    f = p.add("facts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'locate' WHEN 1 THEN 'lift' WHEN 2 THEN 'recover' ELSE 'refuse' END AS op, event_id % 3 = 0 AS leftover, event_id % 5 < 3 AS recovered, event_id % 7 < 3 AS opaque, event_id % 11 < 6 AS residual, event_id % 13 = 0 AS flattened FROM events")
    return pdf.decide(p, f), "*"


@query("documents")
def twin_documents(p: Plan):
    """Strings of one twin only, and identifiers of both."""
    a = artifacts(p)
    x, y = p.add("x", f"SELECT t FROM {a} WHERE id % 10 < 8"), p.add("y", f"SELECT t FROM {a} WHERE id % 10 > 1 OR id < 0")
    return pdf.twins(p, x, y), "*"


@query("documents")
def eof_spans(p: Plan):
    """Revision ends in container texts."""
    src = p.add("s", "SELECT doc_id AS id, concat(text, ' %%EOF ', lang, ' %%EOF ', source) AS t FROM documents")
    return pdf.eof_spans(p, src), "*"


# ---------------------------------------------------------------- whole images and files (rows of Python kernels: no SQL form)


class Kernel:
    """A query whose core is an array kernel or a byte parser."""

    def __init__(self, run: Callable):
        self.run, self.name = run, run.__name__

    def __call__(self, spark, sf_dir: str):
        return self.run(spark, sf_dir)

    def oracle(self) -> None:
        return None


def kernel(run: Callable) -> Callable:
    ALL[run.__name__] = Kernel(run)
    return run


def images(spark, sf_dir: str):
    p = Plan()
    return kernels.packed(p.frame(spark, carriers.paper(p), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def full_profile(m: str) -> None:
    def run(spark, sf_dir: str):
        return kernels.full_lens(images(spark, sf_dir), m)

    run.__name__ = f"full_lens_{m}"
    kernel(run)


for _m in MODES:
    full_profile(_m)


@kernel
def full_target_ink(spark, sf_dir: str):
    """L13 with high-pass."""
    return kernels.full_target(images(spark, sf_dir), "ink")


@kernel
def ink_strokes(spark, sf_dir: str):
    """Components and stroke widths."""
    return kernels.strokes(images(spark, sf_dir))


@kernel
def png_round_trip(spark, sf_dir: str):
    """Encode, decode, and count the images that come back within a byte's half step."""
    from pyspark.sql import functions as F

    from foliant.sources import images as files_

    src = images(spark, sf_dir)
    back = files_.decode_png(kernels.encoded(src), "png").select("image_id", "error", F.col("r").alias("r2"))
    worst = F.aggregate(F.zip_with("r", "r2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return src.join(back, "image_id").select("image_id", "error", (worst <= 0.5 / 255 + 1e-12).alias("same"))


@kernel
def lens_batch(spark, sf_dir: str):
    """Every image through all modes, with the receipts; sources.png.save writes the files."""
    return kernels.batch(images(spark, sf_dir)).drop("png")


@kernel
def synthetic_receipts(spark, sf_dir: str):
    """The synthetic page through every lens."""
    from functools import reduce as fold

    from pyspark.sql import functions as F

    from foliant.sources import images as files_

    page = files_.synthetic_page(spark)
    parts = [lens.apply_mode(page, m).groupBy("image_id").agg(F.lit(m).alias("lens"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in "rgb")) for m in MODES]
    return fold(lambda a, b: a.unionByName(b), parts)


def pdf_files(spark, sf_dir: str):
    """Two-revision PDF files, one a document: its text, then a revision that paints a box over the page."""
    import zlib

    import pyarrow as pa

    from foliant.sources import pdf as files_

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                body = (t or "").encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
                z = zlib.compress(b"BT /F1 12 Tf (" + body + b") Tj ET 0 g 10 10 100 20 re f")
                first = files_.build([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"), (4, b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream")])
                at = first.rfind(b"xref\n", 0, first.rfind(b"startxref"))
                out.append(files_.build([(4, b"<< /Length 21 >>\nstream\n0 g 10 10 100 20 re f\nendstream")], first, at) + b"9 0 obj\n<< /X 4 0 R >>\nendobj\n")
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.pdf" for i in b.column("doc_id").to_pylist()]), pa.array(out, pa.binary())], names=["filename", "content"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(run, "filename string, content binary")


def pdf_table(which: str, name: str) -> None:
    def run(spark, sf_dir: str):
        from foliant.sources import pdf as files_

        return files_.table(pdf_files(spark, sf_dir), which)

    run.__name__ = name
    kernel(run)


for _t, _n in (("objects", "pdf_objects"), ("xref", "pdf_xref"), ("refs", "pdf_refs"), ("drawn", "pdf_drawn"), ("after", "pdf_after_eof")):
    pdf_table(_t, _n)


@kernel
def pdf_history(spark, sf_dir: str):
    """Leftovers of files that were parsed, counted by kind."""
    from foliant.sources import pdf as files_

    src = pdf_files(spark, sf_dir)
    p = Plan()
    left = pdf.leftovers(p, "pdf_objects_in", "pdf_xref_in")
    return p.frame(spark, left, pdf_objects_in=files_.table(src, "objects"), pdf_xref_in=files_.table(src, "xref"))


@kernel
def artifact_parts(spark, sf_dir: str):
    """Parts of mail, JSON and gzip files made of documents."""
    import gzip

    import pyarrow as pa

    from foliant.sources import artifacts as files_

    def run(batches):
        for b in batches:
            names, out = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = (t or "").encode()
                mail = b"From: a@example.com\nSubject: " + str(i).encode() + b"\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n\n" + raw
                names += [f"{i}.eml", f"{i}.json", f"{i}.gz"]
                out += [mail, b'{"_old": {"n": %d}, "n": 1, "n": 2}' % (i or 0), gzip.compress(mail, mtime=0)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], names=["filename", "content"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return files_.scanned(docs.mapInArrow(run, "filename string, content binary"))


@kernel
def streaming_counters(spark, sf_dir: str):
    """C03-C05 as a stream: events read as they arrive, exact totals by key."""
    import tempfile
    import uuid

    from foliant.streaming import counters as stream

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]")
    requests = events.selectExpr("event_type AS kind", "concat('project|', user_id % 7) AS key", "CASE WHEN event_id % 3 = 0 THEN 'curl/8' ELSE 'Mozilla/5.0' END AS ua", "CAST(user_id % 100 AS DOUBLE) AS score", "CAST(NULL AS BOOLEAN) AS verified")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="foliant-")
    where = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    started = stream.start(requests, f"{where}/totals", f"{where}/state")
    started.processAllAvailable()
    started.stop()
    return stream.latest(spark, f"{where}/totals")


# ---------------------------------------------------------------- requests in text


@query("events")
def resolve_modes(p: Plan):
    """Modes, targets, switches and sidecar names from text."""
    names = ("zero", " Candlelight ", "UV-light", "spectrometer", "nope", "balance", "invisible-ink-lemon")
    pick = lambda words, by: "CASE " + by + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"
    src = p.add("req", f"SELECT event_id, {pick(names, 'event_id % 8')} AS name, {pick(('page', 'Folio ', 'ink', 'x'), 'event_id % 5')} AS target, {pick(('off', 'YES', 'maybe', ' 0 ', 'no-inject'), 'event_id % 6')} AS inject, {pick(('a.png', 'b.JPEG', 'c.tar.gz', 'd'), 'event_id % 4')} AS file FROM events")
    m = request.modes(p, src)
    return p.add("all", f"SELECT event_id, mode, error, {request.target_of('target')} AS target, {request.inject_of('inject')} AS inject, {request.sidecar_name(p.d, 'file')} AS sidecar FROM {m}"), "*"


@query("events")
def normalize_lenses(p: Plan):
    """Ordered distinct lenses of a request."""
    texts = ("tazel+vyrn,tazel", "", "zero", " UV , candle+zen", "zero+nope", "balance,balance")
    arms = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return request.lenses(p, p.add("req", f"SELECT event_id AS id, CASE event_id % 7 {arms} END AS text, event_id % 2 = 0 AS inject FROM events")), "*"


@query("events")
def resolve_inject(p: Plan):
    """Inject, else tint, else on."""
    three = lambda n: f"CASE event_id % {n} WHEN 0 THEN true WHEN 1 THEN false END"
    r = p.add("req", f"SELECT event_id, {three(3)} AS inject, {three(5)} AS tint FROM events")
    return p.add("resolved", f"SELECT event_id, inject, tint, {request.inject_resolved('inject', 'tint')} AS resolved FROM {r}"), "*"


@query("region")
def catalogue(p: Plan):
    """Modes, targets and aliases."""
    return request.catalogue(p), "*"


@query("events")
def redaction_regions(p: Plan):
    """Regions by page classes and by hits that hide text."""
    c = p.add("classes", "SELECT event_id AS page, CASE WHEN event_id % 3 = 0 THEN 'old_revision_survives' ELSE 'text_under_vector_overlay' END AS class, event_id % 3 = 0 AS leftover FROM events")
    h = p.add("hits", "SELECT concat('p', CAST(event_id AS VARCHAR(20))) AS path, CASE event_id % 4 WHEN 0 THEN 'rtf-hidden' WHEN 1 THEN 'hidden-css' WHEN 2 THEN 'json-tombstone' ELSE 'plain' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'present_current' ELSE 'present_prior_revision' END AS state, event_type AS preview FROM events")
    return recover.regions(p, c, h), "*"


@query("lineitem")
def resize_nearest(p: Plan):
    """Nearest-neighbour reduction to 12 pixels."""
    return request.resized(p, lens.clean(p, carriers.pixels(p)), 12), f"{lens.KEYS}, {R6('r', 'g', 'b')}"


@query("lineitem")
def paint_shift(p: Plan):
    """Tint of every mode's paint over each image's mean luminance."""
    from foliant.functions.pixel import clamp

    l = p.add("l", f"SELECT image_id, avg({luma()}) AS l FROM {lens.clean(p, carriers.pixels(p))} GROUP BY image_id")
    t = request.paints(p)
    cols = ", ".join(f"round({clamp(f'l * (0.72e0 + 0.28e0 * {c} * 1.6e0)')}, 6) AS {c}" for c in "rgb")
    return p.add("tints", f"SELECT image_id, mode, {cols} FROM {l} CROSS JOIN {t}"), "*"
