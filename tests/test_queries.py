"""Every registered SQL-expressible query gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import pytest

from foliant.queries import ALL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.oracle()])
def test_same_rows(spark, duck, name):
    df = ALL[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(ALL[name].oracle())
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert len(rel.description) == len(cols)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5), (a, b)


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if not q.oracle()])
def test_kernels_give_rows(spark, name):
    assert ALL[name](spark, str(DATA)).count() > 0


def test_named_operations():
    from foliant.operators import ink, pdf

    assert [pdf.op_of(x) for x in ("leftover", "Leftover_Bytes", "unredact", "lift-overlay")] == ["recover", "recover", "locate", "lift"]
    assert [ink.op_of(x) for x in (None, "Forgery_Scan", "sidebyside", "ink-hand", "refuse")] == ["analyze", "forgery-indicators", "side-by-side", "analyze", "refuse"]
    for parse in (pdf.op_of, ink.op_of):
        with pytest.raises(ValueError):
            parse("no such operation")


def literal(spark, build, columns="*", **tables):
    """Rows of a plan over small tables."""
    from foliant.plans.sql import SPARK, Plan

    p = Plan(SPARK)
    return [tuple(r) for r in p.frame(spark, build(p), columns, **{n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()}).collect()]


def test_revision_chain_follows_prev_from_the_tip(spark):
    from foliant.operators import pdf

    schema = "filename string, rev int, place long, startxref long, prev long"
    rows = [("a", 0, 100, None, None), ("a", 1, 500, 540, 120), ("a", 2, 900, None, 550), ("b", 0, 100, None, None), ("b", 1, 500, None, 333), ("b", 2, 900, None, 500), ("c", 0, 100, None, 500), ("c", 1, 500, None, 100)]
    prev = literal(spark, lambda p: pdf.previous(p, "t"), "filename, rev, prev_rev", t=(rows, schema))
    assert sorted(prev, key=repr) == sorted([("a", 0, None), ("a", 1, 0), ("a", 2, 1), ("b", 0, None), ("b", 1, None), ("b", 2, 1), ("c", 0, 1), ("c", 1, 0)], key=repr)
    got = literal(spark, lambda p: pdf.chain(p, pdf.previous(p, "t")), "filename, node, rev, walked", t=(rows, schema))
    assert sorted(got) == [("a", 0, 0, True), ("a", 1, 1, True), ("a", 2, 2, True), ("b", 0, 0, False), ("b", 1, 1, False), ("b", 2, 2, False), ("c", 0, 0, True), ("c", 1, 1, True)]


def test_revision_chain_of_a_long_file(spark):
    from foliant.operators import pdf

    prevs = [("long", r, r - 1 if r else None) for r in range(2500)] + [("loop", 0, 1), ("loop", 1, 0), ("loop", 2, 1)] + [("gaps", 3, None), ("gaps", 10, 3), ("gaps", 12, 10), ("order", 0, 1), ("order", 1, None), ("order", 2, 0)]
    got = literal(spark, lambda p: pdf.chain(p, "v"), "filename, node, rev, walked", v=(prevs, "filename string, rev int, prev_rev int"))
    want = [("long", r, r, True) for r in range(2500)] + [("loop", r, r, True) for r in range(3)]
    want += [("gaps", 0, 3, True), ("gaps", 1, 10, True), ("gaps", 2, 12, True), ("order", 0, 1, True), ("order", 1, 0, True), ("order", 2, 2, True)]
    assert sorted(got) == sorted(want)


def test_half_even_rounds_as_duckdb(spark, duck):
    from foliant.plans.sql import DUCK, SPARK

    ties = "SELECT id, (id + 0.5e0) / 1000e0 AS x FROM "
    got = spark.sql(f"SELECT id, {SPARK.half_even('x', 3)} AS x FROM ({ties} range(0, 1000)) t").collect()
    assert [tuple(r) for r in got] == duck.execute(f"SELECT id, {DUCK.half_even('x', 3)} FROM ({ties} (SELECT range AS id FROM range(0, 1000)) r) t ORDER BY id").fetchall()


def test_deviation_of_whole_numbers_is_exact_in_any_order(spark):
    from pyspark.sql import functions as F

    from foliant.plans.sql import SPARK

    rows = [(g, x) for g in range(40) for x in (g, g + 56, g + 14, g + 14 + 56, g + 5, g + 61)]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "g long, x long").orderBy(F.rand(parts)).repartition(parts)
        got = df.groupBy("g").agg(F.expr(SPARK.spread("x")).alias("s"), F.expr(SPARK.mean("x / 10e0")).alias("m")).collect()
        assert {r.s for r in got} == {math.sqrt(6 * sum(x * x for x in (0, 56, 14, 70, 5, 61)) - 206**2) / 6}
        assert {r.g: r.m for r in got} == {g: (6 * g + 206) / 60 for g in range(40)}


def test_revision_edges_by_hand(spark):
    from foliant.operators import pdf

    x = "filename string, rev int, id int, flag string, place long, objstm int, slot int"
    xref = [("a", 0, 1, "n", 10, None, None), ("a", 0, 2, "n", 50, None, None), ("a", 0, 3, "n", 90, None, None), ("a", 1, 1, "n", 17, None, None), ("a", 1, 2, "n", 300, None, None), ("a", 1, 3, "f", 0, None, None), ("a", 1, 4, "n", 400, None, None), ("a", 2, 4, "f", 0, None, None), ("a", 2, 2, "n", 300, 7, 0)]
    objects = ([("a", 3, 92, None), ("a", 4, 600, None)], "filename string, id int, place long, parent int")
    got = literal(spark, lambda p: pdf.revision_edges(p, "x", "o"), "rev, id, change", x=(xref, x), o=objects)
    assert sorted(got) == [(0, 1, "added"), (0, 2, "added"), (0, 3, "added"), (1, 1, "kept"), (1, 2, "replaced"), (1, 3, "detached"), (1, 4, "added"), (2, 2, "replaced"), (2, 4, "deleted")]
    assert sorted(literal(spark, lambda p: pdf.xref_revision(p, "o", "x"), "id, xref_rev", x=(xref, x), o=objects)) == [(3, 0), (4, None)]


def test_producers_info_and_attachments_by_hand(spark):
    from foliant.operators import text

    t = ([(1, "<< /Title (a \\(b\\)) /Author<48> >> Acrobat /PieceInfo x.tmp /Type /Filespec /F (f.txt) /UF (g)", True), (2, "nothing", False)], "id long, t string, has_stream boolean")
    assert sorted(literal(spark, lambda p: text.info(p, "t"), "key, value, encoding", t=t)) == [("Author", "48", "hex"), ("Title", "a (b)", "literal")]
    assert literal(spark, lambda p: text.attachments(p, "t"), "id, names, has_stream", t=t) == [(1, "f.txt,g", True)]
    assert sorted(literal(spark, lambda p: text.producers(p, "t"), "kind, listed", t=t)) == [("acrobat", True), ("pieceinfo", True), ("temp-filename", True)]


def test_redaction_classes_take_every_event(spark):
    got = ALL["redaction_classes"](spark, str(DATA)).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").collect())
    assert {r.under for r in got} == set(range(7))


def documents(spark, folder, rows):
    """A folder with documents (doc_id, text, lang, source, n_chars) of (doc_id, text, source)."""
    data = [(i, t, "en", source, len(t)) for i, t, source in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_twins_compare_whole_texts(spark, tmp_path):
    long = "same opening " * 8
    first, second = long + "one 2020-01-02", long + "two 2020-01-02"
    got = {(r.side, r.value) for r in ALL["twin_documents"](spark, documents(spark, tmp_path, [(10, first, "s"), (18, second, "s")])).collect()}
    assert {("only_in_first", first), ("only_in_second", second), ("shared:iso-date", "2020-01-02")} <= got


def test_items_are_whole_texts(spark, tmp_path):
    long = "same opening " * 20
    d = documents(spark, tmp_path, [(10, long + "one", "s"), (18, long + "two", "s"), (28, long + "two", "s"), (34, long + "src1", "s")])
    assert {r.seq for r in ALL["recovered_dedup"](spark, d).collect()} == {10, 18, 34}
    assert {(r.side, r.preview) for r in ALL["revision_diff"](spark, d).collect()} == {("removed", long + "one"), ("added", long + "two")}
    assert [r.seq for r in ALL["query_filter"](spark, d).collect()] == [34]


def test_rtf_hits_scan_documents(spark, tmp_path):
    got = ALL["rtf_hits"](spark, documents(spark, tmp_path, [(1, "Plain words, {\\v under cover\\v0 seen", "s")])).collect()
    assert {(r.kind, r.preview) for r in got if r.id == 1} == {("rtf-text", "Plain words"), ("rtf-text", "under cover"), ("rtf-text", "seen"), ("rtf-hidden", "under cover")}


def test_recover_outcomes_by_hand(spark):
    from foliant.operators import recover

    files = ([(1, "txt", "live", 9, False, 0), (2, "pdf", "live", 9, False, 1), (3, "heic", "slot", 9, False, 0), (4, "txt", "live", 0, False, 0), (5, "pdf", "live", 9, True, 0)], "file long, kind string, status string, bytes long, leftover_bytes boolean, others long")
    items = (
        [(1, 1, "hit", "k", "p", "x", None, "present_current"), (1, 2, "history", "k", "p", "x", None, "present_prior_revision"), (1, 3, "thumb", "k", "p", "y", 4, "present_thumbnail"), (1, 4, "metadata", "k", "p", "y", 4, "s"), (1, 5, "secret", None, None, None, None, None)]
        + [(2, 1, "embed", "k", "p", "e", None, "present_embedded"), (2, 2, "orphan", "k", "p", "e", None, None), (2, 3, "sidecar", "k", "p", "e", None, None)],
        "file long, seq long, bucket string, kind string, path string, preview string, pos long, state string",
    )
    rows = literal(spark, lambda p: recover.outcome(p, "f", recover.findings(p, "i")), "file, op, recovered_count, refuse_code, warning, stop", f=files, i=items)
    got = {r[:2]: r[2:] for r in rows}
    assert len(rows) == len(got) == 50
    assert got[1, "locate"] == (2, None, None, False) and got[1, "scan-history"][0] == got[1, "extract-embedded"][0] == got[1, "scan-metadata"][0] == 1
    assert got[1, "refuse"] == (2, None, None, False) and got[1, "cross-compare"] == (2, None, "needs-second-file", False) and got[1, "scan-sidecars"] == (0, None, "no-sidecars", False)
    assert got[2, "locate"] == (0, "SL-RECOVER-SANITIZED", None, False) and got[2, "refuse"] == (0, "SL-RECOVER-SANITIZED", None, True)
    assert [got[2, op][0] for op in ("extract-embedded", "scan-orphans", "scan-sidecars")] == [1, 1, 1] and got[2, "cross-compare"][2] is None
    assert got[3, "refuse"] == (0, "SL-RECOVER-UNSUPPORTED", "slot", False) and got[4, "deep-recover"] == (0, "SL-RECOVER-NO-BYTES", None, False)
    assert got[5, "deep-recover"] == (0, "SL-RECOVER-NO-BYTES", None, False) and got[5, "refuse"][3]
    assert sorted(literal(spark, lambda p: recover.selected(p, recover.findings(p, "i"), "extract_embedded"), "file, seq", i=items)) == [(1, 3), (2, 1)]


def test_hosted_pigment_takes_the_nearest_rank(spark):
    from foliant.operators import pigment

    px = ([(1, 0, x, v, v, v) for x, v in enumerate((0.0, 0.2, 0.4, 0.6, 0.8, 1.0))], "image_id long, y long, x long, r double, g double, b double")
    q = lambda hosted: {round(r[0], 6) for r in literal(spark, lambda p: pigment.evidence(p, "px", hosted), "q", px=px)}
    assert q(False) == q(True) == {0.8}
    px[0].append((1, 0, 6, 0.9, 0.9, 0.9))
    assert q(True) == {0.9} and q(False) == {0.88}


def test_embeds_of_each_revision_by_hand(spark):
    from foliant.operators import pdf

    objects = (
        [("a", 1, 0, 100, True, "x.txt", None, None, None), ("a", 2, 0, 200, False, None, "%PDF", 50, "s2"), ("a", 2, 0, 900, False, None, "PK..", 70, "s2b"), ("a", 3, 0, 300, True, "", "abcd", 9, "s3"), ("a", 4, 0, 400, False, None, "zzzz", 8, "s4")],
        "filename string, id int, gen int, place long, marked boolean, name string, head string, bytes long, sha256 string",
    )
    refs = ([("a", 1, 1, 7), ("a", 1, 2, 2), ("a", 1, 3, 4)], "filename string, id int, seq int, child int")
    xref = ([("a", 0, 1, "n", 100), ("a", 0, 2, "n", 201), ("a", 0, 3, "n", 300), ("a", 0, 4, "n", 400), ("a", 1, 2, "n", 900), ("a", 1, 3, "f", 0), ("a", 2, 2, "f", 0)], "filename string, rev int, id int, flag string, place long")
    got = literal(spark, lambda p: pdf.embeds(p, "o", "r", "x", 60), "source_revision, object_id, embed_name, media_type, sha256, omitted", o=objects, r=refs, x=xref)
    assert sorted(got) == [
        (0, "1 0", "x.txt", "application/pdf", "s2", None),
        (0, "3 0", "embed-3", "application/octet-stream", "s3", None),
        (1, "1 0", "x.txt", "application/zip", "s2b", "hosted-preview-cap"),
        (2, "1 0", "x.txt", "text/plain", "s4", None),
    ]


def test_hosted_receipt_measures_the_output(spark):
    from foliant.operators import reduce

    schema = "image_id long, y long, x long, r double, g double, b double"
    a = ([(1, 0, 0, 1.0, 1.0, 1.0), (1, 0, 1, 0.0, 0.0, 0.0)], schema)
    b = ([(1, 0, 0, 0.0, 0.0, 0.0), (1, 0, 1, 1.0, 1.0, 1.0)], schema)
    x = lambda hosted: literal(spark, lambda p: reduce.receipt(p, "a", "b", "zero", "page", True, "", hosted), "com_x", a=a, b=b)[0][0]
    own = lambda t: literal(spark, lambda p: reduce.center(p, "t"), "com_x", t=t)[0][0]
    assert (x(False), x(True)) == (own(a), own(b)) and x(False) != x(True)
