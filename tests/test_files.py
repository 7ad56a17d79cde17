"""Text, container, revision and counter operators on hand-made files."""

import gzip
import io
import json
import sqlite3
import tarfile
import zipfile
import zlib

import pytest

from foliant.operators import counters, pdf, recover, request, text
from foliant.plans.sql import Plan
from foliant.sources import artifacts, png
from foliant.sources import pdf as pdf_files
from foliant.streaming import counters as stream


def texts(spark, *ts):
    return spark.createDataFrame(list(enumerate(ts)), "id long, t string")


def test_secrets_are_cited_and_suppressed(spark):
    d = texts(spark, "password: hunter2", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "a cookie is nice", "é auth bearer xyz", None, "")
    got = {r.id: (r.kind, r.pos) for r in text.secret_hits(d).collect()}
    assert got == {0: ("credential-key", 0), 1: ("private-key-pem", 0), 3: ("credential-key", 2)}
    p = Plan()
    out = {r.id: r.s for r in p.frame(spark, p.add("s", f"SELECT id, {text.suppressed(p.d, 't')} AS s FROM suppress_in"), suppress_in=d).collect()}
    assert "hunter2" not in out[0] and out[1] == "[private-key-suppressed]" and out[2] == "a cookie is nice"


def test_charsets(spark):
    cases = [("é漢".encode("utf-16-le"), b"\xff\xfe", "utf-16-le"), ("é漢".encode("utf-16-be"), b"\xfe\xff", "utf-16-be"), ("é漢".encode("utf-32-le"), b"\xff\xfe\0\0", "utf-32-le"), ("é漢".encode(), b"\xef\xbb\xbf", "utf-8-bom"), ("é漢".encode(), b"", "utf-8"), ("é".encode("latin-1"), b"", "latin-1")]
    d = spark.createDataFrame([(i, bytearray(m + b)) for i, (b, m, _) in enumerate(cases)] + [(9, None)], "id int, content binary")
    got = {r.id: (r.text, r.encoding) for r in text.decoded(d).collect()}
    assert [got[i] for i in range(6)] == [("é漢", c[2]) for c in cases[:5]] + [("é", "latin-1")] and got[9] == (None, None)


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("src")
    assert text.identifier_hits(texts(spark, "AB123456")).count() == 2 and spark.table("src").count() == 3


def test_identifiers_in_order_and_capped(spark):
    d = texts(spark, "AB123456 D:20200101 2020-01-02 EFTA-123456", " ".join(f"2020-01-{i:02d}" for i in range(1, 60)))
    got = text.identifier_hits(d).collect()
    assert [(r.kind, r.value) for r in sorted((r for r in got if r.id == 0), key=lambda r: r.pos) if r.kind != "bates"] == [("serial", "AB123456"), ("pdf-date", "D:20200101"), ("iso-date", "2020-01-02"), ("fbi-doc-id", "EFTA-123456")]
    assert sum(r.id == 1 for r in got) == 40


def test_plain_text_and_citation(spark):
    d = texts(spark, "x\n# a\n// b\n<<<<<<< HEAD\n" + "# n\n" * 200, "Some Name here", "none")
    got = [r.kind for r in text.plain_hits(d).where("id = 0").collect()]
    assert got.count("conflict-marker") == 1 and len(got) == 81
    assert [(r.id, r.pos, r.excerpt) for r in text.citations(d, "NAME").collect()] == [(1, 5, "Some Name here")]


def test_yaml_tombstones_are_case_sensitive(spark):
    got = [(r.kind, r.word, r.line) for r in text.yaml_hits(texts(spark, "a: 1\n# c\nundeleted: x\nDeleted: y")).collect()]
    assert sorted(got) == [("yaml-comment", "", 1), ("yaml-tombstone", "deleted", 2)]


def zip_of(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in members:
            z.writestr(n, t)
    return out.getvalue()


def test_artifacts_by_content(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create table people(id integer, t text)")
    db.executemany("insert into people values(?, ?)", [(i, "x" * 900) for i in range(42)])
    db.commit()
    db.execute("delete from people where id > 0")
    db.commit()
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        t.addfile(tarfile.TarInfo("backup/a.txt"))
    docx = zip_of([("word/document.xml", "<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r></w:p>"), ("docProps/core.xml", "<c:x><dc:creator>Ann</dc:creator></c:x>")])
    page = png.encode(__import__("numpy").zeros((2, 2, 3)))
    mail = b"From: a@b\nSubject: hi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\nplain password: hunter2\n--X\nContent-Type: text/html\n\n<p>other</p>\n--X\nContent-Type: text/plain\nContent-Disposition: attachment; filename=f.txt\n\nz\n--X--\n"
    files = {
        "notes.docx": b"%PDF-1.4", "file.pdf": page, "set.bin": docx, "t.db": db.serialize(), "x.tar": tar.getvalue(), "a.gz": gzip.compress(gzip.compress(docx)), "n.eml": mail, "pic.heic": b"\0\0\0\x18ftypheic" + bytes(20),
        "rec.json": b'{"a": {"_old": 1, "a": 1, "a": 2}, "b": [{"isDeleted": true}]}', "tail.png": page + page, "bad.json": b"{", "ole.doc": artifacts.OLE + bytes(600), "empty": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "filename string, content binary")
    kinds = {r.filename: (r.kind, r.confirmed, r.status) for r in artifacts.detected(df).collect()}
    assert kinds["notes.docx"][0] == "pdf" and kinds["file.pdf"][0] == "png" and kinds["set.bin"][0] == "docx" and kinds["t.db"][0] == "sqlite"
    assert kinds["pic.heic"] == ("heic", True, "slot") and kinds["rec.json"][:2] == ("json", True) and kinds["bad.json"][:2] == ("json", False) and kinds["empty"][0] == "bin"
    rows = artifacts.scanned(df).collect()
    of = lambda f: {r.kind for r in rows if r.filename == f}
    assert {"tracked-deletion", "hidden-run", "metadata"} <= of("set.bin") and {"sqlite-freelist", "sqlite-row", "sqlite-schema"} <= of("t.db")
    assert {"unwrapped", "tracked-deletion"} <= of("a.gz") and "flag-name" in of("x.tar") and {"after-iend", "carved-signature"} <= of("tail.png")
    assert {"email-header", "email-body", "email-attachment", "alternate-mime-diff"} <= of("n.eml")
    assert {"json-tombstone", "json-duplicate-key"} <= of("rec.json")
    import base64

    deep = json.dumps({"a": {"api_key": "x", "blob": base64.b64encode(b"PK\3\4 and more").decode(), "plain": "bm8gc2lnbmF0dXJlIQ=="}})
    assert [(k, p) for k, p, *_ in artifacts.json_hits(deep.encode(), "f")] == [("json-secret", "f#/a/api_key"), ("json-base64", "f#/a/blob")]
    assert {k for k, *_ in artifacts.json_hits(b'{"x_old": 1, "password": "abcdefgh"', "f")} == {"json-corrupt", "json-tombstone-text", "json-secret"}
    lines = [f'{{"_old": {i}}}' for i in range(300)] + ["", "{"]
    found = list(artifacts.hits("\n".join(lines).encode(), "rows.jsonl"))
    assert sum(k == "json-tombstone" for k, *_ in found) == 300 and ("json-corrupt", "rows.jsonl#301") in {(k, p) for k, p, *_ in found}
    assert not any("hunter2" in r.preview for r in rows)


def two_revisions():
    s = zlib.compress(b"BT /F1 12 Tf (Hello \\(x\\) \\101) Tj ET 0 g 10 10 100 20 re f")
    a = pdf_files.build([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 4 0 R >>"), (4, b"<< /Filter /FlateDecode >>\nstream\n" + s + b"\nendstream")])
    b = pdf_files.build([(4, b"<< >>\nstream\n0 g 10 10 100 20 re f\nendstream")], a, a.rfind(b"xref\n", 0, a.rfind(b"startxref")))
    return b + b"9 0 obj\n<< /X 4 0 R >>\nendobj\n"


def test_pdf_history(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(two_revisions())), ("no.txt", bytearray(b"x")), ("cut.pdf", bytearray(b"%PDF-1.4\n1 0 obj\n<< /A (")), ("null", None)], "filename string, content binary")
    objects, xref = pdf_files.table(df, "objects"), pdf_files.table(df, "xref")
    p = Plan()
    left = p.frame(spark, pdf.leftovers(p, "left_objects", "left_xref"), left_objects=objects, left_xref=xref).collect()
    assert sorted((r.id, r.kind) for r in left) == [(4, "prior-stream"), (9, "unused-object")]
    drawn = pdf_files.table(df, "drawn")
    under = pdf.text_under_overlay(drawn).collect()
    assert [r.text for r in under] == ["Hello (x) A"]
    refs = pdf_files.table(df, "refs").selectExpr("filename AS grp", "src_id AS src", "dst_id AS dst")
    p = Plan()
    got = p.frame(spark, pdf.reach(p, "reach_refs", "reach_roots"), reach_refs=refs, reach_roots=spark.createDataFrame([("a.pdf", 1)], "grp string, id int")).collect()
    assert {(r.id, r.depth) for r in got} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.kind for r in pdf_files.table(df, "after").collect()} == {"tail", "object"}
    p = Plan()
    counts = {r.rev: (r.added, r.replaced, r.objects) for r in p.frame(spark, pdf.cumulative(p, "cum_xref"), cum_xref=xref).collect()}
    assert counts == {0: (4, 0, 4), 1: (0, 1, 4)}


def test_pdf_object_streams_and_maps():
    body = b"5 0 6 14 << /Type /A >> << /Type /B /K 7 0 R >>"
    stm = zlib.compress(body)
    table = bytes([1, 0, 0, 9, 0, 0]) + bytes([2, 0, 0, 3, 0, 0]) + bytes([0, 0, 0, 0, 0, 1])
    data = b"%PDF-1.5\n3 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >>\nstream\n" + stm + b"\nendstream\nendobj\n4 0 obj\n<< /Type /XRef /W [1 3 2] /Index [3 1 5 2] /Size 7 >>\nstream\n" + table + b"\nendstream\nendobj\nstartxref\n9\n%%EOF"
    objs = pdf_files.objects(data)
    members = [(o["id"], o["parent"], o["slot"], o["head"].get("Type")) for o in objs if o["parent"]]
    assert members == [(5, 3, 0, "A"), (6, 3, 1, "B")]
    entries = pdf_files.xrefs(data, objs)[0]["entries"]
    assert entries == [(3, "n", 9, 0, None, None), (5, "n", 0, 0, 3, 0), (6, "f", 0, 1, None, None)]
    codes = pdf_files.cmap(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <03> <0042> <04> <05> [<0058> <0059>] endbfrange")
    assert codes == {1: "A", 2: "B", 3: "C", 4: "X", 5: "Y"}
    assert pdf_files.value(b"<< /A [1 2 0 R (x\\051) <4> /N#41 true null] /B << /C -1.5 >> >>") == {"A": [1, pdf_files.Ref((2, 0)), b"x)", b"@", "NA", True, None], "B": {"C": -1.5}}


def test_redaction_classes_and_decisions(spark):
    f = spark.createDataFrame([(1, 1, True, True, True, 0, 0), (2, 0, True, True, True, 0, 0), (3, 0, False, True, False, 0, 0), (4, 0, False, False, False, 8, 1), (5, 0, False, False, False, 1, 1), (6, 0, False, False, False, 1, 0)], "k int, under int, old_revision boolean, deleted boolean, has_text boolean, path_steps int, images int")
    assert [r["class"] for r in pdf.redaction_classes(f).orderBy("k").collect()] == list(pdf.CLASSES)
    f = spark.createDataFrame([(1, "lift", False, False, True, False, True), (2, "lift", False, False, False, True, False), (3, "lift", True, True, True, False, False), (4, "recover", True, True, True, False, False), (5, "recover", False, False, False, True, False), (6, "locate", False, False, True, False, False)], "k int, op string, leftover boolean, recovered boolean, opaque boolean, residual boolean, flattened boolean")
    assert [(r.outcome, r.refuse_code is not None) for r in pdf.decisions(f).orderBy("k").collect()] == [("refuse", True), ("lift", False), ("recover", False), ("recover", False), ("refuse", True), ("locate", True)]


def test_request_names(spark):
    got = request.normalize_lenses(spark.createDataFrame([(1, "tazel+vyrn, tazel", True), (2, None, True), (3, "zero", True), (4, "zero", False)], "id int, text string, inject boolean")).collect()
    assert {r.id: (r.lens_id, r.inject_applied, r.inject_ignored) for r in got} == {1: ("tazel+vyrn", True, False), 2: ("rosetta", True, False), 3: ("zero", False, True), 4: ("zero", False, False)}
    for parse in (pdf.op_of, recover.op_of):
        with pytest.raises(ValueError):
            parse("guess")
    assert recover.op_of(None) == "locate" and recover.op_of("scan_orphans") == "scan-orphans" and pdf.op_of("lift_overlay") == "lift"


def test_classifier_truth_table(spark):
    cases = [
        ("CF-Healthchecks", None, None, "bot", "healthcheck_ua"), ("curl/8.4", None, None, "bot", "ua_denylist"), ("my GoogleBot x", None, None, "bot", "ua_denylist"), ("", None, None, "bot", "empty_ua"), (None, None, None, "bot", "empty_ua"),
        ("Mozilla/5.0", None, None, "human", "default"), ("Mozilla/5.0", 99.0, True, "bot", "verified_bot"), ("Mozilla/5.0", 30.0, False, "bot", "bot_score"), ("Mozilla/5.0", 0.0, False, "human", "default"), ("Mozilla/5.0", 95.0, False, "human", "default"),
    ]
    d = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "request_id int, ua string, score double, verified boolean")
    got = [(r.bucket, r.reason) for r in counters.classify_requests(d).orderBy("request_id").collect()]
    assert got == [c[3:] for c in cases]
    flags = [r.bucket for r in stream.bucketed(d).orderBy("request_id").collect()]
    assert flags == [c[3] for c in cases]


def test_stats_and_remainder(spark):
    d = spark.createDataFrame([("project|o|r|main|0", 3), ("project|o|r|dev|1", 4), ("project|x|y|main|1", 5), ("project|__views__", 99), ("a|b", 7), ("project|o|r|z|0", 0), ("project|__total__", 0)], "key string, n long")
    got = {(r.level, r.name): r.n for r in counters.collect_stats(d).collect()}
    assert got == {("repo", "o/r"): 7, ("repo", "x/y"): 5, ("branch", "main"): 8, ("branch", "dev"): 4, ("fork", "0"): 3, ("fork", "1"): 9, ("total", ""): 12}
    s = spark.createDataFrame([("a", 11, 10, 0, 0), ("b", 12, 11, 1, 1), ("c", 2, 2, 9, 0)], "name string, views long, downloads long, views_human long, downloads_human long")
    assert [(r.views_bot, r.downloads_bot, r.holds) for r in counters.display_remainder(s).orderBy("name").collect()] == [(11, 10, True), (11, 10, True), (0, 2, True)]


def test_streaming_counts_are_exact(spark, tmp_path):
    src = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'curl/8' ELSE 'Mozilla' END AS ua", "CAST(NULL AS DOUBLE) AS score", "CAST(NULL AS BOOLEAN) AS verified", "concat('k', id % 4) AS key", "'view' AS kind")
    want = sorted(map(tuple, stream.running(src).collect()))
    folder = tmp_path / "in"
    src.repartition(7).write.parquet(str(folder))
    read = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(str(folder))
    totals = str(tmp_path / "totals")
    assert stream.latest(spark, totals).count() == 0
    q = stream.start(read, totals, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, stream.latest(spark, totals).collect())) == want
    src.where("key = 'k1'").limit(5).coalesce(1).write.mode("append").parquet(str(folder))  # a batch that lacks the other keys
    q = stream.start(read, totals, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    more = {r.key: r.total for r in stream.latest(spark, totals).collect()}
    assert more == {k: n + 5 * (k == "k1") for k, _, n, *_ in want} and len(stream.batches(spark, totals)) == 2


def test_production_pairs(spark):
    d = spark.createDataFrame([(1, 1, "docket-0001.json", "docket-0001", "json", "a"), (1, 2, "docket-0002.json", "docket-0002", "json", "b"), (1, 3, "x.bin", "x", "bin", "b"), (1, 4, "old.py", "old", "source", "q"), (2, 5, "docket-0003.json", "docket-0003", "json", "a")], "production int, seq int, name string, stem string, kind string, sha256 string")
    got = {(r.a, r.b): r.reasons for r in recover.production_correlate(d).collect()}
    assert got["docket-0001.json", "docket-0002.json"] == "same-kind,bates-stem," and got["docket-0002.json", "x.bin"] == "same-sha256,"
    assert got["x.bin", "old.py"] == "flag-name," and not any("docket-0003.json" in k for k in got)
    side = spark.createDataFrame([("Report.docx", "Report"), ("report.docx.bak", "report.docx"), ("zz.txt", "zz")], "name string, stem string")
    assert [(r.primary_name, r.sidecar) for r in recover.discover_sidecars(side).collect()] == [("Report.docx", "report.docx.bak")]
