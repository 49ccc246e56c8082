import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vellumflow import cli
from vellumflow.operators.runs import RunLedger
from vellumflow.operators.state import TableStore
from vellumflow.plans.project import run_project
from vellumflow.sinks import files, html, xlsx
from vellumflow.operators import uploads
from vellumflow.sources import archive, candidates, extract, names, normalise, pdf, pricing, remote, validation
from vellumflow.sources.config import ProjectConfig
from vellumflow.streaming.incremental import stream_into


def make_pdf(objects: dict[int, bytes], trailer: bytes = b"") -> bytes:
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return bytes(out + b"trailer\n<</Size %d /Root 1 0 R %s>>\nstartxref\n0\n%%%%EOF" % (max(objects) + 1, trailer))


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<<%s /Length %d>>\nstream\n" % (extra, len(data)) + data + b"\nendstream"


def text_pdf(pages: list[str], catalog: bytes = b"", more: dict[int, bytes] | None = None) -> bytes:
    objects = {1: b"<</Type /Catalog /Pages 2 0 R %s>>" % catalog, 2: b"<</Type /Pages /Count %d /Kids [%s] /Resources <</XObject <</I 90 0 R /F 91 0 R>>>>>>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))))}
    for i, page in enumerate(pages):
        code = b"BT (" + page.encode("latin-1").replace(b"(", b"\\(") + b") Tj ET"
        objects[10 + 2 * i] = b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R>>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(zlib.compress(code), b"/Filter /FlateDecode")
    return make_pdf(objects | (more or {}))


FLAGS = [
    (b"", {}, []),
    (b"/AcroForm <</Fields []>> /OpenAction <</S /JavaScript /JS (x)>>", {}, ["javascript", "interactive_forms"]),
    (b"/Names <</EmbeddedFiles 50 0 R>>", {50: b"<</Names []>>"}, ["embedded_files"]),
    (b"/X 50 0 R", {50: b"<</Type /Filespec /F (a.txt)>>"}, ["external_dependencies"]),
    (b"/X [50 0 R 51 0 R 52 0 R]", {50: b"<</S /Launch>>", 51: b"<</S /URI /URI (http)>>", 52: b"<</Subtype /Screen>>"}, ["launch_actions", "multimedia", "uri_actions"]),
    (b"/Perms <</DocMDP 50 0 R>>", {50: b"<</Type /Sig /ByteRange [0 1] /Contents <00>>>"}, ["digital_signatures"]),
]


@pytest.mark.parametrize("catalog,more,want", FLAGS)
def test_policy(catalog, more, want):
    data = text_pdf(["a"], catalog, more)
    assert pdf.issue_names(pdf.policy_flags(data)) == ["not_pdfa", *want]
    clean = pdf.sanitise(data)
    assert pdf.issue_names(pdf.policy_flags(clean)) == ["not_pdfa"] and pdf.page_count(clean) == 1


def test_pdf_reading_and_splitting():
    assert pdf.page_count(b"no") is None
    locked = make_pdf({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>"}, b"/Encrypt 9 0 R")
    assert pdf.issue_names(pdf.policy_flags(locked)) == ["not_pdfa", "encrypted"] and pdf.page_count(locked) is None
    data = text_pdf([("p%d " % i) + "".join(chr(33 + (i * 7 + k * k) % 90) for k in range(900)).replace("\\", "").replace(")", "").replace("(", "") for i in range(5)])
    assert pdf.page_count(data) == 5
    one = pdf.write_range(data, 2, 3)
    assert pdf.page_count(one) == 2
    parts = pdf.split_file(data, limit=len(pdf.write_range(data, 1, 2)) + 40)
    assert [p[:3] for p in parts] == [("001_0_0", 1, 2), ("001_0_1", 3, 3), ("001_1", 4, 5)]
    with pytest.raises(pdf.PdfError):
        pdf.split_file(data, limit=10)
    packed = b"1 0 2 33 <</Type /Catalog /Pages 2 0 R>>   <</Type /Pages /Kids [3 0 R] /Count 1>>"
    first = packed.index(b"<<")
    head = b"1 0 2 %d " % (packed.index(b"<</Type /Pages") - first)
    body = head + packed[first:]
    compressed = make_pdf({3: b"<</Type /Page>>", 4: stream(zlib.compress(body), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(head))})
    assert pdf.page_count(compressed) == 1


def test_images():
    draw = b"q 72 0 0 144 0 0 cm /I Do Q q 2 0 0 2 0 0 cm /F Do /F Do Q"
    form = b"36 0 0 36 0 0 cm /I Do"
    more = {90: stream(b"x" * 9, b"/Subtype /Image /Width 144 /Height 144"), 91: stream(form, b"/Subtype /Form"), 11: stream(draw)}
    uses = pdf.image_uses(text_pdf(["a"], b"", more))
    assert [(u.page, u.object_id, u.size, u.dpi) for u in uses] == [(1, "90:0", 9, 144.0), (1, "90:0", 9, 144.0)]
    assert pdf.multiply((1, 0, 0, 1, 5, 6), (2, 0, 0, 3, 1, 1)) == (2, 0, 0, 3, 6, 7)


def test_listing(tmp_path):
    for name in ("keep.pdf", "output/.pdfdata", "output/report.pdf", "output/pdfs/copy.pdf", "B.PDF", "a/b.pdf", "a-b.pdf", "_c.pdf", ".d.pdf", "x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = [str(p.relative_to(tmp_path)) for p in archive.list_pdf_paths(tmp_path, [".pdfdata"])]
    assert got == [".d.pdf", "B.PDF", "_c.pdf", "a/b.pdf", "a-b.pdf", "keep.pdf"]
    (tmp_path / ".pdfdata").write_text("")
    assert archive.list_pdf_paths(tmp_path, [".pdfdata"]) == []


def test_config(tmp_path):
    base = {"name": "n", "pdf_directory": "in", "output_directory": "out", "question": "q"}
    c = ProjectConfig.from_mapping(base, tmp_path)
    assert (c.name_clustering, c.ignore_dirs_containing, c.report_html_filename, c.flatten_pdf, c.flatten_dpi) == ("local", [".pdfdata"], "report.html", False, 300)
    assert ProjectConfig.from_mapping(base | {"ignore_dirs_containing": "x"}, tmp_path).ignore_dirs_containing == ["x"]
    for bad in ({"report_html_filename": "a/b.html"}, {"pdf_directory": " in"}, {"flatten_dpi": 0}, {"name_clustering": "magic"}, {"nope": 1}, {"question": ""}):
        with pytest.raises(ValueError):
            ProjectConfig.from_mapping(base | bad, tmp_path)
    with pytest.raises(ValueError):
        ProjectConfig.from_mapping({"name": "n"}, tmp_path)


def test_prices(spark, tmp_path):
    snapshot = {"models": {"m": {"display_name": "M", "aliases": ["mm"], "standard": {"input_usd_per_million_tokens": 0.5, "output_usd_per_million_tokens": 3}}}}
    (tmp_path / "p.json").write_text(json.dumps(snapshot))
    prices, meta = pricing.load_prices(spark, tmp_path / "p.json")
    assert [r.alias for r in prices.collect()] == ["m", "mm"] and len(meta["content_sha256"]) == 64
    with pytest.raises(ValueError):
        pricing.price_rows({"models": {}})
    models = spark.createDataFrame([("mmx", 1000, 0), ("zz", None, 5)], "model_name string, input_token_limit long, output_token_limit long")
    assert [tuple(r) for r in pricing.model_listing(models, prices).collect()] == [("mmx", "1,000", "?", "$0.50", "$3.00"), ("zz", "?", "5", "?", "?")]


def test_identity():
    a = extract.query_identity("v1", "v1", "v1", "p", {"b": 1, "a": 2}, "s", "t")
    assert a == extract.query_identity("v1", "v1", "v1", "p", {"a": 2, "b": 1}, "s", "t")
    assert a["schema_version"] != extract.query_identity("v1", "v1", "v1", "p", {"a": 3}, "s", "t")["schema_version"]
    assert extract.document_prompt("q", "f", ["only"]) == "Question: q\nDocument: f"
    assert "Part 2 of 2: b" in extract.document_prompt("q", "f", ["a", "b"])
    assert extract.synthesize("q", [], 0, None)["status"] == "skipped" and "No responsive" in extract.synthesize("q", [], 2, None)["answer"]


def test_sinks(tmp_path):
    page = html.render_report("T <1>", {"people": [{"_anchor": 'p"x', "name": "<b>", "all": ["a", "&"]}]})
    assert "&lt;b&gt;" in page and 'id="p&quot;x"' in page and page.count("<h2>") == 7 and "a; &amp;" in page
    xlsx.write_workbook(tmp_path / "a.xlsx", {"S": (["x", "y"], [[1, "a\x00<"], [None, True]])})
    sheet = zipfile.ZipFile(tmp_path / "a.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;" in sheet and '<c r="A2"><v>1</v></c>' in sheet and '<c r="B3" t="b"><v>1</v></c>' in sheet
    (tmp_path / "s").mkdir()
    for n in ("x", "y"):
        (tmp_path / "s" / n).mkdir()
        (tmp_path / "s" / n / "f.pdf").write_text(n)
    assert sorted(files.copy_documents([tmp_path / "s/x/f.pdf", tmp_path / "s/y/f.pdf"], tmp_path / "c").values()) == ["f.pdf", "f_1.pdf"]


def test_project_end_to_end(spark, tmp_path):
    class Failing:  # local, so that it travels to the tasks by value
        def analyse(self, question, filename, pages):
            if filename.startswith("bad"):
                raise RuntimeError("no answer")
            return extract.KeywordExtractor().analyse(question, filename, pages)

    source = tmp_path / "in"
    source.mkdir()
    bridge = text_pdf(["Nothing here.", "The cedar bridge opened in May 1921 near Low Field; Anna B. Karlholt spoke."])
    (source / "bridge.pdf").write_bytes(bridge)
    (source / "z").mkdir()
    (source / "z" / "copy.pdf").write_bytes(bridge)
    (source / "other.pdf").write_bytes(text_pdf(["Weather."]))
    (source / "bad.pdf").write_bytes(text_pdf(["Cedar."]))
    (source / "broken.pdf").write_bytes(b"junk")
    (tmp_path / "p.yaml").write_text("name: Cedar\npdf_directory: in\noutput_directory: out\nquestion: Where is the cedar bridge?\n")
    config = ProjectConfig.from_path(tmp_path / "p.yaml")
    first = run_project(spark, config, Failing(), now="2024-01-01T00:00:00")
    assert (first["scanned_documents"], first["queued_documents"], first["total_documents"], first["responsive_documents"]) == (5, 4, 4, 1)
    assert (first["failed_documents"], first["unanalyzed_documents"], first["evidence_rows"], first["total_pages"]) == (2, 2, 1, 4)
    page = (tmp_path / "out/report.html").read_text()
    assert "Anna B. Karlholt" in page and "May 1921" in page and "no answer" in page and "preparation_failed" in page
    assert [p.name for p in (tmp_path / "out/pdfs").iterdir()] == ["copy.pdf"] or [p.name for p in (tmp_path / "out/pdfs").iterdir()] == ["bridge.pdf"]
    book = zipfile.ZipFile(tmp_path / "out/report.xlsx")
    sheets = [book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
    assert [s.split("</row>")[0].count("<c ") for s in sheets] == [14, 12, 6]
    assert "Page 2" in sheets[0] and "Anna B. Karlholt" in sheets[0] and sheets[2].count("<row") == 3
    again = run_project(spark, config, now="2024-01-02T00:00:00")
    assert (again["queued_documents"], again["failed_documents"]) == (2, 1)
    store = TableStore(spark, tmp_path / "out/state")
    answers = store.read("syntheses").collect()
    assert len(answers) == 1 and (answers[0].run_id, answers[0].status) == (2, "succeeded") and store.read("objects").count() == 6
    assert [r.asDict()["skipped_documents"] for r in RunLedger(spark, store).runs().orderBy("run_id").collect()] == [0, 0]
    lost = run_project(spark, config, offline=True, force=True, now="2024-01-03T00:00:00")
    assert lost["responsive_documents"] == 2 and lost["skipped_documents"] == 4
    docs = {r.canonical_filename: (r.first_seen_at, r.last_seen_at) for r in TableStore(spark, tmp_path / "out/state").read("documents").collect()}
    assert docs["copy.pdf"] == ("2024-01-01T00:00:00", "2024-01-03T00:00:00")


def test_commands(tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(text_pdf(["x"], b"/AcroForm <<>>"))
    assert cli.main(["check", str(tmp_path / "a.pdf"), str(tmp_path / "none.pdf")]) == 1
    assert "interactive_forms" in capsys.readouterr().out
    assert cli.main(["check", "--sanitise", str(tmp_path / "a.pdf")]) == 0
    assert pdf.issue_names(pdf.policy_flags((tmp_path / "a.pdf").read_bytes())) == ["not_pdfa"]


def test_files_as_rows(spark):
    rows = [("a", bytearray(text_pdf(["x"]))), ("b", bytearray(b"junk"))]
    got = {r.path: (r.issues, r.page_count, r.error) for r in pdf.analyse_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"] == (["not_pdfa"], 1, None) and got["b"][2] == "no PDF header"


def test_uploads(spark):
    c = spark.createDataFrame([("a", "d", 5, "original"), ("a", "d", 5, "original"), ("b", "d", 7, "original"), ("c", "e", 1, "qpdf")], "candidate_sha256 string, document_sha256 string, size_bytes long, compression_method string")
    none = spark.createDataFrame([], "candidate_sha256 string, remote_name string, uploaded_at string, validated_at string, expires_at string")
    sent = spark.createDataFrame([("a", "r1"), ("b", None)], "candidate_sha256 string, remote_name string")
    cache = uploads.record_uploads(none, sent, "2024-01-01T00:00:00")
    got = {r.candidate_sha256: r.expires_at for r in cache.collect()}
    assert got == {"a": "2024-01-02T23:00:00.000000+00:00", "b": None}
    assert sorted(r.candidate_sha256 for r in uploads.to_upload(c, cache, "2024-01-02T00:00:00").collect()) == ["b", "c"]
    assert sorted(r.candidate_sha256 for r in uploads.to_upload(c, cache, "2024-01-03T00:00:00").collect()) == ["a", "b", "c"]
    kept = uploads.record_uploads(cache, spark.createDataFrame([("a", None)], sent.schema), "2024-02-01T00:00:00").where("candidate_sha256 = 'a'").first()
    assert kept.expires_at == "2024-01-02T23:00:00.000000+00:00"
    log = uploads.call_log(spark.createDataFrame([("d", None, 1.0), ("e", "x", 2.0)], "document_sha256 string, error_text string, duration_ms double"), 3, "upload", "now")
    assert uploads.uploads_of_run(log, 3).first().uploads == 1 and uploads.uploads_of_run(log, 4).first().uploads == 0
    assert {r.document_sha256: (r.analysed_bytes, r.method) for r in uploads.analysed_size(c.distinct()).collect()} == {"d": (12, "chunk"), "e": (1, "qpdf")}


VERDICTS = [
    ({"report": {"jobs": [{"validationResult": [{"compliant": True}]}]}}, True),
    ({"report": {"jobs": [{"validationResult": [{"compliant": True}, {}]}]}}, False),
    ({"report": {"jobs": []}}, False),
    ({"validationReports": [{"isCompliant": True}]}, True),
    ({"validationReports": []}, False),
    ({"validationReports": [{"isCompliant": True}, None]}, False),
    ({"jobs": [{"validationReport": {"isCompliant": True}}]}, True),
    ({"jobs": [{}]}, False),
    ([], False),
]


@pytest.mark.parametrize("payload,want", VERDICTS)
def test_validator_layouts(payload, want):
    ok, why = validation.verdict(json.dumps(payload))
    assert ok is want and (why is None) is want
    assert validation.validate("x.pdf", None)[0] is False and validation.verdict("nonsense")[0] is False


def test_stream_upserts(spark, tmp_path):
    schema = "id long, t long, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], schema).write.json(str(tmp_path / "in"))
    store = TableStore(spark, tmp_path / "s")
    run = lambda: stream_into(spark.readStream.schema(schema).json(str(tmp_path / "in")), store, "x", ["id"], ["t"], str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame([(1, 3, "c"), (2, 4, "late"), (1, 3, "c")], schema).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert sorted((r.id, r.v) for r in store.read("x").select("id", F.col("v")).collect()) == [(1, "c"), (2, "b")]


def test_reports_are_whole(spark, tmp_path, monkeypatch):
    """However many rows there are, none is left out of the page, the workbook, the copies or the answer."""
    from vellumflow.plans import project

    monkeypatch.setattr(project, "REPORT_ROWS", 3, raising=False)
    monkeypatch.setattr(xlsx, "SHEET_ROWS", 4, raising=False)
    people = ["Karlholt", "Veckmund", "Oskander", "Prydwell", "Fennamot", "Wendular", "Torsumba", "Halderby", "Rookmere", "Nolbardi"]
    for i in range(10):
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        (tmp_path / "in" / str(i) / f"n{i % 9}.pdf").write_bytes(text_pdf([f"The cedar bridge {i} opened in May 192{i}; Anna B. {people[i]} spoke."]))
    for i in range(5):
        (tmp_path / "in" / f"bad{i}.pdf").write_bytes(b"junk %d" % i)
    (tmp_path / "p.yaml").write_text("name: Cedar\npdf_directory: in\noutput_directory: out\nquestion: Where is the cedar bridge?\n")
    run_project(spark, ProjectConfig.from_path(tmp_path / "p.yaml"), now="2024-01-01T00:00:00")
    page = (tmp_path / "out/report.html").read_text()
    assert page.count('id="evidence-') == 10 and "10 findings in 9 documents." in page
    sections = {s.split("</h2>")[0]: s.count("<tr") - 1 for s in page.split("<h2>")[1:]}
    assert [sections[k] for k in ("Responsive Index", "People", "Evidence Timeline", "Responsive Documents", "Errors")] == [10, 10 + 1 + 10, 10, 10, 5]  # people, and the head and rows of their mentions
    assert page.count('href="pdfs/') == 20 and page.count('href="#document-') == 20
    ledger = RunLedger(spark, TableStore(spark, tmp_path / "out/state"))
    run = ledger.runs().first()
    assert (run.run_id, run.queued_documents, run.succeeded_documents, run.failed_documents, run.completed_at) == (1, 15, 10, 5, "2024-01-01T00:00:00")
    assert ledger.log().count() == 15 and run.total_tokens > 0
    assert sorted(p.name for p in (tmp_path / "out/pdfs").iterdir()) == sorted([f"n{i}.pdf" for i in range(9)] + ["n0_1.pdf"])
    book = zipfile.ZipFile(tmp_path / "out/report.xlsx")
    names = [x.split('"')[0] for x in book.read("xl/workbook.xml").decode().split('<sheet name="')[1:]]
    rows = [book.read(f"xl/worksheets/sheet{i}.xml").decode().count("<row") - 1 for i in range(1, len(names) + 1)]
    assert list(zip(names, rows)) == [("Evidence", 4), ("Evidence 2", 4), ("Evidence 3", 2), ("Documents", 4), ("Documents 2", 4), ("Documents 3", 4), ("Documents 4", 3), ("Failures", 4), ("Failures 2", 1)]


def test_normalising(tmp_path):
    """Without outside tools a file is freed of what acts; with them it is flattened, converted and judged."""
    path = tmp_path / "a.pdf"
    path.write_bytes(text_pdf(["a"], b"/OpenAction <</S /JavaScript /JS (x)>>"))
    assert normalise.Normaliser()(path) == ["not_pdfa"]
    for name, code in (("conv", 'cp "$1" "$2"; echo "%conv" >> "$2"'), ("flat", 'cp "$3" "$4"; echo "%flat $2" >> "$4"'), ("judge", 'grep -q "%conv" "$3" && ok=true || ok=false; echo "{\\"jobs\\": [{\\"validationReport\\": {\\"isCompliant\\": $ok}}]}"')):
        (tmp_path / name).write_text(f"#!/bin/sh\n{code}\n")
        (tmp_path / name).chmod(0o755)
    tidy = normalise.Normaliser(*(str(tmp_path / x) for x in ("flat", "conv", "judge")), 150)
    assert tidy.issues(path) == ["not_pdfa"] and tidy(path, flatten=True) == [] and b"%flat 150" in path.read_bytes()
    locked = tmp_path / "l.pdf"
    locked.write_bytes(make_pdf({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>"}, b"/Encrypt 9 0 R"))
    assert "encrypted" in tidy(locked)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "conv", "flat", "judge", "l.pdf"]


def test_candidates(spark, tmp_path):
    big, small = text_pdf([f"page {i} " + "x" * 50 for i in range(8)]), text_pdf(["a"])
    (tmp_path / "big.pdf").write_bytes(big)
    (tmp_path / "small.pdf").write_bytes(small)
    (tmp_path / "shrink").write_text('#!/bin/sh\nhead -c 300 "$1" > "$2"\n')
    (tmp_path / "shrink").chmod(0o755)
    df = spark.createDataFrame([("b", str(tmp_path / "big.pdf")), ("s", str(tmp_path / "small.pdf")), ("m", str(tmp_path / "no.pdf"))], "sha256 string, absolute_path string")
    get = lambda strategy: [r.asDict() for r in candidates.prepare_candidates(df, str(tmp_path / "out"), strategy, len(big) - 1, {"qpdf": str(tmp_path / "shrink")}).collect()]
    chunked = [r for r in get("auto") if r["document_sha256"] == "b"]
    assert len(chunked) > 1 and chunked[0]["start_page"] == 1 and chunked[-1]["end_page"] == 8 and all(r["size_bytes"] < len(big) for r in chunked)
    assert {(r["document_sha256"], r["compression_method"], r["error"] is None) for r in get("none")} == {("b", None, False), ("s", "original", True), ("m", None, False)}
    assert [(r["compression_method"], r["size_bytes"]) for r in get("qpdf") if r["document_sha256"] == "b"] == [("qpdf", 300)]
    assert [r["error"] for r in get("ebook") if r["document_sha256"] == "b"] == ["no tool for ebook"]
    with pytest.raises(ValueError):
        get("zip")


def test_name_records(spark, tmp_path):
    (tmp_path / "n.yaml").write_text("- {id: 7, name_string: Anna Karlholt, mentions: 3, source_filenames: [a.pdf]}\n- {name_string: A. Karlholt}\n")
    assert [tuple(r)[:3] for r in names.load_name_records(spark, tmp_path / "n.yaml").collect()] == [(7, "Anna Karlholt", 3), (2, "A. Karlholt", 1)]
    (tmp_path / "e.yaml").write_text("")
    assert names.load_name_records(spark, tmp_path / "e.yaml").count() == 0
    (tmp_path / "x.yaml").write_text("- {mentions: 3}\n")
    with pytest.raises(ValueError):
        names.load_name_records(spark, tmp_path / "x.yaml")


def test_waiting_for_a_remote_file(monkeypatch):
    class Fake:
        def __init__(self, *states):
            self.states = list(states)

        def look(self, name):
            return remote.RemoteFile(name, self.states.pop(0))

        def answer(self, request, files):
            return {"responsive": False, "asked": request["prompt"]}

    slept = []
    done = remote.wait_until_ready(Fake("PROCESSING", "ACTIVE"), remote.RemoteFile("f", "PROCESSING"), slept.append)
    assert done.state == "ACTIVE" and slept == [remote.POLL_SECONDS] * 2
    for state, file in (("FAILED", remote.RemoteFile("f", "PROCESSING")), ("ACTIVE", remote.RemoteFile(None, "PROCESSING"))):
        with pytest.raises(RuntimeError):
            remote.wait_until_ready(Fake(state), file, slept.append)
    assert "Question: q" in remote.RemoteExtractor(Fake(), "m").analyse("q", "f.pdf", [])["asked"]
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(SystemExit):
        remote.required_key("NO_SUCH_KEY")


def test_prices_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    page = {"models": {"m": {"aliases": ["m-1"], "standard": {"input_usd_per_million_tokens": 1, "output_usd_per_million_tokens": 2}}}}

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.headers.get("If-None-Match") == '"v1"'
            self.send_response(304 if known else 404 if self.path == "/gone" else 200)
            self.send_header("ETag", '"v1"')
            self.end_headers()
            if not known and self.path != "/gone":
                self.wfile.write(json.dumps(page if self.path == "/p" else {"models": {}}).encode() + b"\xff")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    read = lambda text: json.loads(text.rstrip("\ufffd"))
    snapshot, meta = pricing.fetch_snapshot(base + "/p", read)
    assert snapshot == page and meta["etag"] == '"v1"' and len(meta["content_sha256"]) == 64
    assert pricing.fetch_snapshot(base + "/p", read, etag='"v1"') is None
    for path in ("/gone", "/empty"):
        with pytest.raises(ValueError):
            pricing.fetch_snapshot(base + path, read)
    server.shutdown()
    with pytest.raises(ValueError):
        pricing.fetch_snapshot(base + "/p", read, timeout=1)


def test_prompts():
    asked = extract.synthesis_prompt("q", 5, 3, [{"document": "a.pdf"}])
    assert asked["total_documents"] == 5 and asked["successful_documents"] == 3 and asked["responsive_documents"] == [{"document": "a.pdf"}]
    assert extract.document_prompt("q", "f", ["a"]).count("\n") == 1 and extract.document_prompt("q", "f", ["a", "b"]).endswith("Part 2 of 2: b")


def test_listing_in_parallel(spark, tmp_path):
    """Level by level, the same files as one walk, odd names, links and marked folders included."""
    for f in ("a.pdf", "b/c.PDF", "b/d/e.pdf", "b/d/no.txt", "m/.mark", "m/x.pdf", "m/n/y.pdf", ".h/_z.pdf", "ü b/1.pdf"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    (tmp_path / "link").symlink_to(tmp_path / "b")
    (tmp_path / "l.pdf").symlink_to(tmp_path / "a.pdf")
    (tmp_path / "empty").mkdir()
    got = {tuple(r) for r in archive.listing(spark, tmp_path, [".mark"], 3).collect()}
    assert got == {(str(p), str(p.relative_to(tmp_path)), p.name) for p in archive.list_pdf_paths(tmp_path, [".mark"])} and len(got) == 6
    assert archive.listing(spark, tmp_path / "empty").collect() == []
