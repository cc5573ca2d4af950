import pytest
from pyspark.sql import functions as F

from quillspark.operators.constraints import Violation
from quillspark.plans.library import Library, newest_first, now
from quillspark.sources.pdf import Unreadable, pages_of
from quillspark.streaming.ingest import watch
from tests.pdfs import obj, pdf, stream

PAGE = b"BT /F1 12 Tf (Hello \\(there\\)) Tj [(wor) -20 (ld) -300 (again)] TJ <41> Tj ET"


@pytest.mark.parametrize("packed", [False, True])
def test_items(packed):
    assert pages_of(pdf([PAGE, b"", b"(x\\101\\n) Tj"], packed)) == [["Hello (there)", "world again", "A"], [], ["xA\n"]]


def test_no_pages():
    assert pages_of(pdf([])) == []


def test_unicode_map_and_object_stream():
    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    inner = b"5 0 << /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    data = b"".join(
        [b"%PDF-1.5\n", obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"), obj(2, b"<< /Type /Pages /Kids [3 0 R] >>"), obj(3, b"<< /Type /Page /Resources << /Font << /F 5 0 R >> >> /Contents [4 0 R] >>"), stream(4, b"/F 9 Tf <000100020003> Tj"), stream(6, cmap, True), stream(7, inner, True, b"/Type /ObjStm /N 1 /First 4")]
    )
    assert pages_of(data) == [["éAB"]]


@pytest.mark.parametrize("data", [b"", b"plain text", b"%PDF-1.4 nothing", pdf([PAGE], trailer=b"/Encrypt 9 0 R")])
def test_unreadable(data):
    with pytest.raises(Unreadable):
        pages_of(data)


def test_add_list_and_ids(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.documents().count() == 0 and lib.health() == {"status": "ok"} and now(spark).count() == 1
    first = lib.add_document("a", document_type="t").first()
    assert (first["document_id"], first["document_name"], first["status"], first["reporting_period"]) == (1, "a", "UPLOADED", None)
    assert lib.add_document("").first()["document_id"] == 2
    with pytest.raises(Violation):
        lib.add_document(None)
    assert [r["document_id"] for r in lib.documents().collect()] == [2, 1]
    with pytest.raises(Violation, match="reference"):
        lib.add("document_pages", spark.createDataFrame([(9, 1, "x")], "document_id int, page_number int, extracted_text string"))


def test_unknown_times_come_first(spark):
    rows = spark.createDataFrame([(1, "2025-01-01"), (2, None), (3, "2025-01-01")], "document_id int, t string").withColumn("uploaded_at", F.col("t").cast("timestamp_ntz"))
    assert [r[0] for r in newest_first(rows).collect()] == [2, 3, 1]


def test_upload(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "two.pdf").write_bytes(pdf([PAGE, b""]))
    (files / "none.pdf").write_bytes(pdf([]))
    lib = Library(spark, str(tmp_path / "lib"))
    got = {r["document_name"]: r for r in lib.upload(str(files)).collect()}
    assert (got["two.pdf"]["pages_detected"], got["none.pdf"]["pages_detected"]) == (2, 0)
    pages = lib.table("document_pages").orderBy("page_number").collect()
    assert [(p["document_id"], p["page_number"], p["extracted_text"]) for p in pages] == [(got["two.pdf"]["document_id"], 1, "Hello (there) world again A"), (got["two.pdf"]["document_id"], 2, "")]
    assert {(r["source_organization"], r["status"]) for r in lib.documents().collect()} == {("Ministry of Coal", "UPLOADED")}
    lib.upload(str(files))
    assert lib.documents().count() == 4 and lib.table("document_pages").select("page_id").distinct().count() == 4


@pytest.mark.parametrize(("data", "message"), [(b"no pdf", "not a PDF"), (pdf([PAGE, b"(a\\000b) Tj"]), "zero character")])
def test_failed_upload_stores_nothing(spark, tmp_path, data, message):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.pdf").write_bytes(data)
    lib = Library(spark, str(tmp_path / "lib"))
    with pytest.raises(Violation, match=message):
        lib.upload(str(tmp_path / "in"))
    assert lib.documents().count() == 0 and lib.table("document_pages").count() == 0


def test_upload_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(Violation, match="no PDF"):
        Library(spark, str(tmp_path / "lib")).upload(str(tmp_path / "in"))


def test_stream_takes_each_file_once(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    lib = Library(spark, str(tmp_path / "lib"))
    for k in (1, 2):
        (files / f"{k}.pdf").write_bytes(pdf([PAGE]))
        watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(60)
        assert lib.documents().count() == k
    watch(spark, str(files), lib, str(tmp_path / "again")).awaitTermination(60)
    assert lib.documents().count() == 2


def test_a_stream_sets_bad_files_aside(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    lib = Library(spark, str(tmp_path / "lib"))
    go = lambda: watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(120)
    for name, content in (("a.pdf", pdf([PAGE])), ("bad.pdf", b"no pdf"), ("c.pdf", pdf([PAGE, PAGE])), ("zero.pdf", pdf([b"(a\\000b) Tj"]))):
        (files / name).write_bytes(content)
    go()
    assert sorted(r.document_name for r in lib.documents().collect()) == ["a.pdf", "c.pdf"] and lib.table("document_pages").count() == 3
    bad = {r.name: r.error for r in lib.rejected().collect()}
    assert bad.keys() == {"bad.pdf", "zero.pdf"} and "zero character" in bad["zero.pdf"]
    (files / "later.pdf").write_bytes(pdf([PAGE]))
    go()
    watch(spark, str(files), lib, str(tmp_path / "again")).awaitTermination(120)  # all files once more
    assert sorted(r.document_name for r in lib.documents().collect()) == ["a.pdf", "c.pdf", "later.pdf"] and lib.rejected().count() == 2


@pytest.mark.parametrize("table", ["_rejected", "documents"])
def test_a_stream_that_failed_among_bad_files(spark, tmp_path, monkeypatch, table):
    files = tmp_path / "in"
    files.mkdir()
    (files / "x.pdf").write_bytes(pdf([PAGE]))
    (files / "bad.pdf").write_bytes(b"%PDF")
    lib = Library(spark, str(tmp_path / "lib"))
    failing(monkeypatch, table)
    with pytest.raises(Exception, match="disk"):
        watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(120)
    watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(120)
    assert [r.document_name for r in lib.documents().collect()] == ["x.pdf"] and [r.name for r in lib.rejected().collect()] == ["bad.pdf"]


def test_delete_through_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.add_document("a")
    lib.add("document_pages", spark.createDataFrame([(1, 1, "x")], "document_id int, page_number int, extracted_text string"))
    left = lib.without_documents(spark.createDataFrame([(1,)], "id int"))
    assert left["documents"].count() == 0 and left["document_pages"].count() == 0


def failing(monkeypatch, table):
    """Let the next append to a table fail."""
    from quillspark.plans import library

    real, left = library.append, [1]

    def append(rows, root, name, *more):
        if name == table and left:
            left.pop()
            raise OSError("disk")
        real(rows, root, name, *more)

    monkeypatch.setattr(library, "append", append)


@pytest.mark.parametrize("table", ["document_pages", "_uploads", "documents"])
def test_what_a_failed_upload_leaves_joins_no_later_document(spark, tmp_path, monkeypatch, table):
    lib = Library(spark, str(tmp_path / "lib"))
    for name, pages in (("a", [b"(first a) Tj", b"(second a) Tj"]), ("b", [b"(only b) Tj"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.pdf").write_bytes(pdf(pages))
    failing(monkeypatch, table)
    with pytest.raises(OSError):
        lib.upload(str(tmp_path / "a"))
    assert lib.documents().count() == 0 and lib.uploaded().count() == 0
    got = lib.upload(str(tmp_path / "b")).collect()
    rows = lib.documents().join(lib.table("document_pages"), "document_id").collect()
    assert [r.document_name for r in got] == ["b.pdf"] and [(r.document_name, r.extracted_text) for r in rows] == [("b.pdf", "only b")]
    assert lib.add_document("c").first()["document_id"] > got[0].document_id


@pytest.mark.parametrize("table", ["document_pages", "_uploads", "documents"])
def test_a_stream_that_failed_uploads_each_file_once(spark, tmp_path, monkeypatch, table):
    files = tmp_path / "in"
    files.mkdir()
    lib = Library(spark, str(tmp_path / "lib"))
    for name in ("x", "y"):
        (files / f"{name}.pdf").write_bytes(pdf([PAGE]))
    failing(monkeypatch, table)
    with pytest.raises(Exception, match="disk"):
        watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(60)
    watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(60)
    assert sorted(r.document_name for r in lib.documents().collect()) == ["x.pdf", "y.pdf"]


def test_a_stream_that_failed_after_all_was_stored(spark, tmp_path, monkeypatch):
    files = tmp_path / "in"
    files.mkdir()
    (files / "x.pdf").write_bytes(pdf([PAGE]))
    lib = Library(spark, str(tmp_path / "lib"))
    store = lib.store

    def stored_and_died(found):
        store(found)
        monkeypatch.setattr(lib, "store", store)
        raise OSError("killed")

    monkeypatch.setattr(lib, "store", stored_and_died)
    with pytest.raises(Exception, match="killed"):
        watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(60)
    watch(spark, str(files), lib, str(tmp_path / "at")).awaitTermination(60)
    assert lib.documents().count() == 1


def test_forms_images_and_glyph_names():
    cmap = b"1 beginbfchar <01> /uni00E9 endbfchar 2 beginbfchar <02> /A <03> /odd endbfchar"
    form = b"<< /Type /XObject /Subtype /Form /Resources << /Font << /F 6 0 R >> >> /Length 0 >>"
    data = b"".join(
        [b"%PDF-1.5\n", obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"), obj(2, b"<< /Type /Pages /Kids [3 0 R] >>"), obj(3, b"<< /Type /Page /Resources << /XObject << /X 5 0 R /I 8 0 R >> >> /Contents 4 0 R >>")]
        + [stream(4, b"(a) Tj /X Do BI /W 1 ID (no) Tj ) ( \xff EI /I Do (z) Tj"), stream(5, b"/F 9 Tf <010203> Tj", True, b"/Subtype /Form /Resources << /Font << /F 6 0 R >> >>")]
        + [obj(6, b"<< /Type /Font /ToUnicode 7 0 R >>"), stream(7, cmap), stream(8, b"(no) Tj", False, b"/Subtype /Image")]
    )
    assert form and pages_of(data) == [["a", "éA\ufffd", "z"]]
    with pytest.raises(Unreadable, match="itself"):
        pages_of(data.replace(b"/F 9 Tf <010203> Tj", b"") .replace(stream(5, b"/F 9 Tf <010203> Tj", True, b"/Subtype /Form /Resources << /Font << /F 6 0 R >> >>"), stream(5, b"/X Do", True, b"/Subtype /Form")))


def test_one_odd_file_fails_by_itself(spark, tmp_path):
    from quillspark.sources import pdf as source

    odd = pdf([PAGE]).replace(b"/Type /Font ", b"/Type /Font /ToUnicode 1 0 R /Subtype 7 ")
    (tmp_path / "odd.pdf").write_bytes(b"%PDF-1.4 1 0 obj [ endobj trailer << /Root [1] >> startxref")
    (tmp_path / "odd2.pdf").write_bytes(odd)
    (tmp_path / "good.pdf").write_bytes(pdf([PAGE]))
    got = {r.name: r for r in source.parsed(source.files(spark, str(tmp_path))).collect()}
    assert got["odd.pdf"].error and got["good.pdf"].error is None and len(got["good.pdf"].pages) == 1 and "odd2.pdf" in got


def test_requests_and_replies(spark, tmp_path):
    from quillspark.sources.tables import failure, reply

    lib = Library(spark, str(tmp_path / "lib"))
    made = lib.add_requests(spark.createDataFrame([('{"document_name": "a", "status": "no", "odd": [1]}',)], "body string"))
    assert reply(made.select("document_id", "document_name", "status", "document_type"), "Added", "document").first()[0] == '{"status":"ok","message":"Added","document":{"document_id":1,"document_name":"a","status":"UPLOADED","document_type":null}}'
    assert reply(spark.sql("select 3 as document_id, 2 as pages_detected"), "Read").first()[0] == '{"status":"ok","message":"Read","document_id":3,"pages_detected":2}'
    assert failure('no "x"') == '{"status":"error","message":"no \\"x\\""}'
    for body in ('{"document_type": "t"}', "no object", None):
        with pytest.raises(Violation, match="document_name"):
            lib.add_requests(spark.createDataFrame([(body,)], "body string"))


def test_the_clock_replies(spark, tmp_path):
    import json
    from datetime import datetime, timedelta

    told = json.loads(Library(spark, str(tmp_path)).clock().first()[0])
    assert list(told) == ["status", "message", "time"] and told["status"] == "ok" and told["message"].endswith("database connected")
    assert abs(datetime.fromisoformat(told["time"]).replace(tzinfo=None) - datetime.utcnow()) < timedelta(minutes=1)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from quillspark import session

    made = []
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    sc = SimpleNamespace(_jsc=jsc, master="spark://host:7077", setCheckpointDir=made.append)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
    assert made == []
