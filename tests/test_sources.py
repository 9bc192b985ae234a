"""Sources, sinks and streams on small files."""

from __future__ import annotations

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import spans
from lectern.sources import books, files, html, logs
from lectern.sources.pdf import PdfError, pdf_text
from lectern.streaming import state as stream


def epub(*chapters: str, missing: bool = False) -> bytes:
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters))) + ('<itemref idref="gone"/>' if missing else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for k, body in enumerate(chapters):
            z.writestr(f"OEBPS/c{k}.xhtml", f"<html><head><title>x</title></head><body>{body}</body></html>")
    return out.getvalue()


def test_book_text():
    text = books.book_text(epub("<h1>One</h1><p>first <strong>bold</strong> <em>em</em></p>", "<h1>Two</h1><ul><li>item</li></ul>", missing=True))
    assert text.index("One") < text.index("first bold em") < text.index("Two") < text.index("item")
    assert "\n\nTwo" in text
    with pytest.raises(books.BookError, match="No readable content"):
        books.book_text(epub("  "))
    with pytest.raises(books.BookError):
        books.book_text(b"not a zip")


@pytest.mark.parametrize("body", ["<p>open <b>bold", "<div><blockquote><aside>deep</aside></blockquote></div>", "<p>héllo 😀 ∑ €</p>"])
def test_html_keeps_words(body):
    out = html.to_text(f"<html><script>var x</script><body>{body}</body></html>")
    for word in ("open", "bold", "deep", "héllo", "😀", "∑", "€"):
        assert (word in body) == (word in out)
    assert "var x" not in out


def test_read_documents_routes_and_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain\ntext")
    (tmp_path / "b.EPUB").write_bytes(epub("<p>book</p>"))
    (tmp_path / "c.epub").write_bytes(b"broken")
    (tmp_path / "d.md").write_text(" \n")
    found = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert found["a.txt"].text == "plain\ntext" and found["b.EPUB"].text == "book" and found["b.EPUB"].ext == "epub"
    assert found["c.epub"].text is None and "BookError" in found["c.epub"].error
    assert found["d.md"].error == "no content"
    assert files.non_empty(files.read_documents(spark, str(tmp_path))).count() == 2
    rows = books.chapter_rows(spark.read.format("binaryFile").load(str(tmp_path / "b.EPUB"))).collect()
    assert [(r.spine_idx, r.text) for r in rows] == [(0, "book")]


@pytest.mark.parametrize("bad", ["a\0b", "t|f", "t&f", "t;f", "t`f", "t$f", "t<f", "t>f", "t\nf"])
def test_paths_refused(bad):
    with pytest.raises(files.PathError) as e:
        files.normalized_path(bad)
    assert e.value.kind == "InvalidPath"


def test_paths_checked(tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    assert files.normalized_path(str(tmp_path / "." / "a b.txt")).endswith("a b.txt")
    for path, kind in ((str(tmp_path / "none"), "FileNotFound"), (str(tmp_path), "NotAFile")):
        with pytest.raises(files.PathError) as e:
            files.normalized_path(path)
        assert e.value.kind == kind


LOG = """{"UpdateProgress":{"timestamp":"2024-01-01T00:00:00Z","document_hash":18446744073709551615,"offset":50,"total_lines":100,"percentage":50.0,"viewport_offset":null,"cursor_y":null}}
{"UpdateProgress":{"timestamp":"2024-01-01T00:00:00Z","document_hash":18446744073709551615,"offset":60,"total_lines":100,"percentage":null}}
{"UpdateProgress":{"timestamp":"2024-01-01T00:00:00Z","document_hash":7,"offset":1,"total_lines":0,"percentage":null}}
"""


def test_progress_log(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(LOG)
    events = logs.read_progress(spark, str(tmp_path / "p.jsonl"))
    from lectern.operators.state import latest_progress

    last = {r.doc: r for r in latest_progress(events).collect()}
    assert last["18446744073709551615"].offset == 60 and last["7"].percentage is None and last["18446744073709551615"].cursor_y is None
    (tmp_path / "bad.jsonl").write_text(LOG + "not json\n")
    assert logs.read_progress(spark, str(tmp_path / "bad.jsonl")).count() == 3
    logs.write_progress(events, str(tmp_path / "out"))
    again = logs.read_progress(spark, str(tmp_path / "out"))
    assert sorted(r.doc for r in again.collect()) == sorted(r.doc for r in events.collect())


def test_bookmarks_and_highlights_round_trip(spark, tmp_path):
    assert logs.read_bookmarks(spark, str(tmp_path / "none")).count() == 0
    logs.write_bookmarks(spark.createDataFrame([("d", "a", 1, 2), ("d", "b", 3, 4), ("e", "a", 5, 6)], "doc string, mark string, line long, col long"), str(tmp_path / "m"))
    assert sorted((r.mark, r.line, r.col) for r in logs.read_bookmarks(spark, str(tmp_path / "m" / "*")).collect()) == [("a", 1, 2), ("a", 5, 6), ("b", 3, 4)]
    logs.write_highlights(spark.createDataFrame([("d", 30, 40, 1), ("d", 10, 20, 1)], "doc string, start long, end long, created_at long"), str(tmp_path / "h"))
    assert [(r.doc, r.start) for r in logs.read_highlights(spark, str(tmp_path / "h" / "*")).collect()] == [("d", 10), ("d", 30)]


def test_settings(tmp_path):
    path = str(tmp_path / ".env")
    assert logs.read_settings(path) == logs.DEFAULTS
    logs.write_settings(path, logs.Settings(show_progress=False))
    assert logs.read_settings(path).show_progress is False and logs.read_settings(path).show_cursor is True
    (tmp_path / ".env").write_text("SHOW_CURSOR=yes\n")
    assert logs.read_settings(path).show_cursor is False and logs.read_settings(path).show_progress is None


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [("a", k, k, o, o, s, s + 5) for k, (o, s) in enumerate([(1, 0), (1, 10), (2, 3), (2, 40), (1, 8)])] + [("b", 1, 1, 5, 5, 0, 9)]
    batch = spark.createDataFrame(rows, "doc string, t long, seq long, offset long, viewport_offset long, start long, end long").withColumn("ts", F.timestamp_seconds("t"))
    batch.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    drain(stream.latest_progress(read().select("doc", "ts", "seq", "offset")), "complete", "latest")
    assert {r.doc: r.offset for r in spark.table("latest").collect()} == {"a": 1, "b": 5}
    moves = stream.drained(stream.changes(read().select("doc", "ts", "seq", "offset", "viewport_offset")), str(tmp_path / "moves"), "update", ("doc", "seq"))
    assert sorted((r.doc, r.seq) for r in moves.where("changed").collect()) == [("a", 0), ("a", 2), ("a", 4), ("b", 1)]
    got = stream.drained(stream.toggled(read().select("doc", "ts", "seq", "start", "end")), str(tmp_path / "toggles"), "update", ("doc",))
    assert _toggles(got) == _by_batch(batch)


def _toggles(df):
    return {r.doc: sorted(zip(r.starts, r.ends, strict=True)) for r in df.collect() if r.starts}


def _by_batch(batch):
    want = {}
    for r in spans.toggled(batch.select("doc", "seq", "start", "end")).collect():
        want.setdefault(r.doc, []).append((r.start, r.end))
    return {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("lateness", [stream.LATENESS, 12.0])
def test_streams_agree_with_batch_over_several_triggers_and_late_rows(spark, tmp_path, lateness):
    """Rows come in other than time order, a few a trigger; what was put out last is what the batch gives."""
    rng = random.Random(3)
    rows = [(f"d{k % 3}", k, k, rng.randint(0, 3), rng.randint(0, 1), s := rng.randint(0, 60), s + rng.randint(1, 15)) for k in range(80)]
    kind = "doc string, t long, seq long, offset long, viewport_offset long, start long, end long"
    batch = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("t"))
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 9))
    for at in range(0, 80, 16):
        spark.createDataFrame(late[at : at + 16], kind).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    moves = stream.drained(stream.changes(read().select("doc", "ts", "seq", "offset", "viewport_offset"), lateness), str(tmp_path / "moves"), "update", ("doc", "seq"))
    last, want = {}, set()
    for doc, _, seq, offset, view, *_ in rows:
        want |= {(doc, seq)} if last.get(doc) != (offset, view) else set()
        last[doc] = (offset, view)
    assert {(r.doc, r.seq) for r in moves.where("changed").collect()} == want and moves.count() == 80
    got = stream.drained(stream.toggled(read().select("doc", "ts", "seq", "start", "end"), lateness), str(tmp_path / "toggles"), "update", ("doc",))
    assert _toggles(got) == _by_batch(batch)
    with pytest.raises(ValueError):
        stream.drained(got, str(tmp_path / "x"), "update")


@pytest.mark.parametrize(("page", "want"), [
    ("<head><title>t</title><body><p>all the text</p>", "all the text"),
    ("<html><head><meta charset=x><p>one<p>two", "one\ntwo"),
    ("<head><script>a</script><title>T</title></head>x", "x"),
    ("<header>kept</header><style>no</style>", "kept"),
])
def test_heads_closed_or_not(spark, page, want):
    assert html.to_text(page) == want
    stripped = spark.createDataFrame([(page,)], "h string").select(html.strip_tags(F.col("h")).alias("t")).first().t
    if "<body" in page or "</head>" in page or "<head>" not in page:
        assert stripped == want


def test_damaged_members_are_errors(spark, tmp_path):
    whole = bytearray(epub("<p>some words that are stored</p>"))
    at = whole.index(b"some words")
    whole[at : at + 4] = b"SOME"
    (tmp_path / "a.epub").write_bytes(bytes(whole))
    (tmp_path / "b.epub").write_bytes(epub("<p>fine</p>"))
    found = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert found["a.epub"].text is None and "BadZipFile" in found["a.epub"].error and found["b.epub"].text == "fine"
    assert [r.text for r in books.chapter_rows(spark.read.format("binaryFile").load(str(tmp_path))).collect()] == ["fine"]


def pdf(*pages: bytes, packed: bool = False, fonts: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more: tuple[bytes, ...] = ()) -> bytes:
    """A small PDF of content streams."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Resources << /Font << /F1 3 0 R >> >> >>", fonts]
    for k, page in enumerate(pages):
        raw = zlib.compress(page) if packed else page
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k))
        bodies.append(b"<< /Length %d%s >>\nstream\n" % (len(raw), b" /Filter /FlateDecode" if packed else b"") + raw + b"\nendstream")
    bodies += more
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, b) for k, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(spark, tmp_path, packed):
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\366rld) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* (third) ' ET"
    two = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <48692021> Tj 1 0 0 1 72 680 Tm (next) Tj ET"
    assert pdf_text(pdf(one, two, packed=packed)) == "Hello (big) w\u00f6rld\nsecond line\nthird\n\nHi !\nnext"
    (tmp_path / "a.pdf").write_bytes(pdf(one, packed=packed))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing in it")
    (tmp_path / "noext").write_bytes(pdf(two, packed=packed))
    found = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert found["a.pdf"].text.startswith("Hello (big)") and "PdfError" in found["b.pdf"].error and found["noext"].text == "Hi !\nnext"


def test_pdf_character_maps():
    chart = b"<< /Length 1 >>\nstream\n1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00E9> <D83DDE00>] endbfrange\nendstream"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    assert pdf_text(pdf(b"BT /F1 9 Tf <0010001100120003002000210099> Tj ET", fonts=font, more=(chart,))) == "ABC \u00e9\U0001f600"
    for bad in (b"", b"%PDF-1.4", b"%PDF-1.4 trailer << /Encrypt 3 0 R >>"):
        with pytest.raises(PdfError):
            pdf_text(bad)


def test_piped_input_wins_over_a_file(spark, tmp_path):
    (tmp_path / "f.txt").write_text("from\nfile\n")
    path = str(tmp_path / "f.txt")
    assert [r.text for r in files.piped_text(spark, io.BytesIO(b"piped\r\nin\n"), path).collect()] == ["piped\r\nin\n"]
    assert [(r.line_idx, r.line) for r in files.piped_lines(spark, io.BytesIO(b"piped\r\nin\n"), path).collect()] == [(0, "piped"), (1, "in")]
    assert [r.line for r in files.piped_lines(spark, io.BytesIO(b""), path).collect()] == ["from", "file"]
    assert files.piped_text(spark, io.BytesIO(b"")).count() == 0
    assert [r.text for r in files.read_text(spark, path).collect()] == ["from\nfile\n"]


def test_file_metadata(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("12345")
    (tmp_path / "sub" / "b.md").write_text("1")
    rows = sorted((r.name, r.ext, r.length) for r in files.list_files(spark, str(tmp_path)).collect())
    assert rows == [("a.TXT", "txt", 5), ("b.md", "md", 1)] and files.list_files(spark, str(tmp_path), "*.md").count() == 1


def test_text_sink_and_executables(spark, tmp_path):
    logs.write_text(spark.createDataFrame([("one\ntwo",)], "text string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["one", "two"]
    assert files.which("sh") and files.which("no-such-program-here") is None
