"""Decoders on small files made in memory, file rules, images, and jobs as batch and stream."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from strataleaf.config import StructureConfig
from strataleaf.operators import images
from strataleaf.sources import files, html, markdown, office
from strataleaf.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def paragraph(style, text, broken=False):
    mark = "<w:r><w:lastRenderedPageBreak/></w:r>" if broken else ""
    pr = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{pr}{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(*paragraphs):
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
    return zipped(**{"word/document.xml": f"<w:document {W}><w:body>{''.join(paragraphs)}<w:tbl/></w:body></w:document>", "word/styles.xml": styles})


def slide(*shapes):
    body = "".join(f'<p:sp><p:nvSpPr><p:nvPr>{"<p:ph type=\"title\"/>" if title else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>' for title, text in shapes)
    return f"<p:sld {A}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"


def pptx(*slides):
    rels = "".join(f'<Relationship Id="r{k}" Target="slides/s{k}.xml"/>' for k in range(len(slides)))
    show = "".join(f'<p:sldId r:id="r{k}"/>' for k in range(len(slides)))
    members = {"ppt/presentation.xml": f"<p:presentation {A}><p:sldIdLst>{show}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": f"<Relationships>{rels}</Relationships>"}
    return zipped(**members, **{f"ppt/slides/s{k}.xml": s for k, s in enumerate(slides)})


def test_docx(spark, tmp_path):
    content = docx(paragraph("", "lost"), paragraph("H1", "1. One"), paragraph("", "a"), paragraph("", "b", broken=True), paragraph("H1", " "), paragraph("H2", "Two"), paragraph("", "c"))
    (tmp_path / "x.docx").write_bytes(content)
    found = office.read_files(spark, str(tmp_path / "*.docx"))
    got = office.docx_sections(office.paragraphs(found)).orderBy("pos").collect()
    assert [(r["section_id"], r["title"], r["text"], r["page_start"]) for r in got] == [("1", "1. One", "a\n\nb", 1), ("1.1", "Two", "c", 2)]


def test_pptx(spark):
    content = pptx(slide((True, "Intro"), (False, "hello"), (False, "world")), slide((True, "Chapter")), slide((True, "Inner"), (False, "x")), slide((False, "untitled")), slide())
    rows = spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary")
    got = office.slide_sections(office.shapes(rows), spark.createDataFrame([(1, "deck")], "doc_id long, title string")).orderBy("pos").collect()
    assert [(r["section_id"], r["title"], r["text"]) for r in got] == [("1", "deck", ""), ("1.1", "Intro", "hello\n\nworld"), ("1.2", "Chapter", ""), ("1.2.1", "Inner", "x"), ("1.2.2", "untitled", "untitled"), ("1.2.3", "Slide 5", "")]
    assert got[0]["page_end"] == 5


def test_epub(spark):
    package = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="a.xhtml" media-type="application/xhtml+xml"/><item href="b.xhtml" media-type="application/xhtml+xml"/><item href="c.css" media-type="text/css"/></manifest></package>'
    content = zipped(**{"META-INF/container.xml": '<c><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>', "O/p.opf": package, "O/a.xhtml": "<body><h2>A</h2><p>x</p><h3>B</h3></body>", "O/b.xhtml": "<body><p>lost</p><h3>C</h3><p>y</p><h1>D</h1></body>"})
    rows = spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary")
    got = office.book_sections(rows).orderBy("pos").collect()
    assert [(r["section_id"], r["title"], r["text"], r["page_start"]) for r in got] == [("1", "A", "x", 1), ("1.1", "B", "", 1), ("2", "C", "y", 2), ("3", "D", "", 2)]


def sections(spark, found):
    return [(r["section_id"], r["title"], r["text"]) for r in html.sections(found).orderBy("pos").collect()]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><div>lost</div><h1>1. Top <b>bold</b></h1><div>out<p>in <i>ner</i></p></div><script>x</script><!-- c --><h3></h3><ul><li>a</li><li>b &amp; c</li></ul><h2>Next</h2></body><p>after</p></html>"
    rows = spark.createDataFrame([(1, page), (2, "<p>no heading"), (3, None)], "page_id long, html string")
    assert sections(spark, html.elements(rows)) == [("1", "Topbold", "out in ner\n\nin ner"), ("1.1", "", "a b & c"), ("1.2", "Next", "")]


def test_unclosed_paragraphs_nest():
    found = html.elements_of("<body><h1>h</h1><p>one<p>two</p>three</body>")
    assert [(t, s) for t, _, s in found] == [("h1", "h"), ("p", "one two three"), ("p", "two")]


def test_markdown(spark):
    text = "lost\n\n# One #\npara *em*\nline two\n\nTwo\n---\n- a\n- b\n\n> quote\n\n    code\n\n#### Deep"
    rows = spark.createDataFrame([(1, text)], "doc_id long, md string")
    assert sections(spark, markdown.elements(rows)) == [("1", "One", "para em\nline two"), ("1.1", "Two", "a b\n\nquote\n\nquote\n\ncode\n\ncode"), ("1.1.1", "Deep", "")]


@pytest.mark.parametrize(("path", "fmt", "route"), [("a/B.PDF", "pdf", "pdf parser"), ("x.jpeg", "image", "error: images need the page model"), ("x.tar", None, "error: unsupported file format .tar"), ("x.doc", "docx", "docx parser"), ("noext", None, "error: unsupported file format ")])
def test_routing(spark, path, fmt, route):
    row = spark.createDataFrame([(path,)], ["p"]).select(files.source_format(F.col("p")).alias("f"), files.route(F.col("p"), F.lit(False)).alias("r"), files.route(F.col("p"), F.lit(False), StructureConfig(page_model_available=True)).alias("m")).first()
    assert (row["f"], row["r"]) == (fmt, route)
    assert row["m"] == ("page model" if fmt in ("pdf", "image") else route)


def test_outlines_gate_twice(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    toc = spark.createDataFrame([(1, 1, 1, " ", 0), (1, 2, 1, "x", 3)], "doc_id long, pos int, level int, title string, page_start int")
    assert {r["doc_id"]: r["has_outline"] for r in files.usable_outlines(docs, toc).collect()} == {1: True, 2: False}
    assert files.sanitise_outline(toc).count() == 1


@pytest.mark.parametrize(("path", "ok"), [("assets/a.png", True), ("../x", False), ("a/../../x", False), ("a/../b", True), ("/etc/x", False), ("a/..", False)])
def test_assets_stay_inside(spark, path, ok):
    assert spark.createDataFrame([(path,)], ["p"]).select(files.is_inside(F.col("p")).alias("x")).first()["x"] is ok


def test_sizes_and_names(spark):
    row = spark.range(1).select(*[files.size_text(F.lit(n)).alias(f"s{k}") for k, n in enumerate((0, 1, 1536, 5 * 1024**2, 3 * 1024**4))], files.stem(F.lit("a/b.c.pdf")).alias("stem"), files.asset_url(F.lit("j"), F.lit("assets/x.png")).alias("url")).first()
    assert list(row) == ["0 B", "1.0 B", "1.5 KB", "5.0 MB", "3072.0 GB", "b.c", "/asset/j/assets/x.png"]


def test_write_outputs(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a":1}', "# x\ny")], "doc_id long, json string, markdown string")
    files.write_outputs(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/markdown"), wholetext=True).first()["value"].strip() == "# x\ny"
    with pytest.raises(ValueError):
        files.write_outputs(rows, str(tmp_path / "out"), "xml")


def test_raster_rules(spark):
    def image(n, **k):
        base = {"doc_id": 1, "page": 1, "n": n, "xref": n, "width_px": 200, "height_px": 200, "bpc": 8, "ext": "png", "x0": 100.0, "y0": 200.0, "x1": 300.0, "y1": 400.0}
        return tuple({**base, **k}.values())

    rows = [image(1), image(2, width_px=79), image(3, width_px=1000, height_px=100), image(4, bpc=1), image(5, x1=110.0), image(6, y0=0.0, y1=80.0, x0=0.0, x1=600.0), image(7, x0=None, y0=None, x1=None, y1=None), image(8, xref=1), image(9, bpc=0)]
    schema = "doc_id long, page int, n long, xref long, width_px int, height_px int, bpc int, ext string, x0 double, y0 double, x1 double, y1 double"
    got = images.rasters(spark.createDataFrame(rows, schema)).orderBy("n").collect()
    assert [(r["n"], r["filename"]) for r in got] == [(1, "p1_img_1.png"), (7, "p1_img_2.png"), (9, "p1_img_3.png")]


def test_placements_prefer_the_first_source(spark):
    im = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 1, 7)], "doc_id long, page int, xref long")
    box = "doc_id long, page int, xref long, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 1, 5, 1.0, 1.0, 2.0, 2.0)], box)
    b = spark.createDataFrame([(1, 1, 5, 9.0, 9.0, 9.0, 9.0), (1, 1, 6, 3.0, 3.0, 4.0, 4.0)], box)
    assert {r["xref"]: r["x0"] for r in images.placements(im, a, b).collect()} == {5: 1.0, 6: 3.0, 7: None}


def test_markers_fold_in_order(spark):
    nodes = spark.createDataFrame([(1, 1, "Alpha beta gamma.\n\nNext."), (1, 2, "kept")], "doc_id long, pos int, text string")
    blocks = spark.createDataFrame([(1, 1, 50.0, "Alpha beta gamma."), (1, 1, 500.0, "Next.")], "doc_id long, page int, y1 double, text string")
    figures = spark.createDataFrame([(1, 1, 1, 1, 60.0, "a.png", "F1", ""), (1, 1, 2, 1, 510.0, "b.png", "F2", "")], "doc_id long, page int, n int, pos int, y0 double, filename string, label string, caption string")
    got = {r["pos"]: r["text"] for r in images.insert_markers(nodes, images.block_above(figures, blocks, ["doc_id", "page", "n"])).collect()}
    assert got == {1: "Alpha beta gamma.\n\n\n\n{{IMG:a.png|F1|}}\n\nNext.\n\n{{IMG:b.png|F2|}}\n\n", 2: "kept"}


EVENTS = "job_id long, event_id long, ts timestamp, event string, progress_page int"


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    return [(1, 1, at(0), "submitted", 0), (1, 2, at(1), "progress", 3), (1, 3, at(2), "progress", 5), (1, 4, at(3), "complete", 0), (2, 5, at(1), "submitted", 0), (2, 6, at(2), "error", 0), (3, 7, at(4), "submitted", 0), (4, 8, at(4), "submitted", 0), (4, 9, at(5), "deleted", 0)]


def test_job_states(spark):
    got = {r["job_id"]: (r["status"], r["progress_page"], r["elapsed_seconds"]) for r in jobs.states(spark.createDataFrame(events(spark), EVENTS)).collect()}
    assert got[1] == ("complete", 5, 180.0) and got[2] == ("error", 0, 60.0) and got[3] == ("processing", 0, 0.0)
    codes = spark.createDataFrame([(None,), ("error",), ("processing",), ("complete",)], "s string").select(jobs.result_code(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in codes] == [404, 500, 409, 200]


def test_job_stream_agrees_with_batch_and_expires(spark, tmp_path):
    rows = events(spark)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    late = dt.datetime(2024, 1, 1, 3)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = jobs.state_stream(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = {r["job_id"]: (r["status"], r["progress_page"]) for r in spark.table("job_states").where("NOT expired").collect()}
        want = {r["job_id"]: (r["status"], r["progress_page"]) for r in jobs.states(spark.createDataFrame(rows, EVENTS)).collect() if r["job_id"] != 4}
        assert got == want
        for k in range(2):
            spark.createDataFrame([(9, 90 + k, late + dt.timedelta(hours=k), "submitted", 0)], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
            query.processAllAvailable()
        assert {r["job_id"] for r in spark.table("job_states").where("expired").collect()} >= {1, 2, 3}
    finally:
        query.stop()


def test_progress_windows(spark, tmp_path):
    spark.createDataFrame(events(spark), EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.progress_windows(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("job_windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert {r["event"]: r["n"] for r in spark.table("job_windows").collect()} == {"submitted": 4, "progress": 2, "complete": 1, "error": 1, "deleted": 1}
    finally:
        query.stop()


def test_page_model_retries_and_goes_on(spark):
    from strataleaf.sources import page_model

    def model(image, tail, addendum):
        if image == b"bad":
            raise OSError("no answer")
        return f"# {image.decode()}\nafter <{tail[-5:]}>"

    rows = spark.createDataFrame([(1, 2, bytearray(b"bad")), (1, 1, bytearray(b"Alpha")), (1, 3, bytearray(b"Gamma"))], "doc_id long, page_num int, image binary")
    got = [r["md"] for r in page_model.transcribe(rows, model, pause=0.0).orderBy("page_num").collect()]
    assert got == ["# Alpha\nafter <>", "[ERROR: Could not process page 2]", "# Gamma\nafter <ge 2]>"]
    assert [r["title"] for r in page_model.sections(rows, model, pause=0.0).orderBy("pos").collect()] == ["Alpha", "Gamma"]
    assert spark.range(1).select(page_model.addendum(F.lit("form")).alias("a"), page_model.addendum(F.lit("x")).alias("b")).first() == (page_model.ADDENDA["form"], "")
