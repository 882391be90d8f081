"""Office and e-book files: zip containers of XML, decoded one file at a time, then plans of windows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataleaf.functions import text as T
from strataleaf.operators import tree
from strataleaf.sources import html

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Levels of paragraph styles.
STYLE_LEVELS = {**{f"heading {k}": k for k in range(1, 10)}, "title": 1, "subtitle": 2}
PARAGRAPHS = "doc_id long, pos int, style string, text string, has_break boolean"
SHAPES = "doc_id long, slide int, shape int, is_title boolean, text string"
ITEMS = "doc_id long, item int, html string"


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """(doc_id, path, content) of binary files; doc_id is a hash of the path."""
    return spark.read.format("binaryFile").load(glob).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def docx_paragraphs(content: bytes) -> list[tuple[str, str, bool]]:
    """(style name, text, holds a page break) of the body's paragraphs; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        style = p.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(f"{_W}val") if style is not None else None
        parts = []
        for run in p.iter():
            if run.tag == f"{_W}t":
                parts.append(run.text or "")
            elif run.tag == f"{_W}tab":
                parts.append("\t")
            elif run.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        broken = any(x.tag in (f"{_W}pageBreak", f"{_W}lastRenderedPageBreak") for x in p.iter())
        out.append((names.get(key, key) or "Normal", "".join(parts), broken))
    return out


def pptx_shapes(content: bytes) -> list[tuple[int, int, bool, str]]:
    """(slide, shape, is title placeholder, text) of shapes with text, slides in the order of the show."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        show = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        targets = [rels[s.get(f"{_R}id")] for s in show.iter(f"{_P}sldId")]
        out = []
        for n, target in enumerate(targets, 1):
            slide = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"ppt/{target}"))
            seen_title = False
            shapes = list(slide.iter(f"{_P}sp"))
            for k, sp in enumerate(shapes, 1):
                ph = sp.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                is_title = not seen_title and ph is not None and (ph.get("type") in ("title", "ctrTitle") or ph.get("idx") == "0")
                seen_title |= is_title
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in sp.iter(f"{_A}p"))
                out.append((n, k, is_title, text))
            if not shapes:
                out.append((n, 0, False, ""))
    return out


def epub_items(content: bytes) -> list[tuple[int, str]]:
    """(number, markup) of the book's documents in the order of its manifest."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
        folder = package.rpartition("/")[0]
        manifest = [x for x in ElementTree.fromstring(z.read(package)).iter() if x.tag.endswith("}item")]
        paths = [x.get("href") for x in manifest if x.get("media-type") == "application/xhtml+xml" and "nav" not in (x.get("properties") or "").split()]
        return [(k, z.read(f"{folder}/{p}" if folder else p).decode("utf-8", "ignore")) for k, p in enumerate(paths, 1)]


def _decoded(files: DataFrame, decode, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *row) for d, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in decode(content)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, schema)


def paragraphs(files: DataFrame) -> DataFrame:
    def decode(content):
        return [(k, *row) for k, row in enumerate(docx_paragraphs(content))]

    return _decoded(files, decode, PARAGRAPHS, [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()])


def shapes(files: DataFrame) -> DataFrame:
    return _decoded(files, pptx_shapes, SHAPES, [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()])


def book_sections(files: DataFrame) -> DataFrame:
    """Section trees of e-books: each document of a book is a page, and its headings start at the top again."""
    items = _decoded(files, epub_items, ITEMS, [pa.int64(), pa.int32(), pa.string()])
    return html.sections(html.elements(items, "doc_id", "html", "item"))


def docx_sections(found: DataFrame) -> DataFrame:
    """Section trees of paragraphs (PARAGRAPHS): styles give levels, page breaks before a paragraph its page.

    Text before the first heading is dropped; a heading style without text is no heading.
    """
    levels = F.create_map(*[F.lit(x) for pair in STYLE_LEVELS.items() for x in pair])
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = found.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).withColumn("level", F.element_at(levels, F.lower("style")))
    rows = rows.withColumn("page", (1 + F.coalesce(F.sum(F.col("has_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    is_head = F.col("level").isNotNull() & (F.col("text") != "")
    owned = rows.withColumn("owner", F.max(F.when(is_head, F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = owned.where(~is_head & F.col("owner").isNotNull() & (F.col("text") != "")).groupBy("doc_id", F.col("owner").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    heads = owned.where(is_head).select("doc_id", "pos", "level", F.col("text").alias("title"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return tree.build(heads).join(texts, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("body", F.lit(""))).drop("body").withColumn("confidence", F.lit(1.0))


def slide_sections(found: DataFrame, stems: DataFrame) -> DataFrame:
    """Trees of shapes (SHAPES): the file's stem (stems: doc_id, title) on top, slides below.

    A slide whose title has at most eight words and no other text is a section; the slides
    after it are its children. Without a title placeholder the first text is the title and
    stays in the body, so such a slide is no section.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    ordered = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("shape", text.alias("t")))))
    slides = found.groupBy("doc_id", "slide").agg(F.max(F.when(F.col("is_title") & (text != ""), text)).alias("_title"), ordered(text != "").alias("_any"), ordered((text != "") & ~F.col("is_title")).alias("_body"))
    title = F.coalesce("_title", F.get("_any", F.lit(0))["t"])
    rows = slides.select("doc_id", "slide", title.alias("_t"), F.array_join(F.transform("_body", lambda x: x["t"]), "\n\n").alias("text"), (F.coalesce(T.word_count(title), F.lit(0)).between(1, 8) & (F.size("_body") == 0)).alias("divider"))
    w = Window.partitionBy("doc_id").orderBy("slide").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.coalesce(F.max(F.col("divider").cast("int")).over(w), F.lit(0)) == 1)
    level = F.when(F.col("divider") | ~F.col("_open"), 2).otherwise(3)
    nodes = rows.select("doc_id", (F.col("slide") + 1).alias("pos"), level.alias("level"), F.coalesce("_t", F.concat(F.lit("Slide "), F.col("slide"))).alias("title"), "text", F.col("slide").alias("page_start"), F.col("slide").alias("page_end"))
    tops = stems.join(found.groupBy("doc_id").agg(F.max("slide").alias("n")), "doc_id").select("doc_id", F.lit(1).alias("pos"), F.lit(1).alias("level"), "title", F.lit("").alias("text"), F.lit(1).alias("page_start"), F.col("n").alias("page_end"))
    return tree.build(tops.unionByName(nodes)).withColumn("confidence", F.lit(1.0))
