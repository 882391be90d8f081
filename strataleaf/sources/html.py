"""HTML and e-book sources: markup to elements in document order, elements to sections.

Decoding runs one document at a time in Arrow batches; all that follows is a plan of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import text as T
from strataleaf.operators import tree

HEADINGS = tuple(f"h{k}" for k in range(1, 7))
CONTAINERS = ("p", "div", "ul", "ol", "pre", "code", "blockquote", "table")
# Elements without content.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
REFERENCE = re.compile(r"&(?:#\d+;|#[xX][\da-fA-F]+;|[A-Za-z][A-Za-z\d]*;)?")
ELEMENTS = "doc_id long, item int, pos int, tag string, level int, joined string, spaced string"


class _Elements(HTMLParser):
    """Wanted elements with the text between their tags. End tags close the nearest open element of their name, others are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.body_at: int | None = None
        self.body_over = False
        self.buffer: list[str] = []

    def _text(self) -> None:
        if self.buffer:
            text = "".join(self.buffer).strip()
            self.buffer.clear()
            if text and not any(t in HIDDEN for t, _ in self.open):
                for _, k in self.open:
                    if k is not None:
                        self.found[k][1].append(text)

    def handle_starttag(self, tag, attrs):
        self._text()
        if tag == "body" and self.body_at is None:
            self.body_at = len(self.found)
        k = None
        if (tag in HEADINGS or tag in CONTAINERS) and not self.body_over:
            k = len(self.found)
            self.found.append((tag, []))
        if tag not in VOID:
            self.open.append((tag, k))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._text()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if any(t == "body" for t, _ in self.open[k:]):
                    self.body_over = True
                del self.open[k:]
                return

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._text()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _bare_as_text(markup: str) -> str:
    """Markup in which an ampersand that begins no known reference with a semicolon stands for itself."""
    return REFERENCE.sub(lambda m: m[0] if m[0].startswith("&#") or m[0][1:] in html5 else f"&amp;{m[0][1:]}", markup)


def elements_of(markup: str | None, bare: bool = True) -> list[tuple[str, str, str]]:
    """(tag, text joined without a separator, text joined by spaces) of headings and containers in the body, in document order."""
    parser = _Elements()
    parser.feed(markup or "" if bare else _bare_as_text(markup or ""))
    parser.close()
    parser._text()
    return [(tag, "".join(parts), " ".join(parts)) for tag, parts in parser.found[parser.body_at or 0 :]]


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", item_col: str | None = None, bare: bool = True) -> DataFrame:
    """ELEMENTS of pages; an item is one file of an e-book (1 for a page of its own).

    References without a semicolon, such as ``&amp``, are decoded as browsers do; without
    ``bare`` they are text, as for one that was cut off.
    """
    item = F.col(item_col).cast("int") if item_col else F.lit(1)
    source = pages.select(F.col(id_col).cast("long").alias("doc_id"), item.alias("item"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int32()), ("pos", pa.int32()), ("tag", pa.string()), ("level", pa.int32()), ("joined", pa.string()), ("spaced", pa.string())])
        for batch in batches:
            rows = [(d, i, k, tag, int(tag[1]) if tag in HEADINGS else None, a, b) for d, i, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (tag, a, b) in enumerate(elements_of(h, bare))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)

    return source.mapInArrow(run, ELEMENTS)


def sections(found: DataFrame) -> DataFrame:
    """Section tree of elements: nodes with title, text, page_start and page_end (the item's number).

    A container's text goes to the heading before it in its item, so nested containers repeat
    their text; containers before the first heading are dropped. Trees of an e-book's items
    stand side by side.
    """
    order = Window.partitionBy("doc_id").orderBy("item", "pos")
    in_item = Window.partitionBy("doc_id", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("level").isNotNull()
    numbered = found.withColumn("_all", F.row_number().over(order))
    owned = numbered.withColumn("owner", F.max(F.when(is_head, F.col("_all"))).over(in_item))
    heads = owned.where(is_head).select("doc_id", F.col("_all").alias("pos"), "item", "level", T.strip_numbering(F.col("joined")).alias("title"), F.col("item").alias("page_start"), F.col("item").alias("page_end"))
    texts = owned.where(~is_head & F.col("owner").isNotNull() & (F.col("spaced") != "")).groupBy("doc_id", F.col("owner").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_all", "spaced"))), lambda x: x["spaced"]), "\n\n").alias("text"))
    # Each item starts at the top again: levels count from the item's own stack.
    before = Window.partitionBy("doc_id", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parent = None
    for k in range(1, 7):
        nearest = F.max(F.when(F.col("level") < k, F.col("pos"))).over(before)
        parent = F.when(F.col("level") == k, nearest) if parent is None else parent.when(F.col("level") == k, nearest)
    linked = heads.withColumn("parent_pos", parent)
    # Only the path matters for numbering, so a node's depth can stand for its level across items.
    nodes = tree.with_identity(_levels_by_depth(linked))
    return nodes.join(texts, ["doc_id", "pos"], "left").select("doc_id", "pos", "parent_pos", "level", "id", "section_id", "depth", "node_type", "title", F.coalesce("text", F.lit("")).alias("text"), "page_start", "page_end", F.lit(1.0).alias("confidence"))


def _levels_by_depth(linked: DataFrame) -> DataFrame:
    """level becomes the number of open headings, counted in the item: headings of smaller levels that no later one closed."""
    before = Window.partitionBy("doc_id", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.max(F.when(F.col("level") <= k, F.struct("pos", "level"))).over(before) for k in range(1, 7)]
    marked = linked.select("*", *[x.alias(f"_d{k}") for k, x in enumerate(latest, 1)])
    depth = sum((F.when((F.col(f"_d{k}.level") == k) & (F.col("level") >= k), 1).otherwise(0) for k in range(1, 7)), F.lit(0))
    return marked.withColumn("level", depth).drop(*[f"_d{k}" for k in range(1, 7)])
