"""Markdown source: blocks by lines, then the same tree as HTML.

Covers what block structure needs: ATX and setext headings, fenced and indented code, block
quotes, lists and paragraphs. Inline marks stay out of titles and texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.sources import html

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]*)(.*?)[ \t]*#*[ \t]*$")
_SETEXT = re.compile(r"^(=+|-+)[ \t]*$")
_LIST = re.compile(r"^ {0,3}(?:[*+-]|\d+\.)[ \t]+")
_INLINE = [(re.compile(r"!\[([^\]]*)\]\([^)]*\)"), ""), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"(\*\*|__|\*|_|`)(?=\S)(.+?)(?<=\S)\1"), r"\2")]


def plain(text: str) -> str:
    for pattern, to in _INLINE:
        text = pattern.sub(to, text)
    return text


def blocks_of(source: str | None) -> list[tuple[str, str, str]]:
    """(tag, joined, spaced) of the blocks, as html.elements_of gives them."""
    out: list[tuple[str, str, str]] = []
    lines = (source or "").expandtabs(4).split("\n")
    k = 0

    def add(tag: str, parts: list[str]) -> None:
        parts = [p for p in (x.strip() for x in parts) if p]
        out.append((tag, "".join(parts), " ".join(parts)))

    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := _ATX.match(line):
            add(f"h{len(m[1])}", [plain(m[2])])
            k += 1
        elif line.startswith("    "):
            start = k
            while k < len(lines) and (lines[k].startswith("    ") or not lines[k].strip()):
                k += 1
            code = ["\n".join(x[4:] for x in lines[start:k])]
            add("pre", code)
            add("code", code)
        elif line.lstrip().startswith(">"):
            start = k
            while k < len(lines) and lines[k].strip():
                k += 1
            quoted = [plain("\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[start:k]))]
            add("blockquote", quoted)
            add("p", quoted)
        elif _LIST.match(line):
            start = k
            while k < len(lines) and lines[k].strip():
                k += 1
            tag = "ul" if re.match(r" {0,3}[*+-]", line) else "ol"
            add(tag, [plain(_LIST.sub("", x)) for x in lines[start:k]])
        elif k + 1 < len(lines) and _SETEXT.match(lines[k + 1]):
            add("h1" if lines[k + 1][0] == "=" else "h2", [plain(line)])
            k += 2
        else:
            start = k
            while k < len(lines) and lines[k].strip() and not _ATX.match(lines[k]):
                k += 1
            add("p", [plain("\n".join(lines[start:k]))])
    return out


def elements(files: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    """html.ELEMENTS of Markdown texts."""
    source = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("md"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int32()), ("pos", pa.int32()), ("tag", pa.string()), ("level", pa.int32()), ("joined", pa.string()), ("spaced", pa.string())])
        for batch in batches:
            rows = [(d, 1, k, tag, int(tag[1]) if tag in html.HEADINGS else None, a, b) for d, md in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (tag, a, b) in enumerate(blocks_of(md))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)

    return source.mapInArrow(run, html.ELEMENTS)
