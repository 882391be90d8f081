"""Hook for a model that reads page images: any callable (image, previous tail, addendum) -> Markdown.

A page's prompt holds the end of the page before it, so a document's pages are read in order;
documents run in parallel. There is no client here: the callable is the caller's.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.operators import page_markdown

ATTEMPTS, PAUSE_SECONDS, TAIL = 3, 2.0, 500
DPI = 150
#: What a prompt says further about a type of document, in our own words.
ADDENDA = {
    "legal": "Provision numbers in the margin are text, not headings. Keep every level of indentation of numbered provisions.",
    "academic": "Keep citations in brackets and number footnotes. References form one section.",
    "financial": "Keep figures, signs and units as printed; every table keeps its columns.",
    "technical": "Keep code in fences and the names of parameters as they are.",
    "form": "Write fields as 'label: value' and boxes as [ ] or [x].",
    "general": "",
}


def addendum(doc_type: Column) -> Column:
    """The further instructions for a type, empty for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in ADDENDA.items() for x in pair])
    return F.coalesce(F.element_at(table, doc_type), F.lit(""))


def zoom(dpi: int = DPI) -> float:
    return dpi / 72.0


def transcribe(pages: DataFrame, model: Callable[[bytes, str, str], str], attempts: int = ATTEMPTS, pause: float = PAUSE_SECONDS) -> DataFrame:
    """(doc_id, page_num, md) of page images (doc_id, page_num, image).

    A call that fails is tried again after a pause that grows by ``pause`` each time; a page
    that fails for good reads ``[ERROR: Could not process page N]``, and the others go on.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out, tail = [], ""
        for row in frame.sort_values("page_num").itertuples():
            md = f"[ERROR: Could not process page {row.page_num}]"
            for k in range(attempts):
                try:
                    md = model(row.image, tail, "")
                    break
                except Exception:  # noqa: BLE001  whatever the caller's model raises
                    if k + 1 < attempts:
                        time.sleep(pause * (k + 1))
            tail = md[-TAIL:]
            out.append((row.doc_id, row.page_num, md))
        return pd.DataFrame(out, columns=["doc_id", "page_num", "md"])

    return pages.select("doc_id", "page_num", "image").groupBy("doc_id").applyInPandas(one, "doc_id long, page_num int, md string")


def sections(pages: DataFrame, model: Callable[[bytes, str, str], str], **options) -> DataFrame:
    """Section trees of page images: transcription, cleaning, continuations, tree."""
    return page_markdown.sections(page_markdown.with_continuations(transcribe(pages, model, **options)))
