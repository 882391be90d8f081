"""Text layers of pages: running lines, cleaning, text of page ranges, printed page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import text as T
from strataleaf.functions.binding import let

SCANNED_PAGES, LEAST_PAGES = 5, 3
MAX_CHARS = 15_000


def lines_of(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, page, line_no, line) of pages (doc_id, page, text)."""
    return pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, line, n_pages): stripped lines on three or more of a document's first five pages.

    Pages are told apart before they are counted, by a partial aggregate on the map side.
    """
    stripped = lines_of(pages.where(F.col("page") <= SCANNED_PAGES)).select("doc_id", "page", T.strip(F.col("line")).alias("line")).where(T.is_repeatable(F.col("line")))
    return stripped.distinct().groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)


def strip_text(texts: DataFrame, running: DataFrame, keys: list[str]) -> DataFrame:
    """texts (*keys, text) without running lines and page artefacts; at most one blank line in a row."""
    repeated = running.groupBy("doc_id").agg(F.collect_set("line").alias("_running"))
    joined = texts.join(repeated, "doc_id", "left")
    none = F.array().cast("array<string>")
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: let(T.strip(x), lambda s: ~F.array_contains(F.coalesce("_running", none), s) & ~T.is_artefact(s)))
    return joined.select(*keys, T.strip(T.squeeze_blank_lines(F.array_join(kept, "\n"))).alias("text"))


def range_texts(ranges: DataFrame, pages: DataFrame, running: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Text of page ranges (doc_id, pos, page_start, text_end): (doc_id, pos, text).

    Pages are joined by blank lines until ``max_chars`` characters are reached, then cleaned
    and cut. A running sum decides where to stop, so no range collects more than it keeps
    and one page.
    """
    spread = ranges.select("doc_id", "pos", F.explode(F.sequence(F.greatest("page_start", F.lit(1)), F.greatest("page_start", F.least("text_end", F.greatest("page_start", "text_end"))))).alias("page"))
    full = pages.select("doc_id", "page", T.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    joined = spread.join(full, ["doc_id", "page"])
    before = Window.partitionBy("doc_id", "pos").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = joined.withColumn("_sum", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_sum") < max_chars)
    texts = kept.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    clean = strip_text(texts, running, ["doc_id", "pos"])
    cut = F.when(F.length("text") > max_chars, T.rstrip(F.substring("text", 1, max_chars))).otherwise(F.col("text"))
    return ranges.select("doc_id", "pos").join(clean, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce(cut, F.lit("")).alias("text"))


def logical_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, logical): the printed number of each page, null where none is found."""
    return pages.select("doc_id", "page", T.logical_page(F.coalesce("text", F.lit(""))).alias("logical"))


def single_nodes(docs: DataFrame, pages: DataFrame, running: DataFrame) -> DataFrame:
    """One node for each document (doc_id, title, total_pages) without usable headings: all its text, confidence 0.6."""
    ranges = docs.select("doc_id", F.lit(1).alias("pos"), F.lit(1).alias("page_start"), F.greatest("total_pages", F.lit(1)).alias("text_end"))
    texts = range_texts(ranges, pages, running)
    return docs.join(texts, "doc_id").select("doc_id", F.lit(1).alias("pos"), F.lit(1).alias("level"), "title", "text", F.lit(1).alias("page_start"), F.greatest("total_pages", F.lit(1)).alias("page_end"), F.lit(0.6).alias("confidence"))
