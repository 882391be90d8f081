"""Table candidates of pages: deduplication, quality, captions, attachment to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import geometry as B
from strataleaf.functions import grids as G
from strataleaf.functions import text as T

OVERLAP = 0.80
STRIP = 40.0
STRATEGIES = ("lines", "text", "mixed")


def normalise(candidates: DataFrame) -> DataFrame:
    """Candidates with stripped cells, null cells empty, and missing boxes zero."""
    grid = F.transform("data", lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: T.strip(F.coalesce(c, F.lit("")))))
    return candidates.withColumn("data", grid).fillna(0.0, ["x0", "y0", "x1", "y1"])


def union_strategies(*found: DataFrame) -> DataFrame:
    """Candidates of several strategies one after another, numbered by seq on each page."""
    out = None
    for k, df in enumerate(found):
        df = df.withColumn("_s", F.lit(k))
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy("doc_id", "page").orderBy("_s", "n")
    return out.withColumn("seq", F.row_number().over(w)).drop("_s")


def deduplicate(candidates: DataFrame) -> DataFrame:
    """Per page, in the order of seq: a candidate that overlaps a kept one by OVERLAP or more is absorbed, and takes its place if it has fewer empty cells.

    The outcome depends on the order, so it is a fold over a page's candidates, not a join.
    Rows (doc_id, page, place, seq, method, x0, y0, x1, y1, data, empty).
    """
    fields = ["seq", "method", "x0", "y0", "x1", "y1", "data"]
    item = F.struct(*fields, G.empty_ratio(F.col("data")).alias("empty"))
    pages = candidates.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("found"))
    corner = lambda s: (s["x0"], s["y0"], s["x1"], s["y1"])

    def step(kept, x):
        hits = F.transform(kept, lambda k: B.iou(corner(x), corner(k)) >= OVERLAP)
        at = F.coalesce(F.array_position(hits, True), F.lit(0).cast("long"))
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (x["empty"] < k["empty"]), x).otherwise(k))
        return F.when(at > 0, swapped).otherwise(F.concat(kept, F.array(x)))

    start = F.slice("found", 1, 0)
    return pages.select("doc_id", "page", F.posexplode(F.aggregate("found", start, step)).alias("place", "t")).select("doc_id", "page", "place", "t.*")


def accepted(tables: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Tables that pass the quality gate."""
    return tables.where(G.passes_quality(F.col("data"), F.col("x0"), F.col("x1"), F.lit(page_width), F.col("method")))


def captions(tables: DataFrame, words: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """(doc_id, page, place, caption): words in a strip above the table, else below, if they read like a caption; else empty."""
    on_page = tables.select("doc_id", "page", "place", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")]).join(words, ["doc_id", "page"])
    word = B.box()
    x0, x1 = F.greatest("t_x0", F.lit(0.0)), F.least("t_x1", F.lit(page_width))
    above = (x0, F.greatest(F.col("t_y0") - STRIP, F.lit(0.0)), x1, F.least("t_y0", F.lit(page_height)))
    below = (x0, F.greatest("t_y1", F.lit(0.0)), x1, F.least(F.col("t_y1") + STRIP, F.lit(page_height)))

    def text(where):
        near = F.array_sort(F.collect_list(F.when(B.intersects(word, where), F.struct("word_no", "word"))))
        return F.array_join(F.transform(near, lambda x: x["word"]), " ")

    texts = on_page.groupBy("doc_id", "page", "place").agg(text(above).alias("above"), text(below).alias("below"))
    chosen = F.when(F.col("above").rlike(T.TABLE_CAPTION), F.col("above")).when(F.col("below").rlike(T.TABLE_CAPTION), F.col("below")).otherwise("")
    joined = tables.select("doc_id", "page", "place").join(texts.select("doc_id", "page", "place", chosen.alias("caption")), ["doc_id", "page", "place"], "left")
    return joined.select("doc_id", "page", "place", F.coalesce("caption", F.lit("")).alias("caption"))


def attach(tables: DataFrame, deepest: DataFrame) -> DataFrame:
    """Tables with table_id (numbered on each page), header, rows and Markdown, and the section they belong to (deepest: as of tree.deepest_for_page)."""
    w = Window.partitionBy("doc_id", "page").orderBy("place")
    rows = tables.withColumn("_clean", G.cleaned(F.col("data")))
    rows = rows.withColumn("idx", F.row_number().over(w)).withColumn("table_id", F.concat(F.lit("p"), F.col("page"), F.lit("_t"), F.col("idx")))
    rows = rows.withColumn("headers", F.get("_clean", F.lit(0))).withColumn("rows", F.slice(F.col("_clean"), F.lit(2), F.greatest(F.size("_clean") - 1, F.lit(0))))
    rows = rows.withColumn("markdown", F.when(F.col("_clean").isNotNull(), G.markdown(F.col("_clean"))).otherwise(""))
    return rows.join(deepest, ["doc_id", "page"]).drop("_clean", "data", "empty")


def documents_for_table_pass(documents: DataFrame, page_tables: DataFrame) -> DataFrame:
    """Documents whose tables still have to be looked for: those without a table from the page model."""
    return documents.join(page_tables.select("doc_id").distinct(), "doc_id", "left_anti")
