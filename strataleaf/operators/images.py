"""Images and figures of pages: validity, diagrams, captions, markers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import geometry as B
from strataleaf.functions import text as T

MIN_PIXELS, MIN_ASPECT, MAX_ASPECT, MIN_BITS = 80, 0.14, 7.0, 2
MIN_AREA, MARGIN = 0.03, 0.07
MIN_PATHS, MIN_VECTOR_AREA = 8, 0.04
PADDING, TABLE_OVERLAP, MAX_TEXT_DENSITY = 3.0, 0.40, 0.40
CAPTION_STRIP = 60.0
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def is_valid_raster(page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> Column:
    """A predicate of images (width_px, height_px, bpc, x0 ... y1); without a box, size and place are not asked for."""
    w, h = F.col("width_px"), F.col("height_px")
    pixels = (w >= MIN_PIXELS) & (h >= MIN_PIXELS)
    aspect = w.cast("double") / F.greatest(h, F.lit(1))
    depth = F.when(F.coalesce("bpc", F.lit(0)) == 0, F.lit(8)).otherwise(F.col("bpc")) >= MIN_BITS
    b = B.box()
    boxed = F.coalesce((b[2] > b[0]) & (b[3] > b[1]), F.lit(False))
    centre = (b[1] + b[3]) / 2.0
    placed = (B.area(b) / F.lit(page_width * page_height) >= MIN_AREA) & ~(centre < page_height * MARGIN) & ~(centre > page_height * (1.0 - MARGIN))
    return pixels & (aspect >= MIN_ASPECT) & (aspect <= MAX_ASPECT) & depth & (~boxed | placed)


def rasters(images: DataFrame) -> DataFrame:
    """Valid images, each xref once a page, named by page and number."""
    first = Window.partitionBy("doc_id", "page", "xref").orderBy("n")
    once = images.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").where(is_valid_raster())
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    numbered = once.withColumn("idx", F.row_number().over(w))
    return numbered.withColumn("filename", F.concat(F.lit("p"), F.col("page"), F.lit("_img_"), F.col("idx"), F.lit("."), F.coalesce("ext", F.lit("png"))))


def placements(images: DataFrame, from_list: DataFrame, from_text: DataFrame) -> DataFrame:
    """Images with the box of the first source that knows their xref (both: doc_id, page, xref, x0, y0, x1, y1)."""
    def first(df: DataFrame, name: str) -> DataFrame:
        boxes = F.struct("x0", "y0", "x1", "y1")
        return df.groupBy("doc_id", "page", "xref").agg(F.min(boxes).alias(name))

    keys = ["doc_id", "page", "xref"]
    joined = images.join(first(from_list, "_a"), keys, "left").join(first(from_text, "_b"), keys, "left")
    return joined.withColumn("_box", F.coalesce("_a", "_b")).select(*images.columns, "_box.*")


def diagram_pages(drawings: DataFrame) -> DataFrame:
    """(doc_id, page, n_paths, area_ratio) of pages with enough drawing paths and area."""
    sums = drawings.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_paths"), (F.sum(B.area(B.box())) / F.lit(PAGE_WIDTH * PAGE_HEIGHT)).alias("area_ratio"))
    return sums.where((F.col("n_paths") >= MIN_PATHS) & (F.col("area_ratio") >= MIN_VECTOR_AREA))


def text_density(regions: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, density): area of words inside a region over the region's area; 1 for regions without one."""
    region = regions.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    r = B.box("r_")
    inside = region.join(words, ["doc_id", "page"]).groupBy(*keys).agg(F.sum(B.intersection(B.box(), r)).alias("_in"))
    joined = region.join(inside, keys, "left")
    return joined.select(*keys, F.when((r[2] <= r[0]) | (r[3] <= r[1]), F.lit(1.0)).otherwise(F.coalesce("_in", F.lit(0.0)) / B.area(r)).alias("density"))


def diagrams(clusters: DataFrame, tables: DataFrame, words: DataFrame) -> DataFrame:
    """Clusters of drawings that are figures: padded and clipped to the page, large enough, no table, little text."""
    x0, y0, x1, y1 = B.box()
    clipped = clusters.select("doc_id", "page", "n", F.greatest(x0 - PADDING, F.lit(0.0)).alias("x0"), F.greatest(y0 - PADDING, F.lit(0.0)).alias("y0"), F.least(x1 + PADDING, F.lit(PAGE_WIDTH)).alias("x1"), F.least(y1 + PADDING, F.lit(PAGE_HEIGHT)).alias("y1"))
    large = clipped.where(B.area(B.box()) / F.lit(PAGE_WIDTH * PAGE_HEIGHT) >= MIN_AREA)
    other = tables.select(F.col("doc_id").alias("t_doc"), F.col("page").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    free = large.join(other, (F.col("doc_id") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & (B.iou(B.box(), B.box("t_")) >= TABLE_OVERLAP), "left_anti")
    dense = text_density(free, words, ["doc_id", "page", "n"])
    kept = free.join(dense, ["doc_id", "page", "n"]).where(F.col("density") <= MAX_TEXT_DENSITY)
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "n")
    return kept.withColumn("idx", F.row_number().over(w)).withColumn("filename", F.concat(F.lit("p"), F.col("page"), F.lit("_vec_"), F.col("idx"), F.lit(".png")))


def figure_captions(figures: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, caption, label): words in a strip below a figure, and the figure label among them."""
    f = figures.select(*keys, *[F.col(c).alias(f"f_{c}") for c in ("x0", "y1", "x1")])
    strip = (F.col("f_x0"), F.col("f_y1"), F.col("f_x1"), F.col("f_y1") + CAPTION_STRIP)
    near = f.join(words, ["doc_id", "page"]).where(B.intersects(B.box(), strip)).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ").alias("caption"))
    joined = f.select(*keys).join(near, keys, "left").withColumn("caption", F.coalesce("caption", F.lit("")))
    return joined.withColumn("label", F.regexp_extract("caption", T.FIGURE_LABEL, 1))


def insert_markers(nodes: DataFrame, figures: DataFrame) -> DataFrame:
    """Nodes (doc_id, pos, text) with the markers of their figures (doc_id, pos, n, anchor, filename, label, caption).

    An image's anchor may lie in text that an earlier marker changed, so a node's figures are
    folded into its text in order.
    """
    item = F.struct("n", "anchor", T.marker(F.col("filename"), F.col("label"), F.col("caption")).alias("mark"))
    marks = figures.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(item)).alias("_m"))
    joined = nodes.join(marks, ["doc_id", "pos"], "left")
    folded = F.aggregate("_m", F.col("text"), lambda t, x: T.insert_marker(t, x["anchor"], x["mark"]))
    return joined.withColumn("text", F.coalesce(folded, "text")).drop("_m")


def block_above(figures: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Figures with anchor, the text of the lowest block (doc_id, page, y1, text) that ends above them."""
    a = blocks.select("doc_id", "page", F.col("y1").alias("y"), F.lit(0).alias("kind"), F.col("text").alias("anchor"), *[F.lit(None).cast(figures.schema[k].dataType).alias(f"k_{k}") for k in keys])
    b = figures.select("doc_id", "page", (F.col("y0") + 1.0).alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("anchor"), *[F.col(k).alias(f"k_{k}") for k in keys])
    w = Window.partitionBy("doc_id", "page").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("anchor", F.last("anchor", ignorenulls=True).over(w)).where("kind = 1")
    return figures.join(found.select(*[F.col(f"k_{k}").alias(k) for k in keys], "anchor"), keys)
