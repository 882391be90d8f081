"""Headings from positioned lines: layout features, scores, filters, levels, body text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.config import StructureConfig
from strataleaf.functions import text as T
from strataleaf.operators import tree

DEFAULT_WIDTH, DEFAULT_HEIGHT = 612.0, 792.0
DEFAULT_FONT_SIZE, DEFAULT_LINE_HEIGHT = 12.0, 14.0
MAX_LEVEL = 6


def lines_from_runs(runs: DataFrame) -> DataFrame:
    """Visual lines from typographic runs (doc_id, page, block_index, line_in_block, run_no, text, font_size, font, flags, x0, y0, x1, y1).

    Non-empty runs are joined by a space; a line is as large as its largest run, and bold or
    italic if a run of it is, by flag or by the font's name. Lines without text are dropped.
    """
    font = F.lower(F.coalesce("font", F.lit("")))
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.contains(font, F.lit("bold"))
    italic = (F.col("flags").bitwiseAND(2) != 0) | F.contains(font, F.lit("italic")) | F.contains(font, F.lit("oblique"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("run_no", T.strip(F.col("text")).alias("t")))), lambda x: x["t"])
    out = runs.groupBy("doc_id", "page", "block_index", "line_in_block").agg(
        F.array_join(F.filter(parts, lambda t: t != ""), " ").alias("text"),
        F.max("font_size").alias("font_size"),
        F.bool_or(bold).alias("is_bold"),
        F.bool_or(italic).alias("is_italic"),
        F.min_by("font", "run_no").alias("font_name"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )
    return out.where("text <> ''").withColumn("line_height", F.col("y1") - F.col("y0")).withColumn("is_caps", T.is_upper(F.col("text")))


def features(spans: DataFrame) -> DataFrame:
    """Adds word_count, space_above, numbering and has_numbering to lines ordered by (page, line_no)."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    above = F.lag("y1").over(w)
    return (
        spans.withColumn("space_above", F.when(above.isNull() | (above == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("y0") - above)))
        .withColumn("word_count", T.word_count(F.col("text")))
        .withColumn("numbering", T.numbering(F.col("text")))
        .withColumn("has_numbering", F.col("numbering") != "")
    )


def with_columns(spans: DataFrame) -> DataFrame:
    """Adds column: 0 or 1, and -1 for lines across both columns of a page.

    A page has two columns where long lines lie left and right and hardly in between.
    """
    width = F.coalesce("page_width", F.lit(DEFAULT_WIDTH))
    centre = (F.col("x0") + F.col("x1")) / 2
    long = F.col("word_count") > 3
    page = Window.partitionBy("doc_id", "page")
    n, left, right = F.count_if(long).over(page), F.count_if(long & (centre < width * 0.45)).over(page), F.count_if(long & (centre > width * 0.55)).over(page)
    counted = spans.select("*", n.alias("_n"), left.alias("_l"), right.alias("_r"))
    two = (F.col("_n") >= 20) & (F.col("_n") - F.col("_l") - F.col("_r") < 0.1 * F.col("_n")) & (F.col("_l") > 10) & (F.col("_r") > 10)
    across = (F.col("x1") - F.col("x0")) > width * 0.65
    in_left = (F.col("x0") < width * 0.08) | (centre < width * 0.52)
    return counted.withColumn("column", F.when(~two, 0).when(across, -1).when(in_left, 0).otherwise(1)).drop("_n", "_l", "_r")


def with_scores(spans: DataFrame) -> DataFrame:
    """Adds median_size, median_height and heading_score.

    Medians are exact, over positive values. The score is a sum of doubles in a fixed order:
    some sums lie a rounding error beside the thresholds.
    """
    doc = Window.partitionBy("doc_id")
    positive = lambda c, default: F.coalesce(F.median(F.when(F.col(c) > 0, F.col(c))).over(doc), F.lit(default))
    spans = spans.withColumns({"median_size": positive("font_size", DEFAULT_FONT_SIZE), "median_height": positive("line_height", DEFAULT_LINE_HEIGHT)})
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = (
        F.lit(0.0)
        + add(F.col("font_size") > F.col("median_size") * 1.1, 0.3)
        + add(F.col("is_bold"), 0.2)
        + add(F.col("word_count") < 12, 0.15)
        + add(~T.strip(F.col("text")).rlike(r"[.!?]$"), 0.1)
        + add(F.col("space_above") > F.col("median_height"), 0.15)
        + add(F.col("has_numbering"), 0.2)
    )
    return spans.withColumn("heading_score", F.least(score, F.lit(1.0)))


def marked(spans: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:  # noqa: B008
    """Scored lines with level, which is null for lines that the filters take for body text.

    Everything a filter or a level needs of the rest of the document comes from windows over
    it, so lines meet in no join.
    """
    doc = Window.partitionBy("doc_id")
    text = T.strip(F.col("text"))
    numbered = F.col("has_numbering") & (F.col("heading_score") >= config.heading_threshold)
    # The first numbered heading's place is compared without regard to its page.
    first = F.min(F.when(numbered, F.struct("page", "line_no", "y0"))).over(doc)["y0"]
    width = F.coalesce("page_width", F.lit(DEFAULT_WIDTH))
    height = F.coalesce("page_height", F.lit(DEFAULT_HEIGHT))
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) < width * 0.15
    title_area = (F.col("page") == config.metadata_zone_page) & ~F.col("has_numbering") & centred & (F.col("y0") < height * config.metadata_zone_fraction) & F.coalesce(F.col("y0") < F.col("_first_y"), F.lit(False))
    passes = (
        (F.col("heading_score") >= F.when(F.col("has_numbering"), config.heading_threshold).otherwise(config.unnumbered_heading_threshold))
        & F.col("word_count").between(config.min_heading_word_count, config.max_heading_words)
        & ~F.contains(text, F.lit("@"))
        & ~text.rlike(r"^(http|www\.|doi:)")
        & (F.length(text) > 2)
        & ~T.is_rule_identifier(text)
        & ~title_area
    )
    judged = spans.withColumn("_first_y", first).withColumn("_kept", passes).drop("_first_y")
    style = F.dense_rank().over(Window.partitionBy("doc_id", "_kept").orderBy(F.col("font_size").desc(), F.col("is_bold").desc()))
    parts = F.size(T.numbering_parts(F.col("numbering")))
    ranked = judged.withColumn("_style", F.least(style, F.lit(MAX_LEVEL))).withColumn("_parts", F.when(F.col("_kept") & F.col("has_numbering"), parts))
    level = F.when(F.col("_parts") >= 0, F.least("_parts", F.lit(MAX_LEVEL))).otherwise(F.col("_style"))
    small = (F.col("word_count") == 1) & ~F.col("has_numbering") & (F.col("font_size") <= F.col("median_size") * 1.25)
    return ranked.withColumn("level", F.when(F.col("_kept"), F.when(small, F.greatest(level, F.lit(3))).otherwise(level))).drop("_style", "_parts", "_kept")


def candidates(spans: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:  # noqa: B008
    """Scored lines that pass the filters, with level."""
    return marked(spans, config).where("level IS NOT NULL")


def prepared(spans: DataFrame) -> DataFrame:
    """Lines with all features, columns and scores."""
    return with_scores(with_columns(features(spans)))


def heads(found: DataFrame, least: int = 2) -> DataFrame:
    """Candidates as headings (doc_id, pos, level, title, page_start, page_end, confidence, page, line_no) of documents with ``least`` or more."""
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    out = found.select("doc_id", F.row_number().over(w).alias("pos"), "level", T.strip(F.col("text")).alias("title"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("heading_score").alias("confidence"), "page", "line_no", "column", "y1", n.alias("_n"))
    return out.where(F.col("_n") >= least).drop("_n")


def tree_of(found: DataFrame) -> DataFrame:
    """Section tree of candidates, with phantoms for skipped levels and resolved page ranges."""
    built = tree.build(heads(found), phantoms=True, levels=MAX_LEVEL)
    return tree.resolve_pages(built, MAX_LEVEL)


def with_heads(lines: DataFrame, least: int = 2) -> DataFrame:
    """Marked lines with pos, the number of the heading that a line is; null for body lines, and in documents with fewer than ``least`` headings."""
    is_head = F.col("level").isNotNull()
    upto = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count_if(is_head).over(Window.partitionBy("doc_id"))
    return lines.select("*", F.count_if(is_head).over(upto).cast("int").alias("_k"), n.alias("_n")).withColumn("pos", F.when(is_head & (F.col("_n") >= least), F.col("_k"))).drop("_k", "_n")


def body_owners(lines: DataFrame) -> DataFrame:
    """Body lines with the pos of the heading above them in their column (lines: as of with_heads()).

    An as-of join in one pass: a heading stands at its bottom, in both columns if it goes
    across, and a line at its top; sorted by page, column and height, a line takes the last
    heading before it. Lines above all headings are dropped.
    """
    event = lambda col, y, kind, owner: F.struct(col.alias("col"), y.alias("y"), F.lit(kind).alias("kind"), owner.alias("owner"))
    none = F.lit(None).cast("int")
    at = lambda c: event(c, F.col("y1"), 0, F.col("pos"))
    body = F.array(event(F.greatest("column", F.lit(0)), F.col("y0"), 1, none))
    heading = F.when(F.col("column") == -1, F.array(at(F.lit(0)), at(F.lit(1)))).otherwise(F.array(at(F.col("column"))))
    rows = lines.select("doc_id", "page", "line_no", "block_index", "text", F.explode(F.when(F.col("pos").isNull(), body).otherwise(heading)).alias("e")).select("doc_id", "page", "line_no", "block_index", "text", "e.*")
    w = Window.partitionBy("doc_id").orderBy("page", "col", "y", "kind", F.coalesce("owner", F.lit(0)), "line_no")
    owned = rows.withColumn("pos", F.last("owner", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return owned.where("kind = 1 AND pos IS NOT NULL").select("doc_id", "pos", "page", "col", "y", "line_no", "block_index", "text")


def body_texts(owned: DataFrame) -> DataFrame:
    """(doc_id, pos, text): lines of a block joined by spaces, blocks by blank lines."""
    w = Window.partitionBy("doc_id", "pos").orderBy("page", "col", "y", "line_no")
    changed = (F.lag("page").over(w) != F.col("page")) | (F.lag("block_index").over(w) != F.col("block_index"))
    marked = owned.withColumn("_new", F.coalesce(changed, F.lit(True)).cast("int"))
    marked = marked.withColumn("_par", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page", "col", "y", "line_no", T.strip(F.col("text")).alias("t")))), lambda x: x["t"])
    paragraphs = marked.groupBy("doc_id", "pos", "_par").agg(F.array_join(lines, " ").alias("t"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_par", "t"))), lambda x: x["t"])
    return paragraphs.groupBy("doc_id", "pos").agg(F.array_join(F.filter(whole, lambda t: t != ""), "\n\n").alias("text"))
