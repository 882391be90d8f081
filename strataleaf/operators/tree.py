"""Trees as flat tables: parents, phantoms, page ranges, identifiers, lookups.

Nodes are rows (doc_id, pos, level, ...) in document order, which is preorder. The parent of
a node is the nearest earlier node of a smaller level; with at most ``LEVELS`` levels that is
one window over doc_id for all levels together, and no loop or recursion. All windows
partition by doc_id alone or with more columns, so a document is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9
PHANTOM_TITLE = "[implied section]"


def _before():
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def _after():
    # Backwards, so that the frame grows row by row; one that shrinks would be gone through anew for every row.
    return Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)


def _by_level(value, levels: int = LEVELS) -> Column:
    """value(L) at L = the row's level."""
    out = None
    for k in range(1, levels + 1):
        out = F.when(F.col("level") == k, value(k)) if out is None else out.when(F.col("level") == k, value(k))
    return out


def dense_levels(heads: DataFrame) -> DataFrame:
    """Levels as ranks within the document; comparisons stay as they are, and the number of levels is bounded by the distinct ones."""
    w = Window.partitionBy("doc_id").orderBy("level")
    return heads.withColumn("level", F.dense_rank().over(w))


def with_phantoms(heads: DataFrame) -> DataFrame:
    """Adds a node for each level that a heading skips below the one before it, and renumbers pos.

    Phantoms have the title PHANTOM_TITLE, confidence 0 and the page of the heading; origin is
    the pos of the heading that they and it come from.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    gap = heads.withColumn("_prev", F.lag("level").over(w))
    missing = F.when(F.col("level") > F.col("_prev") + 1, F.sequence(F.col("_prev") + 1, F.col("level") - 1)).otherwise(F.array().cast("array<int>"))
    steps = F.concat(F.transform(missing, lambda k: F.struct(k.alias("level"), F.lit(True).alias("ph"))), F.array(F.struct(F.col("level").alias("level"), F.lit(False).alias("ph"))))
    out = gap.select(*[c for c in gap.columns if c not in ("level", "_prev")], F.posexplode(steps).alias("_k", "_s"))
    order = Window.partitionBy("doc_id").orderBy("pos", "_k")
    phantom = F.col("_s.ph")
    return (
        out.withColumn("level", F.col("_s.level"))
        .withColumn("is_phantom", phantom)
        .withColumn("title", F.when(phantom, F.lit(PHANTOM_TITLE)).otherwise(F.col("title")))
        .withColumn("confidence", F.when(phantom, F.lit(0.0)).otherwise(F.col("confidence")))
        .withColumn("origin", F.col("pos"))
        .withColumn("pos", F.row_number().over(order))
        .drop("_k", "_s")
    )


def with_parents(heads: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Adds parent_pos, null for top nodes."""
    w = _before()
    return heads.withColumn("parent_pos", _by_level(lambda k: F.max(F.when(F.col("level") < k, F.col("pos"))).over(w), levels))


def with_identity(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Adds id, section_id, depth and node_type to nodes with parent_pos.

    section_id joins the sibling numbers on the way from the top. The latest node of level L
    is on that way if no later one of a smaller level came between, so one window finds all.
    """
    siblings = Window.partitionBy("doc_id", F.coalesce("parent_pos", F.lit(-1))).orderBy("pos")
    order = Window.partitionBy("doc_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = nodes.withColumn("_n", F.row_number().over(siblings))
    latest = [F.max(F.when(F.col("level") <= k, F.struct("pos", "level", "_n"))).over(upto) for k in range(1, levels + 1)]
    now = now.select("*", *[x.alias(f"_l{k}") for k, x in enumerate(latest, 1)], F.row_number().over(order).alias("_i"), F.lead("level").over(order).alias("_next"))
    path = F.array_compact(F.array(*[F.when((F.col(f"_l{k}.level") == k) & (F.col("level") >= k), F.col(f"_l{k}._n")) for k in range(1, levels + 1)]))
    depth = F.size(path)
    kind = F.when(F.col("parent_pos").isNull(), "root").when(F.col("_next") > F.col("level"), "parent").otherwise("child")
    return (
        now.withColumn("section_id", F.array_join(F.transform(path, lambda x: x.cast("string")), "."))
        .withColumn("depth", depth)
        .withColumn("id", F.lpad(F.col("_i").cast("string"), 4, "0"))
        .withColumn("node_type", kind)
        .drop("_n", "_i", "_next", *[f"_l{k}" for k in range(1, levels + 1)])
    )


def build(heads: DataFrame, phantoms: bool = False, levels: int = LEVELS) -> DataFrame:
    """Headings (doc_id, pos, level, title, ...) to identified nodes."""
    return with_identity(with_parents(with_phantoms(heads) if phantoms else heads, levels), levels)


def subtree_end(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Adds end_pos, the last pos of the node's subtree: its subtree is the interval [pos, end_pos]."""
    w = _after()
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    nxt = _by_level(lambda k: F.min(F.when(F.col("level") <= k, F.col("pos"))).over(w), levels)
    return nodes.withColumn("end_pos", F.coalesce(nxt - 1, last))


def resolve_pages(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """page_end of a node is the largest of its subtree; an inverted leaf ends where it starts.

    Needs page_start and page_end. The subtree of a node of level k is the rows up to the
    next of level k or less: rows that share the number of such rows before them. So the
    maximum of each level's subtrees is one window, and no node meets its descendants in a
    join. A heading and the phantoms put in for it share one range.
    """
    now = nodes.withColumn("page_end", F.greatest("page_start", "page_end"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = now.select("*", *[F.count_if(F.col("level") <= k).over(upto).alias(f"_g{k}") for k in range(1, levels + 1)])
    now = now.select("*", *[F.max("page_end").over(Window.partitionBy("doc_id", f"_g{k}")).alias(f"_m{k}") for k in range(1, levels + 1)])
    now = now.withColumn("page_end", _by_level(lambda k: F.col(f"_m{k}"), levels)).drop(*[f"_{x}{k}" for x in "gm" for k in range(1, levels + 1)])
    if "origin" in nodes.columns:
        now = now.withColumn("page_end", F.max("page_end").over(Window.partitionBy("doc_id", "origin")))
    return now


def with_ancestors(nodes: DataFrame, field: Column, name: str, levels: int = LEVELS) -> DataFrame:
    """Adds an array with the field of every node above, from the top down."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = nodes.withColumn("_f", field)
    latest = [F.max(F.when(F.col("level") <= k, F.struct("pos", "level", "_f"))).over(upto) for k in range(1, levels)]
    now = now.select("*", *[x.alias(f"_l{k}") for k, x in enumerate(latest, 1)])
    above = F.array(*[F.when((F.col(f"_l{k}.level") == k) & (F.col("level") > k), F.struct(F.col(f"_l{k}._f").alias("f"))) for k in range(1, levels)])
    out = F.transform(F.filter(above, lambda x: x.isNotNull()), lambda x: x["f"])
    return now.withColumn(name, out).drop("_f", *[f"_l{k}" for k in range(1, levels)])


def clamp_to_parents(nodes: DataFrame) -> DataFrame:
    """page_end of a node is at most that of every node above it."""
    marked = with_ancestors(nodes, F.col("page_end"), "_above")
    return marked.withColumn("page_end", F.least("page_end", F.coalesce(F.array_min("_above"), "page_end"))).drop("_above")


def without_phantoms(nodes: DataFrame) -> DataFrame:
    """Drops phantom nodes with their subtrees."""
    marked = with_ancestors(nodes, F.col("is_phantom"), "_above")
    return marked.where(~F.col("is_phantom") & ~F.array_contains("_above", True)).drop("_above")


def find(nodes: DataFrame, by: str, value: str) -> DataFrame:
    """The first node of each document with this id or section_id."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return nodes.where(F.col(by) == value).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def flatten(nodes: DataFrame) -> DataFrame:
    """Nodes in preorder."""
    return nodes.orderBy("doc_id", "pos")


def deepest_for_page(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """For (doc_id, page) the deepest node whose range holds the page, the first of equally deep ones.

    The range join is an equality join on the pages of each range.
    """
    spread = nodes.where("page_start <= page_end").select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page"), "depth", "pos", "id", "section_id")
    best = spread.groupBy("doc_id", "page").agg(F.max_by(F.struct("pos", "id", "section_id"), F.struct(F.col("depth"), -F.col("pos"))).alias("b"), F.max("depth").alias("depth"))
    return pages.join(best, ["doc_id", "page"]).select("doc_id", "page", F.col("b.pos").alias("pos"), F.col("b.id").alias("id"), F.col("b.section_id").alias("section_id"), "depth")


def outline_ranges(toc: DataFrame, totals: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Outline entries (doc_id, pos, level, title, page_start) with page_end.

    The first later entry of the same or a smaller level ends a section on the page before
    its own, or on the section's first page if it starts no later; without one the document
    ends it.
    """
    w = _after()
    nxt = _by_level(lambda k: F.min(F.when(F.col("level") <= k, F.struct("pos", "page_start"))).over(w), levels)
    ranked = toc.withColumn("_next", nxt["page_start"]).join(totals, "doc_id")
    end = F.when(F.col("_next").isNull(), F.col("total_pages")).when(F.col("_next") > F.col("page_start"), F.col("_next") - 1).otherwise(F.col("page_start"))
    return ranked.withColumn("page_end", F.greatest("page_start", F.least(end, F.col("total_pages")))).drop("_next")


def front_matter(toc: DataFrame, title: str = "Front matter") -> DataFrame:
    """A node before the outline, for pages 1 up to the first entry's, if that is after page 2."""
    first = toc.groupBy("doc_id").agg(F.min("page_start").alias("_p"))
    return first.where("_p > 2").select("doc_id", F.lit(-1).alias("pos"), F.lit(1).alias("level"), F.lit(title).alias("title"), F.lit(1).alias("page_start"), (F.col("_p") - 1).alias("page_end"), F.lit(0.9).alias("confidence"))


def parent_text_span(nodes: DataFrame) -> DataFrame:
    """Which pages a parent's own text covers, and what is kept of it if there are none before its first child.

    Adds text_end (last page of own text) and keep_chars: null is all, else that many characters.
    """
    first = nodes.where("parent_pos IS NOT NULL").groupBy("doc_id", F.col("parent_pos").alias("pos")).agg(F.min("page_start").alias("_c"))
    joined = nodes.join(first, ["doc_id", "pos"], "left")
    own = F.col("_c").isNull() | (F.col("_c") > F.col("page_start"))
    end = F.when(F.col("_c").isNull(), F.col("page_end")).when(F.col("_c") > F.col("page_start"), F.col("_c") - 1).otherwise(F.col("page_start"))
    return joined.withColumn("text_end", end).withColumn("keep_chars", F.when(own, F.lit(None).cast("int")).when(F.col("depth") == 1, 500).otherwise(0)).drop("_c")
