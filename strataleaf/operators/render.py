"""Output of trees: Markdown, nested JSON, and the questions that a viewer asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import text as T
from strataleaf.operators.tree import LEVELS, with_ancestors


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def front_matter(documents: DataFrame) -> DataFrame:
    """(doc_id, head): the block of document fields before the sections."""
    fields = ("source_file", "source_format", "total_pages", "extracted_at", "extraction_path")
    return documents.select("doc_id", F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields], F.lit("---")).alias("head"))


def heading_line(with_metadata: bool = False) -> Column:
    head = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth"), F.lit(6))), F.lit(" "), F.col("section_id"), F.lit(" · "), F.col("title"))
    if not with_metadata:
        return head
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(head, F.lit("\n<!-- id:"), F.col("id"), F.lit(" pages:"), page("page_start"), F.lit("-"), page("page_end"), F.lit(" confidence:"), F.format_string("%.2f", F.col("confidence")), F.lit(" type:"), F.col("node_type"), F.lit(" -->"))


def tables_markdown(tables: Column) -> Column:
    """Blocks of an array of table structs."""
    def one(t):
        named = F.coalesce(t["caption"], F.lit("")) != ""
        title = F.concat(F.lit("**"), F.when(named, t["caption"]).otherwise(F.concat(F.lit("Table "), t["table_id"])), F.lit("**\n\n"))
        label = F.when(named, t["caption"]).otherwise(t["table_id"])
        grid = F.when(F.coalesce(t["markdown"], F.lit("")) != "", F.concat(t["markdown"], F.lit("\n\n")))
        image = F.when(F.coalesce(t["image_path"], F.lit("")) != "", F.concat(F.lit("!["), label, F.lit("]("), t["image_path"], F.lit(")\n\n")))
        return F.concat(title, F.coalesce(grid, image, F.lit("")))

    return F.array_join(F.transform(tables, one), "")


def images_markdown(images: Column, text: Column) -> Column:
    """Blocks of images (structs with path, label, caption, page, y0) that no marker in the text shows, by page and height."""
    used = T.marker_files(text)
    name = lambda i: F.element_at(F.split(i["path"], "/"), -1)
    left = F.filter(images, lambda i: (F.coalesce(i["path"], F.lit("")) != "") & ~F.array_contains(used, name(i)))
    ordered = F.array_sort(F.transform(left, lambda i: F.struct(i["page"].alias("page"), i["y0"].alias("y0"), i["path"].alias("path"), i["label"].alias("label"), i["caption"].alias("caption"))))

    def one(i):
        label = F.when(F.coalesce(i["label"], F.lit("")) != "", i["label"]).when(F.coalesce(i["caption"], F.lit("")) != "", i["caption"]).otherwise("image")
        below = F.when(F.coalesce(i["caption"], F.lit("")) != "", F.concat(F.lit("*"), i["caption"], F.lit("*\n"))).otherwise("")
        return F.concat(F.lit("!["), label, F.lit("]("), i["path"], F.lit(")\n"), below, F.lit("\n"))

    return F.array_join(F.transform(ordered, one), "")


def node_markdown(nodes: DataFrame, with_metadata: bool = False) -> DataFrame:
    """Adds md, the Markdown of each node without its children."""
    body = T.strip(T.markers_as_markdown(F.col("text")))
    parts = [heading_line(with_metadata), F.lit("\n\n"), F.when(T.strip(F.coalesce("text", F.lit(""))) != "", F.concat(body, F.lit("\n\n"))).otherwise("")]
    if "tables" in nodes.columns:
        parts.append(F.coalesce(tables_markdown(F.col("tables")), F.lit("")))
    if "images" in nodes.columns:
        parts.append(F.coalesce(images_markdown(F.col("images"), F.col("text")), F.lit("")))
    return nodes.withColumn("md", F.concat(*parts))


def markdown(documents: DataFrame, nodes: DataFrame, with_metadata: bool = False) -> DataFrame:
    """(doc_id, markdown): front matter and the sections in preorder."""
    body = node_markdown(nodes, with_metadata).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "").alias("_b"))
    joined = front_matter(documents).join(body, "doc_id", "left")
    return joined.select("doc_id", F.concat("head", F.lit("\n"), F.when(F.col("_b").isNotNull(), F.concat(F.lit("\n"), F.expr("left(_b, length(_b) - 1)"))).otherwise("")).alias("markdown"))


def node_struct(nodes: DataFrame) -> Column:
    """The public fields of a node, text without markers, confidence rounded to 4 digits."""
    pages = F.struct(F.col("page_start").alias("physical_start"), F.col("page_end").alias("physical_end"), F.lit(None).cast("string").alias("logical_start"), F.lit(None).cast("string").alias("logical_end"))
    none = F.array()
    images = F.transform("images", lambda i: F.struct(*[i[c].alias(c) for c in ("image_id", "label", "caption", "path", "page", "image_type")])) if "images" in nodes.columns else none
    tables = F.transform("tables", lambda t: F.struct(*[t[c].alias(c) for c in ("table_id", "caption", "page", "headers", "rows", "markdown", "image_path")])) if "tables" in nodes.columns else none
    return F.struct("id", "section_id", "depth", "node_type", "title", T.without_markers(F.coalesce("text", F.lit(""))).alias("text"), pages.alias("pages"), F.round(_optional(nodes, "confidence", F.lit(1.0)), 4).alias("confidence"), images.alias("images"), tables.alias("tables"))


def json_trees(nodes: DataFrame) -> DataFrame:
    """(doc_id, nodes_json): the nested tree of each document.

    In preorder a node's JSON opens where it stands and closes before the next node that is
    no deeper, so nesting is a matter of brackets: no recursion, one ordered concatenation.
    """
    body = F.to_json(node_struct(nodes), {"ignoreNullFields": "false"})
    opened = F.concat(F.expr("left(_j, length(_j) - 1)"), F.lit(',"children":['))
    rows = nodes.withColumn("_j", body).select("doc_id", F.struct("pos", "depth", opened.alias("j")).alias("n"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    depth = lambda i: F.coalesce(F.get("ns", i)["depth"], F.lit(0))

    def piece(x, i):
        before = depth(i - 1)
        comma = F.when((i > 0) & (before >= x["depth"]), F.lit(",")).otherwise("")
        closed = F.repeat(F.lit("]}"), F.greatest(x["depth"] - depth(i + 1) + 1, F.lit(0)))
        return F.concat(comma, x["j"], F.when(i + 1 < F.size("ns"), closed).otherwise(F.repeat(F.lit("]}"), x["depth"])))

    return lists.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("ns", piece), ""), F.lit("]")).alias("nodes_json"))


def document_json(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, json): the document's fields and its nested nodes."""
    head = F.to_json(F.struct("source_file", "source_format", "total_pages", F.col("extracted_at").cast("string").alias("extracted_at"), "extraction_path"), {"ignoreNullFields": "false"})
    joined = documents.withColumn("_h", head).join(json_trees(nodes), "doc_id", "left")
    return joined.select("doc_id", F.concat(F.expr("left(_h, length(_h) - 1)"), F.lit(',"nodes":'), F.coalesce("nodes_json", F.lit("[]")), F.lit("}")).alias("json"))


def expanded(nodes: DataFrame, mode: str = "default") -> DataFrame:
    """(doc_id, id) of nodes that are open: with children and depth 2 at most (default), all with children, or none."""
    deeper = F.lead("level").over(Window.partitionBy("doc_id").orderBy("pos")) > F.col("level")
    inner = nodes.withColumn("_inner", deeper).where("_inner")
    chosen = {"default": inner.where("depth <= 2"), "all": inner, "none": inner.where("false")}[mode]
    return chosen.select("doc_id", "id")


def visible(nodes: DataFrame, open_ids: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Nodes all of whose ancestors are open."""
    marked = nodes.join(open_ids.select("doc_id", "id", F.lit(True).alias("_open")), ["doc_id", "id"], "left")
    marked = with_ancestors(marked, F.coalesce("_open", F.lit(False)), "_above", levels)
    return marked.where(~F.array_contains("_above", False)).drop("_above", "_open")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def card(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, page_label, snippet, n_tables, n_images, percent) of each node."""
    label = F.concat(F.lit("p."), F.col("page_start"), F.lit("-"), F.col("page_end"))
    n = lambda c: F.size(c) if c in nodes.columns else F.lit(0)
    count = F.col("n_tables") if "n_tables" in nodes.columns else n("tables")
    return nodes.select("doc_id", "id", label.alias("page_label"), F.substring(T.collapse(F.coalesce("text", F.lit(""))), 1, 120).alias("snippet"), count.alias("n_tables"), n("images").alias("n_images"), F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("percent"))


def table_preview(tables: DataFrame, rows: int = 8) -> DataFrame:
    """Tables with their first rows and a note on how many follow."""
    more = F.greatest(F.size("rows") - rows, F.lit(0))
    return tables.withColumn("preview", F.slice("rows", 1, rows)).withColumn("note", F.when(more > 0, F.concat(F.lit("… "), more, F.lit(" more rows"))).otherwise(""))


def section_of_heading(c: Column) -> Column:
    """The section number that a heading text starts with, or the empty string."""
    return F.regexp_extract(c, r"^\s*([0-9]+(\.[0-9]+)*)", 1)


def statistics(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, total_nodes, total_pages, is_long): is_long from more than 200 pages on."""
    n = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_nodes"))
    return documents.join(n, "doc_id", "left").select("doc_id", F.coalesce("total_nodes", F.lit(0).cast("long")).alias("total_nodes"), "total_pages", (F.col("total_pages") > 200).alias("is_long"))
