"""Documents whose pages are Markdown: cleaning, continuation, pipe tables, section trees.

Pages are rows (doc_id, page_num, md). A loop over pages with a stack becomes windows: the
open section at any place is the last heading before it, and a section stays open until the
next heading of its own or a smaller level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import grids as G
from strataleaf.functions import text as T
from strataleaf.functions.binding import let
from strataleaf.operators import tree

BLANK, CONTINUATION = "[BLANK PAGE]", "[CONTINUATION]"
TAIL = 500
HEADING = r"^(#{1,6})\s+(.+)$"
TABLE_ROW, TABLE_RULE = r"^\|.+\|$", r"^\|[\s:|-]+\|$"
#: Where this does not match, no line of a page is a running one.
MAYBE_RUNNING = r"(?imd)www\.|https?://|^\s*(?:-?\s*\d{1,4}\s*-?|page\s+\d+\s+of\s+\d+|[a-z]+\s+\d{4}|[ivxlcdm]{1,8})\s*$"
LIST_START = r"^\((\d+|[a-z]{1,3}|[ivxlcdm]{1,6})\)"
LIST_ITEM = r"\((\d+|[a-z]{1,3}|[ivxlcdm]{1,6})\)"


def _has_link(c: Column) -> Column:
    return F.contains(c, F.lit("www.")) | F.contains(c, F.lit("http://")) | F.contains(c, F.lit("https://"))


def clean(md: Column) -> Column:
    """A page without code fences around it, running lines, surplus blank lines and false headings."""

    def unfenced(text: Column) -> Column:
        newline = F.position(F.lit("\n"), text)
        opened = F.when(~F.startswith(text, F.lit("```")), text).when(newline > 0, F.substring(text, newline + 1, F.length(text))).otherwise(F.lit(""))
        return let(T.strip(opened), lambda t: F.when(F.endswith(t, F.lit("```")), T.strip(F.substring(t, F.lit(1), F.length(t) - 3))).otherwise(t))

    def dropped(s: Column) -> Column:
        number = s.rlike(r"^-?\s*\d{1,4}\s*-?$") | s.rlike(T.PAGE_OF)
        return (F.length(s) <= 120) & (_has_link(s) | s.rlike(T.MONTH_YEAR) | number | (s.rlike(r"(?i)^[ivxlcdm]+$") & (F.length(s) <= 8)))

    def is_false(content: Column) -> Column:
        def shouts(ws: Column) -> Column:
            alphabetic = F.filter(ws, lambda w: w.rlike(r"^\p{L}+$"))
            return (F.size(ws) <= 3) & (F.size(alphabetic) > 0) & ~F.exists(alphabetic, lambda w: F.length(w) > 6)

        return _has_link(content) | content.rlike(T.MONTH_YEAR) | content.rlike(r"^-?\s*\d{1,4}\s*-?$") | (T.is_upper(content) & let(T.words(content), shouts))

    def demoted(line: Column) -> Column:
        plain = let(T.strip(F.regexp_replace(T.strip(line), r"^#+", "")), lambda content: F.when(is_false(content), content).otherwise(line))
        return F.when(F.startswith(T.lstrip(line), F.lit("#")), plain).otherwise(line)

    # Most pages have nothing of the kind; one look at the whole text spares them the work by lines.
    def without_running_lines(text: Column) -> Column:
        kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~let(T.strip(x), dropped)), "\n")
        return T.squeeze_blank_lines(F.when(text.rlike(MAYBE_RUNNING), kept).otherwise(text))

    def without_false_headings(text: Column) -> Column:
        plain = F.array_join(F.transform(F.split(text, "\n"), demoted), "\n")
        return F.when(text.rlike(f"(?md)^[{T.SPACE}]*#"), plain).otherwise(text)

    return T.strip(let(let(let(T.strip(md), unfenced), without_running_lines), without_false_headings))


def continues(md: Column, tail: Column) -> Column:
    """Whether a page goes on where the previous page's tail stopped."""
    first_line = T.rstrip(F.regexp_extract(md, f"([^{T.SPACE}][^\\n]*)", 1))

    def decide(x: Column) -> Column:
        first, listed, end = x["first"], x["listed"], x["end"]
        item, before = F.regexp_extract(first, LIST_START, 1), F.element_at(listed, -1)
        digits = item.rlike(r"^\d+$") & before.rlike(r"^\d+$")
        next_item = (item != "") & (F.size(listed) > 0) & F.when(digits, item.cast("int") > before.cast("int")).otherwise(~item.rlike(r"^[ai]$"))
        sentence = T.starts_lower(first) & (end != "") & ~end.rlike(r"[.!?:]$")
        return F.coalesce((tail != "") & (first != "") & (next_item | sentence | end.rlike(r"[;,]$")), F.lit(False))

    return let(F.struct(first_line.alias("first"), F.regexp_extract_all(tail, F.lit(LIST_ITEM), 1).alias("listed"), T.rstrip(tail).alias("end")), decide)


def with_continuations(pages: DataFrame) -> DataFrame:
    """Cleaned pages, with the marker before those that continue the one before them.

    Pages are dealt out by document before they are cleaned: the window needs them so anyway,
    and plans that use the result several times share that exchange.
    """
    cleaned = pages.repartition("doc_id").withColumn("md", clean(F.col("md")))
    w = Window.partitionBy("doc_id").orderBy("page_num")
    tailed = cleaned.withColumn("_tail", F.coalesce(F.lag(F.right("md", F.lit(TAIL))).over(w), F.lit("")))
    judged = tailed.withColumn("_on", continues(F.col("md"), F.col("_tail")) & ~F.startswith(F.col("md"), F.lit(CONTINUATION)))
    # An explosion of one row: later filters on md would otherwise be pushed down as copies of the whole decision.
    page = F.struct(F.when(F.col("_on"), F.concat(F.lit(CONTINUATION + "\n"), "md")).otherwise(F.col("md")).alias("md"), F.col("_on").alias("is_continuation"))
    others = [c for c in pages.columns if c != "md"]
    return judged.select(*others, F.explode(F.array(page)).alias("_p")).select(*others, "_p.md", "_p.is_continuation")


def _lines(pages: DataFrame) -> DataFrame:
    """Lines of pages with table_start: the first line of the pipe table that a line belongs to, or null.

    A run of row-like lines is a table from the first line on that a rule follows.
    """
    lines = pages.select("doc_id", "page_num", F.posexplode(F.split("md", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("_row", F.col("line").rlike(TABLE_ROW))
    w = Window.partitionBy("doc_id", "page_num").orderBy("line_no")
    by_kind = Window.partitionBy("doc_id", "page_num", "_row").orderBy("line_no")
    lines = lines.withColumn("_starts", F.col("_row") & F.coalesce(F.lead("line").over(w).rlike(TABLE_RULE), F.lit(False)))
    lines = lines.withColumn("_run", F.col("line_no") - F.row_number().over(by_kind))
    first = F.min(F.when(F.col("_starts"), F.col("line_no"))).over(Window.partitionBy("doc_id", "page_num", "_row", "_run"))
    return lines.withColumn("table_start", F.when(F.col("_row") & (F.col("line_no") >= first), first)).drop("_row", "_starts", "_run")


def tables(pages: DataFrame) -> DataFrame:
    """Pipe tables of pages: see _tables."""
    return _tables(_lines(pages))


def _tables(lines: DataFrame) -> DataFrame:
    """Pipe tables: (doc_id, page_num, table_start, seq, table_id, headers, rows, markdown, is_valid). Invalid ones use up a number too."""
    inside = lines.where("table_start IS NOT NULL")
    grouped = inside.groupBy("doc_id", "page_num", "table_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    w = Window.partitionBy("doc_id", "page_num").orderBy("table_start")
    out = grouped.select(
        "doc_id",
        "page_num",
        "table_start",
        F.row_number().over(w).alias("seq"),
        G.split_row(F.get("lines", F.lit(0))).alias("headers"),
        F.transform(F.slice(F.col("lines"), F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))), G.split_row).alias("rows"),
        F.array_join("lines", "\n").alias("markdown"),
    )
    named = out.withColumn("table_id", F.concat(F.lit("p"), F.col("page_num"), F.lit("_t"), F.col("seq")))
    return named.withColumn("is_valid", G.is_valid_page_table(F.col("headers"), F.col("rows")))


def _is_blank(md: Column) -> Column:
    return md.isNull() | T.strip(F.coalesce(md, F.lit(""))).isin("", BLANK)


def items(pages: DataFrame) -> DataFrame:
    """What pages are made of, in order: (doc_id, page_num, line_no, kind, level, text, has_heading).

    kind: heading, text, continuation (a whole page that goes on), table (a valid one, before
    the lines of its page) or page (its Markdown as it stands). Lines of valid tables are left
    out; rows of invalid ones are prose. Blank pages have no other item than the page.
    """
    full = pages.where(~_is_blank(F.col("md")))
    lines = _lines(full)
    valid = _tables(lines).select("doc_id", "page_num", "table_start", "is_valid")
    joined = lines.join(valid, ["doc_id", "page_num", "table_start"], "left")
    is_table = F.col("is_valid") & (F.col("line_no") == F.col("table_start"))
    prose = F.array_join(F.filter(G.split_row(F.col("line")), lambda c: c != ""), " ")
    spoken = F.when(F.col("is_valid").isNull(), F.col("line")).when(~F.col("is_valid") & (F.col("line_no") != F.col("table_start") + 1) & (prose != ""), prose)
    level = F.length(F.regexp_extract("_t", HEADING, 1))
    parts = joined.withColumn("_t", spoken).where(F.col("_t").isNotNull() | is_table)
    parts = parts.select("doc_id", "page_num", F.when(is_table, -1).otherwise(F.col("line_no")).alias("line_no"), F.when(is_table, "table").when(level > 0, "heading").otherwise("text").alias("kind"), F.when(level > 0, level).alias("level"), F.when(level > 0, T.strip(F.regexp_extract("_t", HEADING, 2))).otherwise(F.coalesce("_t", F.lit(""))).alias("text"))
    # A marked page is a continuation if a section is open, that is, if an earlier page has a heading.
    marked = F.startswith(T.lstrip(F.coalesce("md", F.lit(""))), F.lit(CONTINUATION)) & ~_is_blank(F.col("md"))
    rest = F.regexp_replace(F.substring(T.lstrip(F.col("md")), len(CONTINUATION) + 1, 1 << 30), r"^\n+", "")
    whole = F.struct(F.lit("page").alias("kind"), F.col("md").alias("text"))
    units = pages.select("doc_id", "page_num", F.explode(F.when(marked, F.array(whole, F.struct(F.lit("continuation").alias("kind"), rest.alias("text")))).otherwise(F.array(whole))).alias("u"))
    units = units.select("doc_id", "page_num", F.lit(0).alias("line_no"), "u.kind", F.lit(None).cast("int").alias("level"), "u.text")
    every = parts.unionByName(units)
    whole_doc, one_page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page_num")
    first = F.min(F.when(F.col("kind") == "heading", F.col("page_num"))).over(whole_doc)
    every = every.withColumn("_first", first).withColumn("_marked", F.bool_or(F.col("kind") == "continuation").over(one_page))
    goes_on = F.coalesce(F.col("_marked") & (F.col("page_num") > F.col("_first")), F.lit(False))
    kept = F.when(F.col("kind").isin("page", "table"), F.lit(True)).when(F.col("kind") == "continuation", goes_on).otherwise(~goes_on)
    return every.where(kept).withColumn("has_heading", F.col("_first").isNotNull()).drop("_first", "_marked")


def sections(pages: DataFrame) -> DataFrame:
    """The section tree: nodes with title, text, page_start, page_end and n_tables.

    Text before the first heading is lost, unless a document has no heading: then one node
    holds all pages. Tables of a page belong to the section that is open when it begins.
    """
    # The plan reads pages several times; behind this exchange they are cleaned and judged once.
    pages = pages.select("doc_id", "page_num", "md").repartition("doc_id")
    every = items(pages)
    order = Window.partitionBy("doc_id").orderBy("page_num", "line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head, on = F.col("kind") == "heading", F.col("kind") == "continuation"
    placed = every.where("has_heading AND kind <> 'page'").withColumn("pos", F.sum(is_head.cast("long")).over(upto))
    # Text is flushed at each heading and around each continuation.
    placed = placed.withColumn("_part", F.sum((is_head | on).cast("int")).over(upto))
    owned = placed.where("pos > 0")
    chunks = owned.where(F.col("kind").isin("text", "continuation")).groupBy("doc_id", "pos", "_part", on.alias("on")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "line_no", "text"))), lambda x: x["text"]), "\n").alias("t"), F.min(F.struct("page_num", "line_no")).alias("at"))
    chunks = chunks.withColumn("t", F.when(F.col("on"), F.col("t")).otherwise(T.preserve_indentation(F.col("t"))))

    def joined(acc: Column, x: Column) -> Column:
        merged = lambda end: F.concat(end, F.when(end.rlike(r"[).;]$"), F.concat(F.lit("\n\n"), x["t"])).otherwise(F.concat(F.lit("\n"), T.lstrip(x["t"]))))
        return F.when(x["t"] == "", F.when(x["on"] & (acc != ""), let(T.rstrip(acc), merged)).otherwise(acc)).when(acc == "", x["t"]).when(x["on"], let(T.rstrip(acc), merged)).otherwise(F.concat(acc, F.lit("\n\n"), x["t"]))

    texts = chunks.groupBy("doc_id", "pos").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "on", "t"))), F.lit(""), joined).alias("text"))
    heads = owned.groupBy("doc_id", "pos").agg(F.max(F.when(is_head, F.struct("level", F.col("text").alias("title"), F.col("page_num").alias("page_start")))).alias("h"), F.count_if(F.col("kind") == "table").alias("n_tables"))
    nodes = tree.with_identity(tree.with_parents(heads.select("doc_id", "pos", "h.*", "n_tables"), 6), 6)
    out = _page_ends(nodes, pages).join(texts, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    columns = ["doc_id", "pos", "parent_pos", "level", "id", "section_id", "depth", "node_type", "title", "text", "page_start", "page_end", "n_tables"]
    bare = every.where("NOT has_heading AND kind = 'page'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(T.strip(F.col("text")) != "", F.struct("page_num", "text")))), lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).cast("int").alias("page_end"))
    fallback = bare.select("doc_id", F.lit(1).cast("long").alias("pos"), F.lit(None).cast("long").alias("parent_pos"), F.lit(1).alias("level"), F.lit("0001").alias("id"), F.lit("1").alias("section_id"), F.lit(1).alias("depth"), F.lit("root").alias("node_type"), F.concat(F.lit("document "), F.col("doc_id")).alias("title"), "text", F.lit(1).cast("int").alias("page_start"), "page_end", F.lit(0).cast("long").alias("n_tables"))
    return out.select(*columns).unionByName(fallback)


def _page_ends(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """A section ends on the last page before the one with the heading that closes it, or on the last page."""
    w = Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)  # later rows, as a frame that grows
    closing = None
    for k in range(1, 7):
        nxt = F.min(F.when(F.col("level") <= k, F.struct("pos", "page_start"))).over(w)
        closing = F.when(F.col("level") == k, nxt) if closing is None else closing.when(F.col("level") == k, nxt)
    by_page = Window.partitionBy("doc_id").orderBy("page_num")
    numbered = pages.select("doc_id", "page_num", F.lag("page_num").over(by_page).alias("_before"))
    last = pages.groupBy("doc_id").agg(F.max("page_num").alias("_last"))
    marked = nodes.withColumn("_closed", closing["page_start"]).join(numbered.withColumnRenamed("page_num", "_closed"), ["doc_id", "_closed"], "left").join(last, "doc_id")
    return marked.withColumn("page_end", F.greatest("page_start", F.when(F.col("_closed").isNull(), F.col("_last")).otherwise(F.coalesce("_before", "page_start"))).cast("int")).drop("_closed", "_before", "_last")


def table_owners(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid tables with the pos of the section that was open when their page began; tables before all headings are dropped."""
    valid = tables(pages.where(~_is_blank(F.col("md")))).where("is_valid").select("doc_id", F.col("page_num").alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("owner"), "seq", "table_id", "headers", "rows", "markdown")
    opened = nodes.select("doc_id", F.col("page_start").alias("p"), F.lit(1).alias("kind"), F.col("pos").cast("long").alias("owner"), F.lit(0).alias("seq"), *[F.lit(None).cast(valid.schema[c].dataType).alias(c) for c in ("table_id", "headers", "rows", "markdown")])
    w = Window.partitionBy("doc_id").orderBy("p", "kind", F.coalesce("owner", F.lit(0)), "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = valid.unionByName(opened).withColumn("pos", F.last("owner", ignorenulls=True).over(w))
    return both.where("kind = 0 AND pos IS NOT NULL").select("doc_id", "pos", F.col("p").alias("page_num"), "seq", "table_id", "headers", "rows", "markdown")
