"""Record tables derived from the star-schema tables, where no decoded documents are at hand.

Each is a DataFrame and, under the same name in SQL, a common table expression: only integer
arithmetic, substrings and total orders, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of documents, dealt out by document before they are cut, so that no later window or join on doc_id shuffles lines."""
    return load(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def spans(spans_of: DataFrame) -> DataFrame:
    """Positioned lines of doc_lines: twelve to a page, three to a block, some large, bold or numbered."""
    n = F.col("line_no")
    big, numbered = n % 7 == 0, n % 5 == 0
    prefix = F.concat((1 + n % 4).cast("string"), F.lit("."), (1 + n % 3).cast("string"), F.lit(" "), F.substring("line", 1, 30))
    text = F.when(numbered, prefix).when(big, F.substring("line", 1, 24)).otherwise(F.col("line"))
    out = spans_of.select(
        "doc_id",
        n.cast("int").alias("line_no"),
        (F.floor(n / 12) + 1).cast("int").alias("page"),
        F.floor((n % 12) / 3).cast("int").alias("block_index"),
        text.alias("text"),
        F.when(big, 16.0).when(numbered, 13.0).otherwise(11.0).alias("font_size"),
        (big | (n % 10 == 0)).alias("is_bold"),
        F.when((n % 2 == 1) & (F.col("doc_id") % 4 == 0), 320.0).otherwise(60.0).alias("x0"),
        (60.0 + (n % 12) * 50.0).alias("y0"),
    )
    out = out.where(F.trim("text") != "")
    return out.withColumns({"x1": F.col("x0") + 240.0, "y1": F.col("y0") + F.col("font_size"), "line_height": F.col("font_size"), "page_width": F.lit(612.0), "page_height": F.lit(792.0)})


def page_text(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): ten lines a page under a running header and above a page number."""
    page = (F.floor(F.col("line_no") / 10) + 1).cast("int")
    body = lines.groupBy("doc_id", page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_b"))
    return body.select("doc_id", "page", F.concat(F.lit("Report "), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), "_b", F.lit("\n"), F.col("page").cast("string")).alias("text"))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, level, title, page_start): an outline for each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = load(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "pos", (1 + F.col("l_partkey") % 3).cast("int").alias("level"), F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("title"), (F.col("pos") * 2 - F.col("l_suppkey") % 2 + F.when(F.col("l_orderkey") % 5 == 0, 3).otherwise(0)).cast("int").alias("page_start"))


def toc_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("doc_id").agg((2 * F.max("pos") + 3).cast("int").alias("total_pages"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_num, md): a page for each turn of a conversation."""
    t, text = F.col("turn"), F.col("text")
    nl = F.lit("\n")
    grid = F.concat(text, nl, F.lit("| Name | Value |"), nl, F.lit("|---|---|"), nl, F.lit("| Turn | "), t.cast("string"), F.lit(" |"), nl, F.lit("| Role | "), F.col("role"), F.lit(" |"))
    md = (
        F.when(t % 5 == 4, "[BLANK PAGE]")
        .when(t % 3 == 0, F.concat(F.when(t % 2 == 0, "# ").otherwise("## "), F.lit("Part "), t.cast("string"), nl, nl, text))
        .when(t % 3 == 1, F.concat(F.lit("("), (t + 1).cast("string"), F.lit(") "), F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30), F.lit(";")))
        .otherwise(grid)
    )
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (t + 1).cast("int").alias("page_num"), md.alias("md"))


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data): a table for each order, some cells empty."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    hole = F.col("l_suppkey") % 4 == 0
    row = F.array(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.when(hole, "").otherwise(F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string"))), F.when(hole & (F.col("l_partkey") % 2 == 0), "").otherwise(F.concat(F.lit("no|"), F.col("l_linenumber").cast("string"), F.lit("  x"))))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("r"), row.alias("cells"))
    body = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"]).alias("b"))
    return body.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.array(F.array(F.lit("Part"), F.lit("Qty"), F.lit("Price|Unit"))), "b").alias("data"))


def table_candidates(grids: DataFrame) -> DataFrame:
    """(doc_id, page, n, method, x0, y0, x1, y1, data): three strategies' finds of each table, shifted a little or far."""
    found = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(s)).alias("s")) for m, s in (("lines", 0), ("text", 4), ("mixed", 40))]))
    rows = grids.select("doc_id", found.alias("f"), "data")
    shift = F.col("f.s") * (F.col("doc_id") % 4)
    return rows.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("n"), F.col("f.method").alias("method"), (60.0 + shift).alias("x0"), F.lit(100.0).alias("y0"), (360.0 + shift).alias("x1"), F.lit(300.0).alias("y1"), "data")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, n, xref, width_px, height_px, bpc, ext, x0, y0, x1, y1) from parts."""
    k = F.col("p_partkey")
    x0, y0 = (k % 5) * 60.0, (k % 9) * 85.0
    return load(spark, sf_dir, "part").select((k % 50).alias("doc_id"), (k % 4 + 1).cast("int").alias("page"), k.alias("n"), (k % 700).alias("xref"), (40 + 10 * F.col("p_size")).cast("int").alias("width_px"), (60 + k % 400).cast("int").alias("height_px"), (1 + k % 8).cast("int").alias("bpc"), F.lit("png").alias("ext"), x0.alias("x0"), y0.alias("y0"), (x0 + 40.0 + (k % 7) * 40.0).alias("x1"), (y0 + 30.0 + (k % 11) * 25.0).alias("y1"))


def words(lines: DataFrame) -> DataFrame:
    """(doc_id, page, word_no, x0, y0, x1, y1, word) of spans, a fixed advance for each word; one line in six reads like a caption."""
    text = F.when(F.col("line_no") % 6 == 3, F.concat(F.lit("Figure "), F.col("line_no").cast("string"), F.lit(" "), "text")).otherwise(F.col("text"))
    rows = lines.select("doc_id", "page", "line_no", "x0", "y0", F.posexplode(F.split(text, " ")).alias("k", "word")).where("word <> ''")
    return rows.select("doc_id", "page", (F.col("line_no") * 100 + F.col("k")).alias("word_no"), (F.col("x0") + F.col("k") * 20.0).alias("x0"), "y0", (F.col("x0") + F.col("k") * 20.0 + 18.0).alias("x1"), (F.col("y0") + 10.0).alias("y1"), "word")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size_bytes) from customers, a suffix of any kind each."""
    from strataleaf.sources.files import FORMATS

    suffixes = [*FORMATS, ".txt", ""]
    chosen = F.get(F.array(*[F.lit(s) for s in suffixes]), (F.col("c_custkey") % len(suffixes)).cast("int"))
    name = F.concat(F.lit("in/file"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.upper(chosen)).otherwise(chosen))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), name.alias("path"), (F.col("c_custkey") * F.col("c_custkey") * 977 % 700_000_000).alias("size_bytes"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, event_id, ts, event, progress_page) from events."""
    event = F.when(F.col("event_type") == "signup", "submitted").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("progress")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), event.alias("event"), F.floor("value").cast("int").alias("progress_page"))


SQL = {
    "doc_lines": "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents",
    "spans": """SELECT *, x0 + 240.0 AS x1, y0 + font_size AS y1, font_size AS line_height FROM (
SELECT doc_id, line_no::INT AS line_no, (line_no // 12 + 1)::INT AS page, ((line_no % 12) // 3)::INT AS block_index,
 CASE WHEN line_no % 5 = 0 THEN concat(1 + line_no % 4, '.', 1 + line_no % 3, ' ', substr(line, 1, 30)) WHEN line_no % 7 = 0 THEN substr(line, 1, 24) ELSE line END AS text,
 (CASE WHEN line_no % 7 = 0 THEN 16.0 WHEN line_no % 5 = 0 THEN 13.0 ELSE 11.0 END)::DOUBLE AS font_size, (line_no % 7 = 0 OR line_no % 10 = 0) AS is_bold,
 (CASE WHEN line_no % 2 = 1 AND doc_id % 4 = 0 THEN 320.0 ELSE 60.0 END)::DOUBLE AS x0, (60.0 + (line_no % 12) * 50.0)::DOUBLE AS y0
FROM doc_lines) WHERE trim(text) <> ''""",
    "page_text": "SELECT doc_id, (line_no // 10 + 1)::INT AS page, 'Report ' || (doc_id % 7) || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || chr(10) || (line_no // 10 + 1) AS text FROM doc_lines GROUP BY doc_id, line_no // 10",
    "toc": """SELECT l_orderkey AS doc_id, pos::INT AS pos, (1 + l_partkey % 3)::INT AS level, 'Item ' || l_partkey AS title,
 (pos * 2 - l_suppkey % 2 + CASE WHEN l_orderkey % 5 = 0 THEN 3 ELSE 0 END)::INT AS page_start
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos FROM lineitem)""",
    "toc_totals": "SELECT doc_id, (2 * max(pos) + 3)::INT AS total_pages FROM toc GROUP BY doc_id",
    "page_markdown": """SELECT conv_id AS doc_id, (turn + 1)::INT AS page_num, CASE WHEN turn % 5 = 4 THEN '[BLANK PAGE]'
 WHEN turn % 3 = 0 THEN (CASE WHEN turn % 2 = 0 THEN '# ' ELSE '## ' END) || 'Part ' || turn || chr(10) || chr(10) || text
 WHEN turn % 3 = 1 THEN '(' || (turn + 1) || ') ' || lower(substr(text, 1, 1)) || substr(text, 2) || ';'
 ELSE text || chr(10) || '| Name | Value |' || chr(10) || '|---|---|' || chr(10) || '| Turn | ' || turn || ' |' || chr(10) || '| Role | ' || role || ' |' END AS md FROM conversations""",
    "table_grid": """SELECT doc_id, list_prepend(['Part', 'Qty', 'Price|Unit'], list(cells ORDER BY r)) AS data FROM (
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS r,
 ['Part ' || l_partkey, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'qty ' || l_quantity::INT END, CASE WHEN l_suppkey % 4 = 0 AND l_partkey % 2 = 0 THEN '' ELSE 'no|' || l_linenumber || '  x' END] AS cells FROM lineitem) GROUP BY doc_id""",
    "table_candidates": """SELECT doc_id, 1 AS page, m.method AS method, m.seq AS seq, 60.0::DOUBLE + m.s * (doc_id % 4) AS x0, 100.0::DOUBLE AS y0, 360.0::DOUBLE + m.s * (doc_id % 4) AS x1, 300.0::DOUBLE AS y1, data
FROM table_grid, (VALUES ('lines', 1, 0.0::DOUBLE), ('text', 2, 4.0::DOUBLE), ('mixed', 3, 40.0::DOUBLE)) AS m(method, seq, s)""",
    "images": """SELECT p_partkey % 50 AS doc_id, (p_partkey % 4 + 1)::INT AS page, p_partkey AS n, p_partkey % 700 AS xref, (40 + 10 * p_size)::INT AS width_px, (60 + p_partkey % 400)::INT AS height_px, (1 + p_partkey % 8)::INT AS bpc,
 ((p_partkey % 5) * 60.0)::DOUBLE AS x0, ((p_partkey % 9) * 85.0)::DOUBLE AS y0, ((p_partkey % 5) * 60.0 + 40.0 + (p_partkey % 7) * 40.0)::DOUBLE AS x1, ((p_partkey % 9) * 85.0 + 30.0 + (p_partkey % 11) * 25.0)::DOUBLE AS y1 FROM part""",
    "words": """SELECT doc_id, page, line_no * 100 + k AS word_no, x0 + k * 20.0::DOUBLE AS x0, y0, x0 + k * 20.0::DOUBLE + 18.0::DOUBLE AS x1, y0 + 10.0::DOUBLE AS y1, word FROM (
SELECT doc_id, page, line_no, x0, y0, unnest(range(len(ws))) AS k, unnest(ws) AS word FROM (
SELECT *, string_split(CASE WHEN line_no % 6 = 3 THEN 'Figure ' || line_no || ' ' || text ELSE text END, ' ') AS ws FROM spans)) WHERE word <> ''""",
    "files": """SELECT c_custkey AS doc_id, 'in/file' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN upper(s) ELSE s END AS path, (c_custkey * c_custkey * 977) % 700000000 AS size_bytes
FROM (SELECT *, ['.pdf','.docx','.doc','.html','.htm','.md','.markdown','.epub','.pptx','.ppt','.png','.jpg','.jpeg','.tiff','.tif','.txt',''][(c_custkey % 17 + 1)::INT] AS s FROM customer)""",
    "job_events": """SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END AS event, floor(value)::INT AS progress_page FROM events""",
}
NEEDS = {"spans": ["doc_lines"], "page_text": ["doc_lines"], "toc_totals": ["toc"], "table_candidates": ["table_grid"], "words": ["spans"]}


def ctes(*names: str) -> str:
    """A WITH clause (no trailing comma) for these tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)


def paragraphs(lines: DataFrame) -> DataFrame:
    """office.PARAGRAPHS from doc_lines: every seventh line a heading of some level, a page break every ninth."""
    n = F.col("line_no")
    style = F.when(n % 7 == 0, F.concat(F.lit("Heading "), (1 + n % 4).cast("string"))).when(n % 11 == 0, "Subtitle").otherwise("Normal")
    return lines.select("doc_id", n.cast("int").alias("pos"), style.alias("style"), F.col("line").alias("text"), (n % 9 == 8).alias("has_break"))


def shapes(lines: DataFrame) -> DataFrame:
    """office.SHAPES from doc_lines: four lines a slide, the first one a title on most slides."""
    n = F.col("line_no")
    slide, shape = F.floor(n / 4) + 1, n % 4
    title = F.when(slide % 5 == 2, "").otherwise(F.substring("line", 1, 30))
    text = F.when(shape == 0, title).when(slide % 3 == 0, "").otherwise(F.col("line"))
    return lines.select("doc_id", slide.cast("int").alias("slide"), shape.cast("int").alias("shape"), ((shape == 0) & (slide % 4 != 3)).alias("is_title"), text.alias("text"))


SQL |= {
    "paragraphs": "SELECT doc_id, line_no::INT AS pos, CASE WHEN line_no % 7 = 0 THEN 'Heading ' || (1 + line_no % 4) WHEN line_no % 11 = 0 THEN 'Subtitle' ELSE 'Normal' END AS style, line AS text, line_no % 9 = 8 AS has_break FROM doc_lines",
    "shapes": """SELECT doc_id, (line_no // 4 + 1)::INT AS slide, (line_no % 4)::INT AS shape, line_no % 4 = 0 AND (line_no // 4 + 1) % 4 <> 3 AS is_title,
 CASE WHEN line_no % 4 = 0 THEN (CASE WHEN (line_no // 4 + 1) % 5 = 2 THEN '' ELSE substr(line, 1, 30) END) WHEN (line_no // 4 + 1) % 3 = 0 THEN '' ELSE line END AS text FROM doc_lines""",
}
NEEDS |= {"paragraphs": ["doc_lines"], "shapes": ["doc_lines"]}
