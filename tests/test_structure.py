"""Trees, pages and tables on hand-made rows, and trees against a plain stack."""

import random

import pytest
from pyspark.sql import functions as F

from strataleaf.operators import headings, page_markdown, pages, render, tables, tree


def stack_model(levels, phantoms):
    """Parents by the plain stack, as list of (level, parent index, phantom)."""
    out, stack = [], []
    for level in levels:
        if phantoms and stack and level > stack[-1][0] + 1:
            for k in range(stack[-1][0] + 1, level):
                out.append((k, stack[-1][1], True))
                stack.append((k, len(out) - 1))
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append((level, stack[-1][1] if stack else None, False))
        stack.append((level, len(out) - 1))
    return out


@pytest.mark.parametrize("phantoms", [False, True])
def test_trees_match_a_stack(spark, phantoms):
    rng = random.Random(5)
    docs = {d: [rng.randint(1, 6) for _ in range(rng.randint(1, 12))] for d in range(150)}
    docs[999] = [1, 3, 2, 3, 3, 1, 2]
    rows = [(d, k, level, f"t{k}", 1.0) for d, levels in docs.items() for k, level in enumerate(levels, 1)]
    heads = spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, confidence double")
    got = {}
    for r in tree.build(heads, phantoms=phantoms).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, levels in docs.items():
        want = stack_model(levels, phantoms)
        nodes = got[d]
        assert [n["level"] for n in nodes] == [w[0] for w in want]
        place = {n["pos"]: k for k, n in enumerate(nodes)}
        assert [place.get(n["parent_pos"]) for n in nodes] == [w[1] for w in want]
        counts, ids = {}, []
        for _, parent, _ in want:
            counts[parent] = counts.get(parent, 0) + 1
            ids.append((ids[parent] + "." if parent is not None else "") + str(counts[parent]))
        assert [n["section_id"] for n in nodes] == ids
        assert [n["depth"] for n in nodes] == [i.count(".") + 1 for i in ids]
        assert [n["id"] for n in nodes] == [f"{k:04d}" for k in range(1, len(ids) + 1)]
        inner = {w[1] for w in want}
        assert [n["node_type"] for n in nodes] == ["root" if w[1] is None else "parent" if k in inner else "child" for k, w in enumerate(want)]


def test_page_ranges_share_a_phantom(spark):
    heads = spark.createDataFrame([(1, 1, 1, "a", 1, 1, 1.0), (1, 2, 3, "b", 2, 2, 1.0), (1, 3, 3, "c", 5, 4, 1.0), (1, 4, 1, "d", 7, 7, 1.0)], "doc_id long, pos int, level int, title string, page_start int, page_end int, confidence double")
    got = {r["title"]: (r["page_start"], r["page_end"]) for r in tree.resolve_pages(tree.build(heads, phantoms=True)).collect()}
    # The heading b shares its range with the phantom put in for it, which also holds c.
    assert got == {"a": (1, 5), tree.PHANTOM_TITLE: (2, 5), "b": (2, 5), "c": (5, 5), "d": (7, 7)}


def test_dense_levels_and_clamp(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 40), (1, 3, 20)], "doc_id long, pos int, level int")
    assert [r["level"] for r in tree.dense_levels(rows).orderBy("pos").collect()] == [1, 3, 2]
    nodes = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 2, 9), (1, 3, 3, 6)], "doc_id long, pos int, level int, page_end int")
    assert [r["page_end"] for r in tree.clamp_to_parents(nodes).orderBy("pos").collect()] == [4, 4, 4]


def test_score_boundaries(spark):
    rows = [
        (1, 1, 1, 0, "1. Short bold line", 11.0, True, 0.0),  # bold, short, no stop, numbered: just under .65
        (1, 2, 1, 1, "1. Gap line but plain " + "word " * 3, 11.0, False, 60.0),
        (1, 3, 1, 2, "body text of the page that goes on and on and on and on for more than twelve words.", 11.0, False, 75.0),
        (1, 4, 1, 3, "body text of the page that goes on and on and on and on for more than twelve words.", 11.0, False, 90.0),
    ]
    spans = spark.createDataFrame(rows, "doc_id long, line_no int, page int, block_index int, text string, font_size double, is_bold boolean, y0 double")
    spans = spans.withColumns({"x0": F.lit(60.0), "x1": F.lit(300.0), "y1": F.col("y0") + F.col("font_size"), "line_height": F.col("font_size"), "page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    scored = headings.prepared(spans)
    score = {r["line_no"]: r["heading_score"] for r in scored.collect()}
    assert score[1] == 0.0 + 0.2 + 0.15 + 0.1 + 0.2 < 0.65
    assert score[2] == 0.15 + 0.1 + 0.15 + 0.2
    assert headings.candidates(scored).count() == 0


def test_two_columns_with_a_heading_across(spark):
    rows = [(1, 0, 1, 0, "Wide heading", 60.0, 560.0, 40.0, 56.0)]
    for k in range(12):
        rows.append((1, 1 + 2 * k, 1, 1, f"left body line number {k}", 60.0, 280.0, 60.0 + 20 * k, 70.0 + 20 * k))
        rows.append((1, 2 + 2 * k, 1, 2, f"right body line number {k}", 330.0, 550.0, 60.0 + 20 * k, 70.0 + 20 * k))
    spans = spark.createDataFrame(rows, "doc_id long, line_no int, page int, block_index int, text string, x0 double, x1 double, y0 double, y1 double")
    spans = spans.withColumns({"page_width": F.lit(612.0), "word_count": F.size(F.split("text", " "))})
    placed = headings.with_columns(spans)
    columns = {r["line_no"]: r["column"] for r in placed.collect()}
    assert columns[0] == -1 and columns[1] == 0 and columns[2] == 1
    owned = headings.body_owners(headings.with_heads(placed.withColumn("level", F.when(F.col("line_no") == 0, 1)), least=1))
    assert owned.count() == 24
    text = headings.body_texts(owned).first()["text"]
    assert text.startswith("left body line number 0 left body") and "\n\nright body line number 0 " in text


def test_runs_become_lines(spark):
    rows = [(1, 1, 0, 0, 0, " A ", 10.0, "Times-Bold", 0, 0.0, 0.0, 5.0, 10.0), (1, 1, 0, 0, 1, "b", 12.0, "Times", 2, 6.0, 0.0, 9.0, 12.0), (1, 1, 0, 1, 0, "  ", 10.0, "T", 0, 0.0, 0.0, 1.0, 1.0)]
    got = headings.lines_from_runs(spark.createDataFrame(rows, "doc_id long, page int, block_index int, line_in_block int, run_no int, text string, font_size double, font string, flags int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [(r["text"], r["font_size"], r["is_bold"], r["is_italic"], r["is_caps"]) for r in got] == [("A b", 12.0, True, True, False)]


def test_outline_and_front_matter(spark):
    toc = spark.createDataFrame([(1, 1, 1, "a", 4), (1, 2, 2, "b", 5), (1, 3, 2, "c", 5), (1, 4, 1, "d", 9)], "doc_id long, pos int, level int, title string, page_start int")
    totals = spark.createDataFrame([(1, 12)], "doc_id long, total_pages int")
    ranged = tree.outline_ranges(toc, totals)
    assert [(r["page_start"], r["page_end"]) for r in ranged.orderBy("pos").collect()] == [(4, 8), (5, 5), (5, 8), (9, 12)]
    assert [(r["page_start"], r["page_end"]) for r in tree.front_matter(toc).collect()] == [(1, 3)]
    spans = {r["title"]: (r["text_end"], r["keep_chars"]) for r in tree.parent_text_span(tree.build(ranged)).collect()}
    assert spans == {"a": (4, None), "b": (5, None), "c": (8, None), "d": (12, None)}


def test_running_lines_and_budget(spark):
    texts = [(1, p, f"Head\nbody {p}\n{'x' * 8000}\n{p}") for p in range(1, 6)]
    found = spark.createDataFrame(texts, "doc_id long, page int, text string")
    running = pages.running_lines(found)
    assert {r["line"] for r in running.collect()} == {"Head", "x" * 8000} - {"x" * 8000}
    ranges = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 5, 5)], "doc_id long, pos int, page_start int, text_end int")
    got = {r["pos"]: r["text"] for r in pages.range_texts(ranges, found, running).collect()}
    assert len(got[1]) == 15000 and "body 2" in got[1] and "body 3" not in got[1] and "Head" not in got[1]
    assert got[2].startswith("body 5")
    docs = spark.createDataFrame([(1, "name", 5)], "doc_id long, title string, total_pages int")
    node = pages.single_nodes(docs, found, running).first()
    assert (node["title"], node["confidence"], node["page_end"]) == ("name", 0.6, 5)


def md_pages(spark, *mds):
    return spark.createDataFrame([(1, k, md) for k, md in enumerate(mds, 1)], "doc_id long, page_num int, md string")


TABLE = "| Name | Value |\n|---|---|\n| Alpha | Twelve |"


def sections(spark, *mds):
    return {r["title"]: r for r in page_markdown.sections(md_pages(spark, *mds)).collect()}


def test_tables_go_to_the_section_open_before_the_page(spark):
    got = sections(spark, "# A\ntext", f"# B\n\n{TABLE}")
    assert (got["A"]["n_tables"], got["B"]["n_tables"]) == (1, 0)
    assert got["B"]["text"] == ""


def test_text_before_the_first_heading_is_lost_unless_there_is_none(spark):
    got = sections(spark, f"intro\n{TABLE}\n# A\nx")
    assert set(got) == {"A"} and got["A"]["text"] == "x" and got["A"]["n_tables"] == 0
    only = page_markdown.sections(md_pages(spark, "one", "two")).collect()
    assert [(r["text"], r["page_start"], r["page_end"]) for r in only] == [("one\n\ntwo", 1, 2)]


def test_continuations_keep_tables_and_headings_in_the_text(spark):
    got = sections(spark, "# A\nends here.", f"[CONTINUATION]\n## Not a heading\n{TABLE}", "[BLANK PAGE]", "# B\n(c)", "[CONTINUATION]\nmore")
    assert got["A"]["text"] == f"ends here.\n\n## Not a heading\n{TABLE}"
    assert (got["A"]["n_tables"], got["A"]["page_start"], got["A"]["page_end"]) == (1, 1, 3)
    assert got["B"]["text"] == "(c)\n\nmore" and got["B"]["page_end"] == 5


def test_a_continuation_without_an_open_section_is_plain(spark):
    got = sections(spark, "[CONTINUATION]\n# A\nx")
    assert got["A"]["text"] == "x"


def test_invalid_tables_use_up_numbers_and_become_prose(spark):
    bad = "| name | value |\n|---|---|\n| a | b |"
    found = page_markdown.tables(md_pages(spark, f"{bad}\n\n{TABLE}\n\n  {TABLE}")).orderBy("seq").collect()
    assert [(r["table_id"], r["is_valid"]) for r in found] == [("p1_t1", False), ("p1_t2", True)]
    got = sections(spark, f"# A\n{bad}\nend")
    assert got["A"]["text"] == "name value\na b\nend"


def test_page_cleaning(spark):
    md = "```markdown\n# INDEX\nwww.example.org\n\n\n\nText 12\n12\nMay 2020\nxiv\n## Real heading\n```"
    got = md_pages(spark, md).select(page_markdown.clean(F.col("md")).alias("x")).first()["x"]
    assert got == "INDEX\n\nText 12\n## Real heading"


@pytest.mark.parametrize(("tail", "md", "goes_on"), [("(2) a", "(3) b", True), ("(3) a", "(3) b", False), ("(a) x.", "(b) y", True), ("(z) x.", "(a) y", False), ("word", "lower start", True), ("word.", "lower start", False), ("word;", "Upper", True), ("", "lower", False), ("word,", "  \n", False)])
def test_continuation_rule(spark, tail, md, goes_on):
    row = spark.createDataFrame([(md, tail)], "md string, tail string")
    assert row.select(page_markdown.continues(F.col("md"), F.col("tail")).alias("x")).first()["x"] is goes_on


def test_deduplication_is_a_fold(spark):
    cells = [["Name", "Value"], ["a", ""]]
    full = [["Name", "Value"], ["a", "b"]]
    rows = [(1, 1, 1, "lines", 0.0, 0.0, 100.0, 100.0, cells), (1, 1, 2, "text", 5.0, 0.0, 105.0, 100.0, full), (1, 1, 3, "mixed", 10.0, 0.0, 110.0, 100.0, cells), (1, 2, 1, "lines", 0.0, 0.0, 0.0, 0.0, cells), (1, 2, 2, "text", 0.0, 0.0, 0.0, 0.0, cells)]
    found = spark.createDataFrame(rows, "doc_id long, page int, seq int, method string, x0 double, y0 double, x1 double, y1 double, data array<array<string>>")
    got = [(r["page"], r["place"], r["method"]) for r in tables.deduplicate(found).orderBy("page", "place").collect()]
    # The fuller table takes the first one's place; tables without a box never meet.
    assert got == [(1, 0, "text"), (2, 0, "lines"), (2, 1, "text")]


def test_captions_and_attachment(spark):
    found = spark.createDataFrame([(1, 1, 0, "lines", 10.0, 100.0, 200.0, 200.0, [["Name", "Value"], ["a", "b"]])], "doc_id long, page int, place int, method string, x0 double, y0 double, x1 double, y1 double, data array<array<string>>")
    words = spark.createDataFrame([(1, 1, 1, 10.0, 80.0, 40.0, 90.0, "Table"), (1, 1, 2, 45.0, 80.0, 60.0, 90.0, "3."), (1, 1, 3, 10.0, 300.0, 20.0, 310.0, "far")], "doc_id long, page int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    assert tables.captions(found, words).first()["caption"] == "Table 3."
    deepest = spark.createDataFrame([(1, 1, 5, "0005")], "doc_id long, page int, pos int, id string")
    row = tables.attach(found, deepest).first()
    assert (row["table_id"], row["id"], row["headers"], row["markdown"].split("\n")[1]) == ("p1_t1", "0005", ["Name", "Value"], "| ---- | ----- |")


def test_rendering(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, 1, "0001", "1", 1, "root", "A", "text {{IMG:a.png|F|}}", 1, 2, 0.87654, [("t1", "", 1, ["H"], [["c"]], "| H |", "")], [("", "L", "C", "assets/images/b.png", 2, "raster", 5.0), ("", "", "", "assets/images/a.png", 1, "raster", 1.0)]), (1, 2, 1, 2, "0002", "1.1", 2, "child", "B", "", 2, 2, 1.0, [], [])],
        "doc_id long, pos int, parent_pos int, level int, id string, section_id string, depth int, node_type string, title string, text string, page_start int, page_end int, confidence double, tables array<struct<table_id string, caption string, page int, headers array<string>, rows array<array<string>>, markdown string, image_path string>>, images array<struct<image_id string, label string, caption string, path string, page int, image_type string, y0 double>>",
    )
    documents = spark.createDataFrame([(1, "a.pdf", "pdf", 2, "2020-01-01T00:00:00Z", "fast")], "doc_id long, source_file string, source_format string, total_pages int, extracted_at string, extraction_path string")
    md = render.markdown(documents, nodes).first()["markdown"]
    assert md.split("---\n\n", 1)[1] == "# 1 · A\n\ntext ![F](assets/images/a.png)\n\n**Table t1**\n\n| H |\n\n![L](assets/images/b.png)\n*C*\n\n## 1.1 · B\n"
    assert "<!-- id:0001 pages:1-2 confidence:0.88 type:root -->" in render.markdown(documents, nodes, with_metadata=True).first()["markdown"]
    import json

    tree_json = json.loads(render.document_json(documents, nodes).first()["json"])
    top = tree_json["nodes"][0]
    assert (tree_json["source_file"], top["confidence"], top["text"], top["pages"]["logical_start"], top["children"][0]["title"]) == ("a.pdf", 0.8765, "text ", None, "B")
    assert set(top["images"][0]) == {"image_id", "label", "caption", "path", "page", "image_type"}
    assert render.visible(nodes, render.expanded(nodes, "none")).count() == 1
    assert render.visible(nodes, render.expanded(nodes, "all")).count() == 2


def test_json_nesting_of_deep_and_shallow_turns(spark):
    import json

    levels = [1, 2, 3, 2, 1, 2, 3, 4, 1]
    heads = spark.createDataFrame([(1, k, level, f"t{k}", "", 1, 1) for k, level in enumerate(levels, 1)], "doc_id long, pos int, level int, title string, text string, page_start int, page_end int")
    found = json.loads(render.json_trees(tree.build(heads)).first()["nodes_json"])

    def flat(nodes):
        return [x for n in nodes for x in [n["section_id"], *flat(n["children"])]]

    assert flat(found) == ["1", "1.1", "1.1.1", "1.2", "2", "2.1", "2.1.1", "2.1.1.1", "3"]
