"""Text functions, one small case each."""

import pytest
from pyspark.sql import functions as F

from strataleaf.functions import grids as G
from strataleaf.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "prefix", "parts"),
    [
        ("1.2 Scope", "1.2 ", [1, 2]),
        ("1.2.3. Scope", "1.2.3. ", [1, 2, 3]),
        ("A. Scope", "A. ", [1]),
        ("a. scope", "a. ", None),
        ("(b) item", "(b) ", [2]),
        ("(12) item", "(12) ", [12]),
        ("Chapter 4 End", "Chapter 4", [4]),
        ("appendix C", "appendix C", [3]),
        ("Part of it", "Part of", None),
        ("Article IV", "Article IV", None),
        ("Plain", "", None),
    ],
)
def test_numbering(spark, text, prefix, parts):
    row = spark.createDataFrame([(text,)], ["t"]).select(T.numbering(F.col("t")).alias("p"), T.numbering_parts(T.numbering(F.col("t"))).alias("n")).first()
    assert (row["p"], row["n"]) == (prefix, parts)


@pytest.mark.parametrize(("text", "title"), [("1.2 Scope", "Scope"), ("Section 3: Scope", "Scope"), ("Article 3 Scope", "Article 3 Scope"), ("  Scope ", "Scope")])
def test_strip_numbering(spark, text, title):
    assert one(spark, T.strip_numbering(F.col("t")), t=text) == title


@pytest.mark.parametrize(("text", "is_rule"), [("SYSC 8.1.1 R", True), ("Article 15(3)", True), ("(1)(a)", True), ("§ 42", True), ("civil", True), ("iv.", True), ("Results and discussion", False), ("Article of faith", False)])
def test_rule_identifier(spark, text, is_rule):
    assert one(spark, T.is_rule_identifier(F.col("t")), t=text) is is_rule


@pytest.mark.parametrize(("line", "gone"), [("Page 3", False), ("Page 3 of 9", True), ("civil", True), ("- 12 -", True), ("March 2020", True), ("www.a.b see", True), ("see www.a.b", False), ("12345", False)])
def test_artefacts(spark, line, gone):
    assert one(spark, T.is_artefact(F.col("t")), t=line) is gone


def test_unicode_space_is_stripped_but_a_byte_order_mark_is_not(spark):
    assert one(spark, T.strip(F.col("t")), t="  x　\n") == "x"
    assert one(spark, T.strip(F.col("t")), t="﻿x ") == "﻿x"


@pytest.mark.parametrize(("text", "page"), [("Title\nbody\n12", "12"), ("XIV\nbody", "xiv"), ("a\nb\nc\n7\nd\ne\nf", None), ("", None)])
def test_logical_page(spark, text, page):
    assert one(spark, T.logical_page(F.col("t")), t=text) == page


def test_document_type(spark):
    assert one(spark, T.document_type(F.col("t")), t="The firm shall comply pursuant to the directive") == "legal"
    assert one(spark, T.document_type(F.col("t")), t="Abstract\nAs shown [1, 2]") == "academic"
    assert one(spark, T.document_type(F.col("t")), t="Revenue of $5") == "financial"
    assert one(spark, T.document_type(F.col("t")), t="nothing") == "general"


def test_markers(spark):
    made = one(spark, T.marker(F.lit("a.png"), F.col("l"), F.col("c")), l=" Fig\n1 ", c="x | y }} z")
    assert made == "{{IMG:a.png|Fig 1|x / y  z}}"
    text = "one {{IMG:a.png|Fig 1|cap}} two {{IMG:|x|y}} three {{IMG:b.png||}}"
    assert one(spark, T.markers_as_markdown(F.col("t")), t=text) == "one ![Fig 1](assets/images/a.png)\n*cap* two  three ![image](assets/images/b.png)"
    assert one(spark, T.without_markers(F.col("t")), t=text) == "one  two  three "
    assert one(spark, T.without_markers(F.col("t")), t="open {{IMG:a") == "open {{IMG:a"


def test_insert_marker(spark):
    text = "First paragraph ends here.\n\nSecond one."
    assert one(spark, T.insert_marker(F.col("t"), F.col("a"), F.lit("[M]")), t=text, a="First  paragraph ends here.") == "First paragraph ends here.\n\n\n\n[M]\n\nSecond one."
    assert one(spark, T.insert_marker(F.col("t"), F.col("a"), F.lit("[M]")), t=text, a="is one.") == text + "\n\n[M]\n\n"
    assert one(spark, T.insert_marker(F.col("t"), F.col("a"), F.lit("[M]")), t=text, a="absent") == text
    assert one(spark, T.insert_marker(F.col("t"), F.col("a"), F.lit("[M]")), t=text, a="") == text


def test_grids(spark):
    def grid(data, c):
        return spark.createDataFrame([(data,)], "g array<array<string>>").select(c(F.col("g")).alias("x")).first()["x"]

    assert grid([["A", "B"], ["x|y", ""], ["", ""], ["only"]], lambda g: G.markdown(G.cleaned(g))) == "| A    | B   |\n| ---- | --- |\n| x\\|y |     |\n| only |     |"
    assert grid([], G.empty_ratio) == 1.0
    assert grid([], G.average_cell_length) == 0.0
    assert grid([["Name", "Total"], ["Submiss", "ion here"], ["Ma", "tters"]], G.has_split_words) is True
    assert grid([["AP", "PLE INC."], ["N", "ON-EMPLOYEE"]], G.has_split_words) is True
    assert grid([["Name", "Total"], ["Alpha Beta", "Gamma Delta"]], G.has_split_words) is False
    assert grid([["Name", "Value"], ["Alpha", "12.50"]], lambda g: G.passes_quality(g, F.lit(0.0), F.lit(600.0), F.lit(612.0), F.lit("lines"))) is True
    assert grid([["Name", "Value"], ["Alpha", "12.50"]], lambda g: G.passes_quality(g, F.lit(0.0), F.lit(600.0), F.lit(612.0), F.lit("text"))) is False
    assert grid(None, G.cleaned) is None


def test_page_table_validity(spark):
    def valid(h, r):
        return spark.createDataFrame([(h, r)], "h array<string>, r array<array<string>>").select(G.is_valid_page_table(F.col("h"), F.col("r")).alias("x")).first()["x"]

    assert valid(["Name", "Value"], [["a", "1"]])
    assert not valid(["Name", ""], [["a", "1"]])
    assert not valid(["Name", "value"], [["a", "1"]])
    assert not valid(["Name", "Value"], [])
    assert not valid(["Name", "Value"], [["Submiss", "ion"], ["Ma", "tters"]])
    assert not valid(["N", "V"], [["a", "b"]] * 5)
