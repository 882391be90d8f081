"""The language that a page declares, wherever its <html> tag stands."""

from strataleaf.llm import language_id as I


def test_declared_after_a_long_start(spark):
    pages = [(1, None, "<!--" + "x " * 5_000 + "--><html lang='fr'><p>a"), (2, None, "<html lang=de><p>b"), (3, None, "<p>" + "c " * 5_000), (4, None, None)]
    rows = I.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r["page_id"]: r["declared"] for r in rows.collect()} == {1: "fr", 2: "de", 3: None, 4: None}
