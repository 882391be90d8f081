"""Every registered query of the structure engine against its SQL."""

from pathlib import Path

import pytest
from oracle import assert_same

from strataleaf.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, data, name):
    assert_same(spark, data, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["book_outline", "html_outline", "html_section_text", "markdown_outline"])
def test_references_without_a_semicolon(spark, data, tmp_path, name):
    """Titles and texts that were cut inside a character reference, as in the larger tables."""
    cut = ["a &amp;&amp", "a &amp;&am", "a &", "&lt", "a &quot b", "&ampx; c", "&amp;lt d", "1. &gt;&gt"]
    pages = [(k, f"<html><body><article><h1>{c}</h1><p>first {c}</p><p>{c} &amp; more</p></article></body></html>") for k, c in enumerate(cut)]
    for table in Path(data).iterdir():
        if table.name != "pages.parquet":
            (tmp_path / table.name).symlink_to(table)
    spark.createDataFrame([(k, f"http://a.org/{k}", h) for k, h in pages], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "pages.parquet").symlink_to(next((tmp_path / "made").glob("part-*.parquet")))
    assert_same(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLE_SQL[name])
