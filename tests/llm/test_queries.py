"""Registered queries against their SQL, and the pipeline against its stages done by hand."""

from collections import Counter

import pytest
from oracle import assert_same

import corpus_pipeline
from strataleaf.llm import mixing, quality, queries
from test_near_copies import brute_force


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, data, name):
    assert_same(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])


CONTRACT = {
    "op1_language_id": {"doc_id", "page_id", "lang"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op3_mixing": {"doc_id", "probability", "kept"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op7_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op9_simhash": {"doc_id", "fingerprint", "component_id"},
    "op10_html_extract": {"page_id", "url", "text", "n_chars"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert CONTRACT[name] <= set(df.columns)
    rows = df.count()
    docs, pages = (spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("documents", "pages"))
    if name == "op8_packing":
        assert rows >= docs
    else:
        assert rows == {"op1_language_id": docs + pages, "op6_url_filter": pages, "op10_html_extract": pages}.get(name, docs)


def test_pipeline(spark, data, small_docs):
    """Stage by stage: what stays is what the operators decide about all that came in."""
    now = small_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, data)
        assert out.columns == small_docs.columns, name
        rows = out.collect()
        kept, before = Counter(tuple(r) for r in rows), Counter(tuple(r) for r in now.collect())
        assert kept and not kept - before, name
        if name == "exact dedup":
            largest = {}
            for r in before:
                largest[lower(r[1])] = max(largest.get(lower(r[1]), -1), r[0])
            assert {(r["doc_id"], lower(r["text"])) for r in rows} == {(i, t) for t, i in largest.items()} and len(rows) == len(largest)
        if name == "quality rules":
            verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(now).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, k in verdicts.items() if k}
        if name == "simhash near-dedup":
            roots = brute_force([(r[0], r[1]) for r in before])
            by_root = Counter(roots[r["doc_id"]] for r in rows)
            assert set(by_root) == set(roots.values()) and max(by_root.values()) == 1
        if name == "source mix":
            verdicts = {r["doc_id"]: r["kept"] for r in mixing.mix(now).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, k in verdicts.items() if k}
        now = spark.createDataFrame(rows, small_docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in now.collect()}
    whole = corpus_pipeline.run(spark, data)
    key = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(whole) == key(pieces)


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark, data):
    rows = [(1, "aaa"), (1, "bbb"), (2, "BBB"), (None, "zzz"), (None, "yyy"), (None, "ZZZ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.exact_copies(spark, docs, data).collect())
    assert out == Counter([(1, "aaa"), (2, "bbb"), (None, "zzz"), (None, "yyy")])
    # Words are compared in lower case, so bbb and BBB, zzz and ZZZ are copies.
    near = Counter(r["text"].lower() for r in corpus_pipeline.near_copies(spark, docs, data).collect())
    assert near == Counter(["aaa", "bbb", "zzz", "yyy"])
    assert corpus_pipeline.source_mix(spark, docs, data).where("doc_id IS NULL").count() in (0, 3)
    words = " ".join(f"{w} plain words" for w in ("some", "quite", "very", "rather", "other", "more", "less", "few", "many", "most", "such", "own", "same", "too", "only", "then", "here", "now."))
    long = spark.createDataFrame([(None, words, "en", "a", 3), (7, words, "en", "a", 3), (7, "short", "en", "a", 3)], docs.schema)
    assert [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality_rules(spark, long, data).orderBy("doc_id").collect()] == [(None, words), (7, words)]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, data, docs, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    before = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    rows = stage(spark, docs, data).collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert not Counter((r["doc_id"], r["text"], r["source"]) for r in rows) - before
        assert (k == 0) == (len(rows) < 2)  # of these rows only the long one has 50 words
    else:
        assert {r["doc_id"] for r in rows} == {i for i, _, _ in before}
    assert stage(spark, no_docs, data).count() == 0
