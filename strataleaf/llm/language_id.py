"""Language identification by Bayesian fusion of evidence.

A row's posterior combines

* the likelihood of its text under character trigram models, tempered and bounded because
  neighbouring trigrams are far from independent;
* the language that its markup declares and the suffix of its address, with reliabilities
  counted against what the texts alone say;
* a prior for its host, smoothed towards its registered domain, that towards its suffix, and
  that towards all rows: grouped counts of the verdicts of the other texts, at each level. A
  country's suffix is evidence of its own, so it is no level here: countries share one.

Texts stay where they are read; only narrow evidence rows are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import UPPER, cut, join_sliced

#: Labelled rows per language that the trigram models are fitted on, at most.
SAMPLE = 1_500
#: Hashed trigrams of a model.
TABLE = 1 << 16
#: The text's log-likelihood ratio counts with TEMPER per trigram, and BOUND at most.
TEMPER, BOUND = 0.3, 12.0
#: Pseudo-rows of the level above, in host priors and in reliabilities.
SMOOTH = 10.0
MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.S | re.I)


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed trigrams of bytes whose digits and ASCII punctuation count as space."""
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint32)
    return ((b[:-2] * 40503 + b[1:-1]) * 40503 + b[2:]) % 4294967291 % TABLE


_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def counts_of(text: str | None, markup: bool = False) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    if markup:
        raw = MARKUP.sub(b" ", raw)
    return trigrams(raw.lower())


def fit_profiles(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-probabilities (language, trigram) from rows (lang, text); counts meet in grouped sums of bounded size."""
    place = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), TABLE), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[place[lang]] += np.bincount(counts_of(text.as_py()), minlength=TABLE)
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[k, at])], names=["k", "at", "n"])

    counts = np.zeros((len(languages), TABLE))
    for r in labelled.select("lang", "text").mapInArrow(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"], r["at"]] = r["n"]
    shared = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * TABLE)
    return np.log((counts + 500 * shared) / (counts.sum(axis=1, keepdims=True) + 500)).astype(np.float32)


def likelihoods(profiles: np.ndarray, text: str | None, markup: bool) -> list[float]:
    """Tempered log-likelihood of each language, the best one 0; a text without letters says nothing."""
    total = np.zeros(len(profiles))
    at = counts_of(text, markup)
    for a in range(0, len(at), 1 << 20):
        total += profiles[:, at[a : a + (1 << 20)]].sum(axis=1, dtype=np.float64)
    scores = TEMPER * (total - total.max())
    return np.maximum(scores, -BOUND).tolist()


def _host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#:]*)", 1), UPPER, UPPER.lower())


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows of documents: no markup and no address; the source takes the place of the host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("content"), F.lit(False).alias("markup"), F.lit(None).cast("string").alias("declared"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of pages: the language that <html lang> declares, and the host of the url."""
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("content"), F.lit(True).alias("markup"), F.when(declared != "", declared).alias("declared"), _host(F.col("url").cast("string")).alias("host"))


def _log(share: Column) -> Column:
    return F.log(F.greatest(share, F.lit(1e-9)))


LEVELS = ("host", "domain", "generic")


def _counted(rows: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """host, size, and counts of each language by host, domain and generic suffix (host_0, ...), one row a host; and those of all rows."""
    hosts = cut(rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("size"), *[F.sum(f"v_{k}").alias(f"host_{k}") for k in range(n)]))
    # Counts by host come first: all levels above are sums over hosts, not over rows.
    number, *totals = hosts.agg(F.count(F.lit(1)), *[F.sum(f"host_{k}") for k in range(n)]).first()
    out = hosts
    for level in LEVELS[1:]:
        above = hosts.groupBy(level).agg(F.count(F.lit(1)).alias("hosts"), *[F.sum(f"host_{k}").alias(f"{level}_{k}") for k in range(n)])
        out = join_sliced(out, above, level, "hosts", F.col("host"), number).drop("hosts")
    return cut(out.drop(*LEVELS[1:])), [x or 0.0 for x in totals]


def _priors(totals: list[float]) -> list[Column]:
    """Prior of each language for a row with the counts of _counted, its own verdict (v_0, ...) left out at each level."""
    n = len(totals)
    prior = [(F.greatest(F.lit(x) - F.col(f"v_{k}"), F.lit(0.0)) + 1) / F.lit(max(sum(totals) - 1, 0.0) + n) for k, x in enumerate(totals)]
    for level in reversed(LEVELS):
        others = [F.greatest(F.col(f"{level}_{k}") - F.col(f"v_{k}"), F.lit(0.0)) for k in range(n)]
        seen = sum(others[1:], others[0])
        prior = [(x + SMOOTH * p) / (seen + SMOOTH) for x, p in zip(others, prior, strict=True)]
    return prior


def _reliability(rows: DataFrame, evidence: str, languages: list[str]) -> DataFrame:
    """evidence -> log P(evidence | language), smoothed towards its share of all rows."""
    sums = cut(rows.where(F.col(evidence).isNotNull()).groupBy(evidence).agg(*[F.sum(f"v_{k}").alias(f"n_{k}") for k in range(len(languages))]))
    totals = sums.agg(*[F.sum(f"n_{k}") for k in range(len(languages))]).first()
    totals = [x or 0.0 for x in totals]
    n = sum((F.col(f"n_{k}") for k in range(len(languages))), F.lit(0.0))
    share = (n + 1) / F.lit(sum(totals) + 1)
    return sums.select(evidence, *[_log((F.col(f"n_{k}") + SMOOTH * share) / F.lit(totals[k] + SMOOTH)).alias(f"{evidence}_{k}") for k in range(len(languages))])


def identify(rows: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``rows``: doc_id, page_id, lang, confidence, text_lang, declared.

    ``rows``: see document_rows and page_rows. ``labelled`` (doc_id, lang, text) teaches the
    text models: at most ``sample`` rows of each language, those with the smallest hash of
    the id; rows without a language teach nothing. Null and empty texts, and texts without a
    letter, leave the decision to the other evidence, and in the end to the prior of all
    rows. Ties go to the language that comes first in the alphabet. A null host or source is
    a host of its own. A very long text is read as a whole. Repeated rows get one answer each. Without labelled rows, or for an
    empty table, the languages are null or the result is empty. Other columns are ignored.
    """
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return rows.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared")
    # The threshold on the hash that lets through about ``sample`` rows of each language.
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    bound = F.lit(None).cast("long")
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / n) * (1 << 31)))).otherwise(bound)
    profiles = fit_profiles(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < bound), languages)
    sent = rows.sparkSession.sparkContext.broadcast(profiles)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [likelihoods(sent.value, t.as_py(), m) for t, m in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(5), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "page_id", "declared", "host", "ll"])

    read_rows = rows.select("doc_id", "page_id", "content", "markup", "declared", "host").mapInArrow(read, "doc_id long, page_id long, declared string, host string, ll array<double>")
    n = len(languages)
    suffix = F.substring_index("host", ".", -1)
    country = F.when(suffix.rlike("^[a-z]{2}$") & F.contains("host", F.lit(".")), suffix)
    read_rows = read_rows.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("country", country)
    read_rows = read_rows.withColumn("generic", F.when(F.col("country").isNull(), suffix).otherwise(F.lit("")))
    weights = [F.exp(F.get("ll", F.lit(k))) for k in range(n)]
    whole = sum(weights[1:], weights[0])
    marked = cut(read_rows.select("*", *[(w / whole).alias(f"v_{k}") for k, w in enumerate(weights)]))
    counted, totals = _counted(marked, n)
    # One host can have a large share of the rows: they are dealt out in slices.
    joined = join_sliced(marked.drop("domain", "generic"), counted, "host", "size", F.xxhash64("doc_id", "page_id"), round(sum(totals)))
    joined = joined.select("doc_id", "page_id", "declared", "country", "ll", *[p.alias(f"p_{k}") for k, p in enumerate(_priors(totals))])
    # Declared languages have two or three letters and country suffixes two: both tables are bounded.
    for evidence in ("declared", "country"):
        joined = joined.join(F.broadcast(_reliability(marked, evidence, languages)), evidence, "left")
    logs = [F.get("ll", F.lit(k)) + _log(F.col(f"p_{k}")) + F.coalesce(F.col(f"declared_{k}"), F.lit(0.0)) + F.coalesce(F.col(f"country_{k}"), F.lit(0.0)) for k in range(n)]
    names = F.array(*[F.lit(x) for x in languages])
    joined = joined.select("doc_id", "page_id", "declared", "ll", F.array(*logs).alias("logs"))
    top = F.array_max("logs")
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return joined.select("doc_id", "page_id", best(F.col("logs")).alias("lang"), confidence.alias("confidence"), best(F.col("ll")).alias("text_lang"), "declared")
