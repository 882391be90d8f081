"""Quality rules under weak supervision (built-in functions only).

Rules look at a document's base metrics and vote good (1), bad (-1) or abstain (0). The
number of documents with each combination of votes is a sufficient statistic, so
expectation-maximisation runs over at most 3^rules counted combinations (a fixed bound)
and not over documents. The model's latent classes are good documents and a few ways of
being bad; in each, every rule has a rate of bad votes among the votes that it casts, and an
abstention says nothing. All rates and shares are estimated. A document is kept if its
posterior probability of being good is at least 0.5: one rule that fires by accident is
outvoted by those that approve, rules that fire together are not.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import WS_CHARS, WS_CLASS, cut

#: The rules that see a way of being bad; each is a class of bad documents beside the good ones.
FAMILIES = {
    "tables": ("symbols", "letterless", "plain_words"),
    "noise": ("symbols", "letters", "plain_words"),
    "shouts": ("capitals", "shouting", "stops", "letters", "plain_words"),
    "repeats": ("repeated_words", "vocabulary", "stops", "repeated_lines"),
}
#: Share of good documents that the fit starts from, and the rate of bad votes about documents that a rule
#: does not see to be bad; about the others it is one minus that. The start only says which class is which:
#: it counts as PRIOR_DOCS documents, and each rate as PRIOR_VOTES votes, at any size of the corpus.
START_GOOD, CALM = 0.8, 0.2
PRIOR_DOCS, PRIOR_VOTES = 10.0, 2.0
ROUNDS = 60
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words from which on a rate says something; below, rules on rates abstain.
ENOUGH = 20


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what else the rules need.

    ``carry``: columns of docs that the result holds too, prefixed ``in_``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ws = F.lit(WS_CHARS)
    none = F.array().cast("array<string>")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"in_{c}") for c in carry])
    base = base.withColumn("_trimmed", F.btrim("text", ws))
    base = base.withColumn("_words", F.when(F.col("_trimmed") == "", none).otherwise(F.split("_trimmed", f"[{WS_CLASS}]+")))
    base = base.withColumn("n_words", F.size("_words").cast("long"))
    base = base.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, ws) != ""))
    # Hashes tell whether any 3-word window can occur twice; only then places are sorted by them. A
    # number holds 33 bits of the hash and 31 of the place, so that equal windows become neighbours.
    word = lambda i: F.get("_words", i)
    hashed = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    base = base.withColumn("_hashed", F.when(F.size("_words") >= 3, hashed).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("_again", F.size(F.array_distinct("_hashed")) < F.size("_hashed"))
    base = base.withColumn("_packed", F.when(F.col("_again"), F.sort_array(F.transform("_hashed", lambda h, i: F.shiftleft(h, 31).bitwiseOR(i.cast("long"))))))
    high = lambda x: F.shiftright(x, 31)
    beside = lambda x, k: F.coalesce(high(x) == high(F.get("_packed", k)), F.lit(False))
    base = base.withColumn("_maybe", F.filter("_packed", lambda x, k: beside(x, k - 1) | beside(x, k + 1)))
    # What has an equal neighbour is compared by its words.
    place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    named = lambda x, i: F.struct(high(x).alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i"))
    base = base.withColumn("_sorted", F.sort_array(F.transform("_maybe", lambda x: named(x, place(x)))))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    near = lambda x, k: F.coalesce(same(x, F.get("_sorted", k)), F.lit(False))
    twice = F.filter("_sorted", lambda x, k: near(x, k - 1) | near(x, k + 1))
    base = base.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Windows that start at a < b cover min(3, b - a) words of their own before b; the last covers 3.
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["p"])).alias("n"), i.alias("p")),
        lambda acc: acc["n"],
    )
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return base.select(
        "doc_id",
        *[f"in_{c}" for c in carry],
        "n_words",
        (F.length("text") - F.length(F.translate("text", WS_CHARS, ""))).alias("_ws"),
        F.length("text").alias("_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        count(rf"[^\p{{L}}{WS_CLASS}]").alias("_others"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_shouts"),
        count(rf"[.!?](?=[{WS_CLASS}]|\z)").alias("n_stops"),
        count(rf"(?<![^{WS_CLASS}])[^\p{{L}}{WS_CLASS}]+(?![^{WS_CLASS}])").alias("n_no_letter"),
        count(rf"(?<![^{WS_CLASS}])\p{{L}}\p{{Ll}}*+[,.;:!?]?(?![^{WS_CLASS}])").alias("n_plain"),
    ).withColumn("word_chars", (F.col("_chars") - F.col("_ws")).cast("long")).withColumn("n_letters", F.col("word_chars") - F.col("_others")).drop("_chars", "_ws", "_others")


#: Rule -> (quantity, where it votes good, where it votes bad), as SQL over the metrics; x is the quantity.
RULES = {
    "symbols": ("n_symbols / n_words", "x < 0.02", "x > 0.1"),
    "letters": ("n_letters / word_chars", "x > 0.85", "x < 0.75"),
    "letterless": ("n_no_letter / n_words", "x < 0.05", "x > 0.2"),
    "plain_words": ("n_plain / n_words", "x > 0.7", "x < 0.5"),
    "capitals": ("n_upper / n_letters", "x < 0.15", "x > 0.4"),
    "shouting": ("n_shouts / n_words", "x < 0.1", "x > 0.2"),
    "stops": ("n_stops / n_words", "x >= 0.03 AND x <= 0.25", "x < 0.01 OR x > 0.4"),
    "repeated_words": ("n_repeat_words / n_words", "x < 0.1", "x > 0.3"),
    "vocabulary": ("n_distinct_words / sqrt(n_words)", "x > 2.5", "x < 1.2"),
    "repeated_lines": ("n_dup_lines / n_lines", "x < 0.1", "x > 0.3"),
}


def vote_sql(name: str) -> str:
    """The vote of a rule, in SQL that Spark and other engines read alike; a quantity over zero abstains."""
    quantity, good, bad = RULES[name]
    above, _, below = quantity.partition(" / ")
    x = f"({above} * 1e0 / {below})"
    put = lambda condition: condition.replace("x", x)
    return f"CASE WHEN n_words < {ENOUGH} OR {below} = 0 THEN 0 WHEN {put(bad)} THEN -1 WHEN {put(good)} THEN 1 ELSE 0 END"


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[tuple[float, list[float]]]:
    """Share and rates of bad votes of each class (good documents, then FAMILIES), from (votes, documents) pairs.

    ``votes`` are in the order of RULES. Without documents it is the start.
    """
    counts = sorted(counts)
    votes = np.array([v for v, _ in counts], np.int8).reshape(-1, len(RULES))
    n = np.array([k for _, k in counts], float)
    bad, cast = (votes < 0).astype(float), (votes != 0).astype(float)
    begun = np.array([START_GOOD] + [(1 - START_GOOD) / len(FAMILIES)] * len(FAMILIES))
    begun_rates = np.array([[CALM] * len(RULES)] + [[1 - CALM if k in members else CALM for k in RULES] for members in FAMILIES.values()])
    share, rates = begun, begun_rates
    for _ in range(rounds):
        logs = np.log(share) + bad @ np.log(rates).T + (cast - bad) @ np.log(1 - rates).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p *= (n / p.sum(axis=1))[:, None]
        share = (PRIOR_DOCS * begun + p.sum(axis=0)) / (PRIOR_DOCS + n.sum())
        rates = (PRIOR_VOTES * begun_rates + p.T @ bad) / (PRIOR_VOTES + p.T @ cast)
    return [(float(s), [float(r) for r in rs]) for s, rs in zip(share, rates, strict=True)]


def log_terms(model: list[tuple[float, list[float]]]) -> list[tuple[float, list[tuple[float, float]]]]:
    """For each class the logarithm of its share, and what a bad and a good vote of each rule add."""
    return [(math.log(share), [(math.log(r), math.log(1 - r)) for r in rates]) for share, rates in model]


def posterior(model: list[tuple[float, list[float]]], votes: tuple[int, ...]) -> list[float]:
    found = [x + sum(a[0] if v < 0 else a[1] for v, a in zip(votes, adds, strict=True) if v) for x, adds in log_terms(model)]
    top = max(found)
    parts = [math.exp(x - top) for x in found]
    return [x / sum(parts) for x in parts]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the metrics, a vote per rule, base_failed, p_good and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. A
    failed document is not kept whatever the rules say; it counts in the fit like any other.
    A null text has no words; null ids and repeated rows are judged like any other, and
    documents with equal votes get equal answers. A very long text is judged as a whole: its
    words and one number for each of its 3-word windows are in memory while it is. An empty
    table gives an empty result. Other columns are ignored, but for those in ``carry``: each
    comes back, prefixed ``in_``, from the same row.
    """
    rows = metrics(docs, id_col, text_col, carry)
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    names = [f"vote_{k}" for k in RULES]
    rows = cut(rows.select("*", *[F.expr(vote_sql(k)).cast("int").alias(f"vote_{k}") for k in RULES]))
    counts = [(tuple(r[k] for k in names), r["count"]) for r in rows.groupBy(*names).count().collect()]
    logs = []
    for share, adds in log_terms(fit(counts)):
        total = F.lit(share)
        for name, (bad, good) in zip(names, adds, strict=True):
            total = total + F.when(F.col(name) < 0, F.lit(bad)).when(F.col(name) > 0, F.lit(good)).otherwise(F.lit(0.0))
        logs.append(total)
    rows = rows.withColumn("_logs", F.array(*logs))
    p = 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(F.least(x - F.get("_logs", F.lit(0)), F.lit(700.0))))
    return rows.withColumn("p_good", p).drop("_logs").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
