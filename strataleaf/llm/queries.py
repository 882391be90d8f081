"""Registered queries of the operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.llm import exact_dedup, html_extract, language_id, line_dedup, mixing, packing, quality, simhash, toxicity, url_filter
from strataleaf.llm.common import UPPER, load

TOKENIZER = "byte_bpe_50k"


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path(f"{TOKENIZER}.json"), "ranks": public_tokenizers.path(f"{TOKENIZER}.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together: doc_id is null in rows of pages, page_id in rows of documents."""
    docs = load(spark, sf_dir, "documents")
    rows = language_id.document_rows(docs).unionByName(language_id.page_rows(load(spark, sf_dir, "pages")))
    return language_id.identify(rows, docs).withColumn("confidence", F.round("confidence", 6))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 4).alias("p_good"))


URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(load(spark, sf_dir, "pages"), url_filter.parse_rules(URL_RULES)).withColumn("purity", F.round("purity", 6))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"), keep="max")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), **tokenizer_files())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(load(spark, sf_dir, "documents"), width=4, radius=4)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_html_extract": op10_html_extract,
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_WS}), '{UPPER}', '{UPPER.lower()}')"


def _mixing_sql(sweeps: int = mixing.SWEEPS, share: float = 0.9) -> str:
    """The fit unrolled, sweep by sweep; the level of the default targets from sums over values in the order in which they reach their bound."""
    steps, now = [], "m0"
    for k in range(sweeps):
        for d in mixing.DIMENSIONS:
            new = f"m{k}_{d}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, CASE WHEN sum(mass) OVER (PARTITION BY {d}) > 0 THEN least(tokens::DOUBLE, mass * t_{d} / sum(mass) OVER (PARTITION BY {d})) ELSE 0 END AS mass FROM {now})")
            now = new
    targets = []
    for d in mixing.DIMENSIONS:
        # Values whose bound is low for their power saturate first; the others share what is left by their powers.
        targets.append(
            f"""r_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS held, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {mixing.POWERS[d]}::DOUBLE) ELSE 0 END AS p FROM cells GROUP BY 1),
b_{d} AS (SELECT *, held / ((SELECT sum(held) FROM r_{d}) * {share}::DOUBLE) AS bound FROM r_{d} WHERE held > 0),
o_{d} AS (SELECT *, coalesce(sum(bound) OVER before, 0) AS full_share, (SELECT sum(p) FROM b_{d}) - coalesce(sum(p) OVER before, 0) AS rest FROM b_{d} WINDOW before AS (ORDER BY bound / p, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l_{d} AS (SELECT min_by((1 - full_share) / rest, full_share) AS level FROM o_{d} WHERE (1 - full_share) / rest <= bound / p + 1e-15),
q_{d} AS (SELECT {d}, least(p * (SELECT level FROM l_{d}), bound) * (SELECT sum(held) FROM r_{d}) * {share}::DOUBLE AS t_{d} FROM b_{d})"""
        )
    tables = ", ".join(targets)
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM documents),
docs AS (SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
  CASE WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact'
       WHEN len(regexp_extract_all(text, '[{{}}<>;=|]')) * 50 > greatest(length(text), 1) THEN 'code'
       WHEN len(regexp_extract_all(text, '[0-9]')) * 50 > greatest(length(text), 1) THEN 'figures'
       WHEN greatest(length(text), 1)::DOUBLE / (length(text) - length(replace(text, chr(10), '')) + 1) < 80 THEN 'list' ELSE 'prose' END AS topic FROM base),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
{tables},
m0 AS (SELECT source, lang, topic, tokens, coalesce(t_source, 0) AS t_source, coalesce(t_lang, 0) AS t_lang, coalesce(t_topic, 0) AS t_topic, tokens * {share}::DOUBLE AS mass FROM cells LEFT JOIN q_source USING (source) LEFT JOIN q_lang USING (lang) LEFT JOIN q_topic USING (topic)),
{", ".join(steps)},
w AS (SELECT source, lang, topic, CASE WHEN tokens = 0 THEN 1.0::DOUBLE ELSE mass / tokens END AS probability FROM {now})
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < probability AS kept
FROM docs JOIN w USING (source, lang, topic)"""


def _quality_sql(rounds: int = quality.ROUNDS) -> str:
    """Metrics by unnesting words and windows; expectation-maximisation as a recursion over (class, rule) rows."""
    ws = r"[\x20\x09-\x0D]"
    rules = list(quality.RULES)
    members = list(quality.FAMILIES.values())
    start = []
    for z in range(len(members) + 1):
        share = quality.START_GOOD if z == 0 else (1 - quality.START_GOOD) / len(members)
        start += [f"({z}, {j}, {share!r}::DOUBLE, {(1 - quality.CALM if z and k in members[z - 1] else quality.CALM)!r}::DOUBLE)" for j, k in enumerate(rules)]
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))::BIGINT"
    among = lambda pattern: f"len(list_filter(words, lambda x: regexp_full_match(x, '{pattern}', 's')))::BIGINT"
    return f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda x: x <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS}) <> '') AS lines FROM documents),
windows AS (SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row_no, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY row_no),
metrics AS (SELECT row_no, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {count("[#*$%&|<>]")} AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_distinct(words))::BIGINT AS n_distinct_words,
  len(regexp_extract_all(array_to_string(words, ''), '\\p{{L}}'))::BIGINT AS n_letters, {count(chr(92) + "p{Lu}")} AS n_upper, {count("[!?]")} AS n_shouts,
  {among(".*[.!?]")} AS n_stops, {among("[^" + chr(92) + "p{L}]+")} AS n_no_letter, {among(chr(92) + "p{L}" + chr(92) + "p{Ll}*[,.;:!?]?")} AS n_plain
  FROM base LEFT JOIN covered USING (row_no)),
voted AS MATERIALIZED (SELECT *, {", ".join(f"{quality.vote_sql(k)} AS vote_{k}" for k in rules)} FROM metrics),
patterns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {", ".join(f"vote_{k}" for k in rules)}) AS id, * FROM (SELECT {", ".join(f"vote_{k}" for k in rules)}, count(*) AS n FROM voted GROUP BY ALL)),
votes AS MATERIALIZED (SELECT id, n, j, v FROM (SELECT id, n, unnest([{", ".join(f"{{'j': {j}, 'v': vote_{k}}}" for j, k in enumerate(rules))}], recursive := true) FROM patterns)),
start AS MATERIALIZED (SELECT * FROM (VALUES {", ".join(start)}) AS t(z, j, share, rate)),
model AS (
  SELECT 0 AS round, z, j, share, rate FROM start
  UNION ALL
  SELECT now.round + 1, s.z, s.j, ({quality.PRIOR_DOCS!r}::DOUBLE * s.share + held.h) / ({quality.PRIOR_DOCS!r}::DOUBLE + held.docs), ({quality.PRIOR_VOTES!r}::DOUBLE * s.rate + held.bad) / ({quality.PRIOR_VOTES!r}::DOUBLE + held.cast_votes)
  FROM start s JOIN (SELECT DISTINCT round FROM model) now ON now.round < {rounds}
  JOIN (
    SELECT z, j, sum(n * p) AS h, (SELECT sum(n)::DOUBLE FROM patterns) AS docs, sum(CASE WHEN v < 0 THEN n * p ELSE 0 END) AS bad, sum(CASE WHEN v <> 0 THEN n * p ELSE 0 END) AS cast_votes
    FROM votes JOIN (
      SELECT id, z, exp(l - max(l) OVER (PARTITION BY id)) / sum(exp(l - top)) OVER (PARTITION BY id) AS p FROM (
        SELECT *, max(l) OVER (PARTITION BY id) AS top FROM (
          SELECT id, z, ln(max(share)) + sum(CASE WHEN v < 0 THEN ln(rate) WHEN v > 0 THEN ln(1 - rate) ELSE 0 END) AS l FROM votes JOIN model USING (j) GROUP BY id, z))) USING (id) GROUP BY z, j
  ) held ON held.z = s.z AND held.j = s.j),
last AS MATERIALIZED (SELECT * FROM model WHERE round = {rounds}),
logs AS (SELECT id, z, ln(max(share)) + sum(CASE WHEN v < 0 THEN ln(rate) WHEN v > 0 THEN ln(1 - rate) ELSE 0 END) AS l FROM votes JOIN last USING (j) GROUP BY id, z),
odds AS (SELECT id, 1 / sum(exp(least(l - good, 700))) AS p_good FROM logs JOIN (SELECT id, l AS good FROM logs WHERE z = 0) USING (id) GROUP BY id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 4) AS p_good
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM voted) JOIN patterns USING ({", ".join(f"vote_{k}" for k in rules)}) JOIN odds USING (id)"""


ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_at FROM docs),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.holder IS NOT NULL AND r.holder <> k.doc_id AS lost FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_at) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_mixing": _mixing_sql(),
    "op5_quality": _quality_sql(),
    "op7_exact_dedup": f"""
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM docs""",
}
