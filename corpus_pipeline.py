"""From documents to packed sequences in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``, and other columns are dropped, whatever their
names. Decisions are made row by row: rows that share an id, or have none, are documents of
their own, and only equal rows share their fate. Null and empty texts have no words and leave
with the quality rules. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.llm import exact_dedup, mixing, packing, quality
from strataleaf.llm.common import ensure_checkpoint_dir, load, of_keys, remove
from strataleaf.llm.near_copies import near_groups
from strataleaf.llm.queries import tokenizer_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(judged: DataFrame) -> DataFrame:
    """The rows that an operator keeps, in the columns that it carried."""
    return judged.where("kept").select(*[F.col(f"in_{c}").alias(c) for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the weak-supervision model accept."""
    return _kept(quality.judge(docs, carry=COLUMNS))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return _kept(exact_dedup.exact_dedup(docs, keep="max", carry=COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Documents are named by a hash of id and text. The one with the smallest stays; rows with
    equal id and text stay or go together, but the stage before leaves one row of a text.
    """
    named = docs.select(*COLUMNS).withColumn("_name", F.xxhash64("doc_id", "text"))
    groups = near_groups(named, id_col="_name", width=5, least=0.8, radius=6)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_name"))
    return of_keys(named, gone, "_name", "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities of the fitted mixture."""
    return _kept(mixing.mix(docs, carry=COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("simhash near-dedup", near_copies), ("source mix", source_mix), ("packing", packed)]

#: SQL cannot express SimHash or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what lies between them goes through the shared folder.

    A stage's table is removed once its successor's is written; the last one stays, as the
    result reads it.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
