"""Exact deduplication by content sort (built-in functions only).

Rows are dealt out by sampled splitters over (head of the normalised text, hash,
slice) and sorted externally by the whole normalised text inside each partition, so
equal texts lie next to each other; the window operator then compares each text in
full with its neighbour and opens a new run where they differ.

A text with a large share of all rows would make one partition too long. Such texts
are found beforehand by counting hashes (at most HOT_KEYS of them can exist, since each
has at least 1/HOT_KEYS of the rows) and dealt out in slices. One row of each slice's run
then stands for it: these few are compared in full once more, and runs of equal texts merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.common import ascii_lower, cut

#: A text is hot from 1/HOT_KEYS of the rows on, but not below HOT_MIN rows.
HOT_KEYS = 1024
HOT_MIN = 256
#: Characters of the head that order the splitters.
HEAD = 24


def _hot_hashes(rows: DataFrame) -> dict[int, int]:
    """Hash -> rows, for at most HOT_KEYS hashes."""
    least = max(HOT_MIN, math.ceil(rows.count() / HOT_KEYS))
    found = rows.groupBy("_hash").count().where(F.col("count") >= least).collect()
    return {row["_hash"]: math.ceil(row["count"] / least) for row in found}


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise=ascii_lower,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means: the normalised texts are byte for byte the same. Of a group the row with
    the smallest id stays (``keep="max"``: the largest). A null text counts as empty; empty
    texts are one group. A null id ranks behind every other id. Of repeated rows with one
    id, and of a group without ids, exactly one stays. A very long text is sorted as a whole
    and spills to disk like any other. An empty table gives an empty result. Other columns
    are ignored, but for those in ``carry``: each comes back, prefixed ``in_``, from the same row.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    text: Column = F.coalesce("_raw", F.lit(""))
    held = [f"in_{c}" for c in carry]
    others = [F.col(c).alias(f"in_{c}") for c in carry if c != text_col]
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_raw"), *others)
    # Equal normalised texts are equal after lower() too, so its hash brings them together.
    keyed = raw.withColumn("_hash", F.xxhash64(F.lower(text)))
    hot = _hot_hashes(keyed)
    share, is_hot = F.lit(0).cast("long"), F.lit(False)
    if hot:
        is_hot = F.col("_hash").isin(list(hot))
        share = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(max(hot.values())))).otherwise(share)
    head = normalise(F.substring(text, 1, HEAD))
    # Only the text as it is moves; its normal form is made where it is sorted.
    moved = [f"in_{c}" for c in carry if c != text_col]
    dealt = keyed.select("doc_id", head.alias("_head"), "_hash", share.alias("_slice"), "_raw", *moved).repartitionByRange("_head", "_hash", "_slice")
    dealt = dealt.withColumn("_norm", normalise(text)).withColumn("_row", F.monotonically_increasing_id())
    if text_col in carry:
        dealt = dealt.withColumnRenamed("_raw", f"in_{text_col}")
    order = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    run = Window.partitionBy("_head", "_hash", "_slice", "_norm").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        "doc_id",
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(run) == 1).alias("kept"),
        is_hot.alias("_hot"),
        F.first("_row").over(whole).alias("_run"),
        "_norm",
        *held,
    )
    digest = F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")
    if not hot:
        return runs.select("doc_id", "keep_id", "group_size", "kept", digest, *held)
    runs = cut(runs.select("doc_id", "keep_id", "group_size", "kept", digest, *held, "_hot", "_run", F.when(F.col("_hot") & F.col("kept"), F.col("_norm")).alias("_norm")))
    # One row for each run of a hot hash: at most twice HOT_KEYS, as a slice of one holds 1/HOT_KEYS of the rows or is its only one.
    stand = runs.where("_hot AND kept").select("_norm", "_run", "keep_id", "group_size")
    best = F.struct("keep_id", "_run")
    rank = F.max(best) if keep == "max" else F.min(F.struct(F.col("keep_id").isNull(), *[best.getField(k).alias(k) for k in ("keep_id", "_run")]))
    groups = stand.groupBy("_norm").agg(rank.alias("_best"), F.sum("group_size").alias("_size"), F.collect_list("_run").alias("_runs"))
    merged = F.broadcast(groups.select(F.explode("_runs").alias("_run"), F.col("_best.keep_id").alias("_keep"), F.col("_best._run").alias("_first"), "_size"))
    joined = runs.drop("_norm").join(merged, "_run", "left")
    several = F.col("_first").isNotNull()
    return joined.select(
        "doc_id",
        F.when(several, F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("_size", "group_size").alias("group_size"),
        F.when(several, F.col("kept") & (F.col("_run") == F.col("_first"))).otherwise(F.col("kept")).alias("kept"),
        "text_sha256",
        *held,
    )
