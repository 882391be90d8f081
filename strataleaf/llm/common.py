"""Expressions and helpers that several operators share."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ASCII white space [\x20\x09-\x0D], as a Java regex class body and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII, the common case, takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where every task can see it."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strataleaf-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a checkpoint that a task reads at least, where it is gathered; that it writes, by a bound on them; and of a row of a few numbers.
PIECE, WRITTEN, ROW = 4 << 20, 1 << 20, 24


def cut_gathered(df: DataFrame, most: int | None = None) -> DataFrame:
    """cut, then read in fewer partitions where they hold less than PIECE, by the bytes written.

    A task leaves files and a log entry behind however little it reads, and for each file on a
    local disk an executor starts a process that counts as large as itself until it has begun.
    ``most``: bytes that df can have, from the rows known so far; where its partitions would
    hold less than WRITTEN, fewer write them. All rows are read, a large table keeps its
    partitions, and there are as many as cores at least.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if most is not None:
        writers = max(cores, math.ceil(most / WRITTEN))
        if 2 * writers <= int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(writers)
    df = cut(df)
    rdd = df._jdf.queryExecution().logical().rdd()
    path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    pieces = max(cores, math.ceil(size / PIECE))
    return df.coalesce(pieces) if 2 * pieces <= rdd.getNumPartitions() else df


def release(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles and checkpoints that nothing refers to: it notices when the driver's JVM collects its garbage."""
    spark._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys up to which a table of them is broadcast once it was counted: 2 MB of ids.
FEW_KEYS = 1 << 18


def few(keys: DataFrame) -> DataFrame:
    """keys, counted, and marked for a broadcast if there are FEW_KEYS at most."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def of_keys(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows whose key is (left_semi) or is not (left_anti) one of keys; where keys are few, the rows do not move."""
    return rows.join(few(keys.select(key).distinct()), key, how)


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """rows joined with table, which has one row a key. The few keys of table that are ``hot`` are broadcast.

    The caller sees to it that a bounded number of keys can be hot, so that no key with a
    large share of rows meets in one task.
    """
    few = F.broadcast(table.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(few, keys).unionByName(rest)


def attach(rows: DataFrame, table: DataFrame, key: str, value: str, hot: Column, spread: Column) -> DataFrame:
    """rows with ``value`` of table (one row a key), null where the key is missing; rows move once, and not for hot keys.

    Rows of a ``hot`` key (a bounded number, see join_skewed) get its value by broadcast and
    are then dealt out by ``spread``, a column of strings, instead of the key.
    """
    few = F.broadcast(table.where(hot).select(key, F.col(value).alias("_few")))
    rest = table.where(~hot).select(F.col(key).alias("_key"), F.col(value).alias("_rest"))
    known = rows.join(few, key, "left")
    dealt = F.when(F.col("_few").isNull(), F.col(key)).otherwise(F.concat(F.lit("\u0000"), spread))
    out = known.withColumn("_dealt", dealt).join(rest, F.col("_dealt") == F.col("_key"), "left")
    return out.select(*rows.columns, F.coalesce("_few", "_rest").alias(value))


#: A key is hot from 1/HOT_KEYS of the rows on, but not below HOT_MIN of them; its rows are dealt out in SLICES.
HOT_KEYS, HOT_MIN, SLICES = 1024, 256, 32


def join_sliced(rows: DataFrame, table: DataFrame, key: str, size: str, spread: Column, total: int | None = None) -> DataFrame:
    """rows joined with table, which has one row a key and the key's number of rows in ``size``.

    Rows of a hot key (HOT_KEYS at most) are dealt out by ``spread``, and the key's row of
    table comes once for every slice. Only hot keys themselves are broadcast.
    """
    total = total if total is not None else table.agg(F.sum(size)).first()[0] or 0
    least = max(HOT_MIN, math.ceil(total / HOT_KEYS))
    zero = F.lit(0).cast("long")
    hot = F.broadcast(table.where(F.col(size) >= least).select(key, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, key, "left").withColumn("_slice", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SLICES))).otherwise(zero)).drop("_hot")
    every = F.when(F.col(size) >= least, F.sequence(zero, F.lit(SLICES - 1).cast("long"))).otherwise(F.array(zero))
    return dealt.join(table.withColumn("_slice", F.explode(every)), [key, "_slice"]).drop("_slice")
