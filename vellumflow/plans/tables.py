"""Reading tables, removing repeated rows, and cutting lineage through shared storage."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter that tells which rows may be repeats, 64 to a row of what is broadcast: at most 2**20 rows of 16 bytes.
FILTER_BITS = 1 << 26


def read_table(spark: SparkSession, directory: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One Parquet table of ``directory``; ``columns`` keeps the scan narrow."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def drop_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with one row for each different value of ``keys``; rows sharing a key must be equal in the columns kept.

    Wide rows (texts, lists) are not shuffled merely because a few of them arrived twice: the keys alone are counted, those
    that repeat set bits in a filter of FILTER_BITS, and only rows that meet a set bit are shuffled. The filter's size is
    fixed; the more keys repeat, the more rows without repeat meet a set bit by chance and are shuffled too, which costs time
    but changes no row. Nothing is collected. Null keys equal each other.
    """
    names = [f"`{k}`" for k in keys]
    bit = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    repeated = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.floor(bit / 64).cast("int").alias("__word"), (bit % 64).cast("int").alias("__place"))
    words = repeated.groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __place))").alias("__bits"))
    marked = df.withColumn("__word", F.floor(bit / 64).cast("int")).join(F.broadcast(words), "__word", "left").withColumn("__again", F.coalesce(F.getbit("__bits", (bit % 64).cast("int")) == 1, F.lit(False)))
    own = [f"`{c}`" for c in df.columns]
    once = marked.where("not __again").select(*own)
    return once.unionByName(marked.where("__again").select(*own).dropDuplicates(list(keys)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later reads neither recompute it nor depend on an executor.

    The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local master (one machine) gets a temporary
    folder, and a cluster an error: a folder of one machine would be lost with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="vellumflow-checkpoint-"))
    return df.checkpoint(eager=True)


def join_small(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", broadcast_rows: int = 100_000) -> DataFrame:
    """``left`` joined to a table that is expected to be small: sent to every executor only if it has at most
    ``broadcast_rows`` rows (counted first), otherwise joined by an ordinary shuffle."""
    rows = right.limit(broadcast_rows + 1).collect()
    if len(rows) > broadcast_rows:
        return left.join(right, list(on), how)
    return left.join(F.broadcast(left.sparkSession.createDataFrame(rows, right.schema)), list(on), how)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for stages whose work a row is heavy.

    A small file is often one partition; its few rows are then dealt out. Inputs with enough partitions are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
