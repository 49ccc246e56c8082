from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vellumflow.plans import tables
from vellumflow.plans.tables import cut_lineage, drop_repeats, join_small, spread

ROWS = [(1, "a"), (1, "a"), (2, None), (None, "n"), (None, "n"), (3, "c"), (2, None), (2, None)]
SCHEMA = "k long, v string"
ONCE = [(None, "n"), (1, "a"), (2, None), (3, "c")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_drop_repeats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(drop_repeats(df, ["k"])) == ONCE
    assert rows(drop_repeats(df, ["k", "v"])) == ONCE
    assert rows(drop_repeats(df.limit(0), ["k"])) == []
    named = df.withColumnRenamed("k", "_n").withColumnRenamed("v", "a b.c")
    assert rows(drop_repeats(named, ["_n"])) == ONCE and drop_repeats(named, ["a b.c"]).count() == 4


def test_drop_repeats_with_a_full_filter(spark, monkeypatch):
    """Every row meets a set bit: all are shuffled and none is lost."""
    monkeypatch.setattr(tables, "FILTER_BITS", 1)
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(drop_repeats(df, ["k"])) == ONCE


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf={}))
    with pytest.raises(RuntimeError):
        cut_lineage(df)


def test_join_small_both_ways(spark):
    left, right = spark.createDataFrame([(1, "x"), (4, "y")], SCHEMA), spark.createDataFrame([(1, 10), (2, 20)], "k long, w long")
    want = [(1, "x", 10), (4, "y", None)]
    assert rows(join_small(left, right, ["k"])) == want == rows(join_small(left, right, ["k"], broadcast_rows=1))


def test_lineage_and_spread(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    cut = cut_lineage(df)
    assert cut.count() == 100 and "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert rows(spread(df.coalesce(1))) == rows(df)
