"""Numbering of rows in a total order, and picks of the first row of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.plans.tables import cut_lineage


def number_rows(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a number from 1 in the given total order, without bringing all rows into one task.

    Rows are range-partitioned by the order and numbered within their range; the sizes of the ranges, of which there are no
    more than partitions, give each its offset. Ranges are written out first, so that both passes see the same ones.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_range int, _offset long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(table), "_range").withColumn(name, within + F.col("_offset")).drop("_range", "_offset")


def number_within(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Numbers from 1 within each group, groups of any size: numbered in one total order, less what lies before the group."""
    numbered = number_rows(df, [F.col(group), *order], "_no")
    first = numbered.groupBy(group).agg(F.min("_no").alias("_from"))
    return numbered.join(first, group).withColumn(name, F.col("_no") - F.col("_from") + 1).drop("_no", "_from")


def preferred_path(paths: DataFrame, key: str, path: str) -> DataFrame:
    """One path a key: the shortest, of equally short ones the first."""
    return paths.where(F.col(key).isNotNull() & F.col(path).isNotNull()).groupBy(key).agg(F.min_by(path, F.struct(F.length(path), F.col(path))).alias(path))


def copy_names(paths: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path, href): where a report's copy of each file lies. Files of one name are told apart by the beginning of their
    key; the first of them, in order of path, keeps its name."""
    named = paths.select(key, path, F.regexp_extract(path, "[^/]*$", 0).alias("_name"))
    first = named.groupBy("_name").agg(F.min(F.struct(path, key)).alias("_first"))
    plain = F.col(path).eqNullSafe(F.col("_first")[path]) & F.col(key).eqNullSafe(F.col("_first")[key])
    return named.join(first, "_name").select(key, path, F.concat(F.lit("pdfs/"), F.when(plain, F.col("_name")).otherwise(F.concat(F.substring(key, 1, 12), F.lit("-"), "_name"))).alias("href"))


def unique_names(names: Sequence[str]) -> list[str]:
    """Each name as it is, or with _1, _2, ... before its suffix until no earlier one has it. An ordered fold: it runs on the
    driver over the files one report copies."""
    used: set[str] = set()
    last: dict[str, int] = {}
    out = []
    for name in names:
        stem, dot, suffix = name.rpartition(".")
        if not dot or not stem:
            stem, suffix = name, ""
        k = last.get(name, 0)
        got = f"{stem}_{k}{dot if stem != name else ''}{suffix}" if k else name
        while got in used:
            k += 1
            got = f"{stem}_{k}{dot if stem != name else ''}{suffix}"
        used.add(got)
        last[name] = k
        out.append(got)
    return out
