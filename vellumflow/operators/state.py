"""Keyed tables without MERGE: upserts as one aggregation, and a store of versioned, bucketed Parquet directories."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in ``order`` (columns or sort expressions)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], keep_first: Sequence[str] = (), coalesce: Sequence[str] = ()) -> DataFrame:
    """``existing`` with ``incoming`` written over it, one row a key.

    Within ``incoming`` the greatest ``order`` wins; it always wins over ``existing``. ``keep_first`` columns keep the value
    of the row that was there first; ``coalesce`` columns keep an earlier value where the later one is null. Columns only one
    side has are null on the other. One shuffle by key serves both sides.
    """
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("_side", *order)
    columns = [x for x in both.columns if x not in keys and x != "_side"]
    # One aggregate pass: the whole latest row, and the columns that look back.
    picks = [F.max_by(F.struct(*columns), rank).alias("_last")]
    picks += [F.min_by(k, rank).alias(f"_first_{k}") for k in keep_first]
    picks += [F.max_by(k, F.when(F.col(k).isNotNull(), rank)).alias(f"_some_{k}") for k in coalesce]
    merged = both.groupBy(*keys).agg(*picks)
    value = lambda x: F.col(f"_first_{x}") if x in keep_first else F.col(f"_some_{x}") if x in coalesce else F.col(f"_last.{x}")
    return merged.select(*keys, *(value(x).alias(x) for x in columns))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose key it lacks; of several with one key the least ``order`` counts."""
    new = latest_by(incoming, keys, list(order)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str, items: str, ordinal: str = "ordinal") -> DataFrame:
    """Child rows of the parents in ``incoming`` (parent, items array<struct>) replaced by its items, numbered from 1."""
    fresh = incoming.select(parent, F.posexplode(items).alias("_pos", "_item")).select(parent, (F.col("_pos") + 1).alias(ordinal), "_item.*")
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(fresh, allowMissingColumns=True)


def missing_references(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose key no parent has: the integrity check that stands for a foreign key."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


#: Buckets a table's rows are divided into by their key, and versions of a table that are kept.
BUCKETS, KEPT = 16, 4


class TableStore:
    """Tables under one directory of any file system Spark can write to, each a series of versions.

    A version is a manifest: the Parquet directories that make up the table, each of one bucket of keys or of no particular
    one, and the schema. A write adds directories and then a manifest of the next number, so readers see the old table or the
    new one, and a run that dies changes nothing; no file is moved or overwritten. An upsert reads and writes only the buckets
    its keys fall into, an append only what it adds. The last KEPT versions stay readable. One writer at a time a table.
    """

    def __init__(self, spark: SparkSession, root: str | Path, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, str(root), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self, name: str) -> list[str]:
        return [n for n in self._names(f"{self.root}/{name}") if n.startswith("manifest-")]

    def _manifest(self, name: str) -> dict:
        """The newest manifest, an empty one if there is none."""
        found = self._manifests(name)
        if not found:
            return {"entries": [], "schema": None}
        stream = self._fs.open(self._path(f"{self.root}/{name}/{found[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, entries: list[list], schema: StructType) -> None:
        found = self._manifests(name)
        number = int(found[-1].split("-")[1].split(".")[0]) + 1 if found else 1
        stream = self._fs.create(self._path(f"{self.root}/{name}/manifest-{number:012d}.json"), False)
        stream.write(json.dumps({"entries": entries, "schema": schema.json()}).encode())
        stream.close()
        self._expire(name)

    def _expire(self, name: str) -> None:
        """Removes manifests older than the last KEPT, and directories none of those names."""
        found = self._manifests(name)
        old, kept = found[:-KEPT], set()
        if not old:
            return
        for manifest in found[-KEPT:]:
            stream = self._fs.open(self._path(f"{self.root}/{name}/{manifest}"))
            kept |= {path.split("/")[0] for _, path in json.loads(bytes(stream.readAllBytes()).decode())["entries"]}
            stream.close()
        for manifest in old:
            self._fs.delete(self._path(f"{self.root}/{name}/{manifest}"), False)
        for folder in self._names(f"{self.root}/{name}"):
            if folder.startswith("data-") and folder not in kept:
                self._fs.delete(self._path(f"{self.root}/{name}/{folder}"), True)

    def _load(self, name: str, entries: list[list], schema: StructType) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{path}" for _, path in entries))

    def _store(self, name: str, df: DataFrame, keys: Sequence[str] = ()) -> list[list]:
        """Writes rows to a directory of their own, by bucket where keys are given; the entries that name it."""
        folder = f"data-{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(f"{self.root}/{name}/{folder}")
            return [[None, folder]]
        df.withColumn("_bucket", self._bucket(keys)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        return [[int(n.split("=")[1]), f"{folder}/{n}"] for n in self._names(f"{self.root}/{name}/{folder}") if n.startswith("_bucket=")]

    def _bucket(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(self.buckets)).cast("int")

    def exists(self, name: str) -> bool:
        return bool(self._manifests(name))

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """The table, or an empty one of ``schema``; columns the schema has and the version lacks are null."""
        held = self._manifest(name)
        if held["schema"] is None:
            if schema is None:
                raise FileNotFoundError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        df = self._load(name, held["entries"], StructType.fromJson(json.loads(held["schema"])))
        if schema is None:
            return df
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields), *(x for x in df.columns if x not in schema.fieldNames()))

    def write(self, name: str, df: DataFrame) -> None:
        """The whole table anew."""
        self._commit(name, self._store(name, df), df.schema)

    def append(self, name: str, df: DataFrame) -> None:
        """Rows added; the log tables use it."""
        held = self._manifest(name)
        fields = StructType.fromJson(json.loads(held["schema"])).fields if held["schema"] else []
        self._commit(name, held["entries"] + self._store(name, df), StructType(fields + [f for f in df.schema.fields if f.name not in {x.name for x in fields}]))

    def upsert(self, name: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], keep_first: Sequence[str] = (), coalesce: Sequence[str] = (), compete: bool = False) -> None:
        """:func:`upsert` of the buckets ``incoming`` falls into. With ``compete`` rows of the table compete with the new ones by
        ``order``, so that a late arrival doesn't displace a newer row."""
        held = self._manifest(name)
        touched = {r[0] for r in incoming.select(self._bucket(keys)).distinct().collect()}
        affected = [e for e in held["entries"] if e[0] is None or e[0] in touched]
        schema = StructType.fromJson(json.loads(held["schema"])) if held["schema"] else incoming.schema
        existing = self._load(name, affected, schema)
        merged = upsert(existing.limit(0), existing.unionByName(incoming, allowMissingColumns=True), keys, order, keep_first, coalesce) if compete else upsert(existing, incoming, keys, order, keep_first, coalesce)
        self._commit(name, [e for e in held["entries"] if e not in affected] + self._store(name, merged, keys), merged.schema)

    def set_metadata(self, key: str, value: object) -> None:
        row = self.spark.createDataFrame([(key, json.dumps(value, sort_keys=True))], "key string, value string")
        self.upsert("metadata", row, ["key"], ["value"])

    def get_metadata(self, key: str) -> object | None:
        if not self.exists("metadata"):
            return None
        row = self.read("metadata").where(F.col("key") == key).first()
        return json.loads(row["value"]) if row else None
