"""Scanning a directory tree of PDF files: listing, pruning by marker files, digests, page counts, incremental state."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.plans.tables import cut_lineage

CHUNK = 1 << 20
LISTING = "absolute_path string, relative_path string, name string"
SCANNED = "absolute_path string, relative_path string, name string, sha256 string, md5 string, size bigint, page_count int, error string"


def list_pdf_paths(root: str | Path, markers: Sequence[str] = ()) -> list[Path]:
    """PDF files under ``root`` in order of path components; a directory holding a marker file is left out with all below it.

    The suffix counts in any case, hidden files and those beginning with an underscore belong to the list, linked
    directories are not followed.
    """
    found: list[Path] = []
    for folder, subfolders, files in os.walk(root):
        if set(markers) & set(files):
            subfolders.clear()
            continue
        found += [Path(folder, f) for f in files if f.lower().endswith(".pdf")]
    return sorted(found)


_ENTRY = "kind string, absolute_path string, relative_path string, name string"


def listing(spark: SparkSession, root: str | Path, markers: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """The same files as a DataFrame (LISTING), unordered. The tree is read level by level, the folders of a level in parallel:
    the driver holds neither folders nor files."""
    marks, partitions = set(markers), partitions or 2 * spark.sparkContext.defaultParallelism

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder, relative in zip(batch["absolute_path"], batch["relative_path"]):
                try:
                    entries = list(os.scandir(folder))
                except OSError:  # a folder that can't be read has nothing to show, as for a walk
                    continue
                if marks & {e.name for e in entries if not e.is_dir()}:
                    continue
                for e in entries:
                    inner = f"{relative}/{e.name}" if relative else e.name
                    if e.is_dir(follow_symlinks=False):
                        rows.append(("folder", e.path, inner, e.name))
                    elif not e.is_dir() and e.name.lower().endswith(".pdf"):
                        rows.append(("file", e.path, inner, e.name))
            yield pd.DataFrame(rows, columns=["kind", "absolute_path", "relative_path", "name"])

    level = spark.createDataFrame([(str(Path(root).absolute()), "")], "absolute_path string, relative_path string")
    found = []
    while True:
        entries = cut_lineage(level.mapInPandas(read, _ENTRY))
        found.append(entries.where("kind = 'file'"))
        folders = entries.where("kind = 'folder'")
        if not folders.limit(1).count():
            return reduce(DataFrame.unionByName, found).select("absolute_path", "relative_path", "name").repartition(partitions)
        level = folders.select("absolute_path", "relative_path").repartition(partitions)


def file_digests(path: str | Path) -> tuple[str, str, int]:
    """SHA-256, MD5 and size of a file, read in pieces."""
    sha, md5, size = hashlib.sha256(), hashlib.md5(usedforsecurity=False), 0
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            sha.update(block)
            md5.update(block)
            size += len(block)
    return sha.hexdigest(), md5.hexdigest(), size


def scan(files: DataFrame) -> DataFrame:
    """``files`` (a :func:`listing`) with digests, size and page count; one row a path. A file that can't be read has its
    error and nulls; one that is no PDF has a null page count."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from vellumflow.sources.pdf import page_count

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    sha, md5, size = file_digests(r.absolute_path)
                    rows.append((r.absolute_path, r.relative_path, r.name, sha, md5, size, page_count(Path(r.absolute_path).read_bytes()), None))
                except OSError as e:
                    rows.append((r.absolute_path, r.relative_path, r.name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["absolute_path", "relative_path", "name", "sha256", "md5", "size", "page_count", "error"]).astype({"size": "Int64", "page_count": "Int32"})

    return files.select("absolute_path", "relative_path", "name").mapInPandas(read, SCANNED)


def update_archive(store, scanned: DataFrame, now: str) -> None:
    """Documents and paths of a scan written into the store: first sights kept, the last path in order names a document."""
    from vellumflow.operators.state import latest_by

    good = scanned.where("error is null")
    stamp = F.lit(now)
    docs = latest_by(good, ["sha256"], [F.split("relative_path", "/").desc()]).select("sha256", F.col("size").alias("file_size_bytes"), "page_count", F.col("name").alias("canonical_filename"), stamp.alias("first_seen_at"), stamp.alias("last_seen_at"))
    paths = good.select("absolute_path", "sha256", "relative_path", F.col("name").alias("original_filename"), stamp.alias("discovered_at"), stamp.alias("last_seen_at"))
    store.upsert("documents", docs, ["sha256"], ["last_seen_at"], keep_first=["first_seen_at"])
    store.upsert("document_paths", paths, ["absolute_path"], ["last_seen_at"], keep_first=["discovered_at"])
