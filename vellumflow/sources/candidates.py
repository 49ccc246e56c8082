"""Files prepared for upload: as they are, cut, or made smaller, each with its hash; one task a document."""

from __future__ import annotations

import hashlib
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from vellumflow.operators.ranges import LIMIT, STRATEGIES

SCHEMA = "document_sha256 string, candidate_sha256 string, compression_method string, local_path string, start_page int, end_page int, size_bytes long, error string"


def prepare(source: Path, sha: str, folder: Path, strategy: str, limit: int, tools: dict[str, str]) -> list[tuple]:
    """Rows of SCHEMA for one file. A file within the limit is its own candidate; else 'none' prepares nothing, 'chunk' and
    'auto' cut it, 'qpdf' and 'ebook' run ``tools[strategy] IN OUT`` and take the result if it is within the limit."""
    from vellumflow.sources.pdf import split_file

    content = source.read_bytes()
    digest = lambda data: hashlib.sha256(data).hexdigest()
    if len(content) <= limit:
        return [(sha, digest(content), "original", str(source), None, None, len(content), None)]
    if strategy == "none":
        raise ValueError(f"{len(content)} bytes are above the limit")
    folder.mkdir(parents=True, exist_ok=True)
    rows = []
    if strategy in ("chunk", "auto"):
        for chunk, first, last, part in split_file(content, limit):
            target = folder / f"{sha}_{chunk}.pdf"
            target.write_bytes(part)
            rows.append((sha, digest(part), "chunk", str(target), first, last, len(part), None))
        return rows
    tool = shutil.which(tools.get(strategy, strategy))
    if not tool:
        raise ValueError(f"no tool for {strategy}")
    target = folder / f"{sha}_{strategy}.pdf"
    subprocess.run([tool, str(source), str(target)], check=True, capture_output=True)
    part = target.read_bytes()
    if len(part) > limit:
        raise ValueError(f"{strategy} left {len(part)} bytes")
    return [(sha, digest(part), strategy, str(target), None, None, len(part), None)]


def prepare_candidates(files: DataFrame, folder: str, strategy: str = "auto", limit: int = LIMIT, tools: dict[str, str] | None = None) -> DataFrame:
    """Candidates of files (sha256, absolute_path), written to a folder all tasks share; whatever stops a file is its error row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    known = dict(tools or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples(index=False):
                try:
                    rows += prepare(Path(r.absolute_path), r.sha256, Path(folder), strategy, limit, known)
                except Exception as e:  # one file's failure is a row, not the run's end
                    rows.append((r.sha256, None, None, None, None, None, None, str(e)))
            columns = [f.split(" ")[0] for f in SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=columns).astype({"start_page": "Int32", "end_page": "Int32", "size_bytes": "Int64"})

    return files.select("sha256", "absolute_path").mapInPandas(run, SCHEMA)
