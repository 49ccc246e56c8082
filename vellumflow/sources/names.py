"""Name records written by hand as YAML."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name_id long, name_string string, mentions int, time_period string, source_filenames array<string>, context_notes array<string>"


def load_name_records(spark: SparkSession, path: str | Path) -> DataFrame:
    """A YAML list of records (id, name_string, and optionally mentions, time_period, source_filenames, context_notes) as rows.

    Records without an id are numbered by their place; one without a name is an error; an empty file has no rows.
    """
    import yaml

    payload = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    records = payload.get("records", []) if isinstance(payload, dict) else payload
    rows = []
    for place, r in enumerate(records, 1):
        if not isinstance(r, dict) or not isinstance(r.get("name_string"), str):
            raise ValueError(f"record {place} has no name_string")
        rows.append((int(r.get("id", place)), r["name_string"], int(r.get("mentions", 1)), r.get("time_period"), list(r.get("source_filenames") or []), list(r.get("context_notes") or [])))
    return spark.createDataFrame(rows, SCHEMA)
