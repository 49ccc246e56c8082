"""Queries of the general data-preparation operators (dates and page coverage) over the archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumflow.operators.intervals import page_coverage
from vellumflow.operators.moments import normalise_moments, resolved_moments
from vellumflow.plans.tables import read_table


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every date entry that fixes a moment, as one UTC instant."""
    return resolved_moments(*_dated(spark, directory))


def p5_moments(spark: SparkSession, directory: str) -> DataFrame:
    """Every date entry with the reading taken, or the reason why it is no moment."""
    return normalise_moments(*_dated(spark, directory))


def _dated(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        read_table(spark, directory, "analysis_evidence", ["evidence_id", "analysis_id", "dates"]),
        read_table(spark, directory, "document_analyses", ["analysis_id", "site_code", "dates"]),
        read_table(spark, directory, "archive_sites", ["site_code", "tz_name", "date_order"]),
    )


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Continuous covered page periods of each analysis and the gaps between them."""
    return page_coverage(read_table(spark, directory, "analysis_evidence", ["analysis_id", "page_number", "page_start", "page_end"]))


QUERIES = {"p5_found": p5_found, "p5_moments": p5_moments, "p6_found": p6_found}

ORACLES = {
    "p6_found": """
WITH rows AS (
  SELECT analysis_id, CAST(coalesce(page_start, page_number) AS BIGINT) AS lo, CAST(page_end AS BIGINT) AS hi
  FROM analysis_evidence WHERE analysis_id IS NOT NULL AND coalesce(page_start, page_number) >= 1
), spans AS (SELECT analysis_id, lo, greatest(lo, coalesce(hi, lo)) AS hi FROM rows),
reach AS (
  SELECT *, max(hi) OVER (PARTITION BY analysis_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans
), runs AS (
  SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY analysis_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM reach
), periods AS (SELECT analysis_id, min(lo) AS first_page, max(hi) AS last_page FROM runs GROUP BY analysis_id, run),
gaps AS (
  SELECT analysis_id, last_page + 1 AS first_page, lead(first_page) OVER (PARTITION BY analysis_id ORDER BY first_page) - 1 AS last_page FROM periods
)
SELECT 'period' AS span_kind, analysis_id, first_page, last_page FROM periods
UNION ALL SELECT 'gap', analysis_id, first_page, last_page FROM gaps WHERE last_page IS NOT NULL
""",
}
