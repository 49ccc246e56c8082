"""The upload cache: what has been sent to a remote extractor already, what still has to be, and the ledger of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.operators.state import upsert

#: Hours a remote copy lives.
LIFETIME_HOURS = 47


def to_upload(candidates: DataFrame, uploads: DataFrame, now: str) -> DataFrame:
    """Candidates without a live remote copy: never sent, or expired by ``now``. One row a candidate_sha256."""
    live = uploads.where("remote_name is not null").where(F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") > F.lit(now).cast("timestamp")))
    return candidates.dropDuplicates(["candidate_sha256"]).join(live.select("candidate_sha256"), "candidate_sha256", "left_anti")


def stamp(at: Column) -> Column:
    """A moment in UTC as text, with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def expiry(at: Column) -> Column:
    """When a copy sent at that moment ends."""
    return at + F.make_dt_interval(hours=F.lit(LIFETIME_HOURS))


def record_uploads(uploads: DataFrame, sent: DataFrame, now: str) -> DataFrame:
    """The cache after ``sent`` (candidate_sha256, ..., remote_name): stamped now, expiring LIFETIME_HOURS later.

    A row sent again is overwritten, but stamps it doesn't bring are kept.
    """
    at = F.lit(now).cast("timestamp")
    arrived = F.col("remote_name").isNotNull()
    fresh = sent.withColumns({"uploaded_at": F.when(arrived, stamp(at)), "validated_at": F.when(arrived, stamp(at)), "expires_at": F.when(arrived, stamp(expiry(at)))})
    return upsert(uploads, fresh, ["candidate_sha256"], ["uploaded_at"], coalesce=["uploaded_at", "validated_at", "expires_at"])


def call_log(results: DataFrame, run_id: int | None, call_type: str, now: str) -> DataFrame:
    """Ledger rows of calls (document_sha256, error_text, duration_ms, and what else they bring): succeeded where there is no
    error. Without ``run_id`` the rows bring their own."""
    status = F.when(F.col("error_text").isNull(), "succeeded").otherwise("failed")
    run = F.col("run_id") if run_id is None else F.lit(run_id)
    more = [c for c in ("prompt_tokens", "candidate_tokens", "total_cost_usd") if c in results.columns]
    return results.select(run.cast("long").alias("run_id"), F.lit(call_type).alias("call_type"), "document_sha256", status.alias("status"), "error_text", F.col("duration_ms").cast("double"), F.lit(now).alias("created_at"), *more)


def uploads_by_run(log: DataFrame) -> DataFrame:
    """(run_id, uploads): successful uploads of each run; cached copies that were only looked at again are not in the ledger."""
    return log.where((F.col("call_type") == "upload") & (F.col("status") == "succeeded")).groupBy("run_id").agg(F.count(F.lit(1)).alias("uploads"))


def uploads_of_run(log: DataFrame, run_id: int) -> DataFrame:
    """One row: successful uploads of a run."""
    return uploads_by_run(log.where(F.col("run_id") == run_id)).agg(F.coalesce(F.sum("uploads"), F.lit(0)).alias("uploads"))


def analysed_size(candidates: DataFrame) -> DataFrame:
    """(document_sha256, analysed_bytes, method): candidate sizes summed; several candidates are a 'chunk'."""
    return candidates.groupBy("document_sha256").agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("analysed_bytes"), F.when(F.count(F.lit(1)) > 1, "chunk").otherwise(F.max("compression_method")).alias("method")
    )
