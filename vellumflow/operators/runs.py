"""The ledger of runs: opened, closed with counters and sums, read back as the latest or as a summary; progress and scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators.ordering import number_within
from vellumflow.operators.state import TableStore

COUNTERS = ("scanned_documents", "queued_documents", "analyzed_documents", "succeeded_documents", "failed_documents", "skipped_documents")
SUMS = ("prompt_tokens", "candidate_tokens", "total_tokens", "input_cost_usd", "output_cost_usd", "total_cost_usd")
_OPEN = "run_id long, query_key string, model string, started_at string, completed_at string, upload_count long, report_html_path string, report_xlsx_path string"
SCHEMA = _OPEN + "".join(f", {c} long" for c in COUNTERS) + "".join(f", {c} {'long' if c.endswith('tokens') else 'double'}" for c in SUMS)
LOG = "run_id long, call_type string, document_sha256 string, status string, error_text string, duration_ms double, created_at string, prompt_tokens long, candidate_tokens long, total_tokens long, input_cost_usd double, output_cost_usd double, total_cost_usd double"


def counters(outcomes: DataFrame, by: str = "run_id") -> DataFrame:
    """Counters of each run from one row a queued document (by, status): queued, analyzed, succeeded, failed, and skipped, which
    are those without a status."""
    status = F.col("status")
    return outcomes.groupBy(by).agg(
        F.count(F.lit(1)).alias("queued_documents"), F.count_if(status.isNotNull()).alias("analyzed_documents"), F.count_if(status == "succeeded").alias("succeeded_documents"),
        F.count_if(status.isNotNull() & (status != "succeeded")).alias("failed_documents"), F.count_if(status.isNull()).alias("skipped_documents"),
    )


def ledger_sums(log: DataFrame, by: str = "run_id") -> DataFrame:
    """Tokens and costs of each run's calls, and its new uploads: cached copies that were only looked at again aren't logged."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]
    return log.groupBy(by).agg(*sums, F.count_if((F.col("call_type") == "upload") & (F.col("status") == "succeeded")).alias("upload_count"))


def summary(runs: DataFrame, counted: DataFrame, sums: DataFrame, by: str = "run_id") -> DataFrame:
    """Runs with their own columns, overlaid with counters and sums; 0 where there is nothing."""
    overlaid = [c for c in (*COUNTERS, *SUMS, "upload_count") if c in counted.columns or c in sums.columns]
    rows = runs.drop(*overlaid).join(counted, by, "left").join(sums, by, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in overlaid})


def latest(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """The run of the greatest id: one row, or none."""
    last = runs.agg(F.max_by(F.struct(*runs.columns), by).alias("r"))
    return last.where("r is not null").select("r.*")


def remaining(outcomes: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """``outcomes`` with how many of a run's documents were still to do after each, in the order they were done."""
    total = outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    return number_within(outcomes, by, order, "done").join(total, by).withColumn("remaining", F.col("_total") - F.col("done")).drop("_total")


def scanned_pages(paths: DataFrame, documents: DataFrame) -> DataFrame:
    """(scanned_paths, scanned_pages): pages over paths, a document counting once for each of its paths, unknown counts 0."""
    pages = paths.select("sha256").join(documents.select("sha256", "page_count"), "sha256", "left")
    return pages.agg(F.count(F.lit(1)).alias("scanned_paths"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("scanned_pages"))


class RunLedger:
    """Runs in a store: an opened run keeps zeros and no end if it is never closed."""

    def __init__(self, spark: SparkSession, store: TableStore):
        self.spark, self.store = spark, store

    def _rows(self, table: str, schema: str) -> DataFrame:
        return self.store.read(table, self.spark.createDataFrame([], schema).schema)

    def runs(self) -> DataFrame:
        return self._rows("runs", SCHEMA)

    def log(self) -> DataFrame:
        return self._rows("call_log", LOG)

    def start(self, query_key: str, model: str | None, now: str) -> int:
        last = latest(self.runs()).first()
        run_id = (last["run_id"] if last else 0) + 1
        zeros = {c: 0 if not c.endswith("usd") else 0.0 for c in (*COUNTERS, *SUMS)}
        row = {"run_id": run_id, "query_key": query_key, "model": model, "started_at": now, "upload_count": 0, **zeros}
        self.store.append("runs", self.spark.createDataFrame([row], SCHEMA))
        return run_id

    def finish(self, run_id: int, counted: dict[str, int], reports: dict[str, str], now: str) -> dict[str, object]:
        """Closes a run with its counters and the sums of its calls; the row as it then stands."""
        sums = ledger_sums(self.log().where(F.col("run_id") == run_id)).first()
        new = {"completed_at": now, **reports, **counted, **({c: sums[c] for c in (*SUMS, "upload_count")} if sums else {})}
        known = self.runs().where(F.col("run_id") == run_id).first().asDict() | new
        self.store.upsert("runs", self.spark.createDataFrame([known], SCHEMA), ["run_id"], ["completed_at"])
        return known


SYNTHESIS = "query_key string, status string, answer string, key_findings array<string>, people array<string>, places array<string>, dates array<string>, reasoning_notes string, run_id long, completed_at string"


def upsert_syntheses(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One synthesis a question: a new one overwrites all of the old."""
    from vellumflow.operators.state import latest_by, upsert

    return upsert(existing, latest_by(incoming, [key], [F.col("completed_at").desc()]), [key], ["completed_at"])
