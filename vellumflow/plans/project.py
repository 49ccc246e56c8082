"""One project from its configuration to its report: scan, work out what is pending, extract, keep, answer, render."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import dates, text
from vellumflow.operators import entities, ordering, reports, runs, uploads
from vellumflow.operators.state import TableStore, replace_children
from vellumflow.plans.tables import cut_lineage
from vellumflow.sinks import files, html, xlsx
from vellumflow.sources import archive, extract
from vellumflow.sources.config import ProjectConfig


def page_texts(paths: DataFrame) -> DataFrame:
    """(document_sha256, filename, pages): the text operators of every page of the files, read in the tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from vellumflow.sources.pdf import Pdf, PdfError, _content

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                pages: list[str] = []
                try:
                    pdf = Pdf(Path(r.absolute_path).read_bytes())
                    for _, page in pdf.pages() if not pdf.encrypted else ():
                        got = pdf.get(page.get("Contents"))
                        code = b"\n".join(_content(pdf, p) for p in (got if isinstance(got, list) else [page.get("Contents")]))
                        pages.append(_shown(code))
                except (OSError, PdfError):
                    pages = []
                rows.append((r.sha256, r.name, pages))
            yield pd.DataFrame(rows, columns=["document_sha256", "filename", "pages"])

    return paths.select("sha256", "absolute_path", "name").mapInPandas(read, "document_sha256 string, filename string, pages array<string>")


def _shown(code: bytes) -> str:
    """Strings a content stream shows, one line for each text operator."""
    from vellumflow.sources.pdf import Lexer, Operator

    lexer, held, lines = Lexer(code), [], []
    while True:
        try:
            x = lexer.value()
        except StopIteration:
            return "\n".join(lines)
        if not isinstance(x, Operator):
            held.append(x)
            continue
        if x.text in ("Tj", "'", '"', "TJ") and held:
            parts = held[-1] if isinstance(held[-1], list) else [held[-1]]
            lines.append("".join(p.decode("latin-1") for p in parts if isinstance(p, bytes)))
        held = []


def run_project(spark: SparkSession, config: ProjectConfig, extractor: extract.Extractor | None = None, force: bool = False, offline: bool = False, limit: int | None = None, now: str | None = None, clusterer: Callable[[DataFrame], DataFrame] | None = None, normalise: Callable[[Path], object] | None = None) -> dict[str, object]:
    """Brings a project up to date and writes its report; returns the run's figures.

    Work is done once a document however many paths it has, and only where this question has no success yet. With
    ``offline`` nothing is extracted and nothing stored is lost, ``force`` or not. The run, its calls, its results as they
    came and the project's answer are kept in the store; a run that dies stays open in the ledger. ``clusterer`` groups the
    people's names where the configuration asks for an external one; ``normalise`` is applied to the copied files.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    now = now or datetime.now(UTC).isoformat()
    output = Path(config.output_directory)
    files.write_marker(output)
    files.write_json(output / "config.json", asdict(config))
    store = TableStore(spark, output / "state")
    identity = extract.query_identity("v1", "v1", "v1", config.question, extract.RESULT, config.question, "answer")
    query_key = extract.fingerprint({"question": " ".join(config.question.split()).casefold(), "model": config.model, **identity})
    ledger = runs.RunLedger(spark, store)
    run_id = ledger.start(query_key, config.model, now)

    scanned = cut_lineage(archive.scan(archive.listing(spark, config.pdf_directory, config.ignore_dirs_containing)))
    archive.update_archive(store, scanned, now)
    good = scanned.where("error is null")
    analyses = store.read("document_analyses", _analysis_schema(spark))
    own = analyses.where(F.col("query_key") == query_key)
    documents = good.groupBy("sha256").agg(F.min(F.struct(F.split("relative_path", "/").alias("parts"), "absolute_path", "name")).alias("first")).select("sha256", "first.parts", "first.absolute_path", "first.name")
    todo = reports.pending(documents, own.select("document_sha256", "status"), force).orderBy("parts", "sha256")
    todo = cut_lineage(todo.limit(limit) if limit is not None else todo)
    outcomes = todo.select(F.lit(run_id).cast("long").alias("run_id"), F.col("sha256").alias("document_sha256"))
    queued = todo.count()
    if offline or not queued:
        outcomes = outcomes.withColumn("status", F.lit(None).cast("string"))
    else:
        # Written out at once: a lost executor must not send a document to the extractor again.
        results = cut_lineage(extract.analyse_documents(page_texts(todo), config.question, extractor or extract.KeywordExtractor()).withColumns({"query_key": F.lit(query_key), "completed_at": F.lit(now)}))
        names = documents.select(F.col("sha256").alias("document_sha256"), F.col("name").alias("source_filename"))
        store.upsert("document_analyses", results.drop("evidence").join(names, "document_sha256"), ["query_key", "document_sha256"], ["completed_at"])
        evidence = store.read("analysis_evidence", _evidence_schema(spark))
        fresh = results.select(F.concat_ws(":", "query_key", "document_sha256").alias("analysis_key"), "evidence")
        store.write("analysis_evidence", replace_children(evidence, fresh, "analysis_key", "evidence"))
        calls = uploads.call_log(results.withColumn("duration_ms", F.lit(0.0)), run_id, "analysis", now)
        store.append("call_log", calls.withColumn("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("candidate_tokens", F.lit(0))))
        store.append("objects", results.select(F.lit("document_analysis").alias("object_name"), "document_sha256", F.lit(run_id).cast("long").alias("run_id"), F.lit(now).alias("created_at"), F.to_json(F.struct("*")).alias("payload")))
        outcomes = outcomes.join(results.select("document_sha256", "status"), "document_sha256", "left")
    counted = runs.counters(outcomes).first()
    counted = {"scanned_documents": scanned.count(), **({c: counted[c] for c in runs.COUNTERS[1:]} if counted else dict.fromkeys(runs.COUNTERS[1:], 0))}
    pages = runs.scanned_pages(good, good.groupBy("sha256").agg(F.max("page_count").alias("page_count"))).first()["scanned_pages"]
    figures = _report(spark, store, config, query_key, output, run_id, offline, force, now, clusterer, normalise)
    paths = {"report_html_path": str(output / config.report_html_filename), "report_xlsx_path": str(output / (Path(config.report_html_filename).stem + ".xlsx"))}
    closed = ledger.finish(run_id, counted, paths, now)
    figures |= {**counted, "scanned_pages": pages, "question": config.question, "run_id": run_id, "upload_count": closed["upload_count"], "total_tokens": closed["total_tokens"]}
    store.set_metadata("last_run", figures | {"completed_at": now})
    files.write_json(output / "run.json", figures)
    return figures


def _analysis_schema(spark: SparkSession):
    fields = [f for f in extract.RESULT.split(", ") if not f.startswith("evidence ")]
    return spark.createDataFrame([], ", ".join(fields) + ", query_key string, completed_at string, source_filename string").schema


def _evidence_schema(spark: SparkSession):
    return spark.createDataFrame([], "analysis_key string, ordinal int, page_start int, page_end int, summary string, people array<string>, places array<string>, dates array<string>").schema


def _answer(spark: SparkSession, store: TableStore, query_key: str, question: str, figures: dict, timeline: DataFrame, n_pending: int, refresh: tuple[bool, bool], run_id: int, now: str) -> dict:
    """The project's answer: the stored one unless it has to be made anew, which is then stored in its place."""
    offline, force = refresh
    held = store.read("syntheses", spark.createDataFrame([], runs.SYNTHESIS).schema).where(F.col("query_key") == query_key).first()
    stored = F.lit(held["status"] if held else None).cast("string")
    anew = spark.range(1).select(reports.refresh_synthesis(F.lit(offline), F.lit(force), F.lit(n_pending), stored).alias("x")).first()["x"]
    if held and not anew:
        return held.asDict()
    whole = timeline.agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("source_filename").alias("documents")).first()
    # The answer stands on all findings; those named are its key findings, the first in the order of the timeline.
    first = [{"document": t["source_filename"], "summary": t["summary"]} for t in timeline.orderBy("position").limit(5).collect()]
    write = lambda q, f: {"answer": f"{whole['findings']} findings in {whole['documents']} documents.", "key_findings": [x["summary"] for x in f]}
    made = extract.synthesize(question, first, figures["total_documents"] - figures["unanalyzed_documents"], write)
    row = {"query_key": query_key, "people": [], "places": [], "dates": [], "reasoning_notes": None, "run_id": run_id, "completed_at": now, **made}
    if not offline:
        store.upsert("syntheses", spark.createDataFrame([row], runs.SYNTHESIS), ["query_key"], ["completed_at"])
    return row


def _report(spark: SparkSession, store: TableStore, config: ProjectConfig, query_key: str, output: Path, run_id: int, offline: bool, force: bool, now: str, clusterer, normalise) -> dict[str, object]:
    documents = store.read("documents")
    analyses = store.read("document_analyses", _analysis_schema(spark)).where(F.col("query_key") == query_key)
    keyed = analyses.withColumn("analysis_key", F.concat_ws(":", "query_key", "document_sha256"))
    evidence = store.read("analysis_evidence", _evidence_schema(spark))
    counts = evidence.groupBy("analysis_key").agg(F.count(F.lit(1)).cast("int").alias("evidence_count"))
    joined = cut_lineage(documents.join(keyed.join(counts, "analysis_key", "left").select(F.col("document_sha256").alias("sha256"), "status", "responsive", "evidence_count", "failure_type", "error_text", "completed_at"), "sha256", "left"))
    figures = reports.key_figures(joined).first().asDict()
    paths = store.read("document_paths")
    copied = ordering.preferred_path(paths.join(joined.where(reports.is_responsive()).select("sha256"), "sha256", "left_semi"), "sha256", "absolute_path")
    names = files.copy_documents((r["absolute_path"] for r in copied.orderBy("absolute_path").toLocalIterator()), output / "pdfs", normalise)
    copies = copied.join(spark.createDataFrame([(p, f"pdfs/{n}") for p, n in names.items()], "absolute_path string, href string"), "absolute_path")
    found = keyed.where(reports.is_succeeded() & reports.is_responsive()).select("analysis_key", "document_sha256", "source_filename", F.col("summary").alias("document_summary")).join(evidence, "analysis_key")
    report = found.withColumns({"query_id": F.lit(0), "evidence_id": F.concat_ws("-", "analysis_key", "ordinal"), "analysis_id": F.col("analysis_key")})
    index = reports.document_index(report, documents)
    linked = reports.with_document_anchor(reports.with_links(reports.timeline_rows(report), copies), index)
    numbered = cut_lineage(ordering.number_rows(linked, reports.timeline_order(), "position"))
    link = lambda shown, href: F.struct(F.col(shown).alias("text"), href.alias("href"))
    anchor = F.when(F.col("document_anchor") != "", F.concat(F.lit("#"), F.col("document_anchor")))
    timeline = numbered.orderBy("position").select(F.concat(F.lit("evidence-"), F.col("position").cast("string")).alias("_anchor"), "position", F.col("date_badge_label").alias("date"), link("source_filename", anchor).alias("document"), link("page_label", F.col("page_href")).alias("pages"), "people", F.col("brief_summary").alias("summary"))
    mapping = _canonical(spark, numbered, config, clusterer)
    people_index = reports.people_index(numbered, mapping, "query_id").orderBy("surname_key", "given_key", "person")
    people = people_index.select(F.col("anchor").alias("_anchor"), "person", "mention_count", "time_period", "variants")
    mentions = reports.people_mentions(numbered, mapping, "query_id").orderBy("person", "mention_no").select("person", "mention_no", F.col("date_label").alias("date"), "source_filename", F.col("page_label").alias("pages"), F.col("brief_summary").alias("summary"), F.col("matched_names").alias("spelt"))
    failures = joined.where(~reports.is_succeeded()).select("canonical_filename", "status", "failure_type", "error_text", "completed_at", "sha256").orderBy("completed_at", "canonical_filename", "sha256").drop("sha256")
    docs = joined.where(reports.is_responsive()).select(text.document_anchor("canonical_filename", "sha256").alias("_anchor"), "canonical_filename", "page_count", "evidence_count", "sha256").join(copies.select("sha256", "href"), "sha256", "left").orderBy(text.casefold("canonical_filename"), "sha256")
    shown = docs.select("_anchor", link("canonical_filename", F.col("href")).alias("document"), "page_count", "evidence_count")
    n_pending = figures["unanalyzed_documents"]
    answer = _answer(spark, store, query_key, config.question, figures, numbered.select("position", "source_filename", F.col("brief_summary").alias("summary")), n_pending, (offline, force), run_id, now)
    summary = [{"figure": k.replace("_", " "), "value": v} for k, v in figures.items()]
    index_rows = docs.select(F.struct(F.col("canonical_filename").alias("text"), F.concat(F.lit("#"), F.col("_anchor")).alias("href")).alias("document"), F.col("evidence_count").alias("evidence"))
    stated = [{k: answer[k] for k in ("status", "answer", "key_findings")}]
    html.write_report(output / config.report_html_filename, config.name, {"summary": summary, "answer": stated, "index": _lines(index_rows), "people": _lines(people), "mentions": _lines(mentions), "timeline": _lines(timeline), "documents": _lines(shown), "errors": _lines(failures)})
    _workbook(output / (Path(config.report_html_filename).stem + ".xlsx"), found, documents, keyed.join(counts, "analysis_key", "left"), paths)
    return figures


def _canonical(spark: SparkSession, timeline: DataFrame, config: ProjectConfig, clusterer: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(query_id, name, canonical): each name found with the one its cluster is known by."""
    dated = timeline.select("query_id", "evidence_id", "people", "source_filename", F.col("brief_summary").alias("note"), "y", "m", "d", "date_label")
    none = spark.createDataFrame([], "query_id int, analysis_id string, people array<string>, source_filename string, note string")
    records = ordering.number_within(reports.name_strings(dated, none, "query_id"), "query_id", [text.casefold("name_string"), F.col("name_string")], "name_id")
    names = cut_lineage(records.select("query_id", F.col("name_id").cast("long").alias("name_id"), "name_string", "mentions"))
    _, groups = entities.clustered_by(names, "query_id", clusterer if config.name_clustering == "external" else None)
    clustered = cut_lineage(groups.select("query_id", "cluster_id", F.explode("members").alias("name_id")))
    best = entities.representatives(names, clustered, "query_id").select("query_id", "cluster_id", F.col("representative_name").alias("canonical"))
    return clustered.join(names, ["query_id", "name_id"]).join(best, ["query_id", "cluster_id"]).select("query_id", F.col("name_string").alias("name"), "canonical")


def _lines(rows: DataFrame) -> Iterator[dict]:
    """All rows in order, of which the driver holds one partition at a time."""
    return (r.asDict(recursive=True) for r in rows.toLocalIterator())


def _workbook(path: Path, evidence: DataFrame, documents: DataFrame, analyses: DataFrame, paths: DataFrame) -> None:
    """Sheets Evidence, Documents and Failures."""
    where = ordering.preferred_path(paths, "sha256", "absolute_path").withColumnRenamed("absolute_path", "source_path")
    relative = ordering.preferred_path(paths, "sha256", "relative_path")
    best = evidence.join(analyses.select("analysis_key", "relevance_score"), "analysis_key").join(where, F.col("document_sha256") == F.col("sha256"), "left").withColumn("_d", dates.best_date_label("dates", F.coalesce("summary", "document_summary")))
    lists = lambda *names: [text.display_list(n).alias(n) for n in names]
    rows = best.select(F.col("_d.date_label").alias("sort_date"), text.sort_year("dates", "summary").alias("sort_year"), "source_filename", "page_start", "page_end", text.page_label("page_start", "page_end").alias("page_label"), text.key_person("people").alias("key_person"), "summary", *lists("people", "places", "dates"), "document_summary", "relevance_score", "source_path", F.struct("_d.y", "_d.m", "_d.d", F.coalesce("page_start", F.lit(10**9)), text.casefold("source_filename").alias("f"), text.casefold("summary").alias("s"), "ordinal").alias("_order"))
    shown = documents.join(relative, "sha256", "left").join(analyses.withColumnRenamed("document_sha256", "sha256").drop("source_filename"), "sha256", "left").join(where, "sha256", "left")
    docs = shown.select(F.col("canonical_filename").alias("source_filename"), "relative_path", "status", "responsive", "relevance_score", "summary", *lists("people", "places", "dates"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "failure_type", "error_text", F.struct("canonical_filename", "sha256").alias("_order"))
    failed = shown.where("status = 'failed'").select(F.col("canonical_filename").alias("source_filename"), "status", "failure_type", "error_text", "source_path", "completed_at", F.struct("completed_at", "canonical_filename", "sha256").alias("_order"))

    def sheet(df: DataFrame) -> tuple[list[str], Iterator[tuple]]:
        columns = [c for c in df.columns if c != "_order"]
        return columns, (tuple(r) for r in df.orderBy("_order").select(*columns).toLocalIterator())

    xlsx.write_workbook(path, {"Evidence": sheet(rows), "Documents": sheet(docs), "Failures": sheet(failed)})
