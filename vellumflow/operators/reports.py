"""The relational reports: evidence, documents, failures, indexes of people and documents, key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import dates, people, text
from vellumflow.operators.ordering import number_rows, number_within


def is_succeeded(status: str = "status") -> Column:
    """True for 'succeeded' only; a missing status is not."""
    return F.col(status).eqNullSafe(F.lit("succeeded"))


def is_responsive(flag: str = "responsive") -> Column:
    return F.col(flag).eqNullSafe(F.lit(True))


def pending(documents: DataFrame, analyses: DataFrame, force: bool = False) -> DataFrame:
    """Documents without a successful analysis, once a document; with ``force`` all of them."""
    if force:
        return documents
    return documents.join(analyses.where(is_succeeded()).select(F.col("document_sha256").alias("sha256")).distinct(), "sha256", "left_anti")


def evidence_report(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of successful, responsive analyses, with the legacy page column filled in."""
    score = [c for c in ("relevance_score",) if c in analyses.columns]
    chosen = analyses.where(is_succeeded() & is_responsive()).select("analysis_id", "query_id", "document_sha256", "source_filename", F.col("summary").alias("document_summary"), *score)
    pages = F.coalesce("page_start", "page_number").alias("page_start")
    return chosen.join(evidence.select("analysis_id", "evidence_id", "ordinal", pages, "page_end", "summary", "people", "places", "dates"), "analysis_id")


def document_report(documents: DataFrame, analyses: DataFrame, query_id: int) -> DataFrame:
    """Every document with its analysis for one question, if there is one: the question is chosen before the outer join."""
    own = analyses.where(F.col("query_id") == query_id).select(F.col("document_sha256").alias("sha256"), "analysis_id", "status", "responsive", "relevance_score", "evidence_count")
    return documents.join(own, "sha256", "left")


def failure_report(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    failed = analyses.where("status = 'failed'").select("analysis_id", "query_id", F.col("document_sha256").alias("sha256"), "failure_type", "completed_at")
    return failed.join(documents.select("sha256", "canonical_filename"), "sha256")


def key_figures(report: DataFrame) -> DataFrame:
    """One pass over a document report: counts, stored pages, and the label of what went wrong."""
    figures = report.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.coalesce(F.sum(F.coalesce("page_count", F.lit(0))), F.lit(0)).cast("long").alias("total_pages"),
        F.coalesce(F.sum(F.when(is_succeeded() & is_responsive(), F.coalesce("evidence_count", F.lit(0)))), F.lit(0)).cast("long").alias("evidence_rows"),
        F.count_if(is_responsive()).alias("responsive_documents"),
        F.count_if(F.col("status").eqNullSafe(F.lit("failed"))).alias("failed_documents"),
        F.count_if(~is_succeeded()).alias("unanalyzed_documents"),
    )
    return figures.withColumn("errors_label", text.errors_label("failed_documents", "unanalyzed_documents"))


def failure_class(has_document: Column, has_file: Column, candidates: Column, uploaded: Column, analysed: Column, offline: Column) -> Column:
    """What stopped a document, in the order it would have met the obstacles; null if nothing did."""
    return (
        F.when(~has_document, "missing_document_state")
        .when(~has_file, "missing_pdf")
        .when(offline, "skipped_offline")
        .when(candidates == 0, "preparation_failed")
        .when(~uploaded, "upload_failed")
        .when(~analysed, "analysis_failed")
    )


def refresh_synthesis(offline: Column, force: Column, n_pending: Column, stored_status: Column) -> Column:
    """Whether a stored synthesis has to be made anew."""
    return F.when(offline, False).when(force | (n_pending > 0) | stored_status.isNull(), True).otherwise(stored_status != "succeeded")


def timeline_rows(report: DataFrame, more: Sequence[Column | str] = ()) -> DataFrame:
    """Evidence with what a report shows of it: date key and labels, short summary, page label and first person."""
    shown = F.coalesce(F.nullif("summary", F.lit("")), "document_summary", F.lit(""))
    return report.withColumn("_d", dates.best_date_label("dates", shown)).select(
        "query_id", "evidence_id", "analysis_id", "document_sha256", "source_filename", "ordinal", "page_start",
        F.col("_d.y").alias("y"), F.col("_d.m").alias("m"), F.col("_d.d").alias("d"), F.col("_d.date_label").alias("date_label"), F.col("_d.date_badge_label").alias("date_badge_label"),
        text.truncate_text(shown).alias("brief_summary"), text.page_label("page_start", "page_end").alias("page_label"), text.key_person("people").alias("key_person"), "people", *more,
    )


def timeline_order() -> list[Column]:
    """Date, page (unknown last), file, summary, then what makes the order total."""
    return [F.col("y"), F.col("m"), F.col("d"), F.coalesce("page_start", F.lit(10**9)), text.casefold("source_filename"), text.casefold("brief_summary"), F.col("source_filename"), F.col("ordinal"), F.col("evidence_id")]


def name_strings(evidence: DataFrame, responsive: DataFrame, by: str) -> DataFrame:
    """One row for each distinct trimmed name of ``by``: mentions (evidence rows naming it), files, up to five first notes.

    ``evidence``: by, evidence_id, people, source_filename, note, y, m, d, date_label. ``responsive``: by, analysis_id,
    people, source_filename, note; it adds names, files and notes but no mentions. Notes come in order of source and id.
    """
    branch = lambda df, number, key, extra: df.select(by, F.lit(number).alias("_b"), F.col(key).alias("_id"), F.explode(text.ordered_distinct("people")).alias("name_string"), "source_filename", "note", *extra)
    none = [F.lit(None).cast("int").alias(k) for k in "ymd"] + [F.lit(None).cast("string").alias("date_label")]
    rows = branch(evidence, 0, "evidence_id", ["y", "m", "d", "date_label"]).unionByName(branch(responsive, 1, "analysis_id", none))
    # A note counts where it first stood; so many rows come together before any list is made.
    notes = rows.where("note <> ''").groupBy(by, "name_string", "note").agg(F.min(F.struct("_b", "_id")).alias("at"))
    first = F.row_number().over(Window.partitionBy(by, "name_string").orderBy("at", "note"))
    few = notes.withColumn("_k", first).where("_k <= 5")
    five = few.groupBy(by, "name_string").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "note"))), lambda x: x["note"]).alias("context_notes"))
    when = F.when(F.col("_b") == 0, F.struct("y", "m", "d", text.casefold("date_label")))
    grouped = rows.groupBy(by, "name_string").agg(
        F.count_if(F.col("_b") == 0).cast("int").alias("mentions"),
        F.sort_array(F.collect_set("source_filename")).alias("source_filenames"),
        dates.time_period(F.min_by("date_label", when), F.max_by("date_label", when)).alias("time_period"),
    )
    return grouped.join(five, [by, "name_string"], "left").withColumn("context_notes", F.coalesce("context_notes", F.array().cast("array<string>")))


def canonical_people(rows: DataFrame, mapping: DataFrame, key: str, by: str) -> DataFrame:
    """(key, people) with each trimmed name replaced by its canonical one, first occurrences kept in order.

    ``mapping``: by, name, canonical, one row a name. Rows without any name keep an empty list.
    """
    exploded = rows.select(key, by, F.posexplode(text.ordered_distinct("people")).alias("_pos", "name"))
    named = exploded.join(mapping, [by, "name"], "left").select(key, "_pos", F.coalesce("canonical", "name").alias("person"))
    lists = named.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "person"))), lambda x: x["person"])).alias("people"))
    return rows.select(key).join(lists, key, "left").withColumn("people", F.coalesce("people", F.array().cast("array<string>")))


def people_index(timeline: DataFrame, mapping: DataFrame, by: str) -> DataFrame:
    """One row a person of ``by``: evidence rows naming them, period, and the variants found; to be sorted by its sort key."""
    names = timeline.select(by, "evidence_id", "y", "m", "d", "date_label", F.explode(text.ordered_distinct("people")).alias("name"))
    mentions = names.join(mapping, [by, "name"], "left").withColumn("person", F.coalesce("canonical", "name"))
    once = mentions.groupBy(by, "person", "evidence_id").agg(F.first("y").alias("y"), F.first("m").alias("m"), F.first("d").alias("d"), F.first("date_label").alias("date_label"), F.collect_set("name").alias("names"))
    key = F.struct("y", "m", "d", text.casefold("date_label"), "evidence_id")
    found = once.groupBy(by, "person").agg(
        F.count(F.lit(1)).alias("mention_count"),
        dates.time_period(F.min_by("date_label", key), F.max_by("date_label", key)).alias("time_period"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("variants"),
    )
    k = people.person_sort_key("person")
    return found.withColumns({"surname_key": k["surname"], "given_key": k["given"], "anchor": text.person_anchor("person")})


def people_mentions(timeline: DataFrame, mapping: DataFrame, by: str) -> DataFrame:
    """One row for each person of ``by`` and evidence row naming them, numbered in the order of the timeline, with the spellings
    found in it. A person may have any number of mentions: they are numbered by range, never gathered."""
    names = timeline.select("*", F.explode(text.ordered_distinct("people")).alias("name"))
    found = names.join(mapping, [by, "name"], "left").withColumn("person", F.coalesce("canonical", "name"))
    kept = ("y", "m", "d", "date_label", "page_start", "page_label", "source_filename", "brief_summary", "ordinal")
    once = found.groupBy(by, "person", "evidence_id").agg(*(F.first(k).alias(k) for k in kept), F.sort_array(F.collect_set("name")).alias("matched_names"))
    return number_within(once.withColumn("_of", F.struct(by, "person")), "_of", timeline_order(), "mention_no").drop("_of")


def with_document_anchor(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (document_sha256) with the anchor of their document in an index of documents, '' for those not in it."""
    anchors = index.groupBy("document_sha256").agg(F.min("anchor").alias("document_anchor"))
    return rows.join(anchors, "document_sha256", "left").withColumn("document_anchor", F.coalesce("document_anchor", F.lit("")))


def with_links(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` (document_sha256, page_start) with the copied file and page they lead to; null where nothing was copied.

    ``copies``: sha256, href, one row a document.
    """
    links = copies.select(F.col("sha256").alias("document_sha256"), F.col("href").alias("report_href"))
    return rows.join(links, "document_sha256", "left").withColumn("page_href", text.page_href("report_href", "page_start"))


def evidence_display(report: DataFrame, copies: DataFrame, index: DataFrame) -> DataFrame:
    """The evidence of a report with every column it shows: place in the order, document, pages, summaries, lists as text, dates,
    first person, links to the copy and to the index."""
    lists = ("people", "places", "dates")
    rows = timeline_rows(report, [F.coalesce("document_summary", F.lit("")).alias("document_summary"), "relevance_score", "page_end", "summary", "places", "dates"])
    numbered = number_rows(rows, timeline_order(), "_position").withColumn("anchor", F.concat(F.lit("evidence-"), F.col("_position").cast("string")))
    path = next(c for c in copies.columns if c not in ("sha256", "href"))
    where = copies.select(F.col("sha256").alias("document_sha256"), F.col(path).alias("source_path"))
    linked = with_document_anchor(with_links(numbered, copies), index).join(where, "document_sha256", "left").withColumns({c: F.coalesce(text.display_list(c), F.lit("")) for c in lists})
    return linked.select(
        "anchor", "document_sha256", "source_filename", "source_path", "document_summary", "relevance_score", "page_start", "page_end", "page_label", "summary", "brief_summary", *lists,
        "y", "m", "d", "date_label", "date_badge_label", "key_person", "report_href", "page_href", "document_anchor",
    )


def document_index(report: DataFrame, documents: DataFrame) -> DataFrame:
    """Responsive documents that have evidence, with how much and from which page on."""
    found = report.groupBy("query_id", "document_sha256").agg(F.count(F.lit(1)).alias("evidence_items"), F.min("page_start").alias("first_page"))
    named = found.join(documents.select(F.col("sha256").alias("document_sha256"), "canonical_filename", F.coalesce("page_count", F.lit(0)).alias("page_count")), "document_sha256")
    return named.withColumn("anchor", text.document_anchor("canonical_filename", "document_sha256"))


def synthesis_input(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Responsive analyses with their evidence summaries in order, an empty list where there are none."""
    chosen = analyses.where(is_succeeded() & is_responsive()).select("analysis_id", "query_id", "document_sha256", "source_filename")
    items = evidence.groupBy("analysis_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "evidence_id", "summary"))), lambda x: x["summary"]).alias("items"))
    return chosen.join(items, "analysis_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
