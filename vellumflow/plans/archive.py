"""Queries of the archive operators over the archive tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import dates, people, text
from vellumflow.operators import costs, entities, ordering, ranges, reports, state
from vellumflow.plans.tables import read_table

QUERIES = {}
ORACLES = {}

#: Prices a million tokens, input and output, by alias; the model names of the tables begin with several of them.
PRICES = [("extract-mini", 0.25, 1.5), ("extract-mini-2", 0.5, 3.0), ("reader", 1.0, 4.0), ("reader-base", 1.25, 5.0)]
_PRICES_SQL = "(VALUES " + ", ".join(f"('{a}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for a, i, o in PRICES) + ") AS p(alias, input_price, output_price)"

# Repeated rows differ at most in their last time stamp.
_A = "a AS (SELECT DISTINCT ON (analysis_id) * EXCLUDE (recorded_at) FROM document_analyses)"
_E = "e AS (SELECT DISTINCT ON (evidence_id) * EXCLUDE (recorded_at) FROM analysis_evidence)"
_D = "d AS (SELECT sha256, any_value(file_size_bytes) AS file_size_bytes, any_value(page_count) AS page_count, any_value(canonical_filename) AS canonical_filename, any_value(relative_path) AS relative_path, any_value(site_code) AS site_code, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM archive_documents GROUP BY sha256)"
_N = "n AS (SELECT DISTINCT ON (name_id) * EXCLUDE (last_seen_at) FROM name_records)"
_U = "u AS (SELECT DISTINCT ON (candidate_sha256) * EXCLUDE (prepared_at) FROM upload_candidates)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _once(spark: SparkSession, d: str, name: str, key: str, columns: list[str]) -> DataFrame:
    return read_table(spark, d, name, [key, *columns]).dropDuplicates([key])


def _analyses(spark, d, *columns):
    return _once(spark, d, "document_analyses", "analysis_id", list(columns))


def _evidence(spark, d, *columns):
    return _once(spark, d, "analysis_evidence", "evidence_id", list(columns))


def _documents(spark, d, *columns):
    return _once(spark, d, "archive_documents", "sha256", list(columns))


def _names(spark, d, *columns):
    return _once(spark, d, "name_records", "name_id", list(columns))


def _uploads(spark, d, *columns):
    return _once(spark, d, "upload_candidates", "candidate_sha256", list(columns))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def content_hash_scan(spark: SparkSession, d: str) -> DataFrame:
    """Digests and size of every text's bytes."""
    content = F.encode("text", "UTF-8")
    return read_table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("""
SELECT sha256(text) AS sha256, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at, arg_max(doc_id, (captured_at, doc_id)) AS canonical_id
FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def dedupe_documents_upsert(spark, d):
    """Documents by content: first sight kept, everything else from the last."""
    rows = read_table(spark, d, "documents", ["doc_id", "text", "captured_at"]).where("text is not null").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.col("captured_at").alias("first_seen_at"), F.col("captured_at").alias("last_seen_at"), F.col("doc_id").alias("canonical_id"))
    cut = F.lit("2024-01-01").cast("timestamp_ntz")
    return state.upsert(rows.where(F.col("last_seen_at") < cut), rows.where(F.col("last_seen_at") >= cut), ["sha256"], ["last_seen_at", "canonical_id"], keep_first=["first_seen_at"])


@query("""
SELECT relative_path, arg_max(sha256, (last_seen_at, sha256)) AS sha256, arg_min(first_seen_at, (last_seen_at, sha256)) AS discovered_at, max(last_seen_at) AS last_seen_at
FROM archive_documents WHERE relative_path IS NOT NULL GROUP BY 1
""")
def path_upsert_keep_first_seen(spark, d):
    """Paths re-pointed to the content last seen there, with the time they were discovered."""
    rows = read_table(spark, d, "archive_documents", ["relative_path", "sha256", "first_seen_at", "last_seen_at"]).where("relative_path is not null").withColumnRenamed("first_seen_at", "discovered_at")
    cut = F.lit("2023-01-15").cast("timestamp_ntz")
    return state.upsert(rows.where(F.col("last_seen_at") < cut), rows.where(F.col("last_seen_at") >= cut), ["relative_path"], ["last_seen_at", "sha256"], keep_first=["discovered_at"])


@query("SELECT document_sha256, arg_min(local_path, (length(local_path), local_path)) AS local_path FROM upload_candidates WHERE document_sha256 IS NOT NULL AND local_path IS NOT NULL GROUP BY 1")
def preferred_path_top1(spark, d):
    """The shortest path of each document."""
    return ordering.preferred_path(read_table(spark, d, "upload_candidates", ["document_sha256", "local_path"]), "document_sha256", "local_path")


@query(f"WITH {_A}, {_D} SELECT sha256, relative_path, page_count FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.document_sha256 = d.sha256 AND a.status = 'succeeded')")
def pending_anti_join(spark, d):
    """Documents that were never analysed with success."""
    return reports.pending(_documents(spark, d, "relative_path", "page_count"), _analyses(spark, d, "document_sha256", "status")).select("sha256", "relative_path", "page_count")


@query(f"""
WITH {_A}, {_D}, p AS (SELECT sha256, relative_path, string_split(relative_path, '/') AS parts FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.document_sha256 = d.sha256 AND a.status = 'succeeded'))
SELECT relative_path, sha256 FROM p ORDER BY parts NULLS FIRST, sha256 LIMIT 100
""")
def pending_limit_component_order(spark, d):
    """The first hundred pending documents in order of path components: the limit is the feature."""
    return pending_anti_join(spark, d).orderBy(F.split("relative_path", "/"), "sha256").select("relative_path", "sha256").limit(100)


@query(f"""
WITH {_A}, {_E} SELECT e.evidence_id, a.analysis_id, a.query_id, a.source_filename, e.ordinal, coalesce(e.page_start, e.page_number) AS page_start, e.page_end, e.summary
FROM a JOIN e USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive
""")
def evidence_inner_join(spark, d):
    """Evidence of successful, responsive analyses."""
    return _report(spark, d).select("evidence_id", "analysis_id", "query_id", "source_filename", "ordinal", "page_start", "page_end", "summary")


def _report(spark, d):
    a = _analyses(spark, d, "query_id", "document_sha256", "source_filename", "summary", "status", "responsive")
    e = _evidence(spark, d, "analysis_id", "ordinal", "page_number", "page_start", "page_end", "summary", "people", "places", "dates")
    return reports.evidence_report(a, e)


@query(f"WITH {_A}, {_D} SELECT d.sha256, d.canonical_filename, d.page_count, a.analysis_id, a.status, a.responsive, a.relevance_score FROM d LEFT JOIN a ON a.document_sha256 = d.sha256 AND a.query_id = 1")
def document_report_left_join(spark, d):
    """Every document with its analysis for question 1."""
    docs = _documents(spark, d, "canonical_filename", "page_count")
    return reports.document_report(docs, _reported(spark, d), 1).select("sha256", "canonical_filename", "page_count", "analysis_id", "status", "responsive", "relevance_score")


def _reported(spark, d):
    return _analyses(spark, d, "query_id", "document_sha256", "status", "responsive", "relevance_score", "evidence_count")


@query(f"WITH {_A}, {_D} SELECT a.analysis_id, a.query_id, d.sha256, d.canonical_filename, a.failure_type, a.completed_at FROM a JOIN d ON d.sha256 = a.document_sha256 WHERE a.status = 'failed' ORDER BY a.completed_at NULLS FIRST, d.canonical_filename, d.sha256")
def failure_report(spark, d):
    """Failed analyses in order of time, file and document."""
    a = _analyses(spark, d, "query_id", "document_sha256", "status", "failure_type", "completed_at")
    return reports.failure_report(_documents(spark, d, "canonical_filename"), a).select("analysis_id", "query_id", "sha256", "canonical_filename", "failure_type", "completed_at").orderBy("completed_at", "canonical_filename", "sha256", "analysis_id")


@query(f"WITH {_A} SELECT run_id, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(candidate_tokens), 0) AS BIGINT) AS candidate_tokens, count(*) AS calls FROM a GROUP BY run_id")
def run_ledger_rollup(spark, d):
    """Tokens and calls of each run."""
    a = _analyses(spark, d, "run_id", "prompt_tokens", "candidate_tokens").withColumn("calls", F.lit(1).cast("long"))
    return costs.rollup(a, ["run_id"], ["prompt_tokens", "candidate_tokens", "calls"])


@query(f"WITH {_U} SELECT compression_method, count(*) AS uploads, count(*) FILTER (WHERE size_bytes > 0) AS sized FROM u GROUP BY 1")
def upload_count(spark, d):
    """Uploads by method."""
    return _uploads(spark, d, "compression_method", "size_bytes").groupBy("compression_method").agg(F.count(F.lit(1)).alias("uploads"), F.count_if(F.col("size_bytes") > 0).alias("sized"))


@query(f"""
WITH {_A}, s AS (SELECT query_id, prompt_tokens AS p, candidate_tokens AS c FROM a UNION ALL SELECT query_id, length(question), length(normalized_question) FROM analysis_queries)
SELECT query_id, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(c), 0) AS BIGINT) AS candidate_tokens FROM s GROUP BY 1
""")
def query_usage_two_source_sum(spark, d):
    """Usage of each question: its analyses and its single synthesis, measured here by the question's length."""
    synthesis = read_table(spark, d, "analysis_queries", ["query_id", "question", "normalized_question"]).select("query_id", F.length("question").cast("long").alias("prompt_tokens"), F.length("normalized_question").cast("long").alias("candidate_tokens"))
    return costs.summed_sources([_analyses(spark, d, "query_id", "prompt_tokens", "candidate_tokens"), synthesis], ["query_id"], ["prompt_tokens", "candidate_tokens"])


def _prices(spark):
    return spark.createDataFrame(PRICES, "alias string, input_price double, output_price double")


_PRICED = f"""m AS (SELECT DISTINCT model_name FROM document_analyses WHERE model_name IS NOT NULL),
pr AS (SELECT m.model_name, arg_min(p.alias, (p.alias <> m.model_name, p.alias)) AS alias, arg_min(p.input_price, (p.alias <> m.model_name, p.alias)) AS ip, arg_min(p.output_price, (p.alias <> m.model_name, p.alias)) AS op
FROM m JOIN {_PRICES_SQL} ON starts_with(m.model_name, p.alias) GROUP BY 1)"""


@query(f"WITH {_PRICED} SELECT model_name, alias, ip AS input_price, op AS output_price FROM pr")
def price_lookup_prefix(spark, d):
    """The price of each model by its own name or the first alias it begins with."""
    return costs.priced_models(read_table(spark, d, "document_analyses", ["model_name"]), _prices(spark))


_COST = "coalesce(prompt_tokens, 0) / 1000000.0::DOUBLE * coalesce(ip, 0) + coalesce(candidate_tokens, 0) / 1000000.0::DOUBLE * coalesce(op, 0)"


@query(f"WITH {_A}, {_PRICED} SELECT analysis_id, round({_COST}, 9) AS estimated_cost_usd, alias IS NULL AS pricing_missing FROM a LEFT JOIN pr USING (model_name)")
def usage_cost_estimate(spark, d):
    """Cost of each analysis at the prices; models without a price cost 0 and say so."""
    priced = costs.with_costs(_analyses(spark, d, "model_name", "prompt_tokens", "candidate_tokens"), _prices(spark))
    return priced.select("analysis_id", F.round("estimated_cost_usd", 9).alias("estimated_cost_usd"), "pricing_missing")


@query(f"""
WITH {_A}, {_PRICED} SELECT analysis_id, round(CASE WHEN coalesce(total_cost_usd, 0) = 0 AND (coalesce(prompt_tokens, 0) > 0 OR coalesce(candidate_tokens, 0) > 0) THEN {_COST} ELSE total_cost_usd END, 9) AS total_cost_usd
FROM a LEFT JOIN pr USING (model_name)
""")
def cost_backfill(spark, d):
    """Stored costs, computed where tokens were used and none is stored."""
    filled = costs.backfill(_analyses(spark, d, "model_name", "prompt_tokens", "candidate_tokens", "total_cost_usd"), _prices(spark))
    return filled.select("analysis_id", F.round("total_cost_usd", 9).alias("total_cost_usd"))


@query(f"""
WITH {_A}, {_D}, r AS (SELECT d.page_count, a.status, a.responsive, a.evidence_count FROM d LEFT JOIN a ON a.document_sha256 = d.sha256 AND a.query_id = 1),
k AS (SELECT count(*) AS total_documents, CAST(coalesce(sum(coalesce(page_count, 0)), 0) AS BIGINT) AS total_pages,
 CAST(coalesce(sum(CASE WHEN status = 'succeeded' AND responsive THEN coalesce(evidence_count, 0) END), 0) AS BIGINT) AS evidence_rows,
 count(*) FILTER (WHERE responsive) AS responsive_documents, count(*) FILTER (WHERE status = 'failed') AS failed_documents, count(*) FILTER (WHERE status IS DISTINCT FROM 'succeeded') AS unanalyzed_documents FROM r)
SELECT *, CASE WHEN failed_documents = 0 AND unanalyzed_documents = 0 THEN 'none' ELSE concat_ws(', ', CASE WHEN failed_documents > 0 THEN failed_documents || ' failure' || CASE WHEN failed_documents = 1 THEN '' ELSE 's' END END,
 CASE WHEN unanalyzed_documents > 0 THEN unanalyzed_documents || ' unanalyzed' || CASE WHEN unanalyzed_documents = 1 THEN '' ELSE 's' END END) END AS errors_label FROM k
""")
def kpi_summary(spark, d):
    """Key figures of question 1."""
    return reports.key_figures(reports.document_report(_documents(spark, d, "page_count"), _reported(spark, d), 1))


@query(f"WITH {_A}, {_D} SELECT d.sha256, a.status FROM d LEFT JOIN a ON a.document_sha256 = d.sha256 AND a.query_id = 1 WHERE a.status IS DISTINCT FROM 'succeeded'")
def unanalyzed_null_safe(spark, d):
    """Documents question 1 has no success for: failed ones and those never tried."""
    return reports.document_report(_documents(spark, d), _reported(spark, d), 1).where(~reports.is_succeeded()).select("sha256", "status")


@query(rf"""
WITH {_E}, t AS (SELECT evidence_id, concat_ws(' ', array_to_string(list_filter(dates, lambda x: x IS NOT NULL), ' '), summary) AS s FROM e)
SELECT evidence_id, CAST(list_min(list_transform(regexp_extract_all(s, '\b(1[89][0-9]{{2}}|20[0-9]{{2}})\b', 1), lambda y: CAST(y AS INTEGER))) AS INTEGER) AS sort_year FROM t
""")
def sort_year(spark, d):
    """The least year an evidence row names."""
    return _evidence(spark, d, "dates", "summary").select("evidence_id", text.sort_year("dates", "summary").alias("sort_year"))


@query()
def date_candidates(spark, d):
    """Every date a summary names, with its sort key and label."""
    rows = _evidence(spark, d, "summary").select("evidence_id", F.posexplode(dates.extract_dates("summary")).alias("pos", "c"))
    return rows.select("evidence_id", "pos", "c.y", "c.m", "c.d", "c.label")


@query()
def best_date_label(spark, d):
    """The earliest date of each evidence row, its label and badge."""
    return _evidence(spark, d, "dates", "summary").select("evidence_id", dates.best_date_label("dates", "summary").alias("b")).select("evidence_id", "b.*")


_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_SP}', ' ', 'g')) AS c FROM documents)
SELECT doc_id, CASE WHEN length(c) > 105 THEN rtrim(substr(c, 1, 102)) || '...' ELSE c END AS brief FROM t
""")
def truncate_summary(spark, d):
    """Every text as a brief of at most 105 characters."""
    return read_table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", text.truncate_text("text").alias("brief"))


@query(f"""
WITH k AS (SELECT *, lower(trim(regexp_replace(question, '{_SP}', ' ', 'g'))) AS key FROM analysis_queries)
SELECT key, model_name, prompt_version, schema_version, synthesis_prompt_version, min(query_id) AS query_id FROM k GROUP BY 1, 2, 3, 4, 5
""")
def normalize_question_key(spark, d):
    """Questions by their identity: normalised text, model and versions; the first id is kept."""
    q = read_table(spark, d, "analysis_queries").withColumn("key", text.normalize_question("question"))
    keys = ["key", "model_name", "prompt_version", "schema_version", "synthesis_prompt_version"]
    none = q.select(*keys, "query_id").limit(0)
    return state.insert_absent(none, q.select(*keys, "query_id"), keys, ["query_id"])


_SLUG = "CASE WHEN regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'project' ELSE regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END"


@query(f"WITH {_D} SELECT sha256, 'document-' || {_SLUG.format('canonical_filename')} || '-' || substr(sha256, 1, 8) AS anchor FROM d")
def slug_anchor(spark, d):
    """The anchor of every document."""
    return _documents(spark, d, "canonical_filename").select("sha256", text.document_anchor("canonical_filename", "sha256").alias("anchor"))


@query(f"""
WITH {_N}, s AS (SELECT name_id, 'person-' || {_SLUG.format('name_string')} AS slug FROM n WHERE name_string IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY name_id) - 1 AS k FROM s)
SELECT name_id, CASE WHEN k = 0 THEN slug ELSE slug || '_' || k END AS toggle_id FROM r
""")
def unique_slug_ids(spark, d):
    """An id for every name: its slug, numbered from its second use on."""
    slugs = _names(spark, d, "name_string").where("name_string is not null").select("name_id", text.person_anchor("name_string").alias("slug"))
    k = ordering.number_within(slugs, "slug", [F.col("name_id")], "_k")
    return k.select("name_id", F.when(F.col("_k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), (F.col("_k") - 1).cast("string"))).alias("toggle_id"))


@query(f"WITH {_E} SELECT evidence_id, coalesce(array_to_string(list_filter(people, lambda x: x IS NOT NULL AND x <> ''), ' | '), '') AS people, coalesce(array_to_string(list_filter(places, lambda x: x IS NOT NULL AND x <> ''), '; '), '') AS places FROM e")
def json_list_coerce(spark, d):
    """Lists read back from JSON text, and shown as one string."""
    rows = _evidence(spark, d, "people", "places").select("evidence_id", F.to_json("people").alias("p"), F.to_json("places").alias("q"))
    return rows.select("evidence_id", F.array_join(text.coerce_json_list("p"), " | ").alias("people"), text.display_list(text.coerce_json_list("q")).alias("places"))


@query(f"""
WITH {_E}, p AS (SELECT evidence_id, coalesce(page_start, page_number) AS s, page_end AS t FROM e)
SELECT evidence_id, CASE WHEN s IS NULL OR s < 1 THEN 'Pages unknown' WHEN t > s THEN 'Pages ' || s || '-' || t ELSE 'Page ' || s END AS page_label,
 CASE WHEN s IS NULL OR s < 1 THEN 'r.pdf' ELSE 'r.pdf#page=' || s END AS page_href FROM p
""")
def page_labels(spark, d):
    """Page label and link of every evidence row."""
    start = F.coalesce("page_start", "page_number")
    return _evidence(spark, d, "page_number", "page_start", "page_end").select("evidence_id", text.page_label(start, "page_end").alias("page_label"), text.page_href(F.lit("r.pdf"), start).alias("page_href"))


@query()
def evidence_timeline(spark, d):
    """Evidence of all responsive analyses in order of date, page, file and summary, numbered through."""
    rows = reports.timeline_rows(_report(spark, d))
    return ordering.number_rows(rows, reports.timeline_order(), "position").withColumn("anchor", F.concat(F.lit("evidence-"), F.col("position").cast("string"))).drop("people")


@query(f"""
WITH {_A}, {_E}, r AS (SELECT analysis_id, summary FROM a WHERE responsive IS NOT DISTINCT FROM false AND summary IS NOT NULL)
SELECT analysis_id, ordinal, summary FROM e WHERE analysis_id NOT IN (SELECT analysis_id FROM r) UNION ALL SELECT analysis_id, 1, summary FROM r
""")
def evidence_replace(spark, d):
    """Evidence of the analyses that found nothing replaced by one item, their summary."""
    fresh = _analyses(spark, d, "responsive", "summary").where("responsive <=> false and summary is not null").select("analysis_id", F.array(F.struct("summary")).alias("items"))
    existing = _evidence(spark, d, "analysis_id", "ordinal", "summary").drop("evidence_id")
    return state.replace_children(existing, fresh, "analysis_id", "items")


@query("""
WITH r AS (SELECT *, (prepared_at >= TIMESTAMP '2023-01-20', prepared_at, candidate_sha256) AS k FROM upload_candidates WHERE document_sha256 IS NOT NULL)
SELECT document_sha256, arg_max(candidate_sha256, k) AS candidate_sha256, arg_max(size_bytes, k) FILTER (WHERE size_bytes IS NOT NULL) AS size_bytes, max(prepared_at) AS prepared_at FROM r GROUP BY 1
""")
def upload_coalesce_upsert(spark, d):
    """The last upload of each document, its size from the last that had one."""
    rows = read_table(spark, d, "upload_candidates", ["document_sha256", "candidate_sha256", "size_bytes", "prepared_at"]).where("document_sha256 is not null")
    cut = F.lit("2023-01-20").cast("timestamp_ntz")
    return state.upsert(rows.where(F.col("prepared_at") < cut), rows.where(F.col("prepared_at") >= cut), ["document_sha256"], ["prepared_at", "candidate_sha256"], coalesce=["size_bytes"])


@query(f"WITH {_A} SELECT document_sha256, arg_max(analysis_id, (completed_at, analysis_id)) AS analysis_id, max(completed_at) AS completed_at FROM a WHERE completed_at IS NOT NULL GROUP BY 1")
def latest_object(spark, d):
    """The last completed analysis of each document."""
    a = _analyses(spark, d, "document_sha256", "completed_at").where("completed_at is not null")
    return a.groupBy("document_sha256").agg(F.max_by("analysis_id", F.struct("completed_at", "analysis_id")).alias("analysis_id"), F.max("completed_at").alias("completed_at"))


_STRIP = "regexp_replace({0}, '^" + _SP.replace("{", "{{").replace("}", "}}") + "|" + _SP.replace("{", "{{").replace("}", "}}") + "$', '', 'g')"
_TRIMMED = "list_filter(list_transform(list_filter({0}, lambda x: x IS NOT NULL), lambda x: " + _STRIP.format("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"


@query(f"""
WITH {_A}, {_E},
b AS (SELECT a.query_id, 0 AS k, e.evidence_id AS id, unnest(list_distinct({_TRIMMED.format('e.people')})) AS name_string, a.source_filename, e.summary AS note FROM a JOIN e USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive
 UNION ALL SELECT query_id, 1, analysis_id, unnest(list_distinct({_TRIMMED.format('people')})), source_filename, summary FROM a WHERE responsive),
f AS (SELECT query_id, name_string, note, min((k, id)) AS first_at FROM b WHERE note <> '' GROUP BY ALL),
g AS (SELECT query_id, name_string, list(note ORDER BY first_at, note)[1:5] AS context_notes FROM f GROUP BY ALL),
c AS (SELECT query_id, name_string, CAST(count(*) FILTER (WHERE k = 0) AS INTEGER) AS mentions, list_sort(list(DISTINCT source_filename) FILTER (WHERE source_filename IS NOT NULL)) AS source_filenames FROM b GROUP BY ALL)
SELECT query_id, name_string, mentions, coalesce(array_to_string(source_filenames, ' | '), '') AS source_filenames, coalesce(array_to_string(context_notes, ' | '), '') AS context_notes FROM c LEFT JOIN g USING (query_id, name_string)
""")
def name_string_records(spark, d):
    """Distinct names of each question with mentions, files and first notes."""
    report = _report(spark, d)
    dated = report.select("query_id", "evidence_id", "people", "source_filename", F.col("summary").alias("note"), F.lit(1).alias("y"), F.lit(1).alias("m"), F.lit(1).alias("d"), F.lit("x").alias("date_label"))
    responsive = _analyses(spark, d, "query_id", "people", "source_filename", "summary", "responsive").where("responsive").withColumnRenamed("summary", "note")
    lists = {k: F.array_join(k, " | ") for k in ("source_filenames", "context_notes")}
    return reports.name_strings(dated, responsive, "query_id").drop("time_period").withColumns(lists)


@query(r"""
WITH n AS (SELECT DISTINCT name_string FROM name_records WHERE name_string IS NOT NULL),
t AS (SELECT name_string, list_transform(regexp_extract_all(name_string, '[A-Za-z]+'), lambda x: lower(x)) AS tok FROM n),
s AS (SELECT *, len(tok) > 1 AND tok[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') AS suf FROM t),
c AS (SELECT name_string, tok, suf, CASE WHEN suf THEN tok[:-2] ELSE tok END AS core FROM s),
p AS (SELECT name_string, tok, suf, coalesce(core[-1], '') AS surname, CASE WHEN len(core) > 1 THEN core[:-2] ELSE [] END AS given FROM c)
SELECT name_string, surname, given[1] AS first_token, given[1][1] AS first_initial, given[2][1] AS middle_initial, CASE WHEN suf THEN tok[-1] END AS suffix,
 CAST(3 * len(list_filter(given, lambda g: length(g) > 1)) + 2 * greatest(len(given) - 1, 0) + CASE WHEN suf THEN 1 ELSE 0 END + len(tok) AS INTEGER) AS information FROM p
""")
def name_parse(spark, d):
    """The parts of every distinct name string and how much they tell."""
    n = read_table(spark, d, "name_records", ["name_string"]).where("name_string is not null").distinct()
    return n.select("name_string", people.name_parts("name_string").alias("p")).select("name_string", "p.surname", "p.first_token", "p.first_initial", "p.middle_initial", "p.suffix", F.col("p.information").cast("int").alias("information"))


@query(r"""
WITH n AS (SELECT DISTINCT name_string FROM name_records WHERE name_string IS NOT NULL),
t AS (SELECT name_string, list_transform(regexp_extract_all(name_string, '[A-Za-z]+'), lambda x: lower(x)) AS tok FROM n),
s AS (SELECT *, len(tok) > 1 AND tok[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') AS suf FROM t),
c AS (SELECT name_string, tok, suf, CASE WHEN suf THEN tok[:-2] ELSE tok END AS core FROM s)
SELECT name_string, coalesce(core[-1], '') AS surname_key, array_to_string(list_concat(CASE WHEN len(core) > 1 THEN core[:-2] ELSE [] END, CASE WHEN suf THEN [tok[-1]] ELSE [] END), ' ') AS given_key FROM c
""")
def person_sort(spark, d):
    """Sort keys of every distinct name string, in their order."""
    n = read_table(spark, d, "name_records", ["name_string"]).where("name_string is not null").distinct()
    return n.select("name_string", people.person_sort_key("name_string").alias("k")).select("name_string", F.col("k.surname").alias("surname_key"), F.col("k.given").alias("given_key")).orderBy("surname_key", "given_key", "name_string")


_PARTS = r"""
n AS (SELECT DISTINCT ON (name_id) run_id, name_id, name_string FROM name_records WHERE name_string IS NOT NULL),
t AS (SELECT *, list_transform(regexp_extract_all(name_string, '[A-Za-z]+'), lambda x: lower(x)) AS tok FROM n),
c AS (SELECT *, CASE WHEN len(tok) > 1 AND tok[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') THEN tok[:-2] ELSE tok END AS core FROM t),
p AS (SELECT run_id, name_id, coalesce(core[-1], '') AS surname, CASE WHEN len(core) > 1 THEN core[1] END AS f, CASE WHEN len(core) > 2 THEN core[2][1] END AS mi FROM c)
"""


@query(f"""
WITH {_PARTS}, l AS (
 SELECT a.run_id, a.name_id, count(b.name_id) AS n_links FROM p a LEFT JOIN p b ON a.run_id = b.run_id AND a.surname = b.surname AND a.f[1] = b.f[1] AND a.name_id <> b.name_id
  AND (length(a.f) = 1 OR length(b.f) = 1 OR a.f = b.f) AND (a.mi IS NULL OR b.mi IS NULL OR a.mi = b.mi) GROUP BY ALL)
SELECT run_id, name_id, n_links FROM l
""")
def name_links_exact_surname(spark, d):
    """How many names of its run each name links to, by equal surname and compatible given names."""
    return entities.link_counts(_names(spark, d, "run_id", "name_string").where("name_string is not null"), "run_id")


@query()
def name_links_fuzzy(spark, d):
    """The same with surnames that are nearly equal."""
    return entities.link_counts(_names(spark, d, "run_id", "name_string").where("name_string is not null"), "run_id", fuzzy=True)


@query()
def name_clusters_exact(spark, d):
    """Each name's cluster by the links of equal surnames."""
    return entities.clusters(_names(spark, d, "run_id", "name_string").where("name_string is not null"), "run_id", fuzzy=False)


@query()
def name_clusters_representatives(spark, d):
    """Each cluster by fuzzy links with its representative name."""
    names = _names(spark, d, "run_id", "name_string", "mentions").where("name_string is not null")
    return entities.representatives(names, entities.clusters(names, "run_id"), "run_id")


_MAP = f"mp AS (SELECT run_id, {_STRIP.format('name')} AS name, min(canonical) AS canonical FROM (SELECT run_id, unnest(member_names) AS name, representative_name AS canonical FROM name_clusters WHERE representative_name IS NOT NULL) GROUP BY ALL)"


def _mapping(spark, d):
    c = read_table(spark, d, "name_clusters", ["run_id", "representative_name", "member_names"]).where("representative_name is not null")
    return c.select("run_id", F.explode(text.ordered_distinct("member_names")).alias("name"), "representative_name").groupBy("run_id", "name").agg(F.min("representative_name").alias("canonical"))


@query(f"""
WITH {_A}, {_MAP},
x AS (SELECT analysis_id, run_id, {_TRIMMED.format('people')} AS l FROM a),
y AS (SELECT analysis_id, run_id, unnest(l) AS name, unnest(range(len(l))) AS pos FROM x),
z AS (SELECT y.analysis_id, coalesce(mp.canonical, y.name) AS person, min(pos) AS pos FROM y LEFT JOIN mp USING (run_id, name) GROUP BY ALL),
g AS (SELECT analysis_id, list(person ORDER BY pos) AS people FROM z GROUP BY 1)
SELECT a.analysis_id, coalesce(array_to_string(g.people, ' | '), '') AS people FROM a LEFT JOIN g USING (analysis_id)
""")
def canonicalize_people(spark, d):
    """People of every analysis by their cluster's name, first mentions in order."""
    return reports.canonical_people(_analyses(spark, d, "run_id", "people"), _mapping(spark, d), "analysis_id", "run_id").withColumn("people", F.array_join("people", " | "))


@query()
def people_index(spark, d):
    """People of each run's responsive evidence, with mentions, period and variants."""
    a = _analyses(spark, d, "run_id")
    rows = reports.timeline_rows(_report(spark, d)).join(a, "analysis_id")
    return reports.people_index(rows, _mapping(spark, d), "run_id")


@query(f"""
WITH {_A}, {_E}, {_D}, r AS (SELECT a.query_id, a.document_sha256, count(*) AS evidence_items, min(coalesce(e.page_start, e.page_number)) AS first_page FROM a JOIN e USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive GROUP BY 1, 2)
SELECT r.*, d.canonical_filename, coalesce(d.page_count, 0) AS page_count, 'document-' || {_SLUG.format('d.canonical_filename')} || '-' || substr(d.sha256, 1, 8) AS anchor FROM r JOIN d ON d.sha256 = r.document_sha256
""")
def responsive_document_index(spark, d):
    """Responsive documents with evidence, for every question."""
    return reports.document_index(_report(spark, d), _documents(spark, d, "canonical_filename", "page_count"))


@query(f"""
WITH {_A}, {_E}, i AS (SELECT analysis_id, list(summary ORDER BY ordinal NULLS FIRST, evidence_id) AS items FROM e GROUP BY 1)
SELECT a.analysis_id, a.query_id, a.document_sha256, a.source_filename, coalesce(array_to_string(i.items, ' | '), '') AS items FROM a LEFT JOIN i USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive
""")
def synthesis_input(spark, d):
    """Responsive analyses with their findings in order."""
    return reports.synthesis_input(_analyses(spark, d, "query_id", "document_sha256", "source_filename", "status", "responsive"), _evidence(spark, d, "analysis_id", "ordinal", "summary")).withColumn("items", F.array_join("items", " | "))


@query(f"""
WITH {_A}, p AS (SELECT query_id, count(*) FILTER (WHERE status IS DISTINCT FROM 'succeeded') AS n FROM a GROUP BY 1), q AS (SELECT DISTINCT query_id, CASE WHEN length(question) % 3 = 0 THEN NULL WHEN length(question) % 3 = 1 THEN 'succeeded' ELSE 'failed' END AS st FROM analysis_queries)
SELECT q.query_id, CASE WHEN coalesce(p.n, 0) > 0 OR st IS NULL THEN true ELSE st <> 'succeeded' END AS refresh FROM q LEFT JOIN p USING (query_id)
""")
def synthesis_refresh_decision(spark, d):
    """Whether each question's synthesis has to be made anew; the stored status is derived from the question's length."""
    p = _analyses(spark, d, "query_id", "status").groupBy("query_id").agg(F.count_if(~reports.is_succeeded()).alias("n"))
    rest = F.length("question") % 3
    q = read_table(spark, d, "analysis_queries", ["query_id", "question"]).select("query_id", F.when(rest == 1, "succeeded").when(rest == 2, "failed").alias("st")).distinct()
    return q.join(p, "query_id", "left").select("query_id", reports.refresh_synthesis(F.lit(False), F.lit(False), F.coalesce("n", F.lit(0)), F.col("st")).alias("refresh"))


@query(f"""
WITH {_A}, {_D}, {_U}, c AS (SELECT document_sha256, count(*) AS n, count(*) FILTER (WHERE size_bytes > 0) AS ok FROM u GROUP BY 1)
SELECT a.analysis_id, CASE WHEN d.sha256 IS NULL THEN 'missing_document_state' WHEN d.relative_path IS NULL THEN 'missing_pdf' WHEN coalesce(c.n, 0) = 0 THEN 'preparation_failed' WHEN c.ok = 0 THEN 'upload_failed' WHEN a.status IS DISTINCT FROM 'succeeded' THEN 'analysis_failed' END AS failure
FROM a LEFT JOIN d ON d.sha256 = a.document_sha256 LEFT JOIN c ON c.document_sha256 = a.document_sha256
""")
def failure_classification(spark, d):
    """What stopped each analysis, if anything did."""
    c = _uploads(spark, d, "document_sha256", "size_bytes").groupBy("document_sha256").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size_bytes") > 0).alias("ok"))
    docs = _documents(spark, d, "relative_path").select(F.col("sha256").alias("document_sha256"), "relative_path", F.lit(True).alias("known"))
    rows = _analyses(spark, d, "document_sha256", "status").join(docs, "document_sha256", "left").join(c, "document_sha256", "left")
    cls = reports.failure_class(F.col("known").isNotNull(), F.col("relative_path").isNotNull(), F.coalesce("n", F.lit(0)), F.col("ok") > 0, reports.is_succeeded(), F.lit(False))
    return rows.select("analysis_id", cls.alias("failure"))


@query("""
WITH p AS (SELECT document_sha256 AS document, page_no, any_value(page_bytes) AS bytes FROM document_pages GROUP BY ALL),
o AS (SELECT document, CAST(page_no // 2 AS BIGINT) AS object_id, arg_min(bytes, page_no) AS bytes, count(*) AS uses, CAST(max(page_no * 3) AS DOUBLE) AS dpi FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY dpi > 72 DESC, bytes DESC, dpi DESC, object_id DESC) AS k FROM o),
t AS (SELECT document, list(object_id ORDER BY k) FILTER (WHERE k <= 10) AS top FROM r GROUP BY 1)
SELECT document, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS image_bytes, count(*) FILTER (WHERE dpi > 72) AS high_images, CAST(coalesce(sum(bytes) FILTER (WHERE dpi > 72), 0) AS BIGINT) AS high_bytes, max(dpi) AS max_dpi, array_to_string(CAST(any_value(top) AS VARCHAR[]), ' | ') AS top FROM o JOIN t USING (document) GROUP BY 1
""")
def image_summary_topk(spark, d):
    """Image totals of each document and its ten largest; pairs of pages stand for image objects."""
    p = read_table(spark, d, "document_pages", ["document_sha256", "page_no", "page_bytes"]).dropDuplicates(["document_sha256", "page_no"])
    u = p.select(F.col("document_sha256").alias("document"), F.floor(F.col("page_no") / 2).cast("long").alias("object_id"), F.col("page_no").alias("pos"), F.col("page_bytes").alias("bytes"), (F.col("page_no") * 3).cast("double").alias("dpi"))
    return ranges.image_summary(u).withColumn("top", F.array_join(F.transform("top", lambda x: x["object_id"].cast("string")), " | "))


@query("""
WITH RECURSIVE p AS (SELECT document_sha256 AS document, page_no, any_value(page_bytes) AS b FROM document_pages GROUP BY ALL),
q AS (SELECT document, row_number() OVER (PARTITION BY document ORDER BY page_no) AS k, CAST(sum(b) OVER (PARTITION BY document ORDER BY page_no) AS BIGINT) AS s FROM p),
n AS (SELECT document, max(k) AS pages FROM q GROUP BY 1),
r AS (SELECT document, '001' AS chunk_id, CAST(1 AS BIGINT) AS a, CAST(pages AS BIGINT) AS z, (SELECT max(s) FROM q WHERE q.document = n.document) AS bytes FROM n
 UNION ALL
 SELECT r.document, r.chunk_id || h.k, CASE WHEN h.k = '_0' THEN r.a ELSE (r.a + r.z) // 2 + 1 END, CASE WHEN h.k = '_0' THEN (r.a + r.z) // 2 ELSE r.z END,
  qz.s - coalesce(qa.s, 0)
 FROM r CROSS JOIN (VALUES ('_0'), ('_1')) h(k)
 JOIN q qz ON qz.document = r.document AND qz.k = CASE WHEN h.k = '_0' THEN (r.a + r.z) // 2 ELSE r.z END
 LEFT JOIN q qa ON qa.document = r.document AND qa.k = CASE WHEN h.k = '_0' THEN r.a ELSE (r.a + r.z) // 2 + 1 END - 1
 WHERE r.bytes > 20000000 AND r.a < r.z)
SELECT document, chunk_id, a AS start_page, z AS end_page, CAST(bytes AS BIGINT) AS bytes FROM r WHERE bytes <= 20000000 OR a = z
""")
def chunk_bisect(spark, d):
    """Paged documents halved until each part is within 20 MB."""
    p = read_table(spark, d, "document_pages", ["document_sha256", "page_no", "page_bytes"]).dropDuplicates(["document_sha256", "page_no"])
    return ranges.bisect_ranges(ranges.prefix_sums(p.select(F.col("document_sha256").alias("document"), F.col("page_no").alias("unit_no"), F.coalesce("page_bytes", F.lit(0)).alias("bytes"))), 20_000_000)


@query(f"""
WITH {_U}, f AS (SELECT document_sha256, size_bytes > 0 AND size_bytes <= 50000000 AS fits, compression_method = 'original' AS o, size_bytes, candidate_sha256 FROM u),
g AS (SELECT document_sha256, min((size_bytes, candidate_sha256)) FILTER (WHERE fits AND o) AS x, min((size_bytes, candidate_sha256)) FILTER (WHERE fits) AS y FROM f GROUP BY 1)
SELECT document_sha256, CASE WHEN x IS NOT NULL THEN 'original' WHEN y IS NOT NULL THEN 'compressed' ELSE 'chunk' END AS choice, coalesce(x, y)[2] AS candidate_sha256, coalesce(x, y)[1] AS size_bytes FROM g
""")
def candidate_choice(spark, d):
    """What would be uploaded of each document."""
    return ranges.choose_candidate(_uploads(spark, d, "document_sha256", "compression_method", "size_bytes"))


@query(f"""
WITH {_N}, c AS (SELECT DISTINCT ON (cluster_id) run_id, cluster_id, list_distinct(member_name_ids) AS m FROM name_clusters),
x AS (SELECT run_id, cluster_id, unnest(m) AS name_id FROM c), o AS (SELECT run_id, name_id FROM n WHERE run_id IN (SELECT run_id FROM c))
SELECT run_id, 'empty' AS fault, CAST(NULL AS BIGINT) AS name_id FROM c WHERE m IS NULL OR len(m) = 0
UNION ALL SELECT DISTINCT run_id, 'unknown', name_id FROM x WHERE (run_id, name_id) NOT IN (SELECT run_id, name_id FROM o)
UNION ALL SELECT run_id, 'repeated', name_id FROM x GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT run_id, 'omitted', name_id FROM o WHERE (run_id, name_id) NOT IN (SELECT run_id, name_id FROM x)
""")
def cluster_partition_validation(spark, d):
    """Faults of the stored clusters as partitions of their runs' names."""
    c = _once(spark, d, "name_clusters", "cluster_id", ["run_id", "member_name_ids"]).select("run_id", "cluster_id", F.array_distinct("member_name_ids").alias("members"))
    return entities.partition_faults(_names(spark, d, "run_id"), c, "run_id")


@query()
def cluster_set_diff(spark, d):
    """Member sets in which the rule-based clusters and the stored ones differ, for the runs that have stored ones."""
    stored = _once(spark, d, "name_clusters", "cluster_id", ["run_id", "member_name_ids"]).select("run_id", F.col("member_name_ids").alias("members"))
    names = _names(spark, d, "run_id", "name_string").where("name_string is not null").join(stored.select("run_id").distinct(), "run_id", "left_semi")
    own = entities.clusters(names, "run_id").groupBy("run_id", "cluster_id").agg(F.collect_list("name_id").alias("members"))
    return entities.differing_clusters(stored, own, "run_id")


@query(f"WITH {_A}, {_E} SELECT a.document_sha256 AS sha256 FROM a JOIN e USING (analysis_id) UNION SELECT document_sha256 FROM a WHERE responsive")
def responsive_set_union(spark, d):
    """Documents with evidence or flagged responsive."""
    a = _analyses(spark, d, "document_sha256", "responsive")
    with_evidence = a.join(_evidence(spark, d, "analysis_id").select("analysis_id").distinct(), "analysis_id", "left_semi")
    return with_evidence.select(F.col("document_sha256").alias("sha256")).union(a.where("responsive").select("document_sha256")).distinct()


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS cell FROM documents")
def excel_safe(spark, d):
    """Texts without what a spreadsheet can't hold."""
    return read_table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", text.excel_safe("text").alias("cell"))


@query("""SELECT query_id, sha256('{"model":"' || model_name || '","prompt":"' || prompt_version || '","schema":"' || schema_version || '"}') AS fingerprint, prompt_version || '+pf:' || substr(sha256('{"model":"' || model_name || '","prompt":"' || prompt_version || '","schema":"' || schema_version || '"}'), 1, 12) AS effective_version FROM (SELECT DISTINCT query_id, model_name, prompt_version, schema_version FROM analysis_queries)""")
def query_fingerprint(spark, d):
    """Fingerprint of what makes up a question's identity, as canonical JSON, and the version it gives."""
    q = read_table(spark, d, "analysis_queries", ["query_id", "model_name", "prompt_version", "schema_version"]).distinct()
    f = F.sha2(F.to_json(F.struct(F.col("model_name").alias("model"), F.col("prompt_version").alias("prompt"), F.col("schema_version").alias("schema"))), 256)
    return q.select("query_id", f.alias("fingerprint"), F.concat("prompt_version", F.lit("+pf:"), F.substring(f, 1, 12)).alias("effective_version"))
