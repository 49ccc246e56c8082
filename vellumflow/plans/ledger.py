"""More queries over the archive tables: runs and their ledger, syntheses, links, name clusters, formats; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import dates, people, text
from vellumflow.operators import entities, ordering, ranges, reports, runs, state, uploads
from vellumflow.plans import archive
from vellumflow.plans.archive import _A, _D, _E, _MAP, _N, _PARTS, _SLUG, _SP, _STRIP, _TRIMMED, _U, _analyses, _documents, _evidence, _mapping, _names, _once, _report, _uploads
from vellumflow.plans.tables import read_table
from vellumflow.sources import pricing

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _runs(spark, d):
    """The runs of the analyses, as a ledger would hold them."""
    a = _analyses(spark, d, "run_id", "started_at", "completed_at", "model_name")
    return a.where("run_id is not null").groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.count_distinct("model_name").alias("models"))


_RUNS = "runs AS (SELECT run_id, min(started_at) AS started_at, max(completed_at) AS completed_at, count(DISTINCT model_name) AS models FROM a WHERE run_id IS NOT NULL GROUP BY 1)"
_COUNTED = """counted AS (SELECT run_id, count(*) AS queued_documents, count(status) AS analyzed_documents, count(*) FILTER (WHERE status = 'succeeded') AS succeeded_documents,
 count(*) FILTER (WHERE status <> 'succeeded') AS failed_documents, count(*) FILTER (WHERE status IS NULL) AS skipped_documents FROM o GROUP BY 1)"""
# Documents of a run that were queued but have no usable result count as skipped.
_OUTCOMES = "o AS (SELECT run_id, analysis_id, completed_at, CASE WHEN failure_type IN ('missing_pdf', 'upload_failed') THEN NULL ELSE status END AS status FROM a WHERE run_id IS NOT NULL)"


def _outcomes(spark, d):
    a = _analyses(spark, d, "run_id", "status", "failure_type", "completed_at").where("run_id is not null")
    return a.select("run_id", "analysis_id", "completed_at", F.when(~F.coalesce(F.col("failure_type").isin("missing_pdf", "upload_failed"), F.lit(False)), F.col("status")).alias("status"))


@query(f"WITH {_A}, {_OUTCOMES}, {_COUNTED} SELECT * FROM counted")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each run; documents whose file was missing or never arrived count as skipped."""
    return runs.counters(_outcomes(spark, d))


def _log(spark, d):
    """The analyses as a ledger of calls, and each of their documents' uploads."""
    a = _analyses(spark, d, "run_id", "document_sha256", "failure_type", "prompt_tokens", "candidate_tokens", "total_cost_usd").where("run_id is not null")
    calls = uploads.call_log(a.select("document_sha256", F.col("failure_type").alias("error_text"), F.lit(0.0).alias("duration_ms"), "run_id", "prompt_tokens", "candidate_tokens", "total_cost_usd"), None, "analysis", "now")
    sent = uploads.call_log(a.where("failure_type is null or failure_type <> 'missing_pdf'").select("document_sha256", F.when(F.col("failure_type") == "upload_failed", F.col("failure_type")).alias("error_text"), F.lit(0.0).alias("duration_ms"), "run_id"), None, "upload", "now")
    both = calls.unionByName(sent, allowMissingColumns=True)
    return both.withColumns({"total_tokens": F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("candidate_tokens", F.lit(0)), "input_cost_usd": F.lit(0.0), "output_cost_usd": F.lit(0.0)})


@query(f"""
WITH {_A}, {_RUNS}, {_OUTCOMES}, {_COUNTED},
l AS (SELECT run_id, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(candidate_tokens), 0) AS BIGINT) AS candidate_tokens, count(*) FILTER (WHERE failure_type IS DISTINCT FROM 'missing_pdf' AND failure_type IS DISTINCT FROM 'upload_failed') AS upload_count,
 round(coalesce(sum(total_cost_usd), 0), 6) AS total_cost_usd FROM a WHERE run_id IS NOT NULL GROUP BY 1)
SELECT run_id, started_at, completed_at, models, queued_documents, analyzed_documents, succeeded_documents, failed_documents, skipped_documents, prompt_tokens, candidate_tokens, prompt_tokens + candidate_tokens AS total_tokens, total_cost_usd, upload_count
FROM runs JOIN counted USING (run_id) JOIN l USING (run_id)
""")
def run_summary(spark, d):
    """Every run overlaid with its counters, the sums of its calls and its new uploads."""
    rows = runs.summary(_runs(spark, d), runs.counters(_outcomes(spark, d)), runs.ledger_sums(_log(spark, d)))
    return rows.withColumn("total_cost_usd", F.round("total_cost_usd", 6)).drop("input_cost_usd", "output_cost_usd")


@query(f"WITH {_A}, {_RUNS} SELECT * FROM runs WHERE run_id = (SELECT max(run_id) FROM runs)")
def latest_run(spark, d):
    """The run of the greatest id."""
    return runs.latest(_runs(spark, d))


@query(f"WITH {_A}, {_OUTCOMES}, r AS (SELECT run_id, analysis_id, row_number() OVER (PARTITION BY run_id ORDER BY completed_at NULLS FIRST, analysis_id) AS done, count(*) OVER (PARTITION BY run_id) AS total FROM o) SELECT run_id, analysis_id, CAST(done AS BIGINT) AS done, CAST(total - done AS BIGINT) AS remaining FROM r")
def progress_remaining(spark, d):
    """How many documents of its run were still to do after each analysis."""
    rows = runs.remaining(_outcomes(spark, d), "run_id", [F.col("completed_at"), F.col("analysis_id")])
    return rows.select("run_id", "analysis_id", F.col("done").cast("long").alias("done"), F.col("remaining").cast("long").alias("remaining"))


_P = "p AS (SELECT DISTINCT document_sha256 AS sha256, local_path FROM upload_candidates WHERE document_sha256 IS NOT NULL AND local_path IS NOT NULL)"


def _paths(spark, d):
    return read_table(spark, d, "upload_candidates", ["document_sha256", "local_path"]).where("document_sha256 is not null and local_path is not null").distinct().withColumnRenamed("document_sha256", "sha256")


@query(f"WITH {_D}, {_P} SELECT count(*) AS scanned_paths, CAST(coalesce(sum(d.page_count), 0) AS BIGINT) AS scanned_pages FROM p LEFT JOIN d USING (sha256)")
def scanned_pages_over_paths(spark, d):
    """Pages over all paths: documents with several paths count several times."""
    return runs.scanned_pages(_paths(spark, d), _documents(spark, d, "page_count"))


@query(f"WITH {_A} SELECT run_id, count(*) AS uploads FROM a WHERE run_id IS NOT NULL AND failure_type IS DISTINCT FROM 'missing_pdf' AND failure_type IS DISTINCT FROM 'upload_failed' GROUP BY 1")
def uploads_of_runs(spark, d):
    """New uploads of each run: successful calls of that type in its ledger."""
    return uploads.uploads_by_run(_log(spark, d))


@query("""
WITH q AS (SELECT DISTINCT query_id, question, model_name, created_at FROM analysis_queries),
x AS (SELECT query_id, question AS answer, 'succeeded' AS status, NULL AS notes, created_at AS completed_at, 0 AS side FROM q WHERE query_id <= 30
 UNION ALL SELECT query_id, NULL, CASE WHEN query_id % 2 = 0 THEN 'succeeded' ELSE 'failed' END, model_name, created_at, 1 FROM q WHERE query_id >= 20)
SELECT query_id, arg_max(coalesce(answer, ''), side) AS answer, arg_max(status, side) AS status, arg_max(coalesce(notes, ''), side) AS notes, max(completed_at) AS completed_at FROM x GROUP BY 1
""")
def synthesis_upsert(spark, d):
    """Stored answers overwritten as a whole by new ones, empty columns included."""
    q = read_table(spark, d, "analysis_queries", ["query_id", "question", "model_name", "created_at"]).distinct()
    old = q.where("query_id <= 30").select("query_id", F.col("question").alias("answer"), F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("notes"), F.col("created_at").alias("completed_at"))
    new = q.where("query_id >= 20").select("query_id", F.lit(None).cast("string").alias("answer"), F.when(F.col("query_id") % 2 == 0, "succeeded").otherwise("failed").alias("status"), F.col("model_name").alias("notes"), F.col("created_at").alias("completed_at"))
    return runs.upsert_syntheses(old, new, "query_id").withColumns({c: F.coalesce(c, F.lit("")) for c in ("answer", "notes")})


@query("""
WITH r AS (SELECT query_id, document_sha256, analysis_id, status, summary, recorded_at, row_number() OVER (PARTITION BY query_id, document_sha256 ORDER BY recorded_at >= TIMESTAMP '2023-01-15' DESC, recorded_at DESC, analysis_id DESC) AS k FROM document_analyses)
SELECT query_id, document_sha256, analysis_id, status, recorded_at FROM r WHERE k = 1
""")
def analysis_upsert(spark, d):
    """Analyses keyed by question and document, the last record of each kept."""
    a = read_table(spark, d, "document_analyses", ["query_id", "document_sha256", "analysis_id", "status", "recorded_at"])
    cut = F.lit("2023-01-15").cast("timestamp_ntz")
    return state.upsert(a.where(F.col("recorded_at") < cut), a.where(F.col("recorded_at") >= cut), ["query_id", "document_sha256"], ["recorded_at", "analysis_id"])


@query(f"WITH {_A}, {_E} SELECT evidence_id, e.analysis_id FROM e LEFT JOIN a ON a.analysis_id = e.analysis_id AND a.site_code IS NOT NULL WHERE a.analysis_id IS NULL")
def missing_parents(spark, d):
    """Evidence whose analysis is not among those of a known site."""
    a = _analyses(spark, d, "site_code").where("site_code is not null")
    return state.missing_references(_evidence(spark, d, "analysis_id"), a, ["analysis_id"]).select("evidence_id", "analysis_id")


_ANCHOR = f"'document-' || {_SLUG.format('d.canonical_filename')} || '-' || substr(d.sha256, 1, 8)"
_INDEXED = "i AS (SELECT DISTINCT document_sha256 FROM a JOIN e USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive)"


@query(f"WITH {_A}, {_E}, {_D}, {_INDEXED} SELECT a.analysis_id, coalesce({_ANCHOR}, '') AS document_anchor FROM a LEFT JOIN i ON i.document_sha256 = a.document_sha256 LEFT JOIN d ON d.sha256 = i.document_sha256")
def document_anchor_lookup(spark, d):
    """The anchor of each analysis's document in the index of responsive ones, or nothing."""
    index = reports.document_index(_report(spark, d), _documents(spark, d, "canonical_filename", "page_count"))
    return reports.with_document_anchor(_analyses(spark, d, "document_sha256"), index).select("analysis_id", "document_anchor")


def _copied(spark, d):
    """Copies a report of all responsive documents would make: one path each, named apart within the report."""
    wanted = _analyses(spark, d, "document_sha256", "responsive").where("responsive").select(F.col("document_sha256").alias("sha256")).distinct()
    return ordering.copy_names(ordering.preferred_path(_paths(spark, d).join(wanted, "sha256", "left_semi"), "sha256", "local_path"), "sha256", "local_path")


@query(rf"""
WITH {_A}, {_E}, {_P}, w AS (SELECT DISTINCT document_sha256 AS sha256 FROM a WHERE responsive),
f AS (SELECT sha256, arg_min(local_path, (length(local_path), local_path)) AS path FROM p JOIN w USING (sha256) GROUP BY 1),
b AS (SELECT sha256, path, regexp_extract(path, '[^/]*$') AS name FROM f),
k AS (SELECT sha256, name, row_number() OVER (PARTITION BY name ORDER BY path, sha256) - 1 AS n FROM b),
h AS (SELECT sha256, 'pdfs/' || CASE WHEN n = 0 THEN name ELSE substr(sha256, 1, 12) || '-' || name END AS href FROM k),
e2 AS (SELECT e.evidence_id, a.document_sha256, coalesce(e.page_start, e.page_number) AS s FROM a JOIN e USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive)
SELECT evidence_id, href AS report_href, CASE WHEN s IS NULL OR s < 1 THEN href ELSE href || '#page=' || s END AS page_href FROM e2 LEFT JOIN h ON h.sha256 = e2.document_sha256
""")
def report_link_lookup(spark, d):
    """The copied file of each evidence row's document and its page there, null where nothing was copied."""
    return reports.with_links(_report(spark, d), _copied(spark, d)).select("evidence_id", "report_href", "page_href")


@query(f"WITH {_N} SELECT run_id, name_id, row_number() OVER (PARTITION BY run_id ORDER BY replace(lower(name_string), 'ß', 'ss'), name_id) AS name_no FROM n WHERE name_string IS NOT NULL")
def name_ids(spark, d):
    """Names of each run numbered in the order of their folded spelling, equal ones by first appearance."""
    n = _names(spark, d, "run_id", "name_string").where("name_string is not null")
    return ordering.number_within(n, "run_id", [text.casefold("name_string"), F.col("name_id")], "name_no").select("run_id", "name_id", F.col("name_no").cast("long").alias("name_no"))


_CLUSTERED = f"""
{_PARTS}, cls AS (SELECT run_id, surname, f, mi, min(name_id) AS id FROM p WHERE f IS NOT NULL GROUP BY ALL),
l AS (SELECT a.run_id, a.id AS x, b.id AS y, a.f IS NOT DISTINCT FROM b.f AS same FROM cls a JOIN cls b ON a.run_id = b.run_id AND a.surname = b.surname AND a.f[1] = b.f[1] AND (length(a.f) = 1 OR length(b.f) = 1 OR a.f = b.f) AND (a.mi IS NULL OR b.mi IS NULL OR a.mi = b.mi)),
reach AS (SELECT run_id, x, y FROM l UNION SELECT r.run_id, r.x, l.y FROM reach r JOIN l ON r.run_id = l.run_id AND r.y = l.x),
top AS (SELECT run_id, x, min(y) AS root FROM reach GROUP BY 1, 2),
cl AS (SELECT p.run_id, p.name_id, coalesce(top.root, p.name_id) AS cluster_id, cls.id AS class_id FROM p LEFT JOIN cls ON cls.run_id = p.run_id AND cls.surname = p.surname AND cls.f IS NOT DISTINCT FROM p.f AND cls.mi IS NOT DISTINCT FROM p.mi LEFT JOIN top ON top.run_id = cls.run_id AND top.x = cls.id)
"""
archive.ORACLES["name_clusters_exact"] = f"WITH RECURSIVE {_CLUSTERED} SELECT run_id, name_id, cluster_id FROM cl"
_INFORMATION = r"""
inf AS (SELECT name_id, name_string, mentions, list_transform(regexp_extract_all(name_string, '[A-Za-z]+'), lambda x: lower(x)) AS tok FROM (SELECT DISTINCT ON (name_id) name_id, name_string, mentions FROM name_records WHERE name_string IS NOT NULL)),
inf2 AS (SELECT *, len(tok) > 1 AND tok[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') AS suf FROM inf),
inf3 AS (SELECT *, CASE WHEN suf THEN tok[:-2] ELSE tok END AS core3 FROM inf2),
inf4 AS (SELECT *, CASE WHEN len(core3) > 1 THEN core3[:-2] ELSE [] END AS given3 FROM inf3),
score AS (SELECT name_id, name_string, (3 * len(list_filter(given3, lambda g: length(g) > 1)) + 2 * greatest(len(given3) - 1, 0) + CASE WHEN suf THEN 1 ELSE 0 END + len(tok), coalesce(mentions, 0), length(name_string), lower(name_string), -name_id) AS s FROM inf4),
rep AS (SELECT run_id, cluster_id, arg_max(name_id, s) AS representative_name_id, arg_max(name_string, s) AS representative_name, count(*) AS members FROM cl JOIN score USING (name_id) GROUP BY 1, 2)
"""


@query(f"WITH RECURSIVE {_CLUSTERED}, {_INFORMATION} SELECT run_id, cluster_id, representative_name_id AS name_id, representative_name, members FROM rep")
def representatives_exact(spark, d):
    """Each cluster by links of equal surnames with its representative name."""
    names = _names(spark, d, "run_id", "name_string", "mentions").where("name_string is not null")
    return entities.representatives(names, entities.clusters(names, "run_id", fuzzy=False), "run_id")


@query(f"""
WITH RECURSIVE {_CLUSTERED}, {_INFORMATION},
no AS (SELECT run_id, cluster_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY min(name_id)) AS INTEGER) AS cluster_no, array_to_string(list(name_id ORDER BY name_id), ' | ') AS member_name_ids FROM cl GROUP BY 1, 2),
why AS (SELECT run_id, class_id AS a, name_id AS b, 'same surname and matching first name' AS reason FROM cl WHERE class_id < name_id UNION ALL SELECT run_id, x, y, CASE WHEN same THEN 'same surname and matching first name' ELSE 'same surname and compatible initials' END FROM l WHERE x < y),
said AS (SELECT why.run_id, cl.cluster_id, string_agg(a || '-' || b || ': ' || reason, '; ' ORDER BY a, b) AS rationale FROM why JOIN cl ON cl.run_id = why.run_id AND cl.name_id = why.a GROUP BY 1, 2)
SELECT no.run_id, cluster_no, representative_name_id, representative_name, member_name_ids, coalesce(rationale, 'singleton') AS rationale FROM no JOIN rep USING (run_id, cluster_id) LEFT JOIN said USING (run_id, cluster_id)
""")
def cluster_assembly(spark, d):
    """Whole clusters of equal surnames: numbered densely, members in order, with the links that hold them together."""
    names = _names(spark, d, "run_id", "name_string", "mentions").where("name_string is not null")
    rows = entities.assembled(names, "run_id", fuzzy=False)
    return rows.drop("member_names").withColumn("member_name_ids", F.array_join(F.transform("member_name_ids", lambda x: x.cast("string")), " | "))


@query(f"""
WITH RECURSIVE {_CLUSTERED},
st AS (SELECT DISTINCT run_id, list_sort(list_distinct(member_name_ids)) AS m FROM (SELECT DISTINCT ON (cluster_id) * FROM name_clusters)),
ow AS (SELECT run_id, list(name_id ORDER BY name_id) AS m FROM cl WHERE run_id IN (SELECT run_id FROM st) GROUP BY run_id, cluster_id)
SELECT run_id, 'first' AS side, array_to_string(m, ' | ') AS members FROM st WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.run_id = st.run_id AND ow.m = st.m)
UNION ALL SELECT run_id, 'second', array_to_string(m, ' | ') FROM ow WHERE NOT EXISTS (SELECT 1 FROM st WHERE ow.run_id = st.run_id AND ow.m = st.m)
""")
def cluster_set_diff_exact(spark, d):
    """Member sets in which clusters of equal surnames and the stored ones differ, for the runs that have stored ones."""
    stored = _once(spark, d, "name_clusters", "cluster_id", ["run_id", "member_name_ids"]).select("run_id", F.col("member_name_ids").alias("members"))
    names = _names(spark, d, "run_id", "name_string").where("name_string is not null").join(stored.select("run_id").distinct(), "run_id", "left_semi")
    own = entities.clusters(names, "run_id", fuzzy=False).groupBy("run_id", "cluster_id").agg(F.collect_list("name_id").alias("members"))
    return entities.differing_clusters(stored, own, "run_id").withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), " | "))


@query(f"""
WITH {_N}, c AS (SELECT DISTINCT ON (cluster_id) run_id, cluster_id, list_distinct(member_name_ids) AS m FROM name_clusters),
g AS (SELECT run_id, cluster_id, CASE WHEN cluster_id % 5 = 0 THEN [] WHEN cluster_id % 5 = 1 THEN list_concat(list_sort(m), [-cluster_id]) WHEN cluster_id % 5 = 2 THEN list_concat(list_sort(m), [list_sort(m)[1]]) WHEN cluster_id % 5 = 3 THEN list_sort(m)[2:] ELSE m END AS m FROM c),
x AS (SELECT run_id, cluster_id, unnest(m) AS name_id FROM g), o AS (SELECT run_id, name_id FROM n WHERE run_id IN (SELECT run_id FROM g))
SELECT run_id, 'empty' AS fault, CAST(NULL AS BIGINT) AS name_id FROM g WHERE len(m) = 0
UNION ALL SELECT DISTINCT run_id, 'unknown', name_id FROM x WHERE (run_id, name_id) NOT IN (SELECT run_id, name_id FROM o)
UNION ALL SELECT run_id, 'repeated', name_id FROM x GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT run_id, 'omitted', name_id FROM o WHERE (run_id, name_id) NOT IN (SELECT run_id, name_id FROM x)
""")
def cluster_faults_planted(spark, d):
    """The stored clusters with every fault planted in some, and what the validation says of them."""
    c = _once(spark, d, "name_clusters", "cluster_id", ["run_id", "member_name_ids"]).select("run_id", "cluster_id", F.sort_array(F.array_distinct("member_name_ids")).alias("m"))
    kind = F.col("cluster_id") % 5
    spoilt = F.when(kind == 0, F.array().cast("array<bigint>")).when(kind == 1, F.concat("m", F.array(-F.col("cluster_id")))).when(kind == 2, F.concat("m", F.slice("m", 1, 1))).when(kind == 3, F.slice("m", 2, 1_000_000)).otherwise(F.col("m"))
    return entities.partition_faults(_names(spark, d, "run_id"), c.select("run_id", "cluster_id", spoilt.alias("members")), "run_id")


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^0-9a-z]+'), lambda w: w <> '')"


@query(f"WITH {_N}, o AS (SELECT run_id, name_id, time_period, lag(time_period) OVER (PARTITION BY run_id ORDER BY name_id) AS before FROM n) SELECT run_id, name_id, coalesce(list_has_any({_WORDS.format('time_period')}, {_WORDS.format('before')}), false) AS overlaps FROM o")
def period_overlap(spark, d):
    """Whether each name's period shares a word with that of the name before it in its run."""
    from pyspark.sql import Window

    n = _names(spark, d, "run_id", "time_period").withColumn("before", F.lag("time_period").over(Window.partitionBy("run_id").orderBy("name_id")))
    return n.select("run_id", "name_id", people.periods_overlap("time_period", "before").alias("overlaps"))


@query(f"WITH {_D} SELECT sha256, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size, format('{{:,}}', file_size_bytes) AS bytes FROM (SELECT sha256, file_size_bytes, CAST(file_size_bytes AS DOUBLE) AS b FROM d)")
def human_sizes(spark, d):
    """Sizes of documents as they are shown."""
    return _documents(spark, d, "file_size_bytes").select("sha256", text.human_size("file_size_bytes").alias("size"), text.thousands("file_size_bytes").alias("bytes"))


@query(f"""
WITH {_U}, s AS (SELECT unnest(['none', 'auto', 'chunk', 'qpdf', 'ebook']) AS strategy),
f AS (SELECT strategy, document_sha256, compression_method AS m, size_bytes, candidate_sha256, size_bytes > 0 AND size_bytes <= 50000000 AS fits FROM u CROSS JOIN s),
g AS (SELECT strategy, document_sha256, min((size_bytes, candidate_sha256)) FILTER (WHERE fits AND m = 'original') AS o, min((size_bytes, candidate_sha256)) FILTER (WHERE fits AND m = strategy AND strategy IN ('qpdf', 'ebook')) AS t FROM f GROUP BY 1, 2)
SELECT strategy, document_sha256, CASE WHEN o IS NOT NULL THEN 'original' WHEN t IS NOT NULL THEN strategy WHEN strategy IN ('auto', 'chunk') THEN 'chunk' ELSE 'none' END AS choice, coalesce(o, t)[2] AS candidate_sha256, coalesce(o, t)[1] AS size_bytes FROM g
""")
def candidate_strategies(spark, d):
    """What would be uploaded of each document under every strategy."""
    from functools import reduce

    u = _uploads(spark, d, "document_sha256", "compression_method", "size_bytes")
    return reduce(DataFrame.unionByName, [ranges.choose_by_strategy(u, s).withColumn("strategy", F.lit(s)) for s in ranges.STRATEGIES])


@query(f"WITH {_U} SELECT document_sha256, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS analysed_bytes, CASE WHEN count(*) > 1 THEN 'chunk' ELSE max(compression_method) END AS method FROM u GROUP BY 1")
def analysed_sizes(spark, d):
    """Bytes sent of each document and how it was made to fit."""
    return uploads.analysed_size(_uploads(spark, d, "document_sha256", "compression_method", "size_bytes"))


@query("""
WITH k AS (SELECT candidate_sha256, max(prepared_at) AS t FROM upload_candidates GROUP BY 1)
SELECT candidate_sha256, strftime(t, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS uploaded_at, strftime(t + INTERVAL 47 HOURS, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS expires_at, t + INTERVAL 47 HOURS > TIMESTAMP '2023-01-20' AS live FROM k
""")
def upload_expiry(spark, d):
    """When each candidate was sent, when its remote copy ends, and whether it lived on a day in January."""
    u = read_table(spark, d, "upload_candidates", ["candidate_sha256", "prepared_at"]).groupBy("candidate_sha256").agg(F.max("prepared_at").alias("at"))
    ends = uploads.expiry(F.col("at"))
    return u.select("candidate_sha256", uploads.stamp(F.col("at")).alias("uploaded_at"), uploads.stamp(ends).alias("expires_at"), (ends > F.lit("2023-01-20").cast("timestamp_ntz")).alias("live"))


@query(f"""
WITH m AS (SELECT model_name, max(prompt_tokens) AS a, max(candidate_tokens) AS b FROM document_analyses WHERE model_name IS NOT NULL GROUP BY 1),
pr AS (SELECT m.model_name, arg_min(p.input_price, (p.alias <> m.model_name, p.alias)) AS ip, arg_min(p.output_price, (p.alias <> m.model_name, p.alias)) AS op FROM m JOIN {archive._PRICES_SQL} ON starts_with(m.model_name, p.alias) GROUP BY 1)
SELECT model_name, CASE WHEN coalesce(a, 0) = 0 THEN '?' ELSE format('{{:,}}', a) END AS input_limit, CASE WHEN coalesce(b, 0) = 0 THEN '?' ELSE format('{{:,}}', b) END AS output_limit,
 CASE WHEN ip IS NULL THEN '?' ELSE printf('$%.2f', ip) END AS input_price, CASE WHEN op IS NULL THEN '?' ELSE printf('$%.2f', op) END AS output_price FROM m LEFT JOIN pr USING (model_name)
""")
def model_listing(spark, d):
    """The models of the analyses with the most tokens they took and their prices, as a catalogue shows them."""
    m = read_table(spark, d, "document_analyses", ["model_name", "prompt_tokens", "candidate_tokens"]).where("model_name is not null").groupBy("model_name").agg(F.max("prompt_tokens").alias("input_token_limit"), F.max("candidate_tokens").alias("output_token_limit"))
    return pricing.model_listing(m, archive._prices(spark))


_SNAPSHOT = {"models": {a: {"standard": {"input_usd_per_million_tokens": i, "output_usd_per_million_tokens": o}, "aliases": [f"{a}-latest", archive.PRICES[0][0]]} for a, i, o in archive.PRICES}}


@query(f"SELECT alias, input_price, output_price FROM {archive._PRICES_SQL} UNION ALL SELECT alias || '-latest', input_price, output_price FROM {archive._PRICES_SQL}")
def alias_fan_out(spark, d):
    """A price snapshot as one row for each model name and alias."""
    return spark.createDataFrame(pricing.price_rows(_SNAPSHOT), pricing.SCHEMA).drop("display_name")


@query(f"WITH {_D} SELECT sha256, row_number() OVER (ORDER BY replace(lower(canonical_filename), 'ß', 'ss') NULLS FIRST, sha256) AS position FROM d")
def document_order(spark, d):
    """Documents in the order a report lists them."""
    rows = ordering.number_rows(_documents(spark, d, "canonical_filename"), [text.casefold("canonical_filename"), F.col("sha256")], "position")
    return rows.select("sha256", F.col("position").cast("long").alias("position"))


@query(f"WITH {_N} SELECT name_id, replace(lower(name_string), 'ß', 'ss') AS folded FROM n")
def casefold_names(spark, d):
    """Every name with its case folded."""
    return _names(spark, d, "name_string").select("name_id", text.casefold("name_string").alias("folded"))


_MONTHS_SQL = "['" + "', '".join(m[:3] for m in dates.MONTHS) + "']"
_NAMED_SQL = "(?:" + "|".join([m for m in dates.MONTHS] + [m[:3] for m in dates.MONTHS if m != "may"][:8] + ["sept", "sep", "oct", "nov", "dec"]) + ")"
_YEAR_SQL = "(?:1[89][0-9][0-9]|20[0-9][0-9])"
_SCAN_SQL = rf"(?i)\b(?:{_NAMED_SQL}\.?{_SP}[0-9]{{1,2}}(?:st|nd|rd|th)?,?{_SP}{_YEAR_SQL}|{_NAMED_SQL}\.?{_SP}{_YEAR_SQL}|(?:early|mid|late)(?:{_SP}|-)+{_YEAR_SQL}|{_YEAR_SQL})\b"
_FOUND = f"""
fx AS (SELECT evidence_id, unnest(l) AS f, unnest(range(len(l))) AS place FROM (SELECT evidence_id, regexp_extract_all(t, '{_SCAN_SQL}') AS l FROM src)),
fw AS (SELECT *, right(f, 4) AS yy, lower(regexp_extract(f, '^[A-Za-z]*')) AS w, regexp_extract(f, '^[^0-9]+([0-9][0-9]?)[^0-9]', 1) AS dd FROM fx),
fk AS (SELECT *, CASE WHEN w = '' THEN 3 WHEN w IN ('early', 'mid', 'late') THEN 2 WHEN dd = '' THEN 1 ELSE 0 END AS kind FROM fw),
fd AS (SELECT evidence_id, kind, place, CAST(yy AS INTEGER) AS y, CAST(CASE kind WHEN 3 THEN 1 WHEN 2 THEN CASE w WHEN 'early' THEN 2 WHEN 'mid' THEN 6 ELSE 10 END ELSE list_position({_MONTHS_SQL}, w[1:3]) END AS INTEGER) AS m,
 CAST(CASE kind WHEN 0 THEN dd ELSE '1' END AS INTEGER) AS d, CASE kind WHEN 3 THEN yy WHEN 2 THEN w || ' ' || yy WHEN 1 THEN upper(w[1]) || w[2:] || ' ' || yy ELSE upper(w[1]) || w[2:] || ' ' || CAST(dd AS INTEGER) || ', ' || yy END AS label FROM fk)
"""
_BEST = f"""
{_FOUND}, fo AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY y, m, d, lower(label)) AS k FROM (SELECT DISTINCT evidence_id, y, m, d, label FROM fd)),
best AS (SELECT src.evidence_id, CAST(coalesce(max(y) FILTER (WHERE k = 1), 9999) AS INTEGER) AS y, CAST(coalesce(max(m) FILTER (WHERE k = 1), 12) AS INTEGER) AS m, CAST(coalesce(max(d) FILTER (WHERE k = 1), 31) AS INTEGER) AS d, coalesce(max(label) FILTER (WHERE k = 1), 'Undated') AS date_label,
 coalesce(string_agg(label, ' -> ' ORDER BY k) FILTER (WHERE k <= 2), 'Undated') AS date_badge_label FROM src LEFT JOIN fo USING (evidence_id) GROUP BY 1)
"""
_READ = "concat_ws(' ', array_to_string(list_filter(e.dates, lambda x: x IS NOT NULL AND x <> ''), ' '), {0})"
archive.ORACLES["date_candidates"] = f"WITH {_E}, src AS (SELECT evidence_id, summary AS t FROM e), {_FOUND} SELECT evidence_id, CAST(row_number() OVER (PARTITION BY evidence_id ORDER BY kind, place) - 1 AS INTEGER) AS pos, y, m, d, label FROM fd"
archive.ORACLES["best_date_label"] = f"WITH {_E}, src AS (SELECT evidence_id, {_READ.format('e.summary')} AS t FROM e), {_BEST} SELECT * FROM best"
_BRIEF = f"""trimmed AS (SELECT evidence_id, trim(regexp_replace(shown, '{_SP}', ' ', 'g')) AS c FROM rep),
brief AS (SELECT evidence_id, CASE WHEN length(c) > 105 THEN rtrim(substr(c, 1, 102)) || '...' ELSE c END AS brief_summary FROM trimmed)"""
_REPORTED = f"""{_A}, {_E},
rep AS (SELECT a.query_id, a.run_id, a.analysis_id, a.document_sha256, a.source_filename, a.summary AS document_summary, a.relevance_score, e.evidence_id, e.ordinal, coalesce(e.page_start, e.page_number) AS page_start, e.page_end, e.summary, e.people, e.places, e.dates, coalesce(nullif(e.summary, ''), a.summary, '') AS shown FROM a JOIN e USING (analysis_id) WHERE a.status = 'succeeded' AND a.responsive),
src AS (SELECT evidence_id, {_READ.format("shown").replace("e.dates", "dates")} AS t FROM rep), {_BEST}, {_BRIEF},
line AS (SELECT rep.*, y, m, d, date_label, date_badge_label, brief_summary, CASE WHEN page_start IS NULL OR page_start < 1 THEN 'Pages unknown' WHEN page_end > page_start THEN 'Pages ' || page_start || '-' || page_end ELSE 'Page ' || page_start END AS page_label
 FROM rep JOIN best USING (evidence_id) JOIN brief USING (evidence_id))"""
_TOLD = "y, m, d, coalesce(page_start, 1000000000), replace(lower(source_filename), 'ß', 'ss') NULLS FIRST, replace(lower(brief_summary), 'ß', 'ss') NULLS FIRST, source_filename NULLS FIRST, ordinal NULLS FIRST, evidence_id"
archive.ORACLES["evidence_timeline"] = f"""
WITH {_REPORTED}, o AS (SELECT *, row_number() OVER (ORDER BY {_TOLD}) AS position FROM line)
SELECT query_id, evidence_id, analysis_id, document_sha256, source_filename, ordinal, page_start, y, m, d, date_label, date_badge_label, brief_summary, page_label, coalesce(people[1], 'No named person') AS key_person, position, 'evidence-' || position AS anchor FROM o
"""
_MENTIONED = f"""{_REPORTED}, {_MAP},
nm AS (SELECT evidence_id, run_id, y, m, d, date_label, page_start, page_label, source_filename, brief_summary, ordinal, unnest(list_distinct({_TRIMMED.format('people')})) AS name FROM line),
cn AS (SELECT nm.*, coalesce(mp.canonical, nm.name) AS person FROM nm LEFT JOIN mp USING (run_id, name)),
one AS (SELECT run_id, person, evidence_id, any_value(y) AS y, any_value(m) AS m, any_value(d) AS d, any_value(date_label) AS date_label, any_value(page_start) AS page_start, any_value(page_label) AS page_label, any_value(source_filename) AS source_filename, any_value(brief_summary) AS brief_summary, any_value(ordinal) AS ordinal, list_sort(list(DISTINCT name)) AS names FROM cn GROUP BY 1, 2, 3)"""


@query(f"WITH {_MENTIONED} SELECT run_id, person, evidence_id, CAST(row_number() OVER (PARTITION BY run_id, person ORDER BY {_TOLD}) AS BIGINT) AS mention_no, date_label, page_label, source_filename, brief_summary, array_to_string(names, ' | ') AS matched_names FROM one")
def people_mentions(spark, d):
    """The mentions of each person of a run, in order, with the spellings found in each."""
    rows = reports.timeline_rows(_report(spark, d)).join(_analyses(spark, d, "run_id"), "analysis_id")
    found = reports.people_mentions(rows, _mapping(spark, d), "run_id")
    return found.select("run_id", "person", "evidence_id", F.col("mention_no").cast("long").alias("mention_no"), "date_label", "page_label", "source_filename", "brief_summary", F.array_join("matched_names", " | ").alias("matched_names"))


@query(f"""
WITH {_MENTIONED}, g AS (SELECT run_id, person, count(*) AS mention_count, arg_min(date_label, (y, m, d, lower(date_label), evidence_id)) AS a, arg_max(date_label, (y, m, d, lower(date_label), evidence_id)) AS b FROM one GROUP BY 1, 2),
v AS (SELECT run_id, person, array_to_string(list(DISTINCT name ORDER BY name), ' | ') AS variants FROM cn GROUP BY 1, 2)
SELECT run_id, person, mention_count, CASE WHEN a = b THEN a ELSE a || ' to ' || b END AS time_period, variants, 'person-' || {_SLUG.format('person')} AS anchor FROM g JOIN v USING (run_id, person)
""")
def people_overview(spark, d):
    """People of each run's responsive evidence with mentions, period and spellings."""
    return archive.people_index(spark, d).drop("surname_key", "given_key").withColumn("variants", F.array_join("variants", " | "))


_FOLDED = {c: f"coalesce(array_to_string(list_filter({c}, lambda x: x IS NOT NULL AND x <> ''), '; '), '') AS {c}" for c in ("people", "places", "dates")}


@query(rf"""
WITH {_REPORTED}, {_D}, {_P}, w AS (SELECT DISTINCT document_sha256 AS sha256 FROM a WHERE responsive),
pf AS (SELECT sha256, arg_min(local_path, (length(local_path), local_path)) AS path FROM p JOIN w USING (sha256) GROUP BY 1),
kn AS (SELECT sha256, path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY path, sha256) - 1 AS n FROM pf),
h AS (SELECT sha256, path, 'pdfs/' || CASE WHEN n = 0 THEN name ELSE substr(sha256, 1, 12) || '-' || name END AS href FROM kn),
o AS (SELECT *, row_number() OVER (ORDER BY {_TOLD}) AS position FROM line)
SELECT 'evidence-' || position AS anchor, document_sha256, o.source_filename, h.path AS source_path, coalesce(document_summary, '') AS document_summary, relevance_score, page_start, page_end, page_label, summary, brief_summary, {', '.join(_FOLDED.values())}, y, m, d, date_label, date_badge_label,
 coalesce(o.people[1], 'No named person') AS key_person, h.href AS report_href, CASE WHEN page_start IS NULL OR page_start < 1 THEN h.href ELSE h.href || '#page=' || page_start END AS page_href, coalesce({_ANCHOR}, '') AS document_anchor
FROM o LEFT JOIN h ON h.sha256 = o.document_sha256 LEFT JOIN d ON d.sha256 = o.document_sha256
""")
def evidence_display(spark, d):
    """Every column a report shows of its evidence, in order, with links to the copied files and to the index."""
    report = reports.evidence_report(_analyses(spark, d, "query_id", "document_sha256", "source_filename", "summary", "status", "responsive", "relevance_score"), _evidence(spark, d, "analysis_id", "ordinal", "page_number", "page_start", "page_end", "summary", "people", "places", "dates"))
    index = reports.document_index(report, _documents(spark, d, "canonical_filename", "page_count"))
    return reports.evidence_display(report, _copied(spark, d), index)
