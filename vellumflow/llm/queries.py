"""Queries of the corpus-preparation operators over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumflow.llm import encoding, frequency, linking, packing, personal, representative, splitting
from vellumflow.plans.tables import drop_repeats, read_table, spread

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The best member of each group of names known to be one entity."""
    return representative.surviving_names(*_clusters(spark, directory)).select("cluster_id", "name_id")


@query
def p1_survivors(spark: SparkSession, directory: str) -> DataFrame:
    """The surviving record of each group, with every value of its fields judged true."""
    return representative.surviving_names(*_clusters(spark, directory))


def _clusters(spark: SparkSession, directory: str) -> tuple[DataFrame, ...]:
    return (
        read_table(spark, directory, "name_clusters", ["cluster_id", "run_id", "member_name_ids", "member_names"]),
        read_table(spark, directory, "name_records", ["name_id", "name_string", "mentions", "origin"]),
        read_table(spark, directory, "analysis_evidence", ["evidence_id", "analysis_id", "people"]),
        read_table(spark, directory, "document_analyses", ["analysis_id", "run_id"]),
    )


@query
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Terms of the evidence that are too rare or too common to be useful."""
    return frequency.evidence_terms(_listed(spark, directory)).where("mark <> 'useful'").select("field_name", "term", "mark")


@query
def p2_terms(spark: SparkSession, directory: str) -> DataFrame:
    """Every distinct term with its occurrences, its number of evidence rows and what name_records say of it."""
    return frequency.checked_terms(_listed(spark, directory), read_table(spark, directory, "name_records", ["name_id", "name_string", "mentions"]))


@query
def p2_ngrams(spark: SparkSession, directory: str) -> DataFrame:
    """Every n-gram, of as many words as the entries have, with its occurrences and its number of evidence rows."""
    return frequency.evidence_ngrams(_listed(spark, directory))


def _listed(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "analysis_evidence", ["evidence_id", "people", "places"])


@query
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of name strings that mean the same, in the runs without known clusters."""
    return linking.variant_pairs(_names(spark, directory), read_table(spark, directory, "name_clusters", ["run_id"]))


@query
def p3_clusters(spark: SparkSession, directory: str) -> DataFrame:
    """Every name string that names somebody, of all runs, with its cluster and how many others are in it."""
    return linking.linked_names(_names(spark, directory))


def _names(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "name_records", ["run_id", "name_id", "name_string", "mentions"])


@query
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Upload candidates above the size limit."""
    return splitting.oversized_candidates(*_candidates(spark, directory))


@query
def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """Page ranges the oversized candidates are cut into."""
    return splitting.split_candidates(*_candidates(spark, directory))


def _candidates(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        read_table(spark, directory, "upload_candidates", ["candidate_sha256", "document_sha256", "start_page", "end_page", "size_bytes"]),
        read_table(spark, directory, "document_pages", ["document_sha256", "page_no", "page_bytes", "heading"]),
        read_table(spark, directory, "archive_documents", ["sha256", "page_count"]),
    )


@query
def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Every text as its list of byte_bpe_50k ids."""
    return drop_repeats(spread(_documents(spark, directory)), ["doc_id"]).select("doc_id", encoding.token_ids("text").alias("ids"))


@query
def p8_containers(spark: SparkSession, directory: str) -> DataFrame:
    """Every text, or piece of one above the capacity, with its container."""
    return packing.pack_documents(_documents(spark, directory))


@query
def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """First character of every item of personal information."""
    return personal.find_personal(_documents(spark, directory))


@query
def p9_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """Every text with personal information replaced by typed placeholders."""
    return personal.redact_personal(_documents(spark, directory))


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents", ["doc_id", "text"])


# Space characters beyond ASCII, as both engines are to see them.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TERMS = f"""
WITH e AS (SELECT evidence_id, any_value(people) AS people, any_value(places) AS places FROM analysis_evidence WHERE evidence_id IS NOT NULL GROUP BY evidence_id),
x AS (SELECT evidence_id, 'people' AS field_name, unnest(people) AS v FROM e UNION ALL SELECT evidence_id, 'places', unnest(places) FROM e),
t AS (SELECT evidence_id, field_name, trim(regexp_replace(lower(nfc_normalize(v)), '{_SPACE}', ' ', 'g')) AS term FROM x WHERE v IS NOT NULL),
f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT evidence_id) AS n_records FROM t WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records * 100 > (SELECT count(*) FROM e) THEN 'common' ELSE 'useful' END AS mark FROM f)
"""

ORACLES = {
    "p2_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark <> 'useful'",
    "p2_terms": _TERMS
    + f""", n AS (SELECT name_id, any_value(name_string) AS s, any_value(mentions) AS k FROM name_records WHERE name_id IS NOT NULL GROUP BY name_id),
r AS (SELECT 'people' AS field_name, trim(regexp_replace(lower(nfc_normalize(s)), '{_SPACE}', ' ', 'g')) AS term, CAST(sum(coalesce(k, 0)) AS BIGINT) AS recorded_mentions FROM n GROUP BY ALL)
SELECT m.*, r.recorded_mentions FROM m LEFT JOIN r USING (field_name, term)
""",
    "p2_ngrams": _TERMS
    + """, w AS (SELECT evidence_id, field_name, string_split(term, ' ') AS l FROM t WHERE term <> ''),
s AS (SELECT evidence_id, field_name, l, unnest(range(1, len(l) + 1)) AS i FROM w),
g AS (SELECT evidence_id, field_name, l, i, unnest(range(1, len(l) - i + 2)) AS k FROM s),
c AS (SELECT field_name, CAST(k AS INTEGER) AS n_words, array_to_string(l[i:i + k - 1], ' ') AS ngram, count(*) AS occurrences, count(DISTINCT evidence_id) AS n_records FROM g GROUP BY ALL)
SELECT *, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records * 100 > (SELECT count(*) FROM e) THEN 'common' ELSE 'useful' END AS mark FROM c
""",
    "p4_found": """
WITH c AS (SELECT DISTINCT candidate_sha256, document_sha256, start_page, end_page, size_bytes FROM upload_candidates),
p AS (SELECT document_sha256, page_no, max(page_bytes) AS page_bytes FROM document_pages GROUP BY ALL),
s AS (
  SELECT c.candidate_sha256, any_value(c.size_bytes) AS size_bytes, sum(p.page_bytes) AS pages
  FROM c LEFT JOIN p ON p.document_sha256 = c.document_sha256
    AND p.page_no >= coalesce(c.start_page, p.page_no) AND p.page_no <= coalesce(c.end_page, p.page_no)
  GROUP BY c.candidate_sha256
)
SELECT candidate_sha256 FROM s WHERE CASE WHEN size_bytes > 0 THEN size_bytes ELSE pages END > 50000000
""",
}
