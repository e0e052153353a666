"""Queries on loading and on skewed keys: rows that fail to parse (p3), totals of hot keys (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators import postings, rowcheck
from gramloom.tables import cut, table

#: A key is heavy from this share of all positions on.
HEAVY = 0.03


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Failed lines and their reason."""
    return rowcheck.failed_rows(table(spark, folder, "toy_lines"))


def p3_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records."""
    return rowcheck.valid_rows(table(spark, folder, "toy_lines"))


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Failures per token type and reason."""
    lines = table(spark, folder, "toy_lines")
    failed = rowcheck.check_rows(lines).where(F.col("reason").isNotNull()).select("line_id", "token_type", "reason").distinct()
    return failed.groupBy("token_type", "reason").agg(F.count("*").alias("n_lines"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Single tokens that own at least 3 per cent of all positions."""
    blocks = table(spark, folder, "space_t").where((F.col("ngram_size") == 1) & F.col("ngram").isNotNull())
    return postings.heavy_keys(cut(postings.block_totals(blocks, ["ngram"])), ["ngram"], HEAVY).select("ngram")


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, documents, first and last position per n-gram of any size."""
    blocks = table(spark, folder, "space_t").where(F.col("ngram").isNotNull())
    # documents are numbered inside each run
    documents = postings.document_masks(blocks.where(F.size("loc") > 0), ["ngram", "run_id"]).groupBy("ngram").agg(F.sum(F.bit_count("docs")).cast("bigint").alias("documents"))
    totals = postings.block_totals(blocks, ["ngram"])
    return documents.join(totals, "ngram").select("ngram", "occurrences", "documents", "first_pos", "last_pos")


def p6_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Per n-gram of the rules: rows, runs and documents (of all runs) it was chosen for. A rule delivered twice counts once."""
    rules = table(spark, folder, "rule_t").where(F.col("ngram").isNotNull())
    bit = F.expr("shiftleft(1L, cast(doc & 63 as int))")
    docs = rules.select("ngram", "run_id", F.explode("loc").alias("doc")).where("doc >= 0")
    docs = docs.groupBy("ngram", "run_id", F.expr("doc div 64").alias("g")).agg(F.bit_or(bit).alias("m")).groupBy("ngram").agg(F.sum(F.bit_count("m")).alias("n_docs"))
    rows = rules.groupBy("ngram", "rule_id", "run_id").agg(F.lit(1).alias("one")).groupBy("ngram").agg(F.count("*").alias("n_rules"), F.countDistinct("run_id").alias("n_runs"))
    return rows.join(docs, "ngram", "left").select("ngram", "n_rules", "n_runs", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_valid, p3_reasons, p6_found, p6_totals, p6_rules)}

_LINES = r"""
WITH l AS (SELECT DISTINCT line_id, token_type, regexp_replace(raw_line, '\r\z', '') AS t FROM toy_lines
           WHERE raw_line IS NOT NULL AND NOT regexp_matches(raw_line, '^[ \t\r]*\z') AND raw_line NOT LIKE ';%'),
c AS (SELECT line_id, token_type, t, coalesce(token_type = 'char', false) AS is_char,
             regexp_extract(t, '^([^ \t]*)', 1) AS label,
             CASE WHEN regexp_matches(t, '[ \t]') THEN regexp_replace(regexp_replace(t, '^[^ \t]*[ \t]', ''), '[ \t]+\z', '') ELSE '' END AS s FROM l),
q AS (SELECT *, NOT is_char AND regexp_full_match(s, '(?s)"([^"]|"")*"(\t[^"]*)?') AS quoted FROM c),
r AS (SELECT line_id, token_type, label, s, quoted,
        CASE WHEN quoted THEN regexp_extract(s, '(?s)^("([^"]|"")*")', 1) ELSE s END AS body FROM q),
f AS (SELECT r.line_id, r.token_type, r.label, r.s, r.quoted, CASE WHEN quoted THEN replace(substr(body, 2, length(body) - 2), '""', '"') ELSE body END AS content,
        CASE WHEN label = '' OR s = '' THEN 'columns'
             WHEN contains(s, '"') AND NOT quoted THEN 'quoting'
             WHEN quoted AND length(body) < length(s) THEN 'columns'
             WHEN NOT quoted AND contains(s, chr(9)) THEN 'columns'
             WHEN coalesce(token_type = 'char', false) AND contains(s, ' ') THEN 'columns'
             WHEN label NOT IN ('+1', '1', '-1') THEN 'label'
             WHEN coalesce(token_type = 'char', false) AND NOT regexp_full_match(s, '[A-Za-z]+') THEN 'sequence'
             WHEN NOT coalesce(token_type = 'char', false) AND (regexp_full_match(CASE WHEN quoted THEN substr(body, 2, length(body) - 2) ELSE body END, '[ \t]*')
                  OR regexp_matches(s, '[\x00-\x08\x0A-\x1F\x7F\x{FFFD}]')) THEN 'sequence' END AS reason FROM r)
"""

ENTRIES = """
WITH b AS (SELECT DISTINCT block_id, run_id, ngram, ngram_size, loc FROM space_t WHERE ngram IS NOT NULL AND len(loc) > 0 {where}),
e AS (SELECT block_id, run_id, ngram, loc, unnest(loc) AS v, generate_subscripts(loc, 1) AS i FROM b),
o AS (SELECT run_id, ngram, v, -loc[max(CASE WHEN v < 0 THEN i END) OVER (PARTITION BY block_id ORDER BY i)] - 1 AS doc FROM e)
"""

_TOTALS = """, d AS (SELECT DISTINCT ngram, run_id, doc, CASE WHEN v >= 0 THEN v END AS pos FROM o WHERE doc IS NOT NULL),
t AS (SELECT ngram, count(pos) AS occurrences, count(DISTINCT (run_id, doc)) AS documents, min(pos) AS first_pos, max(pos) AS last_pos FROM d GROUP BY ngram)
"""

SQL = {
    "p3_found": _LINES + "SELECT DISTINCT line_id, reason FROM f WHERE reason IS NOT NULL",
    "p3_valid": _LINES + "SELECT DISTINCT line_id, CAST(label AS INTEGER) AS class_label, content AS example_sequence FROM f WHERE reason IS NULL",
    "p3_reasons": _LINES + "SELECT token_type, reason, count(DISTINCT line_id) AS n_lines FROM f WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": ENTRIES.format(where="AND ngram_size = 1") + _TOTALS + "SELECT ngram FROM t WHERE occurrences >= 0.03 * (SELECT sum(occurrences) FROM t)",
    "p6_totals": ENTRIES.format(where="") + _TOTALS + "SELECT ngram, CAST(occurrences AS BIGINT) AS occurrences, CAST(documents AS BIGINT) AS documents, CAST(first_pos AS BIGINT) AS first_pos, CAST(last_pos AS BIGINT) AS last_pos FROM t",
    "p6_rules": """
WITH r AS (SELECT DISTINCT rule_id, run_id, ngram, loc FROM rule_t WHERE ngram IS NOT NULL),
d AS (SELECT ngram, count(*) AS n_documents FROM (SELECT DISTINCT ngram, run_id, unnest(loc) AS doc FROM r) WHERE doc >= 0 GROUP BY ngram)
SELECT r.ngram, count(DISTINCT (rule_id, run_id)) AS n_rules, count(DISTINCT run_id) AS n_runs, coalesce(any_value(n_documents), 0) AS n_documents
FROM r LEFT JOIN d ON r.ngram = d.ngram GROUP BY r.ngram""",
}
