"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import ledger, mixing, overlap, packing, sentences, spans, subsequences, terms
from gramloom.llm.tokens import with_tokens
from gramloom.tables import cut, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent gapped patterns of three or four tokens in each run."""
    return subsequences.frequent_patterns(table(spark, folder, "space_t")).select("run_id", "pattern")


def p1_support(spark: SparkSession, folder: str) -> DataFrame:
    """The same patterns with the number of documents that hold them."""
    return subsequences.frequent_patterns(table(spark, folder, "space_t"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Single tokens that are too rare or too common."""
    return terms.token_frequencies(table(spark, folder, "space_t")).where("mark is not null").select("ngram", "mark")


def p4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, documents and mark of every single token."""
    return terms.token_frequencies(table(spark, folder, "space_t"))


def p4_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, documents and mark of every rule."""
    return terms.rule_frequencies(table(spark, folder, "rule_t"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record that copies an earlier one, with the first of its group."""
    own, kept = ledger.deduplicate(spark, table(spark, folder, "toy"))
    return ledger.copies(own, kept).select(F.col("first_id").alias("first_doc_id"), F.col("copy_id").alias("copy_doc_id"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each group of copies, with their number."""
    _, kept = ledger.deduplicate(spark, table(spark, folder, "toy"))
    return kept.select(F.col("first_id").alias("doc_id"), "copies")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training record and an evaluation record that are equal or slightly changed."""
    pairs = overlap.cross_split_pairs(table(spark, folder, "toy"))
    return pairs.select(F.least("train_id", "eval_id").alias("doc_id_1"), F.greatest("train_id", "eval_id").alias("doc_id_2"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and source of the evaluation record."""
    return overlap.overlap_counts(table(spark, folder, "toy"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of each record that stand in other records too."""
    return spans.shared_spans(table(spark, folder, "toy"))


def p7_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each record stands in other records too."""
    records = table(spark, folder, "toy")
    return spans.shared_share(records, spans.shared_spans(records))


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Fuzzy passages: chains of matches between every two texts that share seeds."""
    return spans.fuzzy_passages(table(spark, folder, "toy"), every=True)


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """A container for every document, or piece of one, and every kind of container."""
    sized = cut(with_tokens(spark, table(spark, folder, "documents").select("doc_id", "text")))
    return packing.pack_documents(sized, table(spark, folder, "containers"))


def p8_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and room left unused."""
    containers = table(spark, folder, "containers")
    return packing.usage(p8_packed(spark, folder), containers)


def p8_valid(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing."""
    sized = cut(with_tokens(spark, table(spark, folder, "documents").select("doc_id", "text")))
    containers = table(spark, folder, "containers")
    return packing.checked(cut(packing.pack_documents(sized, containers)), sized, containers)


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = cut(with_tokens(spark, table(spark, folder, "documents").select("doc_id", "source", "text")))
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(spark, sized, targets), sized, targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix, a row for each copy of a document, in random order."""
    return mixing.shuffled(_mixed(spark, folder)[0])


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(*_mixed(spark, folder))


def p9_valid(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix."""
    return mixing.checked(*_mixed(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.distinct_sentences(spark, table(spark, folder, "documents"))


def p10_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and their characters per language tag."""
    documents = table(spark, folder, "documents")
    found = sentences.distinct_sentences(spark, documents)
    per = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("c"))
    return documents.select("doc_id", F.lower("lang").alias("lang")).join(per, "doc_id").groupBy("lang").agg(F.sum("n").alias("n_sentences"), F.sum("c").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_support, p4_found, p4_tokens, p4_rules, p5_found, p5_counts, p2_found, p2_counts, p7_found, p7_share, p7_passages, p8_packed, p8_usage, p8_valid, p9_mix, p9_shares, p9_valid, p10_found, p10_counts)}

_TOKENS = """
WITH b AS (SELECT DISTINCT block_id, run_id, ngram, loc FROM space_t WHERE ngram IS NOT NULL AND len(loc) > 0 AND ngram_size = 1),
e AS (SELECT block_id, run_id, ngram, loc, unnest(loc) AS v, generate_subscripts(loc, 1) AS i FROM b),
o AS (SELECT run_id, ngram, v, -loc[max(CASE WHEN v < 0 THEN i END) OVER (PARTITION BY block_id ORDER BY i)] - 1 AS doc FROM e),
d AS (SELECT DISTINCT ngram, run_id, doc, CASE WHEN v >= 0 THEN v END AS pos FROM o WHERE doc IS NOT NULL),
n AS (SELECT count(DISTINCT (run_id, doc)) AS n FROM d),
f AS (SELECT ngram, CAST(count(pos) AS BIGINT) AS occurrences, CAST(count(DISTINCT (run_id, doc)) AS BIGINT) AS documents FROM d GROUP BY ngram),
m AS (SELECT ngram, occurrences, documents, CASE WHEN documents < 5 THEN 'rare' WHEN documents > 0.25 * n THEN 'common' END AS mark FROM f, n)
"""

_GROUPS = r"""
WITH a AS (SELECT doc_id, class_label AS l, example_sequence AS s,
    coalesce(regexp_full_match(class_label, '[\s\x{A0}\x{200B}]*[+-]?[0-9]{1,18}[\s\x{A0}\x{200B}]*'), false) AS li,
    coalesce(regexp_full_match(example_sequence, '[\s\x{A0}\x{200B}]*[+-]?[0-9]{1,18}[\s\x{A0}\x{200B}]*'), false) AS si FROM toy WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, CASE WHEN NOT li AND si THEN s ELSE l END AS l, CASE WHEN NOT li AND si THEN l ELSE s END AS s, li OR si AS i FROM a),
k AS (SELECT DISTINCT doc_id, CASE WHEN l IS NULL THEN 'n' WHEN i THEN 'i' || CAST(CAST(regexp_replace(l, '[\s\x{A0}\x{200B}]+', '', 'g') AS BIGINT) AS VARCHAR) ELSE 't' || trim(l, ' ') END AS l,
    CASE WHEN s IS NULL THEN 'n' ELSE 's' || lower(regexp_replace(s, '[^\p{L}\p{Nd}]+', '', 'g')) END AS s FROM x),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l, s) AS first_doc_id FROM k)
"""

SQL = {
    "p1_found": """
WITH b AS (SELECT DISTINCT block_id, run_id, ngram, loc FROM space_t WHERE ngram IS NOT NULL AND len(loc) > 0 AND ngram_size = 1),
e AS (SELECT block_id, run_id, ngram, loc, unnest(loc) AS v, generate_subscripts(loc, 1) AS i FROM b),
o AS (SELECT run_id, ngram, v, -loc[max(CASE WHEN v < 0 THEN i END) OVER (PARTITION BY block_id ORDER BY i)] - 1 AS doc FROM e),
n AS (SELECT run_id, count(DISTINCT doc) AS n FROM o WHERE doc IS NOT NULL GROUP BY run_id),
t AS (SELECT DISTINCT run_id, doc, v AS pos, ngram FROM o WHERE v >= 0 AND doc IS NOT NULL),
u AS (SELECT run_id, ngram FROM t JOIN n USING (run_id) GROUP BY run_id, ngram, n HAVING count(DISTINCT doc) >= 5 AND 10 * count(DISTINCT doc) >= n),
w AS (SELECT t.* FROM t JOIN u USING (run_id, ngram)),
p3 AS (SELECT a.run_id, a.doc, c.pos, a.ngram || ' ' || b.ngram || ' ' || c.ngram AS pattern FROM w a JOIN w b ON a.run_id = b.run_id AND a.doc = b.doc AND b.pos BETWEEN a.pos + 1 AND a.pos + 3
       JOIN w c ON a.run_id = c.run_id AND a.doc = c.doc AND c.pos BETWEEN b.pos + 1 AND b.pos + 3),
f3 AS (SELECT run_id, pattern, count(DISTINCT doc) AS support FROM p3 JOIN n USING (run_id) GROUP BY run_id, pattern, n HAVING support >= 5 AND 10 * support >= n),
p4 AS (SELECT p3.run_id, p3.doc, p3.pattern || ' ' || c.ngram AS pattern FROM p3 JOIN f3 USING (run_id, pattern) JOIN w c ON p3.run_id = c.run_id AND p3.doc = c.doc AND c.pos BETWEEN p3.pos + 1 AND p3.pos + 3),
f4 AS (SELECT run_id, pattern, count(DISTINCT doc) AS support FROM p4 JOIN n USING (run_id) GROUP BY run_id, pattern, n HAVING support >= 5 AND 10 * support >= n),
r AS (SELECT * FROM f3 UNION ALL SELECT * FROM f4)
SELECT run_id, pattern FROM r""",
    "p4_found": _TOKENS + "SELECT ngram, mark FROM m WHERE mark IS NOT NULL",
    "p4_tokens": _TOKENS + "SELECT * FROM m",
    "p4_rules": """
WITH d AS (SELECT DISTINCT ngram, run_id, coalesce(step, 0) AS step, unnest(loc) AS doc FROM rule_t WHERE ngram IS NOT NULL AND run_id IS NOT NULL),
n AS (SELECT count(DISTINCT (run_id, doc)) AS n FROM d WHERE doc >= 0),
f AS (SELECT ngram, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT (run_id, doc)) AS BIGINT) AS documents FROM d WHERE doc >= 0 GROUP BY ngram)
SELECT ngram, occurrences, documents, CASE WHEN documents < 5 THEN 'rare' WHEN documents > 0.25 * n THEN 'common' END AS mark FROM f, n""",
    "p5_found": _GROUPS + "SELECT first_doc_id, doc_id AS copy_doc_id FROM g WHERE doc_id <> first_doc_id",
    "p5_counts": _GROUPS + "SELECT first_doc_id AS doc_id, count(*) AS copies FROM g GROUP BY first_doc_id",
}
SQL["p2_found"] = r"""
WITH a AS (SELECT DISTINCT doc_id, class_label AS l, example_sequence AS s, CASE WHEN split_name = 'train' THEN 1 WHEN split_name IN ('dev', 'test') THEN 2 END AS side,
    coalesce(regexp_full_match(class_label, '[\s\x{A0}\x{200B}]*[+-]?[0-9]{1,18}[\s\x{A0}\x{200B}]*'), false) AS li,
    coalesce(regexp_full_match(example_sequence, '[\s\x{A0}\x{200B}]*[+-]?[0-9]{1,18}[\s\x{A0}\x{200B}]*'), false) AS si FROM toy WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, side, lower(regexp_replace(CASE WHEN NOT li AND si THEN l ELSE s END, '[^\p{L}\p{Nd}]+', '', 'g')) AS t FROM a WHERE side IS NOT NULL),
c AS (SELECT t, row_number() OVER (ORDER BY t) AS c, bool_or(side = 1) AS tr, bool_or(side = 2) AS ev FROM x WHERE t IS NOT NULL GROUP BY t),
g AS (SELECT DISTINCT c, substr(t, CAST(i AS BIGINT), 6) AS g FROM c, range(1, greatest(2, length(t) - 4)) r(i)),
j AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM g a JOIN g b USING (g) JOIN c ca ON ca.c = a.c AND ca.tr JOIN c cb ON cb.c = b.c AND cb.ev GROUP BY ALL
    UNION SELECT a.c, b.c, 100 AS n FROM c a JOIN c b ON a.tr AND b.ev AND length(a.t) BETWEEN 9 AND 20 AND length(b.t) BETWEEN 9 AND 20),
v AS (SELECT j.a, j.b FROM j JOIN c x ON x.c = j.a JOIN c y ON y.c = j.b WHERE j.a = j.b OR (abs(length(x.t) - length(y.t)) <= floor(0.1 * greatest(length(x.t), length(y.t)) + 1e-9)
    AND n >= 0.1 * greatest(length(x.t), length(y.t)) AND levenshtein(x.t, y.t) <= floor(0.1 * greatest(length(x.t), length(y.t)) + 1e-9)))
SELECT DISTINCT least(p.doc_id, q.doc_id) AS doc_id_1, greatest(p.doc_id, q.doc_id) AS doc_id_2 FROM v JOIN c x ON x.c = v.a JOIN c y ON y.c = v.b JOIN x p ON p.t = x.t AND p.side = 1 JOIN x q ON q.t = y.t AND q.side = 2"""

SQL["p7_found"] = """
WITH t AS (SELECT DISTINCT doc_id, example_sequence AS s FROM toy WHERE doc_id IS NOT NULL AND length(example_sequence) >= 60),
w AS (SELECT doc_id, CAST(i AS BIGINT) AS i, substr(s, CAST(i + 1 AS BIGINT), 60) AS h FROM t, range(0, length(s) - 59) r(i)),
k AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 60 THEN 0 ELSE 1 END AS new FROM w WHERE h IN (SELECT h FROM k)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o)
SELECT doc_id, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 60 AS INTEGER) AS span_end FROM g GROUP BY doc_id, g.g"""

# tokens can't be counted in SQL: what must hold of the results is stated instead
SQL["p8_valid"] = "SELECT container_name, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, true AS whole, CAST(0 AS BIGINT) AS overfull, true AS tight FROM containers WHERE capacity_tokens > 0"
SQL["p9_valid"] = "SELECT source, round(sum(target_share), 6) AS target_share, true AS share_met, true AS repeats_kept FROM mix_targets WHERE target_share > 0 GROUP BY source"
SQL["p1_support"] = SQL["p1_found"].replace("SELECT run_id, pattern FROM r", "SELECT run_id, pattern, support FROM r")

SQL["p2_counts"] = (
    "WITH found AS (" + SQL["p2_found"] + """),
own AS (SELECT DISTINCT doc_id, split_name, source FROM toy WHERE split_name IN ('dev', 'test')),
per AS (SELECT o.doc_id, o.split_name, o.source, count(*) AS n FROM found f JOIN own o ON o.doc_id = f.doc_id_1 OR o.doc_id = f.doc_id_2 GROUP BY ALL)
SELECT split_name, source, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_pairs FROM per GROUP BY split_name, source"""
)
SQL["p7_share"] = (
    "WITH found AS (" + SQL["p7_found"] + """),
c AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS c FROM found GROUP BY doc_id),
o AS (SELECT doc_id, CAST(max(coalesce(length(example_sequence), 0)) AS BIGINT) AS n_chars FROM toy WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(c, 0) AS shared_chars, coalesce(coalesce(c, 0) / nullif(n_chars, 0), 0.0::DOUBLE) AS shared_share FROM o LEFT JOIN c USING (doc_id)"""
)
