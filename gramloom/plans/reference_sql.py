"""SQL of the queries in ``reference``, in DuckDB's dialect."""

from __future__ import annotations

_LINES = r"""
WITH v AS (SELECT DISTINCT line_id, regexp_replace(raw_line, '\r\z', '') AS value FROM toy_lines WHERE raw_line IS NOT NULL),
l AS (SELECT * FROM v WHERE value <> '' AND value NOT LIKE ';%'),
s AS (SELECT line_id, value, regexp_extract(value, '^([^\t ]*)', 1) AS class_label, CASE WHEN regexp_matches(value, '[\t ]') THEN regexp_replace(value, '^[^\t ]*[\t ]', '') END AS text FROM l)
"""

_DOCS = r"""
WITH d AS (SELECT DISTINCT doc_id, split_name, source, token_type,
    CASE WHEN TRY_CAST(regexp_extract(class_label, '^\s*([+-]?[0-9]+)\s*$', 1) AS HUGEINT) > 0 THEN 1 ELSE -1 END AS y, example_sequence AS text
  FROM toy WHERE doc_id IS NOT NULL AND example_sequence IS NOT NULL AND regexp_matches(class_label, '^\s*[+-]?[0-9]+\s*$'))
"""

_WORDS = _DOCS + r""",
a AS (SELECT doc_id, split_name, y, regexp_extract_all(text, '\S+') AS tok FROM d WHERE token_type = 'word'),
w AS (SELECT * FROM a WHERE split_name = 'train'),
t AS (SELECT doc_id, y, unnest(tok) AS token, generate_subscripts(tok, 1) - 1 AS pos FROM w)
"""

_ALL_WORDS = _WORDS + """,
ta AS (SELECT doc_id, unnest(tok) AS token, CAST(generate_subscripts(tok, 1) - 1 AS INTEGER) AS pos FROM a)
"""

_GRAMS = _WORDS + """,
g AS (SELECT n AS size, doc_id, y, array_to_string(tok[i:i + n - 1], ' ') AS pattern, tok[i + n - 1] AS last FROM
      (SELECT doc_id, y, tok, n, unnest(range(1, len(tok) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(tok) >= n)),
p AS (SELECT DISTINCT pattern, size, doc_id, y, last FROM g),
f AS (SELECT pattern, size, count(*) AS support FROM p GROUP BY ALL HAVING count(*) >= 5)
"""

_EVERY = _DOCS + r""",
w AS (SELECT doc_id, token_type, CASE WHEN token_type = 'word' THEN regexp_extract_all(text, '\S+') ELSE regexp_extract_all(text, '\S') END AS tok FROM d WHERE token_type IN ('word', 'char')),
t AS (SELECT doc_id, token_type, unnest(tok) AS token, generate_subscripts(tok, 1) - 1 AS pos FROM w)
"""

_EVERY_GRAMS = _EVERY + """,
g AS (SELECT n AS size, doc_id, token_type, array_to_string(tok[i:i + n - 1], ' ') AS pattern FROM
      (SELECT doc_id, token_type, tok, n, unnest(range(1, len(tok) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(tok) >= n)),
f AS (SELECT token_type, pattern, CAST(size AS INTEGER) AS size, count(DISTINCT doc_id) AS support FROM g GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)
"""

_STATE = _GRAMS + """,
k AS (SELECT token, CASE rn WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN -0.3::DOUBLE ELSE 0.2::DOUBLE END AS beta
      FROM (SELECT token, row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, token) AS rn FROM t GROUP BY token) WHERE rn <= 3),
h AS (SELECT doc_id, sum(beta) AS b FROM (SELECT DISTINCT doc_id, token FROM t) JOIN k USING (token) GROUP BY doc_id),
s AS (SELECT w.doc_id, w.y, coalesce(b, 0.0::DOUBLE) AS score FROM w LEFT JOIN h USING (doc_id)),
z AS (SELECT p.pattern, p.size, p.doc_id, s.y, s.score, -s.y / (1 + exp(s.y * s.score)) AS lg, CASE WHEN 1 - s.y * s.score > 0 THEN -2 * s.y * (1 - s.y * s.score) ELSE 0.0::DOUBLE END AS sg
      FROM p JOIN f USING (pattern, size) JOIN s USING (doc_id)),
q AS (SELECT pattern, size, count(*) AS support, sum(lg) AS lg, sum(sg) AS sg, sum(CASE WHEN y > 0 THEN lg ELSE 0.0::DOUBLE END) AS upos, sum(CASE WHEN y <= 0 THEN lg ELSE 0.0::DOUBLE END) AS uneg FROM z GROUP BY ALL),
r AS (SELECT q.*, k.beta, 0.2::DOUBLE * sign(k.beta) + 0.8::DOUBLE * k.beta AS shift FROM q LEFT JOIN k ON q.size = 1 AND q.pattern = k.token),
b AS (SELECT pattern, size, support, greatest(abs(upos), abs(uneg), abs(upos + coalesce(shift, 0)), abs(uneg + coalesce(shift, 0))) AS bound FROM r)
"""

_BEST = """,
og AS (SELECT pattern, size, count(*) AS support, -0.5::DOUBLE * CAST(sum(y) AS DOUBLE) AS gradient FROM p WHERE last <> '*' GROUP BY pattern, size HAVING count(*) >= 5),
o AS (SELECT * FROM og ORDER BY abs(gradient) DESC, size, string_split(pattern, ' ') LIMIT 1),
c AS (SELECT DISTINCT doc_id FROM p JOIN o USING (pattern, size))
"""

_MODEL = _GRAMS + """,
m AS (SELECT pattern, round(CAST(sum(y) AS DOUBLE) / count(*) - (SELECT avg(y) FROM w), 6) AS weight FROM p JOIN f USING (pattern, size) WHERE size <= 2 GROUP BY pattern),
x AS (SELECT doc_id, y, tok FROM a WHERE split_name = 'test'),
xg AS (SELECT DISTINCT doc_id, array_to_string(tok[i:i + n - 1], ' ') AS pattern FROM (SELECT doc_id, tok, n, unnest(range(1, len(tok) - n + 2)) AS i FROM x, (VALUES (1), (2)) v(n) WHERE len(tok) >= n)),
xs AS (SELECT doc_id, sum(weight) AS s, count(*) AS n FROM xg JOIN m USING (pattern) GROUP BY doc_id),
e AS (SELECT x.doc_id, x.y, round(coalesce(s, 0.0::DOUBLE), 6) AS score, coalesce(n, 0) AS n_matched FROM x LEFT JOIN xs USING (doc_id)),
cf AS (SELECT CAST(count(*) FILTER (y > 0 AND score > 0) AS BIGINT) AS tp, CAST(count(*) FILTER (y <= 0 AND score > 0) AS BIGINT) AS fp, CAST(count(*) FILTER (y > 0 AND score <= 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y <= 0 AND score <= 0) AS BIGINT) AS tn FROM e),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec, coalesce(tn / nullif(tn + fp, 0), 0.0) AS spec FROM cf),
ms AS (SELECT tp, fp, fn, tn, round(100 * (tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy, round(100 * (fp + fn) / nullif(tp + tn + fp + fn, 0), 6) AS error, round(100 * prec, 6) AS precision, round(100 * rec, 6) AS recall,
    round(100 * coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1, round(100 * spec, 6) AS specificity, round(100 * rec, 6) AS sensitivity, round(100 * coalesce(2 * spec * rec / nullif(spec + rec, 0), 0), 6) AS fss,
    round(50 * (fn / nullif(tp + fn, 0) + fp / nullif(fp + tn, 0)), 6) AS balanced_error FROM pr),
ps AS (SELECT score, CAST(count(*) FILTER (y > 0) AS BIGINT) AS pp, CAST(count(*) FILTER (y <= 0) AS BIGINT) AS nn FROM e GROUP BY score),
cu AS (SELECT *, CAST(sum(pp) OVER (ORDER BY score DESC) AS BIGINT) AS cp, CAST(sum(nn) OVER (ORDER BY score DESC) AS BIGINT) AS cn, CAST(sum(pp) OVER (ORDER BY score) AS BIGINT) AS lp, CAST(sum(nn) OVER (ORDER BY score) AS BIGINT) AS ln, lead(score) OVER (ORDER BY score) AS higher,
    CAST(sum(pp) OVER () AS BIGINT) AS ap, CAST(sum(nn) OVER () AS BIGINT) AS an FROM ps),
au AS (SELECT round(100 * coalesce(sum(nn * (cp - pp / 2.0::DOUBLE)) / nullif(max(ap) * max(an), 0), 0), 6) AS auc FROM cu),
a5 AS (SELECT round(100 * coalesce(sum((least(cn, 50) - least(cn - nn, 50)) * ((cp - pp) + CASE WHEN cn >= 50 AND an > 50 THEN ap ELSE cp END) / 2.0::DOUBLE) / nullif(max(ap) * 50, 0), 0), 6) AS auc50 FROM cu WHERE least(cn - nn, 50) < 50),
sw AS (SELECT (score + higher) / 2 AS threshold, lp + an - ln AS errors FROM cu WHERE higher IS NOT NULL
       UNION ALL SELECT -1.7976931348623157e308, max(an) FROM cu UNION ALL SELECT max(score) + 1, max(ap) FROM cu),
tu AS (SELECT threshold, errors FROM sw ORDER BY errors, threshold LIMIT 1)
"""

_RUNS = """
WITH bl AS (SELECT DISTINCT block_id, run_id, ngram, loc FROM space_t WHERE ngram IS NOT NULL AND run_id IS NOT NULL AND len(loc) > 0 AND ngram_size = 1),
en AS (SELECT block_id, run_id, ngram, loc, unnest(loc) AS v, generate_subscripts(loc, 1) AS i FROM bl),
oc AS (SELECT run_id, ngram, v AS pos, -loc[max(CASE WHEN v < 0 THEN i END) OVER (PARTITION BY block_id ORDER BY i)] - 1 AS doc FROM en),
u AS (SELECT DISTINCT run_id, doc, pos, ngram FROM oc WHERE pos >= 0 AND doc IS NOT NULL),
rd AS (SELECT run_id, CAST(doc AS INTEGER) AS doc, list(ngram ORDER BY pos, ngram) AS tok FROM u GROUP BY run_id, doc),
mt AS (SELECT run_id, doc, feature_id, pattern, tokens, weight, list_contains(tokens, '*') AS gapped FROM
       (SELECT rd.run_id, rd.doc, rd.tok, p.feature_id, p.pattern, p.tokens, p.weight, unnest(range(1, len(rd.tok) - len(p.tokens) + 2)) AS i FROM rd JOIN predictors p ON rd.run_id = p.run_id AND len(rd.tok) >= len(p.tokens))
       WHERE list_bool_and(list_transform(list_zip(tok[i:i + len(tokens) - 1], tokens), lambda z: z[2] = '*' OR z[1] = z[2]))),
md AS (SELECT DISTINCT run_id, doc, feature_id, pattern, weight FROM mt),
sc AS (SELECT rd.run_id, rd.doc, coalesce(s, 0.0::DOUBLE) - 0.05 AS score, coalesce(n, 0) AS n_matched FROM rd LEFT JOIN (SELECT run_id, doc, sum(weight) AS s, count(*) AS n FROM md GROUP BY ALL) USING (run_id, doc))
"""

_STEPS = """
WITH st AS (SELECT * FROM model_steps WHERE delta IS NOT NULL AND pattern IS NOT NULL),
ag AS (SELECT run_id, pattern, 2 * sum(delta) AS total FROM st GROUP BY ALL),
sz AS (SELECT run_id, sum(abs(delta)) AS l1, sum(delta) AS s FROM st GROUP BY run_id),
nm AS (SELECT ag.run_id, ag.pattern, ag.total / nullif(sz.l1, 0) AS weight FROM ag JOIN sz USING (run_id))
"""


def _support(sizes: str) -> str:
    return _EVERY_GRAMS + f"SELECT token_type, pattern, size, support FROM f WHERE size IN ({sizes})"


def _grams(n: int) -> str:
    return _EVERY_GRAMS + f"SELECT token_type, pattern, count(*) AS n, count(DISTINCT doc_id) AS support FROM g WHERE size = {n} GROUP BY token_type, pattern"


def _places(condition: str) -> str:
    return _RUNS + f"SELECT run_id, doc, feature_id, count(*) AS n FROM mt WHERE {condition} GROUP BY run_id, doc, feature_id"


_GAPPED = (
    _EVERY
    + """,
r AS (SELECT n, doc_id, token_type, tok[i:i + n - 1] AS win FROM (SELECT doc_id, token_type, tok, n, unnest(range(1, len(tok) - n + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(n) WHERE len(tok) >= n)),
fm AS (SELECT n, doc_id, token_type, array_to_string(win, ' ') AS pattern FROM r
   UNION ALL SELECT n, doc_id, token_type, win[1] || ' * ' || win[3] FROM r WHERE n = 3
   UNION ALL SELECT n, doc_id, token_type, win[1] || ' * ' || win[3] || ' ' || win[4] FROM r WHERE n = 4
   UNION ALL SELECT n, doc_id, token_type, win[1] || ' ' || win[2] || ' * ' || win[4] FROM r WHERE n = 4)
SELECT token_type, pattern, CAST(n AS INTEGER) AS size, count(DISTINCT doc_id) AS support FROM fm GROUP BY token_type, pattern, n HAVING count(DISTINCT doc_id) >= 5"""
)

_LOSS = "greatest(-y * ({s}), 0) + ln(1 + exp(-abs(y * ({s}))))"

SQL = {
    "src_labelled_docs": _LINES + r"SELECT line_id, class_label, CASE WHEN regexp_matches(class_label, '^\s*\+?0*[1-9]') THEN 1 ELSE -1 END AS y, text FROM s WHERE text IS NOT NULL",
    "src_filter_comments": _LINES + "SELECT line_id, value FROM l",
    "src_strip_cr": _LINES + "SELECT line_id, value FROM v",
    "src_test_docs": _DOCS + "SELECT doc_id, token_type, y, text FROM d WHERE split_name = 'test'",
    "tok_word_test": _ALL_WORDS + "SELECT doc_id, pos, token FROM ta WHERE doc_id IN (SELECT doc_id FROM a WHERE split_name = 'test')",
    "learn_valid": "SELECT true AS losses_fall, true AS loss_agrees, true AS best_found, true AS stopped",
    "steps_files": "SELECT run_id, round(delta, 6) AS delta, pattern FROM model_steps WHERE delta IS NOT NULL AND pattern IS NOT NULL",
    "model_files": _STEPS + "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY pattern) - 1 AS INTEGER) AS feature_id, pattern, CAST(len(string_split(pattern, ' ')) AS INTEGER) AS n_tokens, round(weight, 6) AS weight FROM nm",
    "model_trie": """WITH n AS (SELECT run_id, tokens, feature_id, unnest(range(1, len(tokens) + 1)) AS depth FROM predictors)
SELECT run_id, array_to_string(tokens[1:depth], ' ') AS prefix, CAST(depth AS INTEGER) AS depth, min(CASE WHEN depth = len(tokens) THEN feature_id END) AS feature_id FROM n GROUP BY run_id, prefix, depth""",
    "eval_ranked": _MODEL + "SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM e",
    "line_search_refine": _GRAMS + _BEST + """,
h AS (SELECT CAST(sum(CASE WHEN w.y > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN w.y > 0 THEN 0 ELSE 1 END) AS DOUBLE) AS n FROM c JOIN w USING (doc_id)),
s0 AS (SELECT p, n, CASE WHEN p > n THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM h),
b AS (WITH RECURSIVE r(i, lo, hi, p, n, sg) AS (SELECT 0, 0.0::DOUBLE, 64.0::DOUBLE, p, n, sg FROM s0
    UNION ALL SELECT i + 1, CASE WHEN d < 0 THEN m ELSE lo END, CASE WHEN d < 0 THEN hi ELSE m END, p, n, sg
    FROM (SELECT *, (lo + hi) / 2 AS m, sg * (-p / (1 + exp(sg * (lo + hi) / 2)) + n / (1 + exp(-sg * (lo + hi) / 2))) + 0.2 + 0.8 * (lo + hi) / 2 AS d FROM r) WHERE i < 60) SELECT * FROM r WHERE i = 60)
SELECT round(sg * (lo + hi) / 2, 4) AS step FROM b""",
    "src_split_label": _LINES + "SELECT line_id, class_label, text FROM s",
    "class_counts": _DOCS + "SELECT count(*) AS n_docs, CAST(count(*) FILTER (y > 0) AS BIGINT) AS n_positive, CAST(count(*) FILTER (y <= 0) AS BIGINT) AS n_negative FROM d",
    "tok_char": _DOCS + r", c AS (SELECT doc_id, regexp_extract_all(text, '\S') AS tok FROM d WHERE token_type = 'char' AND NOT regexp_matches(regexp_replace(text, '\s+\z', ''), '\s')) SELECT doc_id, CAST(generate_subscripts(tok, 1) - 1 AS INTEGER) AS pos, unnest(tok) AS token FROM c",
    "tok_char_nospace": _DOCS + r", c AS (SELECT doc_id, regexp_extract_all(text, '\S') AS tok FROM d WHERE token_type = 'char') SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, '') AS joined FROM c",
    "tok_word": _ALL_WORDS + "SELECT doc_id, pos, token FROM ta",
    "vocab": _EVERY + "SELECT token_type, token, count(*) AS n_tokens, count(DISTINCT doc_id) AS support FROM t GROUP BY token_type, token",
    "inverted_index": _EVERY + "SELECT token_type, token, doc_id, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_pos FROM t GROUP BY token_type, token, doc_id",
    "unigram_support": _EVERY + "SELECT token_type, token, count(DISTINCT doc_id) AS support FROM t GROUP BY token_type, token",
    "unigram_minsup": _EVERY + "SELECT token_type, token, count(DISTINCT doc_id) AS support FROM t GROUP BY token_type, token HAVING count(DISTINCT doc_id) >= 5",
    "ngram_bigrams": _grams(2),
    "ngram_trigrams": _grams(3),
    "ngram_topk_support": _support("1, 2, 3") + " QUALIFY row_number() OVER (PARTITION BY token_type ORDER BY support DESC, size, pattern) <= 20",
    "ngram_frequent": _support("1, 2, 3"),
    "ngram_len_window": _support("2, 3"),
    "ngram_gapped": _GAPPED,
    "ngram_dfs_order": _EVERY_GRAMS + "SELECT token_type, row_number() OVER (PARTITION BY token_type ORDER BY string_split(pattern, ' ')) AS rank, pattern, size, support FROM f",
    "grad_logistic": _STATE + "SELECT pattern, CAST(size AS INTEGER) AS size, round(lg, 6) AS gradient FROM q",
    "grad_sqhinge": _STATE + "SELECT pattern, CAST(size AS INTEGER) AS size, round(sg, 6) AS gradient FROM q",
    "grad_bounds": _STATE + "SELECT pattern, CAST(size AS INTEGER) AS size, support, round(upos, 6) AS upos, round(uneg, 6) AS uneg FROM q",
    "grad_regularised": _STATE + "SELECT pattern, CAST(size AS INTEGER) AS size, round(lg + coalesce(shift, 0), 6) AS gradient FROM r",
    "prefix_bound": _STATE + "SELECT pattern, CAST(size AS INTEGER) AS size, round(bound, 6) AS bound FROM b",
    "prune_survivors": _STATE + "SELECT pattern, CAST(size AS INTEGER) AS size, round(bound, 6) AS bound FROM b WHERE bound > 5 AND support >= 5",
    "best_ngram": _GRAMS + _BEST + "SELECT pattern, CAST(size AS INTEGER) AS size, support, gradient FROM o",
    "best_ngram_sqhinge": _GRAMS + _BEST + "SELECT pattern, CAST(size AS INTEGER) AS size, support, 4 * gradient AS gradient FROM o",
    "initial_loss": _WORDS + "SELECT round(count(*) * ln(2), 6) AS logistic, CAST(count(*) AS DOUBLE) AS squared_hinge FROM w",
    "loss_logistic": _STATE + f"SELECT round(sum({_LOSS.format(s='score')}), 6) AS loss FROM s",
    "loss_sqhinge": _STATE + "SELECT round(sum(pow(greatest(1 - y * score, 0), 2)), 6) AS loss FROM s",
    "penalty_elastic_net": _STEPS + "SELECT run_id, round(0.2 * sum(abs(total / 2)) + 0.4 * sum(total * total / 4), 6) AS penalty FROM ag GROUP BY run_id",
    "line_search_grid": _GRAMS + _BEST + f""", sp AS (SELECT CAST(i AS INTEGER) AS step_no, 0.001::DOUBLE * pow(2, i) AS step FROM range(10) r(i)),
ln2 AS (SELECT w.doc_id, w.y, CASE WHEN c.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has FROM w LEFT JOIN c USING (doc_id))
SELECT step_no, round(step, 6) AS step, round(sum({_LOSS.format(s='step * has')}), 6) AS loss FROM ln2, sp GROUP BY step_no, step""",
    "state_after_step": _STATE + _BEST + "SELECT s.doc_id, s.y, round(s.score + CASE WHEN c.doc_id IS NULL THEN 0.0::DOUBLE ELSE -0.1::DOUBLE END, 6) AS score FROM s LEFT JOIN c USING (doc_id)",
    "convergence_rate": _STATE + _BEST + "SELECT round(sum(CASE WHEN c.doc_id IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END) / (1 + sum(abs(s.score + CASE WHEN c.doc_id IS NULL THEN 0.0::DOUBLE ELSE -0.1::DOUBLE END))), 6) AS rate FROM s LEFT JOIN c USING (doc_id)",
    "model_aggregate": _STEPS + "SELECT run_id, pattern, round(total, 6) AS total FROM ag",
    "model_normalise": _STEPS + "SELECT run_id, pattern, round(weight, 6) AS weight FROM nm",
    "model_bias": _STEPS + "SELECT run_id, round(-s / nullif(l1, 0), 6) AS bias FROM sz",
    "model_norms": _STEPS + "SELECT sz.run_id, round(sz.l1, 6) AS l1, round(sqrt(sum(total * total)), 6) AS l2 FROM sz JOIN ag USING (run_id) GROUP BY sz.run_id, sz.l1",
    "model_ids": _STEPS + "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY pattern) - 1 AS INTEGER) AS feature_id, pattern, CAST(len(string_split(pattern, ' ')) AS INTEGER) AS n_tokens FROM ag",
    "model_predictors": _STEPS + "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY round(weight, 6) DESC, pattern) AS INTEGER) AS place, pattern, round(weight, 6) AS weight FROM nm",
    "match_unigrams": _places("len(tokens) = 1 AND NOT gapped"),
    "match_ngrams": _places("len(tokens) > 1 AND NOT gapped"),
    "match_gapped": _places("gapped"),
    "match_distinct": _RUNS + "SELECT run_id, doc, feature_id FROM md",
    "score_docs": _RUNS + "SELECT run_id, doc, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS prob, n_matched FROM sc",
    "predict_label": _RUNS + "SELECT run_id, doc, CASE WHEN round(score, 6) > 0 THEN 1 ELSE -1 END AS predicted FROM sc",
    "oov_docs": _RUNS + "SELECT run_id, doc FROM sc WHERE n_matched = 0",
    "explain_rules": _RUNS + "SELECT run_id, doc, string_agg(pattern || ' ' || printf('%.6f', weight), '; ' ORDER BY pattern) AS rules FROM md GROUP BY run_id, doc",
    "feature_ids": _RUNS + "SELECT run_id, doc, string_agg((feature_id + 1) || ':1.0', ' ' ORDER BY feature_id) AS features FROM md GROUP BY run_id, doc",
    "prefix_search": _RUNS + "SELECT DISTINCT rd.run_id, rd.doc, p.pattern FROM rd JOIN (SELECT DISTINCT tokens, pattern FROM predictors WHERE NOT list_contains(tokens, '*')) p ON len(rd.tok) >= len(p.tokens) AND rd.tok[1:len(p.tokens)] = p.tokens",
    "eval_confusion": _MODEL + "SELECT tp, fp, fn, tn FROM cf",
    "eval_accuracy": _MODEL + "SELECT accuracy, error FROM ms",
    "eval_prf": _MODEL + "SELECT precision, recall, f1 FROM ms",
    "eval_fss": _MODEL + "SELECT specificity, sensitivity, fss FROM ms",
    "eval_balanced_error": _MODEL + "SELECT balanced_error FROM ms",
    "eval_auc": _MODEL + "SELECT auc FROM au",
    "eval_auc50": _MODEL + "SELECT auc50 FROM a5",
    "eval_report": _MODEL + "SELECT ms.*, auc, auc50, (SELECT CAST(count(*) AS BIGINT) FROM e WHERE n_matched = 0) AS oov_docs FROM ms, au, a5",
    "tune_threshold": _MODEL + "SELECT round(threshold, 6) AS threshold, errors FROM tu",
    "tune_report": _MODEL + "SELECT auc, round(100 - auc, 6) AS auc_error, errors AS min_errors, round(100 * (1 - errors / (SELECT count(*) FROM e)), 6) AS accuracy, round(threshold, 6) AS best_threshold FROM tu, au",
}
