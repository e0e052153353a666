"""Queries on sequences, patterns, gradients, models, matching and evaluation, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.functions.losses import LOGISTIC, SQUARED_HINGE, penalty
from gramloom.functions.tokens import chars_no_space, is_char_text, shown, words
from gramloom.operators import evaluate, gradient, learner, linesearch, matcher, model, patterns, postings
from gramloom.plans.reference_sql import SQL  # noqa: F401
from gramloom.sources import models, sequences
from gramloom.tables import cut, numbered, once, shared_folder, table

MINSUP, STEPS = 5, [0.001 * 2**i for i in range(10)]
BETAS = (0.4, -0.3, 0.2)


# --- inputs -------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "toy_lines"), "line_id").select("line_id", F.col("raw_line").alias("value"))


def _docs(spark: SparkSession, folder: str, kind: str = "word", split: str | None = "train") -> DataFrame:
    docs = sequences.labelled_docs(table(spark, folder, "toy"), kind)
    if split:
        docs = docs.where(F.col("split_name") == split)
    return docs.withColumn("tokens", words(F.col("text")) if kind == "word" else chars_no_space(F.col("text")))


def _both(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for the word sequences and for the char sequences, each of all splits, with their ``token_type``."""
    word, char = (make(_docs(spark, folder, kind, None)).withColumn("token_type", F.lit(kind)) for kind in ("word", "char"))
    return word.unionByName(char)


def _pairs(docs: DataFrame, maxpat: int = 3) -> DataFrame:
    return patterns.pattern_docs(docs, 1, maxpat, MINSUP)


def _zero(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "y", F.lit(0.0).alias("score"))


def _coef(docs: DataFrame) -> DataFrame:
    """A small model: the three tokens of most support, with fixed coefficients."""
    top = patterns.vocabulary(docs).orderBy(F.desc("support"), "token").limit(len(BETAS))
    ranked = patterns.first_visited(top.withColumn("size", -F.col("support")).withColumn("pattern", F.array("token")), len(BETAS))
    return ranked.select("token", "pattern", F.element_at(F.array(*map(F.lit, BETAS)), F.col("rank").cast("int")).alias("beta"))


def _state(docs: DataFrame) -> DataFrame:
    """The scores of the documents under the small model."""
    held = patterns.positions(docs).select("doc_id", "token").join(F.broadcast(_coef(docs)), "token").select("doc_id", "token", "beta").distinct()
    sums = held.groupBy("doc_id").agg(F.sum("beta").alias("b"))
    return docs.select("doc_id", "y").join(sums, "doc_id", "left").select("doc_id", "y", F.coalesce("b", F.lit(0.0)).alias("score"))


def _best(docs: DataFrame, objective: int = LOGISTIC) -> DataFrame:
    return gradient.best(gradient.gradients(_pairs(docs), _zero(docs), objective))


def _marked(docs: DataFrame, state: DataFrame) -> DataFrame:
    """The state with ``has`` for the best pattern."""
    pairs = cut(_pairs(docs))
    top = gradient.best(gradient.gradients(pairs, _zero(docs)))
    return linesearch.mark(state, pairs.join(F.broadcast(top.select("pattern")), "pattern", "left_semi").select("doc_id"))


def _association(spark: SparkSession, folder: str) -> DataFrame:
    """A model of all frequent words and word pairs: mean label of the documents that hold one, less the mean label of all."""
    docs = _docs(spark, folder)
    mean = docs.agg(F.avg("y").alias("mean"))
    grads = _pairs(docs, 2).join(docs.select("doc_id", "y"), "doc_id").groupBy("pattern").agg((F.sum("y") / F.count("*")).alias("m"))
    weighted = grads.crossJoin(F.broadcast(mean)).select(shown(F.col("pattern")).alias("pattern"), F.round(F.col("m") - F.col("mean"), 6).alias("weight"))
    return weighted.select("pattern", F.split("pattern", " ").alias("tokens"), "weight", F.lit(0).alias("feature_id"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, y, score, n_matched) of the test documents."""
    docs = _docs(spark, folder, "word", "test")
    # the model holds no wildcards of its own: a literal * in it is a word
    grams = patterns.ngrams(docs, 1).unionByName(patterns.ngrams(docs, 2)).distinct()
    found = grams.withColumnRenamed("pattern", "tokens").join(_association(spark, folder), "tokens").select("doc_id", "weight")
    scored = matcher.scores(docs, found)
    return docs.select("doc_id", "y").join(scored, "doc_id").withColumn("score", F.round("score", 6))


def _run_docs(spark: SparkSession, folder: str) -> DataFrame:
    return postings.documents_of(table(spark, folder, "space_t"))


def _run_matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = cut(_run_docs(spark, folder))
    return docs, matcher.matches(docs, table(spark, folder, "predictors"), ("run_id", "doc"), ("run_id",))


def _rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c, kind in frame.dtypes if kind == "double"})


# --- sources ------------------------------------------------------------------------------------------------------


def src_labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as labelled documents."""
    return sequences.parse_labelled(_lines(spark, folder)).select("line_id", "class_label", "y", "text")


def src_filter_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return sequences.record_lines(_lines(spark, folder)).select("line_id", "value")


def src_split_label(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of the first blank or tab; the second is null where there is none."""
    label, text = sequences.split_first(F.col("value"))
    return sequences.record_lines(_lines(spark, folder)).select("line_id", label.alias("class_label"), text.alias("text"))


def src_strip_cr(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without one closing carriage return."""
    return _lines(spark, folder).where("value is not null").select("line_id", F.regexp_replace("value", r"\r\z", "").alias("value"))


def src_test_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the test split, as the classifier reads them."""
    docs = sequences.labelled_docs(table(spark, folder, "toy"))
    return docs.where("split_name = 'test'").select("doc_id", "token_type", "y", "text")


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per class."""
    return sequences.class_counts(sequences.labelled_docs(table(spark, folder, "toy")))


# --- tokens -------------------------------------------------------------------------------------------------------


def tok_char(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of the char sequences that have no white space inside."""
    docs = sequences.labelled_docs(table(spark, folder, "toy"), "char").where(is_char_text(F.col("text")))
    return patterns.positions(docs.withColumn("tokens", chars_no_space(F.col("text"))))


def tok_char_nospace(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of all char sequences, white space dropped: number and order-sensitive checks per document."""
    docs = _docs(spark, folder, "char", None)
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "").alias("joined"))


def tok_word(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the word sequences with their places."""
    return patterns.positions(_docs(spark, folder, "word", None))


def tok_word_test(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the test split, as the classifier reads them."""
    return patterns.positions(_docs(spark, folder, "word", "test"))


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tokens of both kinds with occurrences and documents."""
    return _both(spark, folder, patterns.vocabulary)


# --- index and candidates: all splits, words and characters apart -----------------------------------------------------


def inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per document."""
    return _both(spark, folder, patterns.inverted_index)


def unigram_support(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per token."""
    return vocab(spark, folder).select("token_type", "token", "support")


def unigram_minsup(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens in at least five documents."""
    return unigram_support(spark, folder).where(F.col("support") >= MINSUP)


def _grams(spark: SparkSession, folder: str, size: int) -> DataFrame:
    def make(docs: DataFrame) -> DataFrame:
        # occurrences are counted within documents first
        per = patterns.ngrams(docs, size).groupBy(shown(F.col("pattern")).alias("pattern"), "doc_id").agg(F.count("*").alias("n"))
        return per.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("support"))

    return _both(spark, folder, make)


def ngram_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbouring tokens."""
    return _grams(spark, folder, 2)


def ngram_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of neighbouring tokens."""
    return _grams(spark, folder, 3)


def _shown(pairs: DataFrame) -> DataFrame:
    return learner.support_of(pairs)


def ngram_topk_support(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 patterns of most support among words, and among characters."""
    return _both(spark, folder, lambda docs: _shown(_pairs(docs)).orderBy(F.desc("support"), "size", "pattern").limit(20))


def ngram_frequent(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent patterns of up to three tokens."""
    return _both(spark, folder, lambda docs: _shown(_pairs(docs)))


def ngram_len_window(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent patterns of two or three tokens; single tokens still take part in growing them."""
    return _both(spark, folder, lambda docs: _shown(patterns.pattern_docs(docs, 2, 3, MINSUP)))


def ngram_gapped(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent patterns of up to four tokens with at most one wildcard in a row."""
    return _both(spark, folder, lambda docs: _shown(patterns.pattern_docs(docs, 1, 4, MINSUP, 1)))


def ngram_dfs_order(spark: SparkSession, folder: str) -> DataFrame:
    """All frequent patterns in the order of a depth-first search, words and characters each from 1 on."""
    counted = lambda docs: _pairs(docs).groupBy("pattern", "size").agg(F.count("*").alias("support"))
    return _both(spark, folder, lambda docs: patterns.ranked(counted(docs)).select("rank", shown(F.col("pattern")).alias("pattern"), "size", "support"))


# --- gradients: learning takes the training split, here its words --------------------------------------------------


def _named(grads: DataFrame) -> DataFrame:
    return _rounded(grads.withColumn("pattern", shown(F.col("pattern"))))


def grad_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic gradient of every frequent pattern at the small model's scores."""
    docs = _docs(spark, folder)
    return _named(gradient.gradients(_pairs(docs), _state(docs))).select("pattern", "size", "gradient")


def grad_sqhinge(spark: SparkSession, folder: str) -> DataFrame:
    """Squared-hinge gradient of every frequent pattern."""
    docs = _docs(spark, folder)
    return _named(gradient.gradients(_pairs(docs), _state(docs), SQUARED_HINGE)).select("pattern", "size", "gradient")


def grad_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of both classes that bound the gradients of extensions."""
    docs = _docs(spark, folder)
    return _named(gradient.gradients(_pairs(docs), _state(docs))).select("pattern", "size", "support", "upos", "uneg")


def grad_regularised(spark: SparkSession, folder: str) -> DataFrame:
    """Gradients with the penalty's slope for patterns in the model."""
    docs = _docs(spark, folder)
    grads = gradient.regularised(gradient.gradients(_pairs(docs), _state(docs)), _coef(docs))
    return _named(grads).select("pattern", "size", "gradient")


def _bounded(docs: DataFrame) -> DataFrame:
    return gradient.prefix_bounds(gradient.gradients(_pairs(docs), _state(docs)), _coef(docs))


def prefix_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The largest gradient that a pattern or an extension can have."""
    return _named(_bounded(_docs(spark, folder))).select("pattern", "size", "bound")


def prune_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns worth extending against a best gradient of 5."""
    return _named(gradient.survivors(_bounded(_docs(spark, folder)), 5.0, MINSUP)).select("pattern", "size", "bound")


def best_ngram(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern of largest logistic gradient with no model yet."""
    return _named(_best(_docs(spark, folder))).select("pattern", "size", "support", "gradient")


def best_ngram_sqhinge(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern of largest squared-hinge gradient with no model yet."""
    return _named(_best(_docs(spark, folder), SQUARED_HINGE)).select("pattern", "size", "support", "gradient")


# --- optimiser ------------------------------------------------------------------------------------------------------


def initial_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Both losses with no model."""
    state = _zero(_docs(spark, folder))
    return _rounded(linesearch.total_loss(state).withColumnRenamed("loss", "logistic").crossJoin(linesearch.total_loss(state, SQUARED_HINGE).withColumnRenamed("loss", "squared_hinge")))


def loss_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic loss at the small model's scores."""
    return _rounded(linesearch.total_loss(_state(_docs(spark, folder))))


def loss_sqhinge(spark: SparkSession, folder: str) -> DataFrame:
    """Squared-hinge loss at the small model's scores."""
    return _rounded(linesearch.total_loss(_state(_docs(spark, folder)), SQUARED_HINGE))


def penalty_elastic_net(spark: SparkSession, folder: str) -> DataFrame:
    """Elastic-net penalty of each run's merged steps, cost 1, a fifth on the L1 part."""
    total = model.aggregate_steps(table(spark, folder, "model_steps"), ("run_id",))
    return _rounded(total.groupBy("run_id").agg(penalty(F.col("total") / 2, 1.0, 0.2).alias("penalty")))


def line_search_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Losses along doublings of a step for the best pattern, in one pass."""
    docs = _docs(spark, folder)
    return _rounded(linesearch.grid(_marked(docs, _zero(docs)), STEPS))


def line_search_refine(spark: SparkSession, folder: str) -> DataFrame:
    """The step that minimises the penalised loss along the best pattern."""
    docs = _docs(spark, folder)
    top = _best(docs).first()
    if top is None:
        return spark.createDataFrame([], "step double")
    step = linesearch.exact_step(linesearch.Losses(_marked(docs, _zero(docs))), top["gradient"], lambda s: 0.2 * abs(s) + 0.4 * s * s)
    return spark.createDataFrame([(round(step, 4),)], "step double")


def state_after_step(spark: SparkSession, folder: str) -> DataFrame:
    """Scores after a step of -0.1 on the best pattern."""
    docs = _docs(spark, folder)
    return _rounded(linesearch.after_step(_marked(docs, _state(docs)), -0.1))


def convergence_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Relative change of scores by that step."""
    docs = _docs(spark, folder)
    old = _state(docs)
    return _rounded(linesearch.convergence(old, linesearch.after_step(_marked(docs, old), -0.1)))


#: What was learned in this application: a list of steps for each folder and kind.
_LEARNED: dict[tuple[str, str, str], learner.Learned] = {}


def _learned(spark: SparkSession, folder: str, kind: str) -> learner.Learned:
    """Learned up to the stop tests, from patterns of any length; only ``MINSUP`` prunes. Queries of one application that show different sides of it share a run."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _LEARNED:
        _LEARNED[key] = learner.learn(_docs(spark, folder, kind), learner.Params(token=kind, minsup=MINSUP))
    return _LEARNED[key]


def learn_word(spark: SparkSession, folder: str) -> DataFrame:
    """All steps of the learner on words."""
    return _rounded(_learned(spark, folder, "word").steps_frame(spark, "word"))


def learn_char(spark: SparkSession, folder: str) -> DataFrame:
    """All steps of the learner on characters."""
    return _rounded(_learned(spark, folder, "char").steps_frame(spark, "char"))


def learn_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all iterations of the learner on words."""
    return _rounded(_learned(spark, folder, "word").log_frame(spark))


def learn_valid(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the steps learned on words."""
    held = learner.checked(_docs(spark, folder), _learned(spark, folder, "word"), learner.Params(token="word", minsup=MINSUP))
    return spark.createDataFrame([tuple(held.values())], ", ".join(f"{name} boolean" for name in held))


# --- models ---------------------------------------------------------------------------------------------------------


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "model_steps")


def steps_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's steps, written as text and read again."""
    path = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    models.write_steps(_steps(spark, folder).where("delta is not null and pattern is not null"), path, "run_id")
    return models.read_steps(spark, path).select(F.col("run_id").cast("bigint").alias("run_id"), F.round("delta", 6).alias("delta"), "pattern")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's model, written and read again."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    models.write_model(model.make_model(_steps(spark, folder), ("run_id",)), path)
    return _rounded(models.read_model(spark, path).select("run_id", "feature_id", "pattern", F.size("tokens").alias("n_tokens"), "weight"))


def model_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefixes of each run's patterns."""
    nodes = matcher.trie(table(spark, folder, "predictors"), ("run_id",))
    return nodes.select("run_id", F.array_join("prefix", " ").alias("prefix"), "depth", "feature_id")


def model_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Merged steps of each run."""
    return _rounded(model.aggregate_steps(_steps(spark, folder), ("run_id",)))


def model_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of each run's model."""
    return _rounded(model.normalise(_steps(spark, folder), ("run_id",)))


def model_bias(spark: SparkSession, folder: str) -> DataFrame:
    """Bias of each run's model."""
    return _rounded(model.bias(_steps(spark, folder), ("run_id",)))


def model_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Norms of each run's steps."""
    return _rounded(model.norms(_steps(spark, folder), ("run_id",)))


def model_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each run's patterns in byte order."""
    return model.make_model(_steps(spark, folder), ("run_id",)).select("run_id", "feature_id", "pattern", F.size("tokens").alias("n_tokens"))


def model_predictors(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's model by falling weight."""
    made = _rounded(model.make_model(_steps(spark, folder), ("run_id",)).drop("tokens"))
    return made.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("weight"), "pattern")).alias("place"), "pattern", "weight")


# --- matching -------------------------------------------------------------------------------------------------------


def match_unigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Single tokens of run documents that are in the run's model, at every place."""
    one = table(spark, folder, "predictors").where((F.size("tokens") == 1) & (F.element_at("tokens", 1) != "*"))
    found = matcher.occurrences(_run_docs(spark, folder), one, ("run_id", "doc"), ("run_id",))
    return found.groupBy("run_id", "doc", "feature_id").agg(F.count("*").alias("n"))


def match_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of two and more tokens without wildcards, at every place."""
    more = table(spark, folder, "predictors").where((F.size("tokens") > 1) & ~F.array_contains("tokens", "*"))
    found = matcher.occurrences(_run_docs(spark, folder), more, ("run_id", "doc"), ("run_id",))
    return found.groupBy("run_id", "doc", "feature_id").agg(F.count("*").alias("n"))


def match_gapped(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns with wildcards, at every place."""
    gapped = table(spark, folder, "predictors").where(F.array_contains("tokens", "*"))
    found = matcher.occurrences(_run_docs(spark, folder), gapped, ("run_id", "doc"), ("run_id",))
    return found.groupBy("run_id", "doc", "feature_id").agg(F.count("*").alias("n"))


def match_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns that each run document holds."""
    return _run_matches(spark, folder)[1].select("run_id", "doc", "feature_id")


def score_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Score and probability of every run document under its run's model."""
    docs, found = _run_matches(spark, folder)
    return _rounded(matcher.scores(docs, found, ("run_id", "doc"), 0.05))


def predict_label(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every run document."""
    docs, found = _run_matches(spark, folder)
    return matcher.predicted(_rounded(matcher.scores(docs, found, ("run_id", "doc"), 0.05))).select("run_id", "doc", "predicted")


def oov_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Run documents that hold no pattern of the model."""
    docs, found = _run_matches(spark, folder)
    return matcher.unmatched(docs, found, ("run_id", "doc"))


def explain_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The patterns and weights behind each score."""
    return matcher.explained(_run_matches(spark, folder)[1], ("run_id", "doc"))


def feature_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse vectors of the run documents."""
    return matcher.sparse(_run_matches(spark, folder)[1], ("run_id", "doc"))


def prefix_search(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of any run's model that a run document starts with."""
    every = table(spark, folder, "predictors").select("tokens", "pattern").distinct()
    return matcher.prefixes_of(_run_docs(spark, folder), every, ("run_id", "doc"))


# --- evaluation -----------------------------------------------------------------------------------------------------


def eval_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts of the test documents."""
    return evaluate.confusion(_scored(spark, folder))


def _measures(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return _rounded(evaluate.measures(evaluate.confusion(_scored(spark, folder))).select(*names))


def eval_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and error."""
    return _measures(spark, folder, "accuracy", "error")


def eval_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1."""
    return _measures(spark, folder, "precision", "recall", "f1")


def eval_fss(spark: SparkSession, folder: str) -> DataFrame:
    """Specificity, sensitivity and their harmonic mean."""
    return _measures(spark, folder, "specificity", "sensitivity", "fss")


def eval_balanced_error(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced error."""
    return _measures(spark, folder, "balanced_error")


def eval_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the ROC curve."""
    return _rounded(evaluate.auc(_scored(spark, folder)))


def eval_auc50(spark: SparkSession, folder: str) -> DataFrame:
    """Area up to the first 50 negatives."""
    return _rounded(evaluate.auc50(_scored(spark, folder)))


def eval_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The test documents by falling score, equal scores by id."""
    rows = _scored(spark, folder).select("doc_id", "score", (-F.col("score")).alias("minus"))
    return numbered(rows, "minus", "doc_id").select("rank", "doc_id", "score")


def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    """All measures in one row."""
    return _rounded(evaluate.report(cut(_scored(spark, folder))))


def tune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold of fewest errors."""
    return _rounded(evaluate.tuned(cut(_scored(spark, folder))))


def tune_report(spark: SparkSession, folder: str) -> DataFrame:
    """What tuning reports."""
    return _rounded(evaluate.tune_report(cut(_scored(spark, folder))))


QUERIES = {
    f.__name__: f
    for f in (
        src_labelled_docs, src_filter_comments, src_split_label, src_strip_cr, src_test_docs, class_counts, tok_char, tok_char_nospace, tok_word, tok_word_test, vocab, inverted_index, unigram_support, unigram_minsup,
        ngram_bigrams, ngram_trigrams, ngram_topk_support, ngram_frequent, ngram_len_window, ngram_gapped, ngram_dfs_order,
        grad_logistic, grad_sqhinge, grad_bounds, grad_regularised, prefix_bound, prune_survivors, best_ngram, best_ngram_sqhinge,
        initial_loss, loss_logistic, loss_sqhinge, penalty_elastic_net, line_search_grid, line_search_refine, state_after_step, convergence_rate, learn_word, learn_char, learn_log, learn_valid,
        steps_files, model_files, model_trie, model_aggregate, model_normalise, model_bias, model_norms, model_ids, model_predictors,
        match_unigrams, match_ngrams, match_gapped, match_distinct, score_docs, predict_label, oov_docs, explain_rules, feature_ids, prefix_search,
        eval_confusion, eval_accuracy, eval_prf, eval_fss, eval_balanced_error, eval_auc, eval_auc50, eval_ranked, eval_report, tune_threshold, tune_report,
    )
}
