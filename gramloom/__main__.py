"""python -m gramloom {learn,mkmodel,classify,tune}: the whole chain over labelled sequence files.

    python -m gramloom learn -n 1 train.txt model
    python -m gramloom mkmodel -n 1 -i model -o final -O predictors
    python -m gramloom classify -n 1 -t 0.07 -v 1 test.txt final
    python -m gramloom tune -n 1 train.txt final

Files are read, and results written, by Spark: inputs may be files, folders or patterns of any file system, outputs are folders.
"""

from __future__ import annotations

import argparse
import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions.tokens import tokenised
from gramloom.operators import evaluate, matcher, model
from gramloom.operators.learner import Params, learn
from gramloom.sources import models, sequences
from gramloom.tables import cut, shared_folder

KINDS = {0: "word", 1: "char"}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, y, text) of a file of labelled lines; ``-`` is standard input, which is written to the shared folder as it comes in. Ids are fixed by a write there, too."""
    if path == "-":
        lines = sequences.stored_lines(spark, sys.stdin, f"{shared_folder(spark)}/input-{uuid.uuid4().hex}")
        return sequences.parse_labelled(lines).select(F.col("line_no").alias("doc_id"), "y", "text")
    return cut(sequences.parse_labelled(sequences.read_lines(spark, path)).select(F.monotonically_increasing_id().alias("doc_id"), "y", "text"))


def _learn(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None]) -> None:
    params = Params(objective=a.o, minsup=a.m, minpat=a.l, maxpat=a.L or None, maxgap=a.g, breadth=a.r == 0, token=KINDS[a.n], maxitr=a.T, convergence=a.c, cost=a.C, alpha=a.a, compat=a.compat)
    got = learn(_documents(spark, a.train_file), params)
    models.write_steps(got.steps_frame(spark, params.token), a.model_file)
    if a.v > 1:
        out(f"parameters: {params}")
        for x in got.log:
            out(f"{x['iteration']} {x['n_features']} {x['grown']}/{x['pruned']}/{x['total']} {x['delta']:.12f} {x['pattern']} loss {x['loss']:.6f}")
    out(f"steps: {len(got.steps)}")


def _mkmodel(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None]) -> None:
    steps = models.read_steps(spark, a.i)
    made = model.make_model(steps, separator=" " if KINDS[a.n] == "word" else "")
    models.write_model(made, a.o)
    row = model.bias(steps).first()
    bias = row["bias"] if row is not None else None
    models.write_bias(spark, bias, a.o)
    if a.O:
        models.predictor_lines(made, bias if bias is not None else 0.0).coalesce(1).write.mode("overwrite").text(a.O)
    norms = model.norms(steps).first()
    out(f"features: {made.count()}  bias: {bias}  l1: {norms['l1']}  l2: {norms['l2']}")


def _scored(spark: SparkSession, a: argparse.Namespace, path: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    docs = tokenised(_documents(spark, path), KINDS[a.n])
    found = matcher.matches(docs, models.read_model(spark, a.model))
    return docs.select("doc_id", "y", "text").join(matcher.scores(docs, found, threshold=threshold), "doc_id"), found


def _show(spark: SparkSession, a: argparse.Namespace, scored: DataFrame, found: DataFrame, level: int, by_weight: bool, out: Callable[[str], None]) -> None:
    """Prints the documents, a partition at a time."""
    if level:
        rules = matcher.rules_of(found, by_weight=by_weight).join(matcher.sparse(found), "doc_id")
        lines = models.score_lines(scored.join(rules, "doc_id", "left"), level, models.read_bias(spark, a.model))
        for row in lines.orderBy("doc_id").toLocalIterator():
            out(row["value"])


def _classify(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None]) -> None:
    scored, found = _scored(spark, a, a.test_file, a.t)
    _show(spark, a, scored, found, a.v, False, out)
    r = evaluate.report(scored).first()
    for name in ("accuracy", "error", "balanced_error", "precision", "recall", "f1", "specificity", "sensitivity", "fss", "auc", "auc50", "tp", "fp", "fn", "tn", "oov_docs"):
        out(f"{name}: {r[name]}")


def _tune(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None]) -> None:
    scored, found = _scored(spark, a, a.train_file, 0.0)
    _show(spark, a, scored, found, min(a.v, 3) + (a.v > 2), True, out)
    for name, value in evaluate.tune_report(scored).first().asDict().items():
        out(f"{name}: {value}")


def parser() -> argparse.ArgumentParser:
    """The options of the four programs."""
    top = argparse.ArgumentParser(prog="gramloom", description=__doc__.split("\n")[0])
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("learn", help="labelled sequences to steps")
    p.add_argument("-o", type=int, default=0, choices=(0, 2), help="objective: 0 logistic, 2 squared hinge")
    p.add_argument("-m", type=int, default=1, help="least support")
    p.add_argument("-l", type=int, default=1, help="shortest pattern")
    p.add_argument("-L", type=int, default=0, help="longest pattern; 0: any length")
    p.add_argument("-g", type=int, default=0, help="most wildcards in a row")
    p.add_argument("-r", type=int, default=0, choices=(0, 1), help="order of ties: 0 breadth first, 1 depth first")
    p.add_argument("-T", type=int, default=5000, help="most iterations")
    p.add_argument("-n", type=int, default=1, choices=(0, 1), help="tokens: 0 words, 1 characters")
    p.add_argument("-c", type=float, default=0.005, help="convergence threshold")
    p.add_argument("-C", type=float, default=1.0, help="weight of the penalty")
    p.add_argument("-a", type=float, default=0.2, help="share of L1 in the penalty")
    p.add_argument("-v", type=int, default=1, help="2 and more: parameters and a line for each iteration")
    p.add_argument("--compat", action="store_true", help="steps as recorded models have them")
    p.add_argument("train_file")
    p.add_argument("model_file")
    p.set_defaults(run=_learn)
    p = sub.add_parser("mkmodel", help="steps to a model")
    p.add_argument("-i", required=True, help="steps")
    p.add_argument("-o", required=True, help="model")
    p.add_argument("-O", help="predictors as text")
    p.add_argument("-n", type=int, default=1, choices=(0, 1))
    p.set_defaults(run=_mkmodel)
    p = sub.add_parser("classify", help="scores, explanations and measures of test sequences")
    p.add_argument("-n", type=int, default=1, choices=(0, 1))
    p.add_argument("-t", type=float, default=0.0, help="threshold")
    p.add_argument("-v", type=int, default=0, choices=range(6))
    p.add_argument("test_file")
    p.add_argument("model")
    p.set_defaults(run=_classify)
    p = sub.add_parser("tune", help="the threshold of fewest errors")
    p.add_argument("-n", type=int, default=1, choices=(0, 1))
    p.add_argument("-v", type=int, default=0, help="1 scores, 2 with the text, 3 and more with the rules")
    p.add_argument("train_file")
    p.add_argument("model")
    p.set_defaults(run=_tune)
    return top


def main(args: list[str], spark: SparkSession | None = None, out: Callable[[str], None] = print) -> None:
    """Runs one program and reports its time on the error stream."""
    a, began = parser().parse_args(args), time.monotonic()
    a.run(spark or SparkSession.builder.getOrCreate(), a, out)
    print(f"total time: {time.monotonic() - began:.1f} seconds", file=sys.stderr)


if __name__ == "__main__":
    main(sys.argv[1:])
