"""Report tables: each output of an evaluation report as a query over score rows, and a page of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring, stats
from ..sources.files import report


def tables(rows: DataFrame, reference, categories: list | None = None, n: int = 3, least: int = 10) -> dict[str, DataFrame]:
    """Report tables of score rows(cond, book, item, target, lp, answer, tokens) against a reference condition.

    scoring: argmax, joint and whole-group accuracy by condition; main: macro means and paired differences; per book; by true id;
    items: what all, none, the best one and the best pick get right; agreement; variance; lengths; and the front of accuracy by length.
    """
    single = scoring.argmax_hits(rows)
    joint = scoring.joint_hits(rows, ["cond", "item", "book"], n)
    whole = joint.groupBy("cond", "item").agg(F.min("hit").alias("hit"))
    by_cond = lambda hits, name: scoring.accuracy(hits, ["cond"]).select("cond", F.col("acc").alias(name))
    length = stats.quantiles(rows, ["cond"], "tokens", (0.5,)).select("cond", F.col("q50").alias("tokens"))
    macro = scoring.macro(joint, least)
    out = {
        "scoring": by_cond(single, "argmax").join(by_cond(joint, "joint"), "cond").join(by_cond(whole, "whole"), "cond"),
        "main": macro.join(scoring.paired(joint, reference), "cond", "left"),
        "per book": scoring.all_and_by_book(joint),
        "by true id": scoring.accuracy(single, ["cond", "answer"]),
        "items": stats.oracle_pick(single),
        "agreement": stats.pairwise_agreement(single),
        "variance": stats.variance_shares(single.select("cond", F.concat_ws("/", "item", "target").alias("item"), F.col("hit").cast("double").alias("x"))),
        "intervals": stats.bootstrap(joint.groupBy("cond", "book").agg((F.sum("hit") / F.count("*")).alias("acc")), ["cond"], "acc"),
        "lengths": length,
        "best by length": stats.pareto(macro.join(length, "cond").select(F.lit("all").alias("kind"), "cond", "tokens", "macro"), "kind", "tokens", "macro", "cond"),
    }
    if categories:
        out["category products"] = scoring.agreed(rows, categories)
    return out


def write(rows: DataFrame, reference, path: str, **options) -> None:
    """The report as a page; its tables are a few rows each."""
    report({name: df.orderBy(*df.columns[:2]) for name, df in tables(rows, reference, **options).items()}, path, "Evaluation")
