"""Ranking candidates by score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import hash_uniform


def hash_scorer(text: Column) -> Column:
    """A deterministic stand-in for a reward model."""
    return hash_uniform(F.concat(F.lit("score|"), text))


def best_of(rows: DataFrame, key: list[str], score: str, position: str) -> DataFrame:
    """The row of highest score of each key; the first position of several."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(score), -F.col(position)))
    return rows.groupBy(*key).agg(best.alias("r")).select("r.*")


def rank_candidates(prompts: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """prompts (context, candidates) with rm_score in every candidate and best_idx, best_response, best_score."""
    scored = F.transform("candidates", lambda c: c.withField("rm_score", scorer(F.col("context"), c["response"])))
    placed = F.transform(scored, lambda c, i: F.struct(c["rm_score"].alias("s"), (-i).alias("i"), c.alias("c")))
    top = F.array_max(F.transform(placed, lambda x: F.struct(x["s"], x["i"])))
    rows = prompts.withColumn("candidates", scored).withColumn("__top", top)
    best = F.try_element_at("candidates", (1 - F.col("__top.i")).cast("int"))
    return rows.withColumn("best_idx", best["idx"]).withColumn("best_response", best["response"]).withColumn("best_score", best["rm_score"]).drop("__top")


def winner_histogram(ranked: DataFrame, warn: float = 0.8) -> DataFrame:
    """How often each index wins, its share, and whether one index wins nearly always."""
    n = ranked.groupBy("best_idx").agg(F.count("*").alias("n"))
    total = ranked.agg(F.count("*").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).withColumn("lopsided", F.col("share") > warn).drop("total")


def unstable_steps(metrics: DataFrame, most: float = 50.0) -> DataFrame:
    """Log rows at which training should stop: a metric that is not finite, or a margin beyond `most`."""
    bad = F.exists(F.map_values("values"), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return metrics.where(bad | (F.abs(F.try_element_at("values", F.lit("margin"))) > most))
