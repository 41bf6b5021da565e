"""Procedures: reliability from trials, pruning, transfer, context-weighted reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions import decay


def reliability(trials: DataFrame, *by: str) -> DataFrame:
    """by, trials, successes, reliability = (s + 1) / (n + 2) of trials (by, ok)."""
    return trials.groupBy(*by).agg(F.count(F.lit(1)).alias("trials"), F.sum(F.col("ok").cast("long")).alias("successes")).withColumn("reliability", (F.col("successes") + 1) / (F.col("trials") + 2))


def prunable(rows: DataFrame, least_trials: int, threshold: float) -> DataFrame:
    return rows.where((F.col("trials") >= least_trials) & (F.col("reliability") < threshold))


def transferable(rows: DataFrame, existing: DataFrame, least: float = 0.7, least_trials: int = 3, discount: float = 0.7) -> DataFrame:
    """trigger, action, reliability, trials, successes of rows good enough that existing lacks; discounted, counters at 0."""
    good = rows.where((F.col("reliability") >= least) & (F.col("trials") >= least_trials)).join(existing.select("trigger", "action"), ["trigger", "action"], "left_anti")
    return good.select("trigger", "action", (F.col("reliability") * discount).alias("reliability"), F.lit(0).cast("long").alias("trials"), F.lit(0).cast("long").alias("successes"))


def weighted(trials: DataFrame, by: str, gamma: float = 2.0) -> DataFrame:
    """by, reliability from trials (by, ok, cosine): each counts max(cosine, 0) ** gamma, with one success and one failure before."""
    w = F.pow(F.greatest("cosine", F.lit(0.0)), F.lit(gamma))
    ok, bad = F.sum(F.when(F.col("ok"), w).otherwise(0.0)) + 1.0, F.sum(F.when(~F.col("ok"), w).otherwise(0.0)) + 1.0
    return trials.groupBy(by).agg((ok / (ok + bad)).alias("reliability"))


def adaptive_discount(similarity: Column) -> Column:
    return 0.5 + 0.3 * decay.clamp(similarity)
