"""Ranking metrics, significance tests, intervals, pairwise strength."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def metrics(ranked: DataFrame, k: int) -> DataFrame:
    """qid, ndcg, mrr, accuracy_at_1, recall_at_k of rows (qid, rank, rel, total): rel as gain, total relevant ones of the query."""
    ideal = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "rank"))
    rows = ranked.withColumn("ideal", ideal)
    gain = lambda r: (F.pow(F.lit(2.0), F.col("rel")) - 1) / (F.log(F.col(r) + 1.0) / math.log(2))
    dcg, best = F.sum(F.when(F.col("rank") <= k, gain("rank"))), F.sum(F.when(F.col("ideal") <= k, gain("ideal")))
    hit = F.col("rel") > 0
    return rows.groupBy("qid").agg(
        F.when(best > 0, dcg / best).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.max(F.when((F.col("rank") == 1) & hit, 1.0).otherwise(0.0)).alias("accuracy_at_1"),
        F.when(F.max("total") > 0, F.sum(F.when((F.col("rank") <= k) & hit, 1.0).otherwise(0.0)) / F.max("total")).otherwise(0.0).alias("recall_at_k"),
    )


def cohens_d(pairs: DataFrame, by: str) -> DataFrame:
    """by, d of paired x, y: mean difference over its sample deviation; 0 without differences."""
    d = F.col("y") - F.col("x")
    sd = F.stddev_samp(d)
    return pairs.groupBy(by).agg(F.when((sd == 0) | sd.isNull(), F.when(F.avg(d) == 0, 0.0).otherwise(F.signum(F.avg(d)) * float("inf"))).otherwise(F.avg(d) / sd).alias("d"))


def normal_cdf(x: Column) -> Column:
    """By the five-term rational approximation (Abramowitz and Stegun 26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def wilcoxon(pairs: DataFrame, by: str) -> DataFrame:
    """by, n, w_plus, p of paired x, y; differences of zero are left out, ties have mid-ranks."""
    d = F.col("y") - F.col("x")
    # equal sizes are counted first: a key's task reads one row for each distinct one
    sizes = pairs.withColumn("d", d).where("d <> 0").groupBy(by, F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sizes.withColumn("r", upto - (F.col("c") - 1) / 2.0).groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"))
    n = F.col("n").cast("double")  # its cube is beyond 64 bits from some 1.7 million rows a key
    z = (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    return sums.withColumn("p", 2 * normal_cdf(-F.abs(z)))


def benjamini_hochberg(tests: DataFrame, by: str, alpha: float = 0.05) -> DataFrame:
    """tests (by, id, p) with rejected: all up to the last rank whose p is at most rank / n * alpha."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("p", "id"))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    rows = tests.withColumn("rank", rank).withColumn("n", n)
    last = F.max(F.when(F.col("p") <= F.col("rank") / F.col("n") * alpha, F.col("rank"))).over(Window.partitionBy(by))
    return rows.withColumn("rejected", F.coalesce(F.col("rank") <= last, F.lit(False)))


def normal_quantile(p: Column) -> Column:
    """Rational approximation (Abramowitz and Stegun 26.2.23)."""
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.log(q))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -x).otherwise(x)


def sample_size(effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = normal_quantile(F.lit(1 - alpha / 2)) + normal_quantile(F.lit(power))
    return F.ceil(F.pow(z / effect, F.lit(2.0)))


def bootstrap(values: DataFrame, by: str, resamples: int, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """by, mean, low, high: the percentile interval of the mean over hash-drawn resamples of (by, i from 0, value)."""
    n = values.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    slots = values.select(by, "i").join(n, by).select(by, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    drawn = slots.select(by, "r", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "r", "i").cast("binary")), 1, 12), 16, 10).cast("long"), F.col("n")).alias("i"))
    means = drawn.join(values, [by, "i"]).groupBy(by, "r").agg(F.avg("value").alias("m"))
    ranked = means.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy("m")))
    tail = (1 - confidence) / 2
    low, high = math.floor(tail * resamples) + 1, min(math.ceil((1 - tail) * resamples), resamples)
    return ranked.groupBy(by).agg(F.max(F.when(F.col("__k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("__k") == high, F.col("m"))).alias("high")).join(n.select(by, "mean"), by)


def bradley_terry(wins: DataFrame, rounds: int = 50) -> DataFrame:
    """player, strength (mean 1) of wins (winner, loser, n), by minorisation; each round is two grouped sums over the pairs."""
    pairs = wins.select(F.col("winner").alias("a"), F.col("loser").alias("b"), "n").unionByName(wins.select(F.col("loser").alias("a"), F.col("winner").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    won = wins.groupBy(F.col("winner").alias("player")).agg(F.sum("n").alias("w"))
    players = pairs.select(F.col("a").alias("player")).distinct()
    # one row a pair of players: the rounds run on the driver over these as arrays
    found = pairs.collect()
    names = sorted(r.player for r in players.collect())
    number = {p: i for i, p in enumerate(names)}
    one, two = (np.array([number[r[c]] for r in found], np.int64) for c in "ab")
    played = np.array([r.n for r in found], float)
    score = np.zeros(len(names))
    for r in won.collect():
        score[number[r.player]] = r.w
    s = np.ones(len(names))
    for _ in range(rounds if names else 0):
        s = score / np.maximum(1e-12, np.bincount(one, played / (s[one] + s[two]), len(names)))
        s /= s.mean()
    return wins.sparkSession.createDataFrame(list(zip(names, s.tolist())), f"player {dict(pairs.dtypes)['a']}, strength double")


def corrupted(rows: DataFrame, noise: float, dropout: float, seed: int = 42) -> DataFrame:
    """rows (id, v) with hash-seeded noise added and dimensions set to 0."""
    unit = lambda i, salt: F.pmod(F.xxhash64("id", i, F.lit(seed + salt)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("v", F.transform("v", lambda x, i: F.when(unit(i, 1) < dropout, 0.0).otherwise(x + noise * (2 * unit(i, 0) - 1))))


def sensitivity(sweep: DataFrame, default: float) -> DataFrame:
    """coefficient (central difference at the value nearest the default) and robustness (share within 5 % of the best) of (value, metric)."""
    w = Window.orderBy("value")
    rows = sweep.withColumn("before", F.lag("metric").over(w)).withColumn("after", F.lead("metric").over(w)).withColumn("v0", F.lag("value").over(w)).withColumn("v1", F.lead("value").over(w))
    rows = rows.withColumn("best", F.max("metric").over(Window.partitionBy()))
    near = F.min(F.struct(F.abs(F.col("value") - default).alias("far"), "value", ((F.col("after") - F.col("before")) / (F.col("v1") - F.col("v0"))).alias("slope")))
    return rows.agg(near["slope"].alias("coefficient"), F.avg(F.when(F.col("metric") >= 0.95 * F.col("best"), 1.0).otherwise(0.0)).alias("robustness"))
