"""Streaming forms: usage counters, billing, activity windows, the sliding rate limiter, access rings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import analytics


def activity_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """window start, event_type, n of a stream (ts, event_type); events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def usage_sink(path: str):
    """A foreachBatch function: each batch's sums under its own batch id, so that a batch that runs twice counts once.

    Readers sum over batches (usage_totals); no read-modify-write of totals is needed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        analytics.usage(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def usage_totals(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("user_id", "month", "tier").agg(F.sum("n").cast("long").alias("n"))


def billing_sink(path: str, post):
    """A foreachBatch function: meter records of a batch of requests (user_id, created_at, path) under the batch's id, handed to post(records).

    Only billable paths count. A record's name has the batch's id, so a receiver that drops names it knows bills a repeated batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(analytics.billable(F.col("path"))).withColumn("tier", F.lit("request")).withColumn("n", F.lit(1))
        records = analytics.usage(rows).withColumn("name", F.concat_ws("-", F.lit(str(batch_id)), "user_id", "month"))
        records.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        post(batch.sparkSession.read.parquet(f"{path}/batch={batch_id}"))

    return write


def rate_limit(events: DataFrame, limit: int, window_s: float = 60.0) -> DataFrame:
    """key, id, admitted of a stream (key, id, at seconds): state is the admitted times in the window, at most `limit` a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for at, i in zip(rows["at"], rows["id"]):
            open_ = [t for t in open_ if t > at - window_s]
            ok = len(open_) < limit
            if ok:
                open_.append(at)
            out.append((key[0], i, ok))
        state.update((open_,))
        yield pd.DataFrame(out, columns=["key", "id", "admitted"])

    return events.groupBy("key").applyInPandasWithState(step, "key long, id long, admitted boolean", "open array<double>", "append", GroupStateTimeout.NoTimeout)


def access_ring(events: DataFrame, size: int = 50) -> DataFrame:
    """key, held: the newest `size` access times of each key of a stream (key, at)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = sorted(held + [t for b in batches for t in b["at"]])[-size:]
        state.update((held,))
        yield pd.DataFrame({"key": [key[0]], "held": [len(held)], "newest": [held[-1]]})

    return events.groupBy("key").applyInPandasWithState(step, "key long, held long, newest double", "held array<double>", "update", GroupStateTimeout.NoTimeout)
