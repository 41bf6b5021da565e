"""Counts, activity, usage, quotas, histograms and latency summaries."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillon.operators import folds

#: Activity types that have a column of their own; fixed values.
ACTIVITY = {"recall": "recalls", "remember": "remembers", "observe": "observes", "forget": "forgets"}
#: Bounds of the latency histogram in milliseconds; fixed values.
BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 150.0, 200.0, 250.0, 500.0]


def daily(activity: DataFrame, now: Column, days: int) -> DataFrame:
    """date and a count for each type of the last days; other types make a row of zeros."""
    recent = activity.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(F.to_date("created_at").alias("date")).agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(v) for k, v in ACTIVITY.items()])


def recent(activity: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest events of each group, with a summary from the JSON detail."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    return activity.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("summary", F.concat(F.initcap("event_type"), F.lit(" "), F.coalesce(F.get_json_object("detail", "$.k"), F.lit("-"))))


def usage(events: DataFrame) -> DataFrame:
    """user_id, month, tier, n of events (user_id, created_at, tier, n); those of 0 don't count."""
    return events.where("n > 0").groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month"), "tier").agg(F.sum("n").cast("long").alias("n"))


def month_bounds(t: Column) -> tuple[Column, Column]:
    start = F.date_trunc("month", t)
    return start, F.add_months(start, 1).cast("timestamp")


def quota(used: DataFrame, recalls: int, stored: int) -> DataFrame:
    """user_id, state of (user_id, recalls, stored): the recall limit is looked at first."""
    return used.withColumn("state", F.when(F.col("recalls") >= recalls, "recall_limit").when(F.col("stored") >= stored, "storage_limit").otherwise("ok"))


def histogram(values: DataFrame, by: str, bounds: list[float] | None = None) -> DataFrame:
    """by, bound (null: infinity), n: cumulative counts; sum and count."""
    b = bounds or BOUNDS
    counted = values.groupBy(by).agg(*[F.count(F.when(F.col("value") <= x, 1)).alias(f"b{i}") for i, x in enumerate(b)], F.count("value").alias("n"), F.sum("value").alias("total"))
    cells = F.array(*[F.struct(F.lit(float(x)).alias("bound"), F.col(f"b{i}").alias("below")) for i, x in enumerate(b)], F.struct(F.lit(None).cast("double").alias("bound"), F.col("n").alias("below")))
    return counted.select(by, F.explode(cells).alias("c"), "n", "total").select(by, "c.bound", "c.below", F.col("n").alias("count"), F.col("total").alias("sum"))


def latency(values: DataFrame, by: str) -> DataFrame:
    """by, n, min, mean, max, p50, p95, p99 by floor index, throughput = n / sum of milliseconds * 1000.

    The index needs each group's order: a row number, so that no group is gathered in one array.
    """
    w, all_ = Window.partitionBy(by).orderBy("value"), Window.partitionBy(by)
    rows = values.select(by, "value", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(all_).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * p), F.col("n") - 1) + 1, F.col("value")))
    return rows.groupBy(by).agg(F.max("n").alias("n"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), (F.max("n") / F.sum("value") * 1000).alias("throughput"))


def billable(path: Column) -> Column:
    """Requests under /v1/ that aren't health, usage or stats."""
    return F.startswith(path, F.lit("/v1/")) & ~path.isin("/v1/health", "/v1/usage", "/v1/stats")


def admitted(events: DataFrame, limit: int, window_s: float = 60.0) -> DataFrame:
    """key, id, admitted of events (key, id, at seconds): admitted if fewer than limit were admitted in the window before.

    Refused events do not count, so admission is a fold over a key's events in order; what it holds is the admitted times of one window.
    """
    rows = events.select("key", "id", "at")

    def make():
        live: deque[float] = deque()

        def step(batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            if batch is None:
                return None
            out = []
            for at in batch.column("at").to_pylist():
                while live and live[0] <= at - window_s:
                    live.popleft()
                out.append(len(live) < limit)
                if out[-1]:
                    live.append(at)
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(out, pa.bool_())], ["key", "id", "admitted"])

        return step

    kinds = dict(rows.dtypes)
    return folds.folded(rows, "key", ["at", "id"], f"key {kinds['key']}, id {kinds['id']}, admitted boolean", make)

