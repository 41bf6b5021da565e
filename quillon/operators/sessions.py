"""Results grouped by session, with observations attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def group(ranked: DataFrame, order: str = "chronological", most: int | None = None) -> DataFrame:
    """qid, group_id, episode_id, session_time, group_score, members, position of rows (qid, id, rank, score, memory_type, episode_id, event_time, created_at).

    Rows of an episode are a group, facts and procedures are groups of their own; members by time, then rank; groups by time
    or by score, then by their best rank.
    """
    when = F.coalesce("event_time", "created_at")
    single = F.col("episode_id").isNull() | F.col("memory_type").isin("semantic", "procedural")
    key = F.when(single, F.concat(F.lit("m:"), "id")).otherwise(F.col("episode_id"))
    rows = ranked.withColumn("group_id", key).withColumn("at", when)
    groups = rows.groupBy("qid", "group_id").agg(
        F.first(F.when(~single, F.col("episode_id"))).alias("episode_id"), F.min("at").alias("session_time"), F.max("score").alias("group_score"), F.min("rank").alias("best"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", "rank", "id"))), lambda m: m["id"]).alias("members"),
    )
    by = [F.col("session_time"), F.col("best")] if order == "chronological" else [F.desc("group_score"), F.col("best")]
    out = groups.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*by, "group_id")))
    return (out if most is None else out.where(F.col("position") <= most)).drop("best")


def attach(groups: DataFrame, observations: DataFrame, most: int = 1024) -> DataFrame:
    """qid, group_id, id, score of the groups' observations, at most `most` a query by time."""
    found = groups.where("episode_id IS NOT NULL").select("qid", "group_id", "episode_id", "group_score").join(observations.select("episode_id", "id", "created_at"), "episode_id")
    return found.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy("created_at", "id"))).where(F.col("__r") <= most).select("qid", "group_id", "id", F.col("group_score").alias("score"))


def with_observations(groups: DataFrame, observations: DataFrame, most: int = 1024) -> DataFrame:
    """groups with observations, the ids of those attached to each by time; none: an empty array."""
    found = attach(groups, observations, most).join(observations.select("id", "created_at"), "id")
    lists = found.groupBy("qid", "group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"]).alias("observations"))
    return groups.join(lists, ["qid", "group_id"], "left").withColumn("observations", F.coalesce("observations", F.array().cast("array<string>")))
