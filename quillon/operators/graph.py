"""The typed temporal graph as node and edge frames: traversal in rounds of joins, for batches of starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillon.functions import decay
from quillon.sources.scratch import kept

#: How well an edge type suits an intent; fixed values.
ALIGNMENT = [
    ("temporal", "recall", 0.9), ("causal", "action", 0.9), ("entity", "question", 0.8), ("entity", "code", 0.7),
    ("semantic", "recall", 0.7), ("semantic", "question", 0.7), ("causal", "code", 0.6),
]
DEFAULT_ALIGNMENT = 0.3


def alignment(edge_type: Column, intent: Column) -> Column:
    out = None
    for e, i, score in ALIGNMENT:
        test = (edge_type == e) & (intent == i)
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(DEFAULT_ALIGNMENT)


def valid(edges: DataFrame) -> DataFrame:
    return edges.where("invalid_at IS NULL")


def from_memories(memories: DataFrame) -> DataFrame:
    """Entity -> memory edges: weight 1 for episodic, the confidence for semantic."""
    e = memories.where("memory_type = 'episodic' AND about_entity IS NOT NULL").select(F.col("about_entity").alias("source"), F.col("id").alias("target"), F.lit(1.0).alias("weight"))
    s = memories.where("memory_type = 'semantic' AND subject IS NOT NULL").select(F.col("subject").alias("source"), F.col("id").alias("target"), F.col("confidence").alias("weight"))
    return e.unionByName(s).dropDuplicates(["source", "target"])


def memory_edges(memories: DataFrame) -> DataFrame:
    """from_memories as edges that a beam can walk: of type entity, valid and new."""
    return from_memories(memories).select("source", "target", F.lit("entity").alias("edge_type"), "weight", F.lit(0.0).alias("age_days"), F.lit(None).cast("timestamp").alias("invalid_at"))


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, distance of what valid edges reach from starts (id) in at most depth steps; the start itself is left out.

    Edges are written once and every step's new nodes too, so a step reads edges, one frontier and what was seen, whatever the depth.
    """
    step = kept(valid(edges).select("source", "target").distinct(), "edges")
    front = kept(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "frontier")
    seen = front
    for d in range(1, depth + 1):
        reached = front.join(step, front["node"] == step["source"]).select("start", F.col("target").alias("node")).distinct()
        front = kept(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d)), "frontier")
        seen = seen.unionByName(front)
    return seen.where("distance > 0").withColumn("score", 1.0 / (1.0 + F.col("distance")))


def beam(edges: DataFrame, starts: DataFrame, width: int = 10, depth: int = 4) -> DataFrame:
    """start, node, score of the beams from starts (id, intent). edges: source, target, edge_type, weight, age_days, half_life?.

    A step multiplies exp(0.4 alignment + 0.4 weight + 0.2 confidence); each depth keeps the width best nodes not seen before,
    ties by node. Edges and every step's nodes are written, as in bfs.
    """
    half = F.coalesce("half_life", F.lit(90.0)) if "half_life" in edges.columns else F.lit(90.0)
    step = kept(valid(edges).select("source", "target", "edge_type", "weight", decay.edge_confidence(F.lit(1.0), F.col("age_days"), half).alias("confidence")), "edges")
    front = kept(starts.select(F.col("id").alias("start"), "intent", F.col("id").alias("node"), F.lit(1.0).alias("score")), "frontier")
    seen = front
    for _ in range(depth):
        gain = F.exp(0.4 * alignment(F.col("edge_type"), F.col("intent")) + 0.4 * F.col("weight") + 0.2 * F.col("confidence"))
        to = front.join(step, front["node"] == step["source"]).select("start", "intent", F.col("target").alias("node"), (F.col("score") * gain).alias("score"))
        best = to.groupBy("start", "intent", "node").agg(F.max("score").alias("score")).join(seen.select("start", "intent", "node"), ["start", "intent", "node"], "left_anti")
        front = kept(best.withColumn("__r", F.row_number().over(Window.partitionBy("start", "intent").orderBy(F.desc("score"), "node"))).where(F.col("__r") <= width).drop("__r"), "frontier")
        seen = seen.unionByName(front)
    return seen.where("node <> start")


def superseded(edges: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """edges with all still valid ones from source to target of pairs (source, target, by) ended now."""
    hit = pairs.select("source", "target", F.col("by").alias("__by")).dropDuplicates(["source", "target"])
    joined = edges.join(hit, ["source", "target"], "left")
    ends = F.col("__by").isNotNull() & F.col("invalid_at").isNull()
    return joined.withColumn("superseded_by", F.when(ends, F.col("__by"))).withColumn("invalid_at", F.when(ends, now).otherwise(F.col("invalid_at"))).drop("__by")


def history(edges: DataFrame) -> DataFrame:
    """edges with position (from 1, oldest first, then by id) among those of their source, still (valid) and valid, how many of them are."""
    still = F.col("invalid_at").isNull()
    return edges.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("age_days"), "id"))).withColumn("still", still).withColumn("valid", F.count(F.when(still, 1)).over(Window.partitionBy("source")))


def counts(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("source").alias("n")).unionByName(edges.select(F.col("target").alias("n"))).distinct()
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
