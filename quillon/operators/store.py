"""Lookups, lists, upserts, updates, deletions, erasure and export over the memory tables: pure DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (id)."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those of incoming whose keys it lacks; of incoming rows with equal keys the first by id."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    first = fresh.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("__r = 1").drop("__r")
    return existing.unionByName(first)


def newest(rows: DataFrame, by: str, time: Column, n: int) -> DataFrame:
    """The n newest rows of each group, ties by id."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(time.desc(), "id"))).where(F.col("__r") <= n).drop("__r")


def in_type_order(*frames: DataFrame) -> DataFrame:
    """Rows of all kinds, with type_rank."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("type_rank", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the edges that start or end there: two equi-joins."""
    n = nodes.select(F.col("id").alias("node")).distinct()
    a = edges.join(n, edges["source"] == n["node"])
    b = edges.join(n, edges["target"] == n["node"]).where("source <> target")
    return a.unionByName(b)


def filled(first: DataFrame, second: DataFrame, by: str, n: int) -> DataFrame:
    """Up to n rows of each group: those of first by time (newest), then those of second."""
    both = in_type_order(first, second)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("type_rank", F.desc("created_at"), "id"))).where(F.col("__r") <= n).drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with new rows in place of those with their key. A keyed shuffle of both; write the result to a new version."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__v")))).where("__r = 1").drop("__r", "__v")


def updated(rows: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """rows with the non-null columns of updates (one row a key) over their own."""
    new = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in new])
    return rows.join(u, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in rows.columns])


def touched(rows: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Access updates (id, stability, retrievability): both set, access_count one more, last_accessed now."""
    u = updates.select("id", F.col("stability").alias("__s"), F.col("retrievability").alias("__r"))
    hit = F.col("__s").isNotNull()
    joined = rows.join(u, "id", "left")
    return joined.withColumn("stability", F.coalesce("__s", "stability")).withColumn("retrievability", F.coalesce("__r", "retrievability")).withColumn("access_count", F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed", F.when(hit, now).otherwise(F.col("last_accessed"))).drop("__s", "__r")


def invalidated(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """rows with invalid_at now for those of ids."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("invalid_at", F.when(F.col("__hit"), now).otherwise(F.col("invalid_at"))).drop("__hit")


def of_entities(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """entity and the memories it owns: episodic about or from it, semantic with it as subject (or object entity)."""
    e = entities.select(F.col("id").alias("entity")).distinct()
    parts = [memories.where("memory_type = 'episodic'").join(e, F.col("about_entity") == F.col("entity")), memories.where("memory_type = 'episodic'").join(e, F.col("source_entity") == F.col("entity")), memories.where("memory_type = 'semantic'").join(e, F.col("subject") == F.col("entity"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["entity", "id"])


def without_entities(memories: DataFrame, entities: DataFrame) -> DataFrame:
    return memories.join(of_entities(memories, entities).select("id").distinct(), "id", "left_anti")


def of_episodes(observations: DataFrame, episodes: DataFrame) -> DataFrame:
    return observations.join(episodes.select(F.col("id").alias("episode_id")).distinct(), "episode_id", "left_semi")


def participated(episodes: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, id of the episodes that it took part in."""
    e = entities.select(F.col("id").alias("entity")).distinct()
    return episodes.select("id", F.explode("participants").alias("entity")).join(e, "entity", "left_semi").distinct()


def erase(memories: DataFrame, episodes: DataFrame, edges: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table after entities (id) are erased, and `report`: counts an entity.

    Observations of the entities' episodes go first, then their memories and the edges that touch them; the report counts
    each entity's own, so shared episodes count for each.
    """
    mine = participated(episodes, entities)
    obs = memories.where("memory_type = 'observation'").join(mine.withColumnRenamed("id", "episode_id"), "episode_id").select("entity", "id")
    own = of_entities(memories, entities).select("entity", "id")
    edge = touching(edges, entities).select(F.col("node").alias("entity"), "id")
    count = lambda f, name: f.groupBy("entity").agg(F.count(F.lit(1)).alias(name))
    report = entities.select(F.col("id").alias("entity")).distinct().join(count(obs, "observations"), "entity", "left").join(count(own, "memories"), "entity", "left").join(count(edge, "edges"), "entity", "left").fillna(0)
    gone = obs.select("id").unionByName(own.select("id")).distinct()
    cut = edge.select("id").distinct()
    return {"memories": memories.join(gone, "id", "left_anti"), "edges": edges.join(cut, "id", "left_anti"), "report": report, "gone_memories": gone, "gone_edges": cut}


def export(memories: DataFrame, episodes: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, id, record: each entity's memories and its episodes' observations as JSON."""
    mine = participated(episodes, entities).withColumnRenamed("id", "episode_id")
    own = of_entities(memories, entities).select("entity", "id", "memory_type", "content")
    obs = memories.where("memory_type = 'observation'").join(mine, "episode_id").select("entity", "id", "memory_type", "content")
    return own.unionByName(obs).select("entity", "id", F.to_json(F.struct("id", "memory_type", "content")).alias("record"))
