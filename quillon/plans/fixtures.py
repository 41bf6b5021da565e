"""Adapters: the driver's tables as memories, entities, episodes, edges, activity and accesses.

The same frames are written once more as DuckDB views in VIEWS, for the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The clock of all queries; operators take `now` as a parameter and never read a clock.
NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def at(minutes: Column) -> Column:
    """2024-01-01 and so many minutes."""
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


EPISODIC = """
SELECT concat('e-', conv_id, '-', turn) AS id, concat('ns', conv_id % 3) AS namespace_id, 'episodic' AS memory_type,
       concat('ep', conv_id) AS episode_id, role AS source_entity, concat('u', conv_id % 50) AS about_entity, text AS content,
       CAST(NULL AS STRING) AS subject, CAST(NULL AS STRING) AS predicate, CAST(NULL AS STRING) AS object,
       CAST(NULL AS STRING) AS trigger, CAST(NULL AS STRING) AS action,
       CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS reliability, CAST(NULL AS BIGINT) AS trial_count,
       CAST(1 + conv_id % 30 AS DOUBLE) AS stability, CAST(1.0 AS DOUBLE) AS retrievability, (conv_id * 7 + turn) % 11 AS access_count,
       CAST((conv_id % 10) / 10.0 AS DOUBLE) AS salience, turn % 2 AS has_event, conv_id % 1440 AS age_min, conv_id * 60 % 40000 + turn AS made_min
FROM conversations
"""
SEMANTIC = """
SELECT concat('s-', doc_id) AS id, concat('ns', doc_id % 3) AS namespace_id, 'semantic' AS memory_type,
       CAST(NULL AS STRING) AS episode_id, CAST(NULL AS STRING) AS source_entity, CAST(NULL AS STRING) AS about_entity, concat(lang, ' ', text) AS content,
       source AS subject, lang AS predicate, text AS object, CAST(NULL AS STRING) AS trigger, CAST(NULL AS STRING) AS action,
       CAST((1 + doc_id % 10) / 10.0 AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS reliability, CAST(NULL AS BIGINT) AS trial_count,
       CAST(1 + doc_id % 20 AS DOUBLE) AS stability, CAST(1.0 AS DOUBLE) AS retrievability, CAST(0 AS BIGINT) AS access_count,
       CAST(0.5 AS DOUBLE) AS salience, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 0 END AS has_event, CAST(0 AS BIGINT) AS age_min, doc_id % 40000 AS made_min
FROM documents
"""
PROCEDURAL = """
SELECT concat('p-', p_partkey) AS id, concat('ns', p_partkey % 3) AS namespace_id, 'procedural' AS memory_type,
       CAST(NULL AS STRING) AS episode_id, CAST(NULL AS STRING) AS source_entity, CAST(NULL AS STRING) AS about_entity, concat(p_name, ' -> ', p_type) AS content,
       CAST(NULL AS STRING) AS subject, CAST(NULL AS STRING) AS predicate, CAST(NULL AS STRING) AS object, p_name AS trigger, p_type AS action,
       CAST(1.0 AS DOUBLE) AS confidence, CAST((p_size % 10) / 10.0 AS DOUBLE) AS reliability, p_partkey % 9 AS trial_count,
       CAST(1 + p_size AS DOUBLE) AS stability, CAST(1.0 AS DOUBLE) AS retrievability, CAST(0 AS BIGINT) AS access_count,
       CAST(0.5 AS DOUBLE) AS salience, 0 AS has_event, CAST(0 AS BIGINT) AS age_min, p_partkey % 40000 AS made_min
FROM part
"""
OBSERVATION = """
SELECT concat('o-', item_id) AS id, concat('ns', item_id % 3) AS namespace_id, 'observation' AS memory_type,
       concat('ep', item_id) AS episode_id, CAST(NULL AS STRING) AS source_entity, CAST(NULL AS STRING) AS about_entity, text AS content,
       CAST(NULL AS STRING) AS subject, CAST(NULL AS STRING) AS predicate, CAST(NULL AS STRING) AS object, CAST(NULL AS STRING) AS trigger, CAST(NULL AS STRING) AS action,
       CAST((item_id % 10) / 10.0 AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS reliability, CAST(NULL AS BIGINT) AS trial_count,
       CAST(1.0 AS DOUBLE) AS stability, CAST(1.0 AS DOUBLE) AS retrievability, CAST(0 AS BIGINT) AS access_count,
       CAST(0.5 AS DOUBLE) AS salience, 0 AS has_event, CAST(0 AS BIGINT) AS age_min, item_id % 40000 AS made_min
FROM benchmark
"""


def of_sql(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=read(spark, sf_dir, table))


def timed(df: DataFrame) -> DataFrame:
    """created_at, event_time (episodic: of every other turn, a day earlier), last_accessed, invalid_at from the minute columns."""
    made = at(F.col("made_min"))
    return (
        df.withColumn("created_at", made)
        .withColumn("event_time", F.when((F.col("has_event") == 1), made - F.expr("INTERVAL 1 DAY")))
        .withColumn("last_accessed", F.when(F.col("access_count") > 0, made + F.expr("INTERVAL 2 HOURS")))
        .withColumn("invalid_at", F.when(F.col("has_event") == 2, made + F.expr("INTERVAL 1 DAY")))
        .drop("has_event", "age_min", "made_min")
    )


def episodic(spark, d):
    return timed(of_sql(spark, d, EPISODIC, "conversations"))


def semantic(spark, d):
    return timed(of_sql(spark, d, SEMANTIC, "documents"))


def procedural(spark, d):
    return timed(of_sql(spark, d, PROCEDURAL, "part"))


def observation(spark, d):
    return timed(of_sql(spark, d, OBSERVATION, "benchmark"))


TYPES = ["episodic", "semantic", "procedural", "observation"]


def memories(spark: SparkSession, d: str) -> DataFrame:
    """All four kinds, one wide frame."""
    return episodic(spark, d).unionByName(semantic(spark, d)).unionByName(procedural(spark, d)).unionByName(observation(spark, d))


def entities(spark, d):
    """Customers as entities; kind by segment."""
    return read(spark, d, "customer").selectExpr("concat('c', c_custkey) id", "concat('ns', c_nationkey % 3) namespace_id", "c_name name", "CASE WHEN c_nationkey % 4 = 0 THEN 'agent' WHEN c_nationkey % 4 = 1 THEN 'user' WHEN c_nationkey % 4 = 2 THEN 'team' ELSE 'tool' END kind")


def episodes(spark, d):
    """Conversations as episodes: participants are the entity they are about and their roles."""
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last")).selectExpr(
        "concat('ep', conv_id) id", "concat('ns', conv_id % 3) namespace_id", "array(concat('u', conv_id % 50), 'user') participants",
        "timestamp_seconds(1704067200 + (conv_id * 60 % 40000 + first) * 60) started_at",
        "CASE WHEN conv_id % 5 <> 0 THEN timestamp_seconds(1704067200 + (conv_id * 60 % 40000 + last) * 60) END ended_at",
        "CASE conv_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'partial' END outcome",
    )


def edges(spark, d):
    """Customer -> nation -> region, supplier -> nation, part -> supplier by line items."""
    kinds = "CASE {k} % 5 WHEN 0 THEN 'temporal' WHEN 1 THEN 'causal' WHEN 2 THEN 'entity' WHEN 3 THEN 'semantic' ELSE 'supersedes' END"
    c = read(spark, d, "customer").selectExpr("concat('c', c_custkey) source", "concat('n', c_nationkey) target", kinds.format(k="c_custkey") + " edge_type", "CAST(0.1 + (c_custkey % 9) / 10.0 AS DOUBLE) weight", "CAST(c_custkey % 90 AS DOUBLE) age_days", "c_custkey % 17 = 0 gone")
    n = read(spark, d, "nation").selectExpr("concat('n', n_nationkey) source", "concat('r', n_regionkey) target", kinds.format(k="n_nationkey") + " edge_type", "CAST(0.1 + (n_nationkey % 9) / 10.0 AS DOUBLE) weight", "CAST(n_nationkey % 90 AS DOUBLE) age_days", "n_nationkey % 17 = 16 gone")
    s = read(spark, d, "supplier").selectExpr("concat('s', s_suppkey) source", "concat('n', s_nationkey) target", kinds.format(k="s_suppkey") + " edge_type", "CAST(0.1 + (s_suppkey % 9) / 10.0 AS DOUBLE) weight", "CAST(s_suppkey % 90 AS DOUBLE) age_days", "s_suppkey % 17 = 0 gone")
    p = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k")).selectExpr("concat('p', l_partkey) source", "concat('s', l_suppkey) target", kinds.format(k="(l_partkey + l_suppkey)") + " edge_type", "CAST(least(0.9, 0.2 + k / 10.0) AS DOUBLE) weight", "CAST((l_partkey + l_suppkey) % 90 AS DOUBLE) age_days", "(l_partkey + l_suppkey) % 17 = 0 gone")
    out = c.unionByName(n).unionByName(s).unionByName(p)
    return out.selectExpr("concat(source, '>', target) id", "source", "target", "edge_type", "weight", "age_days", "CASE WHEN gone THEN timestamp'2024-01-15 00:00:00' END invalid_at")


def activity(spark, d):
    """Events as activity of users."""
    return read(spark, d, "events").selectExpr(
        "event_id id", "concat('ns', user_id % 3) namespace_id", "user_id",
        "CASE event_type WHEN 'click' THEN 'recall' WHEN 'view' THEN 'remember' WHEN 'purchase' THEN 'observe' WHEN 'signup' THEN 'forget' ELSE 'other' END event_type",
        "value", "props detail", "CAST(ts AS TIMESTAMP) created_at",
    )


_MEM = "\n UNION ALL \n".join(f"SELECT * FROM ({x})" for x in (EPISODIC, SEMANTIC, PROCEDURAL, OBSERVATION)).replace("AS STRING", "AS VARCHAR")
VIEWS = {
    "mem": f"""SELECT * EXCLUDE (has_event, age_min, made_min), TIMESTAMP '2024-01-01' + to_minutes(made_min) AS created_at,
  CASE WHEN has_event = 1 THEN TIMESTAMP '2024-01-01' + to_minutes(made_min) - INTERVAL 1 DAY END AS event_time,
  CASE WHEN access_count > 0 THEN TIMESTAMP '2024-01-01' + to_minutes(made_min) + INTERVAL 2 HOUR END AS last_accessed,
  CASE WHEN has_event = 2 THEN TIMESTAMP '2024-01-01' + to_minutes(made_min) + INTERVAL 1 DAY END AS invalid_at FROM ({_MEM})""",
    "ent": "SELECT 'c' || c_custkey AS id, 'ns' || (c_nationkey % 3) AS namespace_id, c_name AS name, CASE c_nationkey % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'user' WHEN 2 THEN 'team' ELSE 'tool' END AS kind FROM customer",
    "epi": """SELECT 'ep' || conv_id AS id, 'ns' || (conv_id % 3) AS namespace_id, ['u' || (conv_id % 50), 'user'] AS participants,
  TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 % 40000 + min(turn)) AS started_at, CASE WHEN conv_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 % 40000 + max(turn)) END AS ended_at,
  CASE conv_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'partial' END AS outcome FROM conversations GROUP BY conv_id""",
    "edg": """SELECT source || '>' || target AS id, source, target, CASE k % 5 WHEN 0 THEN 'temporal' WHEN 1 THEN 'causal' WHEN 2 THEN 'entity' WHEN 3 THEN 'semantic' ELSE 'supersedes' END AS edge_type, weight,
  CAST(k % 90 AS DOUBLE) AS age_days, CASE WHEN gone THEN TIMESTAMP '2024-01-15' END AS invalid_at FROM (
  SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, c_custkey AS k, CAST(0.1 + (c_custkey % 9) / 10.0 AS DOUBLE) AS weight, c_custkey % 17 = 0 AS gone FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CAST(0.1 + (n_nationkey % 9) / 10.0 AS DOUBLE), n_nationkey % 17 = 16 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, CAST(0.1 + (s_suppkey % 9) / 10.0 AS DOUBLE), s_suppkey % 17 = 0 FROM supplier
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, l_partkey + l_suppkey, CAST(least(0.9, 0.2 + count(*) / 10.0) AS DOUBLE), (l_partkey + l_suppkey) % 17 = 0 FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "act": """SELECT event_id AS id, 'ns' || (user_id % 3) AS namespace_id, user_id, CASE event_type WHEN 'click' THEN 'recall' WHEN 'view' THEN 'remember' WHEN 'purchase' THEN 'observe' WHEN 'signup' THEN 'forget' ELSE 'other' END AS event_type,
  value, props AS detail, ts AS created_at FROM events""",
    "vec": "SELECT 'v' || vec_id AS id, vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings",
}


def with_views(sql: str) -> str:
    """SQL with the views it names before it."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:]}"
    return f"WITH {heads} {body}"
