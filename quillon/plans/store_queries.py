"""SC and SK: lookups, lists, mutations, erasure, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import store
from quillon.plans import fixtures as X
from quillon.plans.registry import query

T0 = "TIMESTAMP '2024-02-01'"
S = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
STR = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def wanted(spark, d):
    """Ids of every hundredth conversation's and document's memories."""
    c = X.read(spark, d, "conversations").where("conv_id % 100 = 0").selectExpr("concat('e-', conv_id, '-', turn) id")
    return c.unionByName(X.read(spark, d, "documents").where("doc_id % 100 = 0").selectExpr("concat('s-', doc_id) id"))


WANTED = "SELECT 'e-' || conv_id || '-' || turn AS id FROM conversations WHERE conv_id % 100 = 0 UNION ALL SELECT 's-' || doc_id FROM documents WHERE doc_id % 100 = 0"


@query("sc01_point_lookup", f"SELECT id, memory_type, content FROM mem WHERE id IN ({WANTED})")
def sc01(spark, d):
    return store.by_ids(X.memories(spark, d), wanted(spark, d)).select("id", "memory_type", "content")


@query("sc02_lookup_by_name", "SELECT e.id, e.name, e.namespace_id FROM ent e JOIN (SELECT 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS name, 'ns' || (s_nationkey % 3) AS namespace_id FROM supplier) s USING (name, namespace_id)")
def sc02(spark, d):
    names = X.read(spark, d, "supplier").selectExpr("concat('Customer#', lpad(s_suppkey, 9, '0')) name", "concat('ns', s_nationkey % 3) namespace_id")
    return X.entities(spark, d).join(names, ["name", "namespace_id"], "left_semi").select("id", "name", "namespace_id")


@query("sc03_get_or_create", """SELECT id, name, namespace_id FROM ent UNION ALL SELECT min('s' || s_suppkey) AS id, s_name AS name, 'ns' || (s_nationkey % 3) AS namespace_id FROM supplier s
 WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.name = s_name AND e.namespace_id = 'ns' || (s_nationkey % 3)) GROUP BY s_name, 'ns' || (s_nationkey % 3)""")
def sc03(spark, d):
    incoming = X.read(spark, d, "supplier").selectExpr("concat('s', s_suppkey) id", "s_name name", "concat('ns', s_nationkey % 3) namespace_id")
    return store.get_or_create(X.entities(spark, d).select("id", "name", "namespace_id"), incoming, ["name", "namespace_id"])


@query("sc04_list_episodic", f"SELECT id, about_entity, {STR.format('created_at')} AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY about_entity ORDER BY created_at DESC, id) AS r FROM mem WHERE memory_type = 'episodic') WHERE r <= 10")
def sc04(spark, d):
    return store.newest(X.episodic(spark, d), "about_entity", F.col("created_at"), 10).select("id", "about_entity", S("created_at").alias("created_at"))


@query("sc05_list_semantic", f"SELECT id, subject, {STR.format('created_at')} AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id) AS r FROM mem WHERE memory_type = 'semantic') WHERE r <= 10")
def sc05(spark, d):
    return store.newest(X.semantic(spark, d), "subject", F.col("created_at"), 10).select("id", "subject", S("created_at").alias("created_at"))


@query("sc06_episode_timeline", "SELECT id, episode_id, row_number() OVER (PARTITION BY namespace_id, episode_id ORDER BY coalesce(event_time, created_at), id) AS position FROM mem WHERE memory_type = 'episodic'")
def sc06(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("namespace_id", "episode_id").orderBy(F.coalesce("event_time", "created_at"), "id")
    return X.episodic(spark, d).select("id", "episode_id", F.row_number().over(w).cast("long").alias("position"))


@query("sc07_observations_of_episodes", f"SELECT id, episode_id FROM mem WHERE memory_type = 'observation' AND episode_id IN (SELECT id FROM epi) ORDER BY created_at, id LIMIT 1024")
def sc07(spark, d):
    return store.of_episodes(X.observation(spark, d), X.episodes(spark, d)).orderBy("created_at", "id").limit(1024).select("id", "episode_id")


@query("sc08_namespace_scan", "SELECT id, namespace_id, memory_type, CASE memory_type WHEN 'episodic' THEN 0 WHEN 'semantic' THEN 1 WHEN 'procedural' THEN 2 ELSE 3 END AS type_rank FROM mem")
def sc08(spark, d):
    return store.in_type_order(X.episodic(spark, d), X.semantic(spark, d), X.procedural(spark, d), X.observation(spark, d)).select("id", "namespace_id", "memory_type", "type_rank")


@query("sc09_list_entities", "SELECT namespace_id, id, name, kind FROM ent")
def sc09(spark, d):
    return X.entities(spark, d).select("namespace_id", "id", "name", "kind")


@query("sc10_edges_touching", "SELECT n.id AS node, e.id FROM edg e JOIN (SELECT 's' || s_suppkey AS id FROM supplier) n ON e.source = n.id OR e.target = n.id")
def sc10(spark, d):
    return store.touching(X.edges(spark, d), X.read(spark, d, "supplier").selectExpr("concat('s', s_suppkey) id")).select("node", "id")


@query("sc11_newest_accesses", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 20")
def sc11(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return X.read(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 20")


@query("sc12_vector_index_load", "SELECT 'v' || vec_id AS id, 'l' || label AS owner, len(embedding) AS size FROM embeddings WHERE len(embedding) > 0")
def sc12(spark, d):
    return X.read(spark, d, "embeddings").where(F.size("embedding") > 0).select(F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("l"), "label").alias("owner"), F.size("embedding").cast("long").alias("size"))


INSPECT = "SELECT entity, id, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, created_at DESC, id) AS r FROM (SELECT about_entity AS entity, 0 AS t, created_at, id FROM mem WHERE memory_type = 'episodic' UNION ALL SELECT 'u' || (len(subject) * 7) AS entity, 1, created_at, id FROM mem WHERE memory_type = 'semantic')) WHERE r <= 20"


@query("sc13_inspect", INSPECT)
def sc13(spark, d):
    from pyspark.sql.window import Window

    a = X.episodic(spark, d).select(F.col("about_entity").alias("entity"), "created_at", "id")
    b = X.semantic(spark, d).select(F.concat(F.lit("u"), F.length("subject") * 7).alias("entity"), "created_at", "id")
    got = store.filled(a, b, "entity", 20)
    return got.select("entity", "id", F.row_number().over(Window.partitionBy("entity").orderBy("type_rank", F.desc("created_at"), "id")).cast("long").alias("position"))


@query("sk01_upsert", "SELECT id, name, kind FROM ent WHERE id NOT IN (SELECT 'c' || s_suppkey FROM supplier) UNION ALL SELECT 'c' || s_suppkey AS id, s_name AS name, 'team' AS kind FROM supplier")
def sk01(spark, d):
    new = X.read(spark, d, "supplier").selectExpr("concat('c', s_suppkey) id", "s_name name", "'team' kind")
    return store.upsert(X.entities(spark, d).select("id", "name", "kind"), new)


@query("sk02_close_episode", f"SELECT id, coalesce(o.outcome, e.outcome) AS outcome, {STR.format('coalesce(o.ended, e.ended_at)')} AS ended_at FROM epi e LEFT JOIN (SELECT 'ep' || o_orderkey AS id, {T0} AS ended, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failure' END AS outcome FROM orders) o USING (id)")
def sk02(spark, d):
    u = X.read(spark, d, "orders").select(F.concat(F.lit("ep"), "o_orderkey").alias("id"), X.now().alias("ended_at"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failure' END").alias("outcome"))
    return store.updated(X.episodes(spark, d).select("id", "ended_at", "outcome"), u).select("id", "outcome", S("ended_at").alias("ended_at"))


@query("sk03_touch_access", f"SELECT id, CASE WHEN w THEN 99.0 ELSE stability END AS stability, CASE WHEN w THEN access_count + 1 ELSE access_count END AS access_count, {STR.format(f'CASE WHEN w THEN {T0} ELSE last_accessed END')} AS last_accessed FROM (SELECT *, id IN ({WANTED}) AS w FROM mem WHERE memory_type = 'episodic')")
def sk03(spark, d):
    u = wanted(spark, d).withColumn("stability", F.lit(99.0)).withColumn("retrievability", F.lit(1.0))
    return store.touched(X.episodic(spark, d), u, X.now()).select("id", "stability", "access_count", S("last_accessed").alias("last_accessed"))


@query("sk04_update_reliability", "SELECT id, coalesce(round((s + 1.0) / (n + 2.0), 6), reliability) AS reliability, coalesce(n, trial_count) AS trial_count FROM mem LEFT JOIN (SELECT 'p' || '-' || l_partkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS s FROM lineitem GROUP BY 1) USING (id) WHERE memory_type = 'procedural'")
def sk04(spark, d):
    from quillon.operators import procedures

    trials = X.read(spark, d, "lineitem").select(F.concat(F.lit("p-"), "l_partkey").alias("id"), (F.col("l_returnflag") == "N").alias("ok"))
    u = procedures.reliability(trials, "id").select("id", F.round("reliability", 6).alias("reliability"), F.col("trials").alias("trial_count"))
    return store.updated(X.procedural(spark, d).select("id", "reliability", "trial_count"), u)


@query("sk05_update_content", "SELECT id, 'note' AS predicate, lower(object) AS object, confidence FROM mem WHERE memory_type = 'semantic' AND subject = 'src0' UNION ALL SELECT id, predicate, object, confidence FROM mem WHERE memory_type = 'semantic' AND subject <> 'src0'")
def sk05(spark, d):
    rows = X.semantic(spark, d)
    u = rows.where("subject = 'src0'").select("id", F.lit("note").alias("predicate"), F.lower("object").alias("object"), F.lit(None).cast("double").alias("confidence"))
    return store.updated(rows.select("id", "predicate", "object", "confidence"), u)


@query("sk06_invalidate", f"SELECT id, {STR.format(f'CASE WHEN id IN ({WANTED}) THEN {T0} ELSE invalid_at END')} AS invalid_at FROM mem WHERE memory_type = 'semantic'")
def sk06(spark, d):
    return store.invalidated(X.semantic(spark, d), wanted(spark, d), X.now()).select("id", S("invalid_at").alias("invalid_at"))


ENTS = ("SELECT DISTINCT 'u' || (c_custkey % 25) AS id FROM customer WHERE c_acctbal < 0 UNION SELECT 'src3'",)


def erased(spark, d):
    """Entities to erase: those of customers in debt, and one source."""
    return X.read(spark, d, "customer").where("c_acctbal < 0").selectExpr("concat('u', c_custkey % 25) id").unionByName(spark.sql("SELECT 'src3' AS id")).distinct()


@query("sk07_delete_by_entity", f"SELECT memory_type, count(*) AS n FROM mem WHERE NOT (memory_type = 'episodic' AND (about_entity IN ({ENTS[0]}) OR source_entity IN ({ENTS[0]})) OR memory_type = 'semantic' AND subject IN ({ENTS[0]})) GROUP BY 1")
def sk07(spark, d):
    return store.without_entities(X.memories(spark, d), erased(spark, d)).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("sk08_delete_by_id", f"SELECT id, memory_type FROM mem WHERE id NOT IN ({WANTED})")
def sk08(spark, d):
    return X.memories(spark, d).join(wanted(spark, d), "id", "left_anti").select("id", "memory_type")


@query("sk09_purge_namespace", "SELECT namespace_id, memory_type, count(*) AS n FROM mem WHERE namespace_id <> 'ns1' GROUP BY 1, 2")
def sk09(spark, d):
    return X.memories(spark, d).where("namespace_id <> 'ns1'").groupBy("namespace_id", "memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("sk10_delete_observations_of_episodes", "SELECT id FROM mem WHERE memory_type = 'observation' AND episode_id NOT IN (SELECT id FROM epi WHERE outcome = 'failure')")
def sk10(spark, d):
    return X.observation(spark, d).join(X.episodes(spark, d).where("outcome = 'failure'").select(F.col("id").alias("episode_id")), "episode_id", "left_anti").select("id")


@query("sk11_delete_observations_of_entities", f"SELECT id FROM mem WHERE memory_type = 'observation' AND episode_id NOT IN (SELECT id FROM (SELECT id, unnest(participants) AS p FROM epi) WHERE p IN ({ENTS[0]}))")
def sk11(spark, d):
    mine = store.participated(X.episodes(spark, d), erased(spark, d)).select(F.col("id").alias("episode_id")).distinct()
    return X.observation(spark, d).join(mine, "episode_id", "left_anti").select("id")


@query("sk12_delete_entity", "SELECT id, name FROM ent WHERE id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)")
def sk12(spark, d):
    return X.entities(spark, d).join(X.read(spark, d, "customer").where("c_acctbal < 0").selectExpr("concat('c', c_custkey) id"), "id", "left_anti").select("id", "name")


@query("sk13_append_activity", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM act UNION ALL SELECT 'recall' FROM orders) GROUP BY 1")
def sk13(spark, d):
    more = X.read(spark, d, "orders").select(F.lit("recall").alias("event_type"))
    return X.activity(spark, d).select("event_type").unionByName(more).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sk14_record_access", "SELECT l_partkey AS memory_id, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem GROUP BY 1, 2")
def sk14(spark, d):
    return X.read(spark, d, "lineitem").select(F.col("l_partkey").alias("memory_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).dropDuplicates(["memory_id", "day"])


ERASE = f"""SELECT e.id AS entity, (SELECT count(*) FROM mem WHERE memory_type = 'observation' AND episode_id IN (SELECT id FROM (SELECT id, unnest(participants) AS p FROM epi) q WHERE q.p = e.id)) AS observations,
 (SELECT count(*) FROM mem WHERE memory_type = 'episodic' AND (about_entity = e.id OR source_entity = e.id) OR memory_type = 'semantic' AND subject = e.id) AS memories,
 (SELECT count(*) FROM edg WHERE source = e.id OR target = e.id) AS edges FROM ({ENTS[0]}) e"""


@query("sk15_erase_entities", ERASE)
def sk15(spark, d):
    return store.erase(X.memories(spark, d), X.episodes(spark, d), X.edges(spark, d), erased(spark, d))["report"]


@query("sk16_erase_namespace", "SELECT namespace_id, memory_type, count(*) AS n FROM mem WHERE memory_type IN ('procedural', 'observation') OR namespace_id <> 'ns2' GROUP BY 1, 2")
def sk16(spark, d):
    rows = X.memories(spark, d)
    return rows.where("NOT (namespace_id = 'ns2' AND memory_type IN ('episodic', 'semantic'))").groupBy("namespace_id", "memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("sk17_export", f"""SELECT entity, id, json_object('id', id, 'memory_type', memory_type, 'content', content)::VARCHAR AS record FROM (
 SELECT e.id AS entity, m.id, m.memory_type, m.content FROM mem m JOIN ({ENTS[0]}) e ON m.memory_type = 'episodic' AND (m.about_entity = e.id OR m.source_entity = e.id) OR m.memory_type = 'semantic' AND m.subject = e.id
 UNION ALL SELECT DISTINCT q.p, m.id, m.memory_type, m.content FROM mem m JOIN (SELECT id, unnest(participants) AS p FROM epi) q ON m.episode_id = q.id AND m.memory_type = 'observation' JOIN ({ENTS[0]}) e ON q.p = e.id)""")
def sk17(spark, d):
    return store.export(X.memories(spark, d), X.episodes(spark, d), erased(spark, d))
