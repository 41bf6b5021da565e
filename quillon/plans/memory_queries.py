"""DC, GR, JN06-07: decay, consolidation, procedures, the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import decay, vectors as V
from quillon.operators import consolidation, graph, procedures
from quillon.plans import fixtures as X
from quillon.plans.ranking_queries import vecs
from quillon.plans.registry import query

R = lambda c, n=6: F.round(c, n)
T = "floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 1000) / 86400000.0"
RET = "CASE WHEN {t} <= 0 THEN 1.0 ELSE 1 / (1 + {t} / (9 * stability)) END"
EP = f"x AS (SELECT *, {T} AS t FROM mem WHERE memory_type = 'episodic'), y AS (SELECT *, {RET.format(t='t')} AS r FROM x)"


def days():
    return decay.elapsed_days(F.col("created_at"), X.now())


@query("dc01_retrievability", f"WITH {EP} SELECT id, round(r, 6) AS r FROM y")
def dc01(spark, d):
    return X.episodic(spark, d).select("id", R(decay.retrievability(F.col("stability"), days())).alias("r"))


@query("dc02_reinforce", f"WITH {EP} SELECT id, round(stability * (1 + 0.5 * (11 - (1 + access_count % 10)) * pow(stability, -0.2) * (exp(0.2 * (1 - r)) - 1)), 6) AS stability FROM y")
def dc02(spark, d):
    r = decay.retrievability(F.col("stability"), days())
    return X.episodic(spark, d).select("id", R(decay.reinforce(F.col("stability"), (1 + F.col("access_count") % 10).cast("double"), r)).alias("stability"))


@query("dc03_elapsed_days", f"WITH {EP} SELECT id, round(t, 6) AS days FROM y")
def dc03(spark, d):
    return X.episodic(spark, d).select("id", R(days()).alias("days"))


@query("dc04_forget", f"WITH {EP} SELECT id, round(greatest(stability * 0.3 * (11 - (1 + access_count % 10)) / 10, 0.01), 6) AS stability, CAST(least(1 + access_count % 10 + 2, 10) AS DOUBLE) AS difficulty FROM y")
def dc04(spark, d):
    hard = (1 + F.col("access_count") % 10).cast("double")
    return X.episodic(spark, d).select("id", R(decay.forget(F.col("stability"), hard)).alias("stability"), decay.harder(hard).alias("difficulty"))


@query("dc05_strength", f"WITH {EP} SELECT id, round(salience + ln(1 + salience) + 0.1, 6) AS strength, salience < 1 AND r < 0.1 AS archived FROM y")
def dc05(spark, d):
    r = decay.retrievability(F.col("stability"), days())
    return X.episodic(spark, d).select("id", R(decay.strengthen(F.col("salience"))).alias("strength"), decay.archived(F.col("salience"), r).alias("archived"))


@query("dc06_salience", f"WITH {EP}, z AS (SELECT *, least(greatest(0.4 * salience + 0.3 * r + 0.1 * (access_count / 10.0) + 0.2 * 0.5, 0), 1) AS s FROM y) SELECT id, round(s, 6) AS salience, round(stability * (1 + s), 6) AS effective FROM z")
def dc06(spark, d):
    r = decay.retrievability(F.col("stability"), days())
    s = decay.salience(F.col("salience"), r, F.col("access_count") / 10.0, F.lit(0.5))
    return X.episodic(spark, d).select("id", R(s).alias("salience"), R(decay.effective_stability(F.col("stability"), s)).alias("effective"))


@query("dc07_retention", f"WITH {EP}, z AS (SELECT *, least(greatest(0.3 * exp(-t / 30) + 0.3 * least(ln(access_count + 1) / 5, 1) + 0.2 * salience + 0.2 - CASE WHEN access_count = 3 THEN 0.3 ELSE 0 END, 0), 1) AS s FROM y) SELECT id, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'keep' WHEN s >= 0.3 THEN 'compress' ELSE 'archive' END AS tier FROM z")
def dc07(spark, d):
    s = decay.retention(days(), F.col("access_count"), F.col("salience"), F.col("access_count") == 3)
    return X.episodic(spark, d).select("id", R(s).alias("score"), decay.tier(s).alias("tier"))


@query("dc08_replay_priority", f"WITH {EP} SELECT id, round(CASE WHEN access_count = 3 THEN 0 ELSE salience * (1 - r) END, 6) AS priority FROM y")
def dc08(spark, d):
    r = decay.retrievability(F.col("stability"), days())
    return X.episodic(spark, d).select("id", R(decay.replay_priority(F.col("salience"), r, F.col("access_count") == 3)).alias("priority"))


@query("dc09_temporal_context", "WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.user_id, a.event_id, round(sum(0.15 * pow(0.85, a.i - b.i) * b.value) + 1e-9, 6) AS context FROM x a JOIN x b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1, 2")
def dc09(spark, d):
    rows = X.read(spark, d, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("at"), "event_id", "value")
    return consolidation.temporal_context(rows).select(F.col("session").alias("user_id"), "event_id", R(F.col("context") + 1e-9).alias("context"))


@query("dc10_promote", "SELECT source AS entity, 's-' || min(doc_id) AS seed, 's-' || max(doc_id) AS newest, count(*) AS size, round(least(count(*) * 0.3, 1), 6) AS confidence FROM documents GROUP BY source, text HAVING count(*) > 1")
def dc10(spark, d):
    """Hash embeddings of documents: only equal texts are near each other."""
    rows = X.read(spark, d, "documents").select(F.col("source").alias("entity"), F.concat(F.lit("s-"), "doc_id").alias("id"), X.at(F.col("doc_id")).alias("created_at"), F.md5(F.col("text").cast("binary")).alias("content"), V.hash_embedding(F.col("text")).alias("v"))
    return consolidation.promote(rows, 0.8).select("entity", "seed", "newest", "size", R("confidence").alias("confidence"))


@query("jn06_similar_pairs", "SELECT 'l' || a.label AS entity, a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS score FROM vec a JOIN vec b ON a.label = b.label AND a.id < b.id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) > 0.5")
def jn06(spark, d):
    return consolidation.similar_pairs(vecs(spark, d).withColumnRenamed("owner", "entity"), 0.5).withColumn("score", R("score"))


@query("jn07_supersession", "SELECT a.id AS new_id, b.id AS old_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS score FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.id <> b.id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) > 0.3")
def jn07(spark, d):
    v = vecs(spark, d).withColumnRenamed("owner", "entity")
    return consolidation.supersession(v.where("vec_id % 100 = 0"), v, 0.3).where("new_id <> old_id").withColumn("score", R("score"))


PASS = f"""SELECT id, memory_type, round(r, 6) AS retrievability, CASE WHEN gone THEN stability * 0.5 ELSE stability END AS stability, gone AS archived FROM (
 SELECT *, CASE memory_type WHEN 'episodic' THEN r < 0.1 WHEN 'procedural' THEN r < 0.1 AND reliability < 0.1 ELSE FALSE END AS gone FROM (
 SELECT *, {RET.format(t='t')} AS r FROM (SELECT *, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(coalesce(last_accessed, created_at))) / 1000) / 86400000.0 AS t FROM mem WHERE memory_type <> 'observation')))"""


@query("dc11_decay_pass", PASS)
def dc11(spark, d):
    return consolidation.decay_pass(X.memories(spark, d), X.now()).withColumn("retrievability", R("retrievability"))


@query("dc12_consolidation_stats", f"SELECT memory_type, count(*) AS decayed, count(*) FILTER (archived) AS archived FROM ({PASS}) GROUP BY 1")
def dc12(spark, d):
    return consolidation.stats(consolidation.decay_pass(X.memories(spark, d), X.now()))


TRIALS = "SELECT l_partkey, count(*) AS trials, count(*) FILTER (l_returnflag = 'N') AS successes, (count(*) FILTER (l_returnflag = 'N') + 1) / (count(*) + 2) AS reliability FROM lineitem GROUP BY 1"


def trials(spark, d):
    rows = X.read(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "N").alias("ok"))
    return procedures.reliability(rows, "l_partkey")


@query("dc13_reliability", f"SELECT l_partkey, trials, successes, round(reliability, 6) AS reliability FROM ({TRIALS})")
def dc13(spark, d):
    return trials(spark, d).withColumn("reliability", R("reliability"))


@query("dc14_prunable", f"SELECT l_partkey, trials, round(reliability, 6) AS reliability FROM ({TRIALS}) WHERE trials >= 20 AND reliability < 0.3")
def dc14(spark, d):
    return procedures.prunable(trials(spark, d), 20, 0.3).select("l_partkey", "trials", R("reliability").alias("reliability"))


@query("dc15_transfer", f"SELECT p_name AS trigger, p_type AS action, round(reliability * 0.7, 6) AS reliability, 0 AS trials FROM part JOIN ({TRIALS}) ON l_partkey = p_partkey WHERE reliability >= 0.5 AND trials >= 3 AND (p_name, p_type) NOT IN (SELECT p_name, p_type FROM part WHERE p_size < 5)")
def dc15(spark, d):
    p = X.read(spark, d, "part")
    rows = p.join(trials(spark, d), F.col("l_partkey") == F.col("p_partkey")).selectExpr("p_name trigger", "p_type action", "reliability", "trials")
    out = procedures.transferable(rows, p.where("p_size < 5").selectExpr("p_name trigger", "p_type action"), 0.5)
    return out.select("trigger", "action", R("reliability").alias("reliability"), "trials")


@query("dc16_context_reliability", "SELECT l_suppkey, round((sum(CASE WHEN l_returnflag = 'N' THEN w ELSE 0 END) + 1) / (sum(w) + 2), 6) AS reliability FROM (SELECT *, pow(greatest(1 - l_discount * 12, 0), 2) AS w FROM lineitem) GROUP BY 1")
def dc16(spark, d):
    rows = X.read(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "N").alias("ok"), (1 - F.col("l_discount") * 12).alias("cosine"))
    return procedures.weighted(rows, "l_suppkey").withColumn("reliability", R("reliability"))


@query("dc17_adaptive_discount", "SELECT p_partkey, round(0.5 + 0.3 * least(greatest(p_size / 40.0, 0), 1), 6) AS discount FROM part")
def dc17(spark, d):
    return X.read(spark, d, "part").select("p_partkey", R(procedures.adaptive_discount(F.col("p_size") / 40.0)).alias("discount"))


@query("gr01_build", "SELECT source, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT about_entity AS source, id, 1.0::DOUBLE AS weight FROM mem WHERE memory_type = 'episodic' UNION ALL SELECT subject, id, confidence FROM mem WHERE memory_type = 'semantic') GROUP BY 1")
def gr01(spark, d):
    return graph.from_memories(X.memories(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), R(F.sum("weight")).alias("weight"))


STARTS = "SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0"


def starts(spark, d):
    return X.read(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))


@query("gr02_bfs", f"WITH RECURSIVE b AS (SELECT id AS start, id AS node, 0 AS distance FROM ({STARTS}) UNION SELECT b.start, e.target, b.distance + 1 FROM b JOIN edg e ON e.source = b.node WHERE e.invalid_at IS NULL AND b.distance < 4) SELECT start, node, min(distance) AS distance, round(1 / (1 + min(distance)), 6) AS score FROM b WHERE node <> start GROUP BY 1, 2")
def gr02(spark, d):
    return graph.bfs(X.edges(spark, d), starts(spark, d), 4).withColumn("score", R("score"))


@query("gr03_beam", f"""WITH a AS (SELECT id AS start, 'question' AS intent FROM ({STARTS})), w AS (SELECT *, exp(0.4 * CASE edge_type WHEN 'entity' THEN 0.8 WHEN 'semantic' THEN 0.7 ELSE 0.3 END + 0.4 * weight + 0.2 * exp(-age_days * ln(2) / 90)) AS g FROM edg WHERE invalid_at IS NULL),
 d1 AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, node) AS r FROM (SELECT start, target AS node, max(g) AS score FROM a JOIN w ON source = start GROUP BY 1, 2)), k1 AS (SELECT start, node, score FROM d1 WHERE r <= 10 AND node <> start),
 d2 AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, node) AS r FROM (SELECT start, target AS node, max(k1.score * g) AS score FROM k1 JOIN w ON source = node GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM k1 y WHERE y.start = x.start AND y.node = x.node)), k2 AS (SELECT start, node, score FROM d2 WHERE r <= 10),
 d3 AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, node) AS r FROM (SELECT start, target AS node, max(k2.score * g) AS score FROM k2 JOIN w ON source = node GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM k1 y WHERE y.start = x.start AND y.node = x.node) AND NOT EXISTS (SELECT 1 FROM k2 y WHERE y.start = x.start AND y.node = x.node)), k3 AS (SELECT start, node, score FROM d3 WHERE r <= 10)
 SELECT start, node, round(score, 6) AS score FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)""")
def gr03(spark, d):
    return graph.beam(X.edges(spark, d), starts(spark, d).withColumn("intent", F.lit("question"))).select("start", "node", R("score").alias("score"))


@query("rk11_spreading", f"WITH a AS (SELECT id AS start FROM ({STARTS})) SELECT start, target AS node, round(max(exp(0.4 * CASE edge_type WHEN 'entity' THEN 0.7 WHEN 'causal' THEN 0.6 ELSE 0.3 END + 0.4 * weight + 0.2 * exp(-age_days * ln(2) / 90))), 6) AS score FROM a JOIN edg ON source = start WHERE invalid_at IS NULL GROUP BY 1, 2")
def rk11(spark, d):
    return graph.beam(X.edges(spark, d), starts(spark, d).withColumn("intent", F.lit("code")), width=10_000, depth=1).select("start", "node", R("score").alias("score"))


AL = "CASE " + " ".join(f"WHEN edge_type = '{e}' AND intent = '{i}' THEN {s}" for e, i, s in graph.ALIGNMENT) + f" ELSE {graph.DEFAULT_ALIGNMENT} END"


@query("gr04_alignment", f"SELECT edge_type, intent, n, CAST({AL} AS DOUBLE) AS alignment FROM (SELECT edge_type, count(*) AS n FROM edg GROUP BY 1), (SELECT unnest(['recall', 'action', 'question', 'code', 'general']) AS intent)")
def gr04(spark, d):
    rows = X.edges(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).withColumn("intent", F.explode(F.array(*[F.lit(i) for i in ("recall", "action", "question", "code", "general")])))
    return rows.select("edge_type", "intent", "n", graph.alignment(F.col("edge_type"), F.col("intent")).alias("alignment"))


@query("gr05_edge_confidence", "SELECT id, round(weight * exp(-age_days * ln(2) / 90), 6) AS confidence FROM edg")
def gr05(spark, d):
    return X.edges(spark, d).select("id", R(decay.edge_confidence(F.col("weight"), F.col("age_days"))).alias("confidence"))


@query("gr06_supersede", "SELECT e.id, strftime(CASE WHEN c.c_custkey IS NOT NULL AND e.invalid_at IS NULL THEN TIMESTAMP '2024-02-01' ELSE e.invalid_at END, '%Y-%m-%d') AS ended, CASE WHEN c.c_custkey IS NOT NULL AND e.invalid_at IS NULL THEN 'new' END AS superseded_by FROM edg e LEFT JOIN customer c ON e.source = 'c' || c_custkey AND c_acctbal < 0")
def gr06(spark, d):
    pairs = X.read(spark, d, "customer").where("c_acctbal < 0").selectExpr("concat('c', c_custkey) source", "concat('n', c_nationkey) target", "'new' by")
    return graph.superseded(X.edges(spark, d), pairs, X.now()).select("id", F.date_format("invalid_at", "yyyy-MM-dd").alias("ended"), "superseded_by")


@query("gr07_valid_out_edges", "SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY age_days DESC, id) AS position, count(*) FILTER (invalid_at IS NULL) OVER (PARTITION BY source) AS valid, invalid_at IS NULL AS still FROM edg")
def gr07(spark, d):
    return graph.history(X.edges(spark, d)).select("source", "id", F.col("position").cast("long"), "valid", "still")


@query("gr08_counts", "SELECT (SELECT count(*) FROM (SELECT source FROM edg UNION SELECT target FROM edg)) AS nodes, (SELECT count(*) FROM edg) AS edges")
def gr08(spark, d):
    return graph.counts(X.edges(spark, d))
