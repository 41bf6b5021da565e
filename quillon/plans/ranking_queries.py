"""FT, JN, RK: text matching, joins, the ranking pipeline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import decay, text as T, vectors as V
from quillon.operators import fusion, graph, search, sessions, store
from quillon.plans import fixtures as X
from quillon.plans.registry import query
from quillon.sources.scratch import kept

R = lambda c, n=6: F.round(c, n)


def docs(spark, d):
    return X.read(spark, d, "documents").select(F.concat(F.lit("s-"), "doc_id").alias("id"), "text", "source", "lang")


def texts(spark, d):
    return X.read(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("qid"), "text")


def vecs(spark, d):
    return X.read(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.concat(F.lit("l"), "label").alias("owner"), "vec_id", "label")


def asked(spark, d):
    """The search's queries: every row whose id is divisible by 100."""
    return vecs(spark, d).where("vec_id % 100 = 0").withColumn("qid", F.col("id"))


TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
POST = f"""q AS (SELECT qid, token, count(*) OVER (PARTITION BY qid) AS n_terms FROM (SELECT DISTINCT 'q' || item_id AS qid, unnest({TOK}) AS token FROM benchmark)),
 w AS (SELECT 's-' || doc_id AS id, {TOK} AS t FROM documents), f AS (SELECT id, len(t) AS length, unnest(t) AS token FROM w),
 p AS (SELECT id, token, count(*) AS tf, any_value(length) AS length FROM f WHERE token IN (SELECT token FROM q) GROUP BY id, token),
 m AS (SELECT qid, id FROM p JOIN q USING (token) GROUP BY qid, id HAVING count(*) = any_value(n_terms))"""
BM = f"""{POST}, z AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM w), dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
 b AS (SELECT qid, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM p JOIN q USING (token) JOIN dfs USING (token), z GROUP BY qid, id)"""


@query("ft01_match_all", f"WITH {POST} SELECT qid, id FROM m")
def ft01(spark, d):
    return search.match_all(docs(spark, d), texts(spark, d))


def kinds(spark, d):
    kind = F.when(F.col("memory_type") == "semantic", 0).when(F.col("memory_type") == "episodic", 1).otherwise(2).cast("int")
    owners = F.when(F.col("memory_type") == "semantic", F.array("subject")).when(F.col("memory_type") == "episodic", F.array("about_entity", "source_entity")).otherwise(F.array().cast("array<string>"))
    return X.memories(spark, d).select("id", "memory_type", F.col("content").alias("text"), kind.alias("kind"), F.array_compact(owners).alias("owners"))


MEMBM = f"""q AS (SELECT DISTINCT 'q' || item_id AS qid, unnest({TOK}) AS token FROM benchmark), w AS (SELECT id, memory_type, subject, about_entity, source_entity, {TOK.replace('text', 'content')} AS t FROM mem), f AS (SELECT id, len(t) AS length, unnest(t) AS token FROM w),
 p AS (SELECT id, token, count(*) AS tf, any_value(length) AS length FROM f WHERE token IN (SELECT token FROM q) GROUP BY id, token), z AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM w), dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
 b AS (SELECT qid, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM p JOIN q USING (token) JOIN dfs USING (token), z GROUP BY qid, id)"""


@query("ft02_match_ranked_by_type", f"WITH {MEMBM}, x AS (SELECT qid, b.id, memory_type, row_number() OVER (PARTITION BY qid, memory_type ORDER BY score DESC, b.id) AS r FROM b JOIN w USING (id)) SELECT qid, id, memory_type, r AS rank FROM x WHERE r <= 20")
def ft02(spark, d):
    rows, out = kinds(spark, d), None
    # a word's weight is that in all memories: kinds are ranked apart, each memory's target being its kind
    asked = texts(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in X.TYPES], "target string")))  # four rows
    by_kind = rows.select("id", "text", F.lit(0).alias("kind"), F.array("memory_type").alias("owners"))
    found = search.lexical_paths(by_kind, asked.select(F.concat_ws("|", "qid", "target").alias("qid"), "text", "target"), 1, 20).where("path = 0")
    return found.select(F.substring_index("qid", "|", 1).alias("qid"), "id", F.substring_index("qid", "|", -1).alias("memory_type"), F.col("rank").cast("long"))


@query("ft03_match_scoped", f"""WITH {MEMBM}, a AS (SELECT 'q' || item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'u' || (item_id % 50) ELSE 'src' || (item_id % 20) END AS target FROM benchmark),
 x AS (SELECT qid, b.id, memory_type, row_number() OVER (PARTITION BY qid ORDER BY CASE memory_type WHEN 'semantic' THEN 0 ELSE 1 END, score DESC, b.id) AS r FROM b JOIN a USING (qid) JOIN w USING (id) WHERE memory_type = 'semantic' AND subject = target OR memory_type = 'episodic' AND (about_entity = target OR source_entity = target))
 SELECT qid, id, r AS rank FROM x WHERE r <= 20""")
def ft03(spark, d):
    target = F.expr("CASE WHEN substr(qid, 2) % 2 = 0 THEN concat('u', cast(substr(qid, 2) AS INT) % 50) ELSE concat('src', cast(substr(qid, 2) AS INT) % 20) END")
    found = search.lexical_paths(kinds(spark, d), texts(spark, d).withColumn("target", target), 1, 20)
    return found.where("path = 0").select("qid", "id", F.col("rank").cast("long"))


@query("ft04_bm25", f"WITH {BM} SELECT qid, id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM b) WHERE r <= 10")
def ft04(spark, d):
    return search.bm25_top(docs(spark, d), texts(spark, d), 10).select("qid", "id", R("score").alias("score"), F.col("rank").cast("long"))


def _any(words, low="lower(text)"):
    return "(" + " OR ".join("contains({}, '{}')".format(low, w.replace("'", "''")) for w in words) + ")"


@query("ft05_contains_any", f"SELECT doc_id, {_any(T.QUESTION)} AS hit FROM documents")
def ft05(spark, d):
    return X.read(spark, d, "documents").select("doc_id", T.any_of(F.lower("text"), T.QUESTION).alias("hit"))


@query("ft06_whole_phrase", f"SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^0-9A-Za-z])({'|'.join(T.COUNTING)})($|[^0-9A-Za-z])') AS hit FROM conversations")
def ft06(spark, d):
    return X.read(spark, d, "conversations").select("conv_id", "turn", T.whole_phrase(F.col("text"), T.COUNTING).alias("hit"))


@query("ft07_type_filter", "SELECT id, memory_type FROM mem WHERE memory_type IN ('semantic', 'procedural')")
def ft07(spark, d):
    return X.memories(spark, d).where(F.col("memory_type").isin("semantic", "procedural")).select("id", "memory_type")


@query("ft08_min_confidence_after_limit", "SELECT subject, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id) AS r FROM mem WHERE memory_type = 'semantic') WHERE r <= 20 AND confidence >= 0.5")
def ft08(spark, d):
    return store.newest(X.semantic(spark, d), "subject", F.col("created_at"), 20).where("confidence >= 0.5").select("subject", "id", "confidence")


@query("ft09_entity_post_filter", "SELECT id, memory_type FROM mem WHERE memory_type IN ('procedural', 'observation') OR coalesce(about_entity = 'u7', FALSE) OR coalesce(source_entity = 'u7', FALSE) OR coalesce(subject = 'u7', FALSE)")
def ft09(spark, d):
    e = F.lit("u7")
    return X.memories(spark, d).where(F.col("memory_type").isin("procedural", "observation") | F.col("about_entity").eqNullSafe(e) | F.col("source_entity").eqNullSafe(e) | F.col("subject").eqNullSafe(e)).select("id", "memory_type")


@query("ft10_valid_edges", "SELECT id, edge_type FROM edg WHERE invalid_at IS NULL")
def ft10(spark, d):
    from quillon.operators import graph

    return graph.valid(X.edges(spark, d)).select("id", "edge_type")


@query("ft11_namespace_isolation", "SELECT namespace_id, memory_type, count(*) AS n FROM mem WHERE namespace_id = 'ns0' GROUP BY 1, 2")
def ft11(spark, d):
    return X.memories(spark, d).where("namespace_id = 'ns0'").groupBy("namespace_id", "memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("ft12_substring_recall", "SELECT id FROM mem WHERE contains(lower(content), lower('The')) ORDER BY id LIMIT 50")
def ft12(spark, d):
    return X.memories(spark, d).where(F.contains(F.lower("content"), F.lower(F.lit("The")))).orderBy("id").limit(50).select("id")


@query("ft13_access_check", "SELECT c_custkey, greatest(coalesce(list_position(['reader', 'writer', 'admin'], CASE c_nationkey % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' WHEN 2 THEN 'admin' ELSE 'guest' END), 1), 1) >= 2 AS allowed FROM customer")
def ft13(spark, d):
    from quillon.operators import sync

    role = F.expr("CASE c_nationkey % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' WHEN 2 THEN 'admin' ELSE 'guest' END")
    return X.read(spark, d, "customer").select("c_custkey", sync.allowed(role, F.lit("writer")).alias("allowed"))


@query("jn01_hits_join_semantic", f"WITH {POST} SELECT m.qid, m.id, s.confidence FROM m JOIN mem s ON m.id = s.id AND s.subject = 'src0'")
def jn01(spark, d):
    return search.match_all(docs(spark, d), texts(spark, d)).join(X.semantic(spark, d).where("subject = 'src0'").select("id", "confidence"), "id").select("qid", "id", "confidence")


@query("jn02_hits_join_episodic", "SELECT DISTINCT c.id, c.about_entity FROM mem c JOIN (SELECT 'u' || (c_custkey % 25) AS e FROM customer WHERE c_acctbal < 0) x ON c.about_entity = x.e OR c.source_entity = x.e WHERE c.memory_type = 'episodic'")
def jn02(spark, d):
    e = X.read(spark, d, "customer").where("c_acctbal < 0").selectExpr("concat('u', c_custkey % 25) id")
    return store.of_entities(X.episodic(spark, d), e).select("id", "about_entity").distinct()


@query("jn03_hydrate", "SELECT h.id, coalesce(m.memory_type, 'missing') AS memory_type FROM (SELECT 's-' || (vec_id * 3) AS id FROM embeddings UNION SELECT 'p-' || vec_id FROM embeddings) h LEFT JOIN mem m ON h.id = m.id")
def jn03(spark, d):
    v = X.read(spark, d, "embeddings")
    hits = v.selectExpr("concat('s-', vec_id * 3) id").unionByName(v.selectExpr("concat('p-', vec_id) id")).distinct()
    return hits.join(X.memories(spark, d).select("id", "memory_type"), "id", "left").select("id", F.coalesce("memory_type", F.lit("missing")).alias("memory_type"))


@query("jn08_transfer_anti_join", "SELECT p_name AS trigger, p_type AS action FROM part WHERE p_size >= 25 AND (p_name, p_type) NOT IN (SELECT p_name, p_type FROM part WHERE p_size < 25) GROUP BY 1, 2")
def jn08(spark, d):
    p = X.read(spark, d, "part").selectExpr("p_name trigger", "p_type action", "p_size")
    return p.where("p_size >= 25").join(p.where("p_size < 25").select("trigger", "action"), ["trigger", "action"], "left_anti").select("trigger", "action").distinct()


@query("jn09_semi_join", "SELECT id, outcome FROM epi WHERE id IN (SELECT DISTINCT episode_id FROM mem WHERE memory_type = 'observation')")
def jn09(spark, d):
    return X.episodes(spark, d).join(X.observation(spark, d).select(F.col("episode_id").alias("id")), "id", "left_semi").select("id", "outcome")


@query("jn10_traversal_step", "SELECT DISTINCT a.source AS start, b.target AS node FROM edg a JOIN edg b ON a.target = b.source WHERE a.invalid_at IS NULL AND b.invalid_at IS NULL")
def jn10(spark, d):
    e = X.edges(spark, d).where("invalid_at IS NULL")
    return e.select(F.col("source").alias("start"), F.col("target").alias("mid")).join(e.select(F.col("source").alias("mid"), F.col("target").alias("node")), "mid").select("start", "node").distinct()


COS = "a AS (SELECT id AS qid, label AS ql, e AS qe, norm AS qn FROM vec WHERE vec_id % 100 = 0), s AS (SELECT qid, id, ql, label, round(list_dot_product(qe, e) / (qn * norm), 9) AS score FROM a, vec WHERE norm > 0 AND qn > 0)"


def cosines(spark, d, k, scoped=False):
    return search.top_k(search.vector_top_k(vecs(spark, d), asked(spark, d), k + 5, scoped).select("qid", "id", R("score", 9).alias("score")), k)


@query("rk01_vector_top_k", f"WITH {COS} SELECT qid, id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10")
def rk01(spark, d):
    return cosines(spark, d, 10).select("qid", "id", R("score").alias("score"), F.col("rank").cast("long"))


@query("jn05_query_similarity", f"WITH {COS} SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 100")
def jn05(spark, d):
    return cosines(spark, d, 100).select("qid", "id", R("score").alias("score"))


@query("rk02_filtered_top_k", f"WITH {COS} SELECT qid, id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s WHERE ql = label) WHERE r <= 10")
def rk02(spark, d):
    return cosines(spark, d, 10, True).select("qid", "id", R("score").alias("score"), F.col("rank").cast("long"))


@query("jn11_gold_membership", f"WITH {COS} SELECT qid, id, ql = label AS gold FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10")
def jn11(spark, d):
    labels = vecs(spark, d).select("id", "label")
    got = cosines(spark, d, 10).select("qid", "id")
    gold = asked(spark, d).select("qid", F.col("label").alias("ql")).join(labels.withColumnRenamed("label", "ql"), "ql").select("qid", "id", F.lit(True).alias("hit"))
    return got.join(gold, ["qid", "id"], "left").select("qid", "id", F.col("hit").isNotNull().alias("gold"))


@query("rk03_positional_score", f"WITH {POST}, x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS r, count(*) OVER (PARTITION BY qid) AS n FROM m) SELECT qid, id, round((n - r + 1) / n, 6) AS score FROM x")
def rk03(spark, d):
    hits = search.match_all(docs(spark, d), texts(spark, d)).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return search.positional(hits).withColumn("score", R("score"))


def _intent(col):
    return "CASE " + " ".join(f"WHEN {_any(w, f'lower({col})')} THEN '{n}'" for n, w in T.INTENTS) + " ELSE 'general' END"


@query("rk06_intent", f"SELECT conv_id, turn, {_intent('text')} AS intent FROM conversations")
def rk06(spark, d):
    return X.read(spark, d, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


AFF = "CASE " + " ".join(f"WHEN intent = '{i}' AND memory_type = '{t}' THEN {s}" for i, t, s in T.AFFINITY) + f" ELSE {T.DEFAULT_AFFINITY} END"


@query("rk07_affinity", f"SELECT intent, memory_type, n, CAST({AFF} AS DOUBLE) AS affinity FROM (SELECT {_intent('text')} AS intent, count(*) AS n FROM documents GROUP BY 1), (SELECT unnest(['episodic', 'semantic', 'procedural', 'observation']) AS memory_type)")
def rk07(spark, d):
    n = X.read(spark, d, "documents").select(T.intent(F.col("text")).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    rows = n.withColumn("memory_type", F.explode(F.array(*[F.lit(t) for t in X.TYPES])))
    return rows.select("intent", "memory_type", "n", T.affinity(F.col("intent"), F.col("memory_type")).alias("affinity"))


@query("rk08_activation", "SELECT user_id, round(ln(sum(pow(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(ts) / 1e6, -0.5))), 6) AS activation FROM events GROUP BY 1")
def rk08(spark, d):
    age = (F.unix_micros(X.now()) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return X.read(spark, d, "events").groupBy("user_id").agg(R(F.log(F.sum(F.pow(age, F.lit(-0.5))))).alias("activation"))


BOOT = "round(ln(list_sum(list_transform(range(0, least(greatest(access_count, 1), 20)), lambda i: pow(epoch_us(TIMESTAMP '2024-02-01' - INTERVAL 0 DAY) / 1e6 - epoch_us(coalesce(last_accessed, created_at)) / 1e6 + i * {s}, -0.5)))), 6)"


@query("rk09_bootstrap_activation", f"SELECT id, {BOOT.format(s=3600)} AS activation FROM mem WHERE memory_type = 'episodic'")
def rk09(spark, d):
    return X.episodic(spark, d).select("id", R(fusion.activation_signal(X.now())).alias("activation"))


@query("rk10_ring_activation", "SELECT user_id, count(*) AS held, round(ln(sum(pow(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(ts) / 1e6, -0.5))), 6) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 50 GROUP BY 1")
def rk10(spark, d):
    age = (F.unix_micros(X.now()) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    ring = X.read(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("r <= 50")
    return ring.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"), R(F.log(F.sum(F.pow(age, F.lit(-0.5))))).alias("activation"))


@query("rk12_confidence", "SELECT id, round(CASE memory_type WHEN 'procedural' THEN reliability WHEN 'episodic' THEN 1.0 ELSE confidence END, 6) AS confidence FROM mem")
def rk12(spark, d):
    return X.memories(spark, d).select("id", R(fusion.confidence_signal()).alias("confidence"))


@query("rk13_entity_affinity", "SELECT id, CAST(CASE WHEN memory_type = 'semantic' AND subject = 'src1' THEN 1.0 WHEN memory_type = 'episodic' AND about_entity = 'src1' THEN 1.0 WHEN memory_type = 'episodic' AND source_entity = 'user' THEN 0.8 ELSE 0 END AS DOUBLE) AS affinity FROM mem")
def rk13(spark, d):
    rows = X.memories(spark, d)
    a, b = fusion.entity_signal(F.lit("src1")), fusion.entity_signal(F.lit("user"))
    return rows.select("id", F.greatest(a, b).alias("affinity"))


SIG = "g AS (SELECT c_nationkey AS qid, 'a' || (c_custkey % 3) AS signal, 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 1.0 ELSE c_acctbal END AS score FROM customer)"


def rankings(spark, d):
    return X.read(spark, d, "customer").selectExpr("c_nationkey qid", "concat('a', c_custkey % 3) signal", "concat('c', c_custkey) id", "CAST(CASE WHEN c_custkey % 3 = 2 THEN 1.0 ELSE c_acctbal END AS DOUBLE) score")


@query("rk14_gate", f"WITH {SIG} SELECT qid, signal, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) = 1 OR max(score) - min(score) > 1e-6")
def rk14(spark, d):
    return fusion.gate(rankings(spark, d)).groupBy("qid", "signal").agg(F.count(F.lit(1)).alias("n"))


@query("rk15_adaptive_k", "SELECT o_custkey, least(greatest(count(*) // 10, 1), 60) AS k FROM orders GROUP BY 1")
def rk15(spark, d):
    return X.read(spark, d, "orders").groupBy("o_custkey").agg(fusion.adaptive_k(F.count(F.lit(1))).cast("long").alias("k"))


@query("rk16_reciprocal_rank_fusion", f"WITH {SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, signal ORDER BY score DESC, id) AS r FROM g) SELECT qid, id, round(sum(CASE signal WHEN 'a0' THEN 1.0 WHEN 'a1' THEN 0.8 ELSE 0.5 END / (60 + r)), 9) AS score FROM r GROUP BY 1, 2")
def rk16(spark, d):
    return fusion.fuse(rankings(spark, d), {"a0": 1.0, "a1": 0.8, "a2": 0.5}, F.lit(60)).withColumn("score", R("score", 9))


@query("rk17_defaults", "SELECT signal, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('vector', 1.0), ('lexical', 0.8), ('activation', 1.0), ('spread', 0.8), ('intent', 0.5), ('confidence', 0.5), ('entity', 1.2)) t(signal, weight)")
def rk17(spark, d):
    return spark.createDataFrame(list(fusion.WEIGHTS.items()), "signal string, weight double")


DAYS = "floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 1000) / 86400000.0"


@query("rk18_recency", f"SELECT id, round(CASE WHEN {DAYS} <= 0 THEN 1.0 WHEN CASE memory_type WHEN 'procedural' THEN reliability ELSE stability END = 0 THEN 0.0 ELSE 1 / (1 + {DAYS} / (9 * CASE memory_type WHEN 'procedural' THEN reliability ELSE stability END)) END, 6) AS recency FROM mem")
def rk18(spark, d):
    return X.memories(spark, d).select("id", R(fusion.recency(X.now())).alias("recency"))


@query("rk19_access_score", "SELECT id, round(ln(access_count + 1) / ln(max(access_count) OVER (PARTITION BY namespace_id) + 1), 6) AS access FROM mem WHERE memory_type = 'episodic'")
def rk19(spark, d):
    rows = X.episodic(spark, d)
    most = rows.groupBy("namespace_id").agg(F.max("access_count").alias("most"))
    return rows.join(most, "namespace_id").select("id", R(fusion.access_score(F.col("access_count"), F.col("most"))).alias("access"))


@query("rk20_linear_fusion", "SELECT p_partkey, round(0.25 * least(greatest(p_size / 40.0, 0), 1) + 0.10 * 0.5 + 0.15 * (p_partkey % 5) / 5.0 + 0.05 * 0.5 + 0.20 * 0.25 + 0.10 * 0.0 + 0.10 * (p_size % 10) / 10.0 + 0.05, 6) AS score FROM part")
def rk20(spark, d):
    rows = X.read(spark, d, "part").selectExpr("p_partkey", "CAST(p_size / 40.0 AS DOUBLE) vector", "0.5D lexical", "CAST((p_partkey % 5) / 5.0 AS DOUBLE) graph", "0.5D intent", "0.25D recency", "0.0D access", "CAST((p_size % 10) / 10.0 AS DOUBLE) confidence")
    return fusion.linear(rows).select("p_partkey", R("score").alias("score"))


@query("rk21_rerank", f"""WITH {BM}, h AS (SELECT qid, id, r FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM b) WHERE r <= 50),
 o AS (SELECT h.*, len(list_intersect(regexp_extract_all(x.text, '[^ ]+'), regexp_extract_all(y.text, '[^ ]+'))) AS s FROM h JOIN (SELECT 's-' || doc_id AS id, text FROM documents) x USING (id) JOIN (SELECT 'q' || item_id AS qid, text FROM benchmark) y USING (qid))
 SELECT qid, id, r AS rank, row_number() OVER (PARTITION BY qid ORDER BY r > 20, CASE WHEN r <= 20 THEN -s ELSE r END, id) AS new_rank FROM o""")
def rk21(spark, d):
    @F.pandas_udf("double")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(len(set(filter(None, x.split(" "))) & set(filter(None, y.split(" "))))) for x, y in zip(a, b)])

    hits = search.bm25_top(docs(spark, d), texts(spark, d), 50)
    rows = hits.join(docs(spark, d).select("id", "text"), "id").join(F.broadcast(texts(spark, d).withColumnRenamed("text", "query")), "qid")
    return fusion.rerank(rows, overlap).select("qid", "id", F.col("rank").cast("long"), F.col("new_rank").cast("long"))


TARGET = "CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 2 = 0 THEN 'u' || (item_id % 50) ELSE 'src' || (item_id % 20) END"


def recall_frames(spark, d):
    """All memories of all kinds, facts, procedures and observations with the vector of their number where there is one; every benchmark text as a query, with
    the vector of its number; targets are users, sources or none."""
    v = kept(X.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vectors")
    mem = X.memories(spark, d).withColumn("vec_id", F.expr("try_cast(regexp_extract(id, '^[spo]-([0-9]+)$', 1) AS BIGINT)")).join(v, "vec_id", "left").drop("vec_id")
    q = X.read(spark, d, "benchmark").join(v, F.col("item_id") == F.col("vec_id"), "left").select(F.concat(F.lit("q"), "item_id").alias("qid"), "text", "v", F.expr(TARGET).alias("target"))
    mem = kept(mem, "memories")
    return mem, q, graph.memory_edges(mem)


RECALL = f"""q AS (SELECT DISTINCT 'q' || item_id AS qid, unnest({TOK}) AS token FROM benchmark),
 w AS (SELECT id, memory_type, subject, about_entity, source_entity, {TOK.replace('text', 'content')} AS t FROM mem), f AS (SELECT id, len(t) AS length, unnest(t) AS token FROM w),
 p AS (SELECT id, token, count(*) AS tf, any_value(length) AS length FROM f WHERE token IN (SELECT token FROM q) GROUP BY id, token), z AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM w), dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
 b AS (SELECT qid, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM p JOIN q USING (token) JOIN dfs USING (token), z GROUP BY qid, id),
 qs AS (SELECT 'q' || item_id AS qid, e AS qe, norm AS qn, {TARGET} AS target, {_intent('text')} AS intent FROM benchmark LEFT JOIN vec ON item_id = vec_id),
 mv AS (SELECT m.*, CASE memory_type WHEN 'semantic' THEN subject WHEN 'episodic' THEN about_entity END AS owner, v.e, v.norm FROM mem m LEFT JOIN vec v ON v.vec_id = try_cast(regexp_extract(m.id, '^[spo]-([0-9]+)$', 1) AS BIGINT)),
 vs AS (SELECT qid, mv.id, target, owner, round(list_dot_product(qe, e) / (qn * norm), 9) AS score FROM qs, mv WHERE e IS NOT NULL AND qe IS NOT NULL AND qn > 0 AND norm > 0),
 vt AS (SELECT DISTINCT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vs) WHERE r <= CASE WHEN target IS NULL THEN 100 ELSE 25 END
  UNION SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vs WHERE owner = target) WHERE r <= 100),
 lb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM b JOIN qs USING (qid)),
 lo AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE memory_type WHEN 'semantic' THEN 0 ELSE 1 END, score DESC, id) AS r FROM lb JOIN w USING (id) WHERE memory_type = 'semantic' AND subject = target OR memory_type = 'episodic' AND (about_entity = target OR source_entity = target)) WHERE r <= 100),
 lt AS (SELECT qid, id, (n - r + 1) / n AS score FROM (SELECT qid, id, r, count(*) OVER (PARTITION BY qid) AS n FROM lb WHERE r <= 100)),
 c AS (SELECT qid, id FROM vt UNION SELECT qid, id FROM lb WHERE r <= CASE WHEN target IS NULL THEN 100 ELSE 25 END UNION SELECT qid, id FROM lo), cn AS (SELECT qid, count(*) AS n FROM c GROUP BY qid),
 sg AS (SELECT c.qid, c.id, CASE WHEN memory_type = 'episodic' THEN ln(list_sum(list_transform(range(0, least(greatest(access_count, 1), 20)), lambda i: pow(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(coalesce(last_accessed, created_at)) / 1e6 + i * 3600, -0.5)))) ELSE 0.0 END AS activation, {AFF} AS intent,
  CASE memory_type WHEN 'procedural' THEN reliability WHEN 'episodic' THEN 1.0 ELSE confidence END AS confidence,
  CASE WHEN target IS NOT NULL THEN CASE WHEN memory_type = 'semantic' AND subject = target OR memory_type = 'episodic' AND about_entity = target THEN 1.0 WHEN memory_type = 'episodic' AND source_entity = target THEN 0.8 ELSE 0.0 END END AS entity FROM c JOIN mv USING (id) JOIN qs USING (qid)),
 sp AS (SELECT qid, id, score FROM (SELECT qid, m.id, exp(0.4 * CASE intent WHEN 'question' THEN 0.8 WHEN 'code' THEN 0.7 ELSE 0.3 END + 0.4 * CASE memory_type WHEN 'episodic' THEN 1.0 ELSE confidence END + 0.2) AS score,
   row_number() OVER (PARTITION BY qid ORDER BY CASE memory_type WHEN 'episodic' THEN 1.0 ELSE confidence END DESC, m.id) AS r FROM qs JOIN mv m ON owner = target) WHERE r <= 10),
 lg AS (SELECT qid, id, 'vector' AS signal, score, 1.0 AS w FROM vt UNION ALL SELECT qid, id, 'lexical', score, 0.8 FROM lt UNION ALL SELECT qid, id, 'activation', activation, 1.0 FROM sg UNION ALL SELECT qid, id, 'spread', score, 0.8 FROM sp UNION ALL SELECT qid, id, 'intent', intent, 0.5 FROM sg
  UNION ALL SELECT qid, id, 'confidence', confidence, 0.5 FROM sg UNION ALL SELECT qid, id, 'entity', entity, 1.2 FROM sg WHERE entity IS NOT NULL),
 gt AS (SELECT *, row_number() OVER (PARTITION BY qid, signal ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY qid, signal) AS m, max(score) OVER (PARTITION BY qid, signal) - min(score) OVER (PARTITION BY qid, signal) AS sp FROM lg),
 fu AS (SELECT qid, id, round(sum(w / (least(greatest(n // 10, 1), 60) + r)), 12) AS score FROM gt JOIN cn USING (qid) WHERE m = 1 OR sp > 1e-6 GROUP BY qid, id),
 rk AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fu JOIN c USING (qid, id))"""


@query("rk04_candidate_union", f"WITH {RECALL}, x AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vs) WHERE r <= 50 UNION SELECT qid, id FROM lb WHERE r <= 50) SELECT qid, id FROM x")
def rk04(spark, d):
    mem, q, _ = recall_frames(spark, d)
    vectors, lexical = fusion.candidates(mem, kept(q, "queries"), fusion.Config(candidates=50))
    broad = [f.where("path = 1").select("qid", "id", "score") for f in (lexical, vectors)]
    return search.merge_candidates(*broad).select("qid", "id")


@query("rk05_dual_path", f"""WITH {RECALL}, ps AS (SELECT qid, id, 0 AS path FROM lo UNION ALL SELECT qid, id, 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vs WHERE owner = target) WHERE r <= 100
 UNION ALL SELECT qid, id, 2 FROM lb WHERE r <= 25 UNION ALL SELECT qid, id, 3 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vs) WHERE r <= 25) SELECT qid, id, min(path) AS path FROM ps GROUP BY 1, 2""")
def rk05(spark, d):
    mem, q, _ = recall_frames(spark, d)
    vectors, lexical = fusion.candidates(mem, kept(q, "queries"), fusion.Config())
    paths = [f.where((F.col("path") == p) & (F.col("rank") <= n)).select("qid", "id", "score") for p, n in ((0, 100), (1, 25)) for f in (lexical, vectors)]
    return search.merge_candidates(*paths).select("qid", "id", "path")


@query("rk24_recall", f"WITH {RECALL} SELECT qid, id, r AS rank, round(score, 6) AS final_score FROM rk WHERE r <= 5")
def rk24(spark, d):
    mem, q, edges = recall_frames(spark, d)
    return fusion.recall(mem, q, X.now(), edges=edges).select("qid", "id", "rank", R("final_score").alias("final_score"))


@query("rk22_reinforce_returned", f"""WITH {RECALL}, h AS (SELECT DISTINCT id FROM rk WHERE r <= 20)
 SELECT id, round(stability * (1 + 0.5 * 6 * pow(stability, -0.2) * (exp(0.2 * (1 - CASE WHEN t <= 0 THEN 1 ELSE 1 / (1 + t / (9 * stability)) END)) - 1)), 6) AS stability, access_count + 1 AS access_count FROM (SELECT *, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(coalesce(last_accessed, created_at))) / 1000) / 86400000.0 AS t FROM mem WHERE memory_type = 'episodic' AND id IN (SELECT id FROM h))""")
def rk22(spark, d):
    mem, q, edges = recall_frames(spark, d)
    returned = fusion.recall(mem, q, X.now(), fusion.Config(limit=20), edges)
    return fusion.reinforced(store.by_ids(mem, returned), X.now()).select("id", R("stability").alias("stability"), "access_count")


@query("ag02_grouped_recall", f"""WITH {RECALL}, gr AS (SELECT qid, r, score, rk.id, memory_type, episode_id, coalesce(event_time, created_at) AS at, CASE WHEN episode_id IS NULL OR memory_type IN ('semantic', 'procedural') THEN 'm:' || rk.id ELSE episode_id END AS group_id FROM rk JOIN mem USING (id) WHERE r <= 50),
 gs AS (SELECT qid, group_id, max(score) AS group_score, min(r) AS best, count(*) AS n FROM gr GROUP BY 1, 2), gp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY group_score DESC, best, group_id) AS position FROM gs),
 ob AS (SELECT episode_id AS group_id, count(*) AS k FROM mem WHERE memory_type = 'observation' GROUP BY 1)
 SELECT qid, group_id, round(group_score, 6) AS group_score, position, n, coalesce(k, 0) AS observations FROM gp LEFT JOIN ob USING (group_id) WHERE position <= 10""")
def ag02(spark, d):
    mem, q, edges = recall_frames(spark, d)
    got = fusion.recall(mem, q, X.now(), fusion.Config(limit=50), edges).select("qid", "id", "rank", F.col("final_score").alias("score"))
    rows = got.join(mem.select("id", "memory_type", "episode_id", "event_time", "created_at"), "id").where(F.col("memory_type").isin(*X.TYPES))
    groups = sessions.with_observations(sessions.group(rows, "relevance", 10), mem.where("memory_type = 'observation'"))
    return groups.select("qid", "group_id", R("group_score").alias("group_score"), F.col("position").cast("long"), F.size("members").cast("long").alias("n"), F.size("observations").cast("long").alias("observations"))


@query("rk25_surprise", f"WITH {COS} SELECT qid, id, round(least(greatest(ln(greatest(score, 1e-10) / greatest(0.1, 1e-6)), -2), 5), 6) AS surprise FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 100")
def rk25(spark, d):
    return cosines(spark, d, 100).select("qid", "id", R(decay.surprise(F.col("score"), F.lit(0.1))).alias("surprise"))


SPACES = " UNION ALL ".join(f"SELECT '{n}' AS space, id, label, e[1:{k}] AS e, vec_id FROM vec" for n, k in (("text", 64), ("code", 32), ("image", 16)))


@query("rk26_multi_space", f"""WITH sp AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM ({SPACES})), a AS (SELECT id || '-' || space AS qid, e AS qe, norm AS qn, len(e) AS n FROM sp WHERE vec_id % 100 = 0),
 s AS (SELECT qid, id, space, round(list_dot_product(qe, e) / (qn * norm), 9) AS score FROM a JOIN sp ON len(e) = n WHERE norm > 0 AND qn > 0)
 SELECT qid, id, space, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10""")
def rk26(spark, d):
    """A query of each space: its length says where it belongs, and the other spaces have no answer to it."""
    v = vecs(spark, d)
    spaces = {n: v.withColumn("v", F.slice("v", 1, k)) for n, k in (("text", 64), ("code", 32), ("image", 16))}
    asked_all = None
    for name, rows in spaces.items():
        part = rows.where("vec_id % 100 = 0").withColumn("qid", F.concat("id", F.lit(f"-{name}")))
        asked_all = part if asked_all is None else asked_all.unionByName(part)
    found = None
    for name, rows in spaces.items():
        part = search.vector_top_k(rows, asked_all, 15).withColumn("space", F.lit(name))
        found = part if found is None else found.unionByName(part)
    best = search.top_k(found.drop("rank"), 10)
    return best.select("qid", "id", "space", F.col("rank").cast("long"))


@query("rk27_learn_weights", """WITH RECURSIVE x AS (SELECT user_id, value / 500 AS a, 0.5::DOUBLE AS b, (event_id % 7) / 7.0::DOUBLE AS c, CASE WHEN event_type = 'purchase' THEN 0.01 ELSE -0.01 END::DOUBLE AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, [0.5, 0.3, 0.2]::DOUBLE[] AS w FROM x UNION ALL
  SELECT user_id, i, list_transform(m, lambda y: y / list_sum(m)) FROM (SELECT x.user_id, x.i, [greatest(w[1] + d * a, 0.01), greatest(w[2] + d * b, 0.01), greatest(w[3] + d * c, 0.01)]::DOUBLE[] AS m FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1))
 SELECT user_id, max(i) AS samples, round(list_sum(arg_max(w, i)), 6) AS total, round(arg_max(w, i)[1], 6) AS first FROM s GROUP BY 1""")
def rk27(spark, d):
    fb = X.read(spark, d, "events").selectExpr("user_id key", "event_id seq", "array(value / 500, 0.5, (event_id % 7) / 7.0D) signals", "event_type = 'purchase' relevant")
    out = fusion.learn_weights(fb.withColumn("signals", F.col("signals").cast("array<double>")), [0.5, 0.3, 0.2])
    return out.select(F.col("key").alias("user_id"), "samples", R(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)).alias("total"), R(F.element_at("weights", 1)).alias("first"))


@query("rk28_pick_procedure", "SELECT trigger, arg_max(id, (reliability, id)) AS id, max(reliability) AS reliability FROM mem WHERE memory_type = 'procedural' AND reliability >= 0.5 GROUP BY 1")
def rk28(spark, d):
    return fusion.pick_procedure(X.procedural(spark, d), "trigger", 0.5)


@query("so01_top_k", "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def so01(spark, d):
    rows = X.read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return search.top_k(rows, 3, "o_custkey").select("o_custkey", F.col("id").alias("o_orderkey"), F.col("rank").cast("long"))


@query("sf01_cosine", f"WITH {COS} SELECT qid, id, round(score, 6) AS cosine FROM s WHERE ql = label")
def sf01(spark, d):
    q = asked(spark, d).select("qid", F.col("v").alias("qv"), "label")
    return q.join(vecs(spark, d), "label").select("qid", "id", R(V.cosine(F.col("qv"), F.col("v"))).alias("cosine"))


@query("sf02_norm", "SELECT id, round(norm, 6) AS norm, round(list_dot_product(e, e) / (norm * norm), 6) AS unit FROM vec")
def sf02(spark, d):
    u = V.normalise(F.col("v"))
    return vecs(spark, d).select("id", R(V.norm(F.col("v"))).alias("norm"), R(V.dot(u, u)).alias("unit"))


@query("sf03_hash_embedding")
def sf03(spark, d):
    return X.read(spark, d, "documents").select("doc_id", R(V.norm(V.hash_embedding(F.col("text")))).alias("norm"))
