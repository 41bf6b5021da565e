"""AG, ST, SO, JN04, EV, SS in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import analytics, evaluation, search, sessions
from quillon.plans import fixtures as X
from quillon.plans.ranking_queries import COS, asked, cosines, vecs
from quillon.plans.registry import query

R = lambda c, n=6: F.round(c, n)
NUM = "CAST({} AS BIGINT)"


def turns(spark, d):
    """Every turn as a ranked result of one query a namespace, best by length."""
    rows = X.episodic(spark, d).withColumn("score", F.length("content").cast("double"))
    return rows.withColumn("qid", F.col("namespace_id")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).select("qid", "id", "rank", "score", "memory_type", "episode_id", "event_time", "created_at")


GROUPS = """t AS (SELECT namespace_id AS qid, id, length(content)::DOUBLE AS score, episode_id, coalesce(event_time, created_at) AS tm, row_number() OVER (PARTITION BY namespace_id ORDER BY length(content) DESC, id) AS rank FROM mem WHERE memory_type = 'episodic'),
 g AS (SELECT qid, episode_id, min(tm) AS session_time, max(score) AS group_score, min(rank) AS best, list(id ORDER BY tm, rank) AS members FROM t GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY session_time, best) AS position FROM g)"""


@query("ag01_session_groups", f"WITH {GROUPS} SELECT qid, episode_id, group_score, position, array_to_string(members, ',') AS members FROM o")
def ag01(spark, d):
    return sessions.group(turns(spark, d)).select("qid", "episode_id", "group_score", F.col("position").cast("long"), F.array_join("members", ",").alias("members"))


@query("jn04_attach_observations", f"WITH {GROUPS} SELECT qid, id, score FROM (SELECT g.qid, m.id, g.group_score AS score, row_number() OVER (PARTITION BY g.qid ORDER BY m.created_at, m.id) AS r FROM g JOIN mem m ON g.episode_id = m.episode_id AND m.memory_type = 'observation') WHERE r <= 1024")
def jn04(spark, d):
    return sessions.attach(sessions.group(turns(spark, d)), X.observation(spark, d)).select("qid", "id", "score")


@query("ag03_counts_valid", "SELECT namespace_id, count(*) FILTER (memory_type = 'episodic') AS episodic, count(*) FILTER (memory_type = 'semantic' AND invalid_at IS NULL) AS semantic, count(*) FILTER (memory_type = 'procedural') AS procedural FROM mem GROUP BY 1")
def ag03(spark, d):
    kind = F.col("memory_type")
    return X.memories(spark, d).groupBy("namespace_id").agg(F.count(F.when(kind == "episodic", 1)).alias("episodic"), F.count(F.when((kind == "semantic") & F.col("invalid_at").isNull(), 1)).alias("semantic"), F.count(F.when(kind == "procedural", 1)).alias("procedural"))


@query("ag04_counts_all", "SELECT memory_type, count(*) AS n FROM mem GROUP BY 1")
def ag04(spark, d):
    return X.memories(spark, d).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("ag05_entity_status", "SELECT namespace_id, kind, count(*) AS n, count(DISTINCT name) AS names FROM ent GROUP BY 1, 2")
def ag05(spark, d):
    return X.entities(spark, d).groupBy("namespace_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query("ag06_daily_activity", "SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) FILTER (event_type = 'recall') AS recalls, count(*) FILTER (event_type = 'remember') AS remembers, count(*) FILTER (event_type = 'observe') AS observes, count(*) FILTER (event_type = 'forget') AS forgets FROM act WHERE created_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY GROUP BY 1")
def ag06(spark, d):
    return analytics.daily(X.activity(spark, d), X.now(), 30).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("ag07_recent_events", "SELECT user_id, id, upper(event_type[1]) || event_type[2:] || ' ' || coalesce(json_extract_string(detail, '$.k'), '-') AS summary FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM act) WHERE r <= 20")
def ag07(spark, d):
    return analytics.recent(X.activity(spark, d), "user_id", 20).select("user_id", "id", "summary")


def used(spark, d):
    return X.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("tier"), F.floor("value").cast("long").alias("n"))


@query("ag08_usage_rollup", "SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type AS tier, sum(floor(value))::BIGINT AS n FROM events WHERE floor(value) > 0 GROUP BY 1, 2, 3")
def ag08(spark, d):
    return analytics.usage(used(spark, d))


@query("ag09_billing_rollup", "SELECT user_id AS customer, event_type AS tier, sum(floor(value))::BIGINT AS n, count(*) AS calls FROM events WHERE floor(value) > 0 GROUP BY 1, 2")
def ag09(spark, d):
    return used(spark, d).where("n > 0").groupBy(F.col("user_id").alias("customer"), "tier").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("calls"))


PATH = "CASE event_type WHEN 'click' THEN '/v1/recall' WHEN 'view' THEN '/v1/health' WHEN 'purchase' THEN '/v1/remember' WHEN 'signup' THEN '/docs' ELSE '/v1/usage' END"


@query("ag10_billable", f"SELECT event_type, count(*) FILTER ({PATH} LIKE '/v1/%' AND {PATH} NOT IN ('/v1/health', '/v1/usage', '/v1/stats')) AS billable FROM events GROUP BY 1")
def ag10(spark, d):
    return X.read(spark, d, "events").groupBy("event_type").agg(F.count(F.when(analytics.billable(F.expr(PATH)), 1)).alias("billable"))


@query("ag11_quota", "SELECT user_id, CASE WHEN recalls >= 15 THEN 'recall_limit' WHEN stored >= 12 THEN 'storage_limit' ELSE 'ok' END AS state FROM (SELECT user_id, count(*) FILTER (event_type = 'recall') AS recalls, count(*) FILTER (event_type = 'remember') AS stored FROM act GROUP BY 1)")
def ag11(spark, d):
    u = X.activity(spark, d).groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "recall", 1)).alias("recalls"), F.count(F.when(F.col("event_type") == "remember", 1)).alias("stored"))
    return analytics.quota(u, 15, 12).select("user_id", "state")


@query("ag12_histogram", f"SELECT event_type, bound, count(*) FILTER (value <= bound) AS below, count(*) AS count, round(sum(value), 4) AS sum FROM events, (SELECT CAST(unnest({analytics.BOUNDS}) AS DOUBLE) AS bound) GROUP BY 1, 2 UNION ALL SELECT event_type, NULL, count(*), count(*), round(sum(value), 4) FROM events GROUP BY 1")
def ag12(spark, d):
    return analytics.histogram(X.read(spark, d, "events").select("event_type", "value"), "event_type").withColumn("sum", R("sum", 4))


@query("ag13_latency", "SELECT event_type, count(*) AS n, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max, list_sort(list(value))[least(floor(count(*) * 0.5)::BIGINT, count(*) - 1) + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95, list_sort(list(value))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] AS p99, round(count(*) / sum(value) * 1000, 6) AS throughput FROM events GROUP BY 1")
def ag13(spark, d):
    return analytics.latency(X.read(spark, d, "events"), "event_type").withColumn("mean", R("mean")).withColumn("throughput", R("throughput"))


@query("so02_fallback_order", "SELECT id, row_number() OVER (PARTITION BY namespace_id ORDER BY coalesce(ended_at, started_at), id) AS position FROM epi")
def so02(spark, d):
    return X.episodes(spark, d).select("id", F.row_number().over(Window.partitionBy("namespace_id").orderBy(F.coalesce("ended_at", "started_at"), "id")).cast("long").alias("position"))


@query("so03_page", "SELECT DISTINCT namespace_id || '/' || kind AS path FROM ent WHERE namespace_id = 'ns1' ORDER BY path LIMIT 2 OFFSET 1")
def so03(spark, d):
    path = F.array("namespace_id", "kind")
    return X.entities(spark, d).where(F.slice(path, 1, 1) == F.array(F.lit("ns1"))).select(F.array_join(path, "/").alias("path")).distinct().orderBy("path").offset(1).limit(2)


@query("st01_concatenate", "SELECT memory_type, count(*) AS n, count(DISTINCT id) AS ids FROM mem GROUP BY 1")
def st01(spark, d):
    return X.memories(spark, d).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("st02_distinct_union", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def st02(spark, d):
    return X.read(spark, d, "customer").select(F.col("c_nationkey").alias("key")).unionByName(X.read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))).distinct()


@query("st03_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def st03(spark, d):
    return X.read(spark, d, "part").select("p_partkey").join(X.read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query("st04_word_overlap", f"SELECT conv_id, turn, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap FROM (SELECT c.conv_id, c.turn, {WORDS.format('c.text')} AS a, {WORDS.format('e.text')} AS b FROM conversations c JOIN conversations e ON c.conv_id = e.conv_id AND e.turn = c.turn + 1) WHERE len(a) > 0 AND len(b) > 0")
def st04(spark, d):
    from quillon.functions import text as T

    c = X.read(spark, d, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("a")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    has = lambda x: F.col(x).rlike(r"\S")
    return a.join(b, ["conv_id", "turn"]).where(has("a") & has("b")).select("conv_id", "turn", R(T.word_overlap(F.col("a"), F.col("b"))).alias("overlap"))


RANKED = f"""{COS}, rk AS (SELECT qid, id, (ql = label)::INT AS rel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, sum((ql = label)::INT) OVER (PARTITION BY qid) AS total FROM s),
 tp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS ideal FROM rk WHERE rank <= 20)"""


def ranked(spark, d):
    v = vecs(spark, d)
    total = v.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    got = cosines(spark, d, 20).join(v.select("id", "label"), "id").join(asked(spark, d).select("qid", F.col("label").alias("ql")), "qid").join(total.withColumnRenamed("label", "ql"), "ql")
    return got.select("qid", "id", "rank", (F.col("label") == F.col("ql")).cast("int").alias("rel"), "total")


@query("ev01_ndcg", f"WITH {RANKED} SELECT qid, CASE WHEN max(rel) = 0 THEN 0.0::DOUBLE ELSE round(sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1) END) / sum(CASE WHEN ideal <= 5 THEN (pow(2, rel) - 1) / log2(ideal + 1) END), 6) END AS ndcg FROM tp GROUP BY qid")
def ev01(spark, d):
    return evaluation.metrics(ranked(spark, d), 5).select("qid", R("ndcg").alias("ndcg"))


@query("ev02_mrr", f"WITH {RANKED} SELECT qid, round(coalesce(1 / min(CASE WHEN rel > 0 THEN rank END), 0), 6) AS mrr FROM tp GROUP BY qid")
def ev02(spark, d):
    return evaluation.metrics(ranked(spark, d), 5).select("qid", R("mrr").alias("mrr"))


@query("ev03_accuracy_at_1", f"WITH {RANKED} SELECT qid, max(CASE WHEN rank = 1 AND rel > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM tp GROUP BY qid")
def ev03(spark, d):
    return evaluation.metrics(ranked(spark, d), 5).select("qid", F.col("accuracy_at_1").alias("accuracy"))


@query("ev04_recall_at_k", f"WITH {RANKED} SELECT qid, round(sum(CASE WHEN rank <= 5 AND rel > 0 THEN 1 ELSE 0 END) / max(total), 6) AS recall FROM tp GROUP BY qid")
def ev04(spark, d):
    return evaluation.metrics(ranked(spark, d), 5).select("qid", R("recall_at_k").alias("recall"))


@query("ev05_brier", "SELECT quality, round(avg(pow((doc_id % 100) / 100.0 - toxic, 2)), 6) AS brier FROM labels GROUP BY 1")
def ev05(spark, d):
    return X.read(spark, d, "labels").groupBy("quality").agg(R(F.avg(F.pow(F.col("doc_id") % 100 / 100.0 - F.col("toxic"), F.lit(2.0)))).alias("brier"))


BOOTV = "SELECT c_mktsegment AS seg, c_acctbal AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer"


@query("ev06_bootstrap", f"""WITH v AS ({BOOTV}), n AS (SELECT seg, count(*) AS n, avg(value) AS mean FROM v GROUP BY 1), r AS (SELECT unnest(range(200)) AS r),
 s AS (SELECT v.seg, r, ('0x' || substr(md5('42:' || r || ':' || v.i), 1, 12))::BIGINT % n AS i FROM v JOIN n USING (seg), r), m AS (SELECT s.seg, r, avg(value) AS m FROM s JOIN v USING (seg, i) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY m) AS k FROM m)
 SELECT seg, round(max(CASE WHEN k = 6 THEN m END), 6) AS low, round(max(CASE WHEN k = 195 THEN m END), 6) AS high, round(any_value(mean), 6) AS mean FROM k JOIN n USING (seg) GROUP BY 1""")
def ev06(spark, d):
    rows = X.read(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("value"), (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1).alias("i"))
    return evaluation.bootstrap(rows, "seg", 200).select("seg", R("low").alias("low"), R("high").alias("high"), R("mean").alias("mean"))


def pairs(spark, d):
    return X.read(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"))


@query("ev07_cohens_d", "SELECT l_returnflag, round(avg(l_discount * 10 - l_quantity / 50) / stddev_samp(l_discount * 10 - l_quantity / 50), 6) AS d FROM lineitem GROUP BY 1")
def ev07(spark, d):
    return evaluation.cohens_d(pairs(spark, d), "l_returnflag").withColumn("d", R("d"))


WIL = """WITH x AS (SELECT o_orderstatus AS st, (o_orderkey % 50) - (o_custkey % 40) AS d FROM orders), y AS (SELECT st, d, rank() OVER (PARTITION BY st ORDER BY abs(d)) + (count(*) OVER (PARTITION BY st, abs(d)) - 1) / 2.0 AS r FROM x WHERE d <> 0),
 w AS (SELECT st, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus FROM y GROUP BY 1), z AS (SELECT *, abs((w_plus - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0)) AS z, 1 / (1 + 0.2316419 * abs((w_plus - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0))) AS t FROM w)
 SELECT st, n, w_plus, round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))), 6) AS p FROM z"""


@query("ev08_wilcoxon", WIL)
def ev08(spark, d):
    rows = X.read(spark, d, "orders").selectExpr("o_orderstatus st", "CAST(o_custkey % 40 AS DOUBLE) x", "CAST(o_orderkey % 50 AS DOUBLE) y")
    return evaluation.wilcoxon(rows, "st").withColumn("p", R("p"))


@query("ev09_benjamini_hochberg", "WITH x AS (SELECT p_brand, p_partkey, p_size / 1000.0 AS p, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part), y AS (SELECT p_brand, max(CASE WHEN p <= r / n * 0.05 THEN r END) AS last FROM x GROUP BY 1) SELECT p_partkey, coalesce(r <= last, FALSE) AS rejected FROM x JOIN y USING (p_brand)")
def ev09(spark, d):
    rows = X.read(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_size") / 1000.0).alias("p"))
    return evaluation.benjamini_hochberg(rows, "p_brand").select(F.col("id").alias("p_partkey"), "rejected")


QUANT = "(CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END) * ({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"


@query("ev10_sample_size", f"SELECT p_size, ceil(pow((z1 + z2) / (p_size / 25.0), 2))::BIGINT AS n FROM (SELECT DISTINCT p_size FROM part WHERE p_size > 0), (SELECT {QUANT.format(p='0.975', t='sqrt(-2 * ln(1 - 0.975))')} AS z1, {QUANT.format(p='0.8', t='sqrt(-2 * ln(1 - 0.8))')} AS z2)")
def ev10(spark, d):
    return X.read(spark, d, "part").where("p_size > 0").select("p_size").distinct().select("p_size", evaluation.sample_size(F.col("p_size") / 25.0).cast("long").alias("n"))


@query("ev11_bradley_terry", """WITH RECURSIVE w AS (SELECT s_nationkey AS a, (s_nationkey + 1 + l_linenumber) % 25 AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> (s_nationkey + 1 + l_linenumber) % 25 GROUP BY 1, 2),
 p AS (SELECT a, b, sum(n)::DOUBLE AS n FROM (SELECT a, b, n FROM w UNION ALL SELECT b, a, n FROM w) GROUP BY 1, 2), won AS (SELECT a, sum(n)::DOUBLE AS n FROM w GROUP BY 1),
 s AS (SELECT 0 AS r, map_from_entries(list((a, 1.0::DOUBLE))) AS v FROM (SELECT DISTINCT a FROM p) UNION ALL
  SELECT r + 1, (SELECT map_from_entries(list((a, x / m))) FROM (SELECT a, x, avg(x) OVER () AS m FROM (SELECT p.a, coalesce(any_value(won.n), 0) / sum(p.n / (v[p.a] + v[p.b])) AS x FROM p LEFT JOIN won ON won.a = p.a GROUP BY p.a))) FROM s WHERE r < 50)
 SELECT e.key AS player, round(e.value, 6) AS strength FROM (SELECT unnest(map_entries(v)) AS e FROM s WHERE r = 50)""")
def ev11(spark, d):
    o = X.read(spark, d, "lineitem").join(X.read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("w")), F.col("l_suppkey") == F.col("s_suppkey"))
    wins = o.withColumn("l", (F.col("w") + 1 + F.col("l_linenumber")) % 25).where("w <> l").groupBy(F.col("w").alias("winner"), F.col("l").alias("loser")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.bradley_terry(wins).select("player", R("strength").alias("strength"))


@query("ev12_gold", f"WITH {COS}, a2 AS (SELECT qid, id FROM s WHERE score > 0.7 UNION SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r = 1) SELECT qid, id FROM a2")
def ev12(spark, d):
    best = cosines(spark, d, 1).select("qid", "id")
    near = search.vector_over(vecs(spark, d), asked(spark, d), 0.7).select("qid", "id")
    return near.unionByName(best).distinct()


@query("ev13_corruption")
def ev13(spark, d):
    rows = evaluation.corrupted(vecs(spark, d).select("id", "v"), 0.1, 0.2)
    return rows.select("id", F.size(F.filter("v", lambda x: x == 0)).cast("long").alias("zeros"))


@query("ev14_sensitivity", "WITH x AS (SELECT p_size / 50.0 AS value, avg(p_retailprice) AS metric FROM part GROUP BY 1), y AS (SELECT *, lag(metric) OVER (ORDER BY value) AS a, lead(metric) OVER (ORDER BY value) AS b, lag(value) OVER (ORDER BY value) AS v0, lead(value) OVER (ORDER BY value) AS v1, max(metric) OVER () AS best FROM x) SELECT round(arg_min((b - a) / (v1 - v0), (abs(value - 0.5), value)), 4) AS coefficient, round(avg(CASE WHEN metric >= 0.95 * best THEN 1.0 ELSE 0.0 END), 6) AS robustness FROM y")
def ev14(spark, d):
    rows = X.read(spark, d, "part").groupBy((F.col("p_size") / 50.0).alias("value")).agg(F.avg("p_retailprice").alias("metric"))
    return evaluation.sensitivity(rows, 0.5).select(R("coefficient", 4).alias("coefficient"), R("robustness").alias("robustness"))


@query("ev15_monte_carlo", f"WITH {RANKED} SELECT count(DISTINCT qid) AS queries, round(avg(CASE WHEN rank = 1 THEN rel END), 6) AS accuracy, round(sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / count(DISTINCT qid), 6) AS hits FROM tp")
def ev15(spark, d):
    r = ranked(spark, d)
    return r.agg(F.countDistinct("qid").alias("queries"), R(F.avg(F.when(F.col("rank") == 1, F.col("rel")))).alias("accuracy"), R(F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)) / F.countDistinct("qid")).alias("hits"))


@query("ev16_keyword_hits", "SELECT conv_id, bool_or(contains(lower(b), w)) AS hit FROM (SELECT c.conv_id, unnest(list_filter(regexp_split_to_array(lower(c.text), '[^a-z]+'), lambda x: length(x) > 6)) AS w, e.text AS b FROM conversations c JOIN conversations e ON c.conv_id = e.conv_id AND e.turn > 0 WHERE c.turn = 0) GROUP BY 1")
def ev16(spark, d):
    c = X.read(spark, d, "conversations")
    words = c.where("turn = 0").select("conv_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 6)).alias("w"))
    return words.join(c.where("turn > 0").select("conv_id", F.col("text").alias("b")), "conv_id").groupBy("conv_id").agg(F.bool_or(F.contains(F.lower("b"), F.col("w"))).alias("hit"))


@query("ss03_admission", """WITH RECURSIVE x AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::DOUBLE[] AS open, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted FROM x UNION ALL
  SELECT user_id, i, CASE WHEN len(live) < 2 THEN list_append(live, tm) ELSE live END, event_id, len(live) < 2 FROM (
   SELECT x.user_id, x.i, x.event_id, x.tm, list_filter(s.open, lambda t: t > x.tm - 21600.0) AS live FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1))
 SELECT user_id, event_id, admitted FROM s WHERE i > 0""")
def ss03(spark, d):
    e = X.read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return analytics.admitted(e, 2, 6 * 3600.0).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "admitted")


@query("ss07_daily_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ss07(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return X.read(spark, d, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("ss08_sessions", "WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM y GROUP BY user_id, s")
def ss08(spark, d):
    e = X.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")
