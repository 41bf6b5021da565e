"""SF: text functions over documents, conversations and pages; SF25-30."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import blocks as B, text as T
from quillon.operators import sync
from quillon.plans import fixtures as X
from quillon.plans.registry import query

R = lambda c, n=6: F.round(c, n)
Q = lambda s: s.replace("'", "''")


def any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{Q(w)}')" for w in words) + ")"


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, generate_subscripts(m, 1) AS n, unnest(m) AS match FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m FROM documents)" for k, p in T.PATTERNS)


@query("sf04_patterns", _FOUND)
def sf04(spark, d):
    return T.patterns(X.read(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", F.col("n").cast("long"), "match")


@query("sf05_redact")
def sf05(spark, d):
    return X.read(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


INJ = " OR ".join(f"regexp_matches(text, '(?im){Q(p)}')" for p in T.INJECTIONS)


@query("sf06_injection", f"SELECT doc_id, ({INJ}) AS hit FROM documents")
def sf06(spark, d):
    return X.read(spark, d, "documents").select("doc_id", T.injection(F.col("text")).alias("hit"))


def _facts_sql():
    verb = "CASE " + " ".join(f"WHEN instr(low, ' {v} ') > 0 THEN '{v}'" for v in T.FACT_VERBS) + " END"
    obj = "CASE " + " ".join(f"WHEN instr(low, ' {v} ') > 0 THEN rtrim(trim(substr(low, instr(low, ' {v} ') + {len(v) + 2})), '.')" for v in T.FACT_VERBS) + " END"
    sub = "CASE " + " ".join(f"WHEN instr(low, ' {v} ') > 0 THEN trim(regexp_split_to_array(regexp_replace(trim(substr(low, 1, instr(low, ' {v} ') - 1)), ',+$', ''), ',')[-1])" for v in T.FACT_VERBS) + " END"
    return f"SELECT doc_id, {sub} AS subject, {verb} AS predicate, {obj} AS object FROM (SELECT doc_id, lower(trim(unnest(string_split(replace(text, '.', '.\n'), '\n')))) AS low FROM documents) WHERE low <> '' AND {verb} IS NOT NULL"


@query("sf07_heuristic_facts", _facts_sql())
def sf07(spark, d):
    s = X.read(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    a, b, c = T.heuristic_fact(F.col("s"))
    return s.select("doc_id", a.alias("subject"), b.alias("predicate"), c.alias("object")).where("predicate IS NOT NULL")


OUT = f"CASE WHEN {any_sql('lower(text)', T.SUCCESS)} THEN 'success' WHEN {any_sql('lower(text)', T.FAILURE)} THEN 'failure' END"


@query("sf08_causal_chains", f"SELECT conv_id, turn, outcome, CASE WHEN outcome = 'success' THEN coalesce(left(before, 100), 'unknown') ELSE left(lower(text), 100) END AS trigger, CASE WHEN outcome = 'success' THEN left(lower(text), 100) ELSE 'attempted resolution' END AS action FROM (SELECT *, {OUT} AS outcome, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE outcome IS NOT NULL")
def sf08(spark, d):
    c = X.read(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("outcome", T.outcome(F.col("text"))).where("outcome IS NOT NULL")
    low, ok = F.substring(F.lower("text"), 1, 100), F.col("outcome") == "success"
    return c.select("conv_id", "turn", "outcome", F.when(ok, F.coalesce(F.substring("before", 1, 100), F.lit("unknown"))).otherwise(low).alias("trigger"), F.when(ok, low).otherwise("attempted resolution").alias("action"))


def _verbs(what):
    parts = []
    for v in T.SPLIT_VERBS:
        at = f"instr(lower(text), '{v}')"
        before, after = f"trim(substr(text, 1, {at} - 1))", f"trim(substr(text, {at} + {len(v)}))"
        parts.append(f"WHEN {at} > 0 AND length({before}) > 0 AND length({after}) > 0 THEN " + (f"'{v}'" if what == "verb" else after))
    return "CASE " + " ".join(parts) + (" ELSE 'states' END" if what == "verb" else " ELSE text END")


@query("sf09_split_by_verb", f"SELECT item_id, {_verbs('verb')} AS predicate, {_verbs('rest')} AS object FROM benchmark")
def sf09(spark, d):
    a, b = T.split_verb(F.col("text"))
    return X.read(spark, d, "benchmark").select("item_id", a.alias("predicate"), b.alias("object"))


@query("sf10_split_first_space", "SELECT doc_id, CASE WHEN contains(text, ' ') THEN split_part(text, ' ', 1) ELSE 'knows' END AS predicate, CASE WHEN contains(text, ' ') THEN substr(text, instr(text, ' ') + 1) ELSE text END AS object FROM documents")
def sf10(spark, d):
    a, b = T.split_first_space(F.col("text"))
    return X.read(spark, d, "documents").select("doc_id", a.alias("predicate"), b.alias("object"))


@query("sf11_render", "SELECT id, CASE memory_type WHEN 'semantic' THEN predicate || ' ' || object WHEN 'procedural' THEN trigger || ' -> ' || action ELSE content END AS text FROM mem")
def sf11(spark, d):
    return X.memories(spark, d).select("id", T.render(*[F.col(c) for c in ("memory_type", "predicate", "object", "trigger", "action", "content")]).alias("text"))


@query("sf12_observation_text", "SELECT p_partkey, p_type || ' ' || p_name || CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN ' (' || p_size || ' ' || p_brand || ')' WHEN p_size % 3 = 0 THEN ' (' || p_size || ')' WHEN p_size % 2 = 0 THEN ' (' || p_brand || ')' ELSE '' END AS text FROM part")
def sf12(spark, d):
    q, u = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return X.read(spark, d, "part").select("p_partkey", T.observation_text(F.col("p_type"), F.col("p_name"), q, u).alias("text"))


@query("sf13_observation_block", "SELECT p_brand, string_agg(i || '. ' || p_name || CASE WHEN p_size < 10 THEN ' [low confidence]' ELSE '' END, chr(10) ORDER BY i) AS block FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) GROUP BY 1")
def sf13(spark, d):
    lines = B.in_order("p_partkey", B.observation_line(F.col("p_name"), F.col("p_size") < 10))
    return X.read(spark, d, "part").groupBy("p_brand").agg(lines.alias("o")).select("p_brand", B.numbered(F.col("o")).alias("block"))


@query("sf14_history_block", "SELECT conv_id, string_agg(json_object('role', role, 'content', text)::VARCHAR, chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def sf14(spark, d):
    turns = B.in_order("turn", B.history_turn(F.col("role"), F.col("text")))
    return X.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("block"))


@query("sf15_route", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^0-9A-Za-z])({'|'.join(T.COUNTING)})($|[^0-9A-Za-z])') THEN 'inject' ELSE 'skip' END AS route FROM documents")
def sf15(spark, d):
    return X.read(spark, d, "documents").select("doc_id", T.route(F.col("text")).alias("route"))


@query("sf16_parse_observations", "SELECT p_partkey, p_name AS instance, p_type AS action, p_size::DOUBLE AS quantity, CASE WHEN p_partkey % 3 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM part WHERE p_partkey % 5 <> 0")
def sf16(spark, d):
    body = F.concat(F.lit('[{"entity_type":"part","instance":"'), "p_name", F.lit('","action":"'), "p_type", F.lit('","quantity":'), "p_size", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(',"confidence":7'), F.lit("}]"))
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("no list here")).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), body))
    rows = X.read(spark, d, "part").select("p_partkey", F.explode(T.parse_observations(text)).alias("o"))
    return rows.select("p_partkey", "o.instance", "o.action", "o.quantity", "o.confidence")


@query("sf17_prompt_body", "SELECT conv_id, string_agg('[2024-01-01] ' || role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def sf17(spark, d):
    turns = B.in_order("turn", B.prompt_turn(F.lit("2024-01-01").cast("date"), F.col("role"), F.col("text")))
    return X.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("body"))


@query("sf18_fingerprint", "SELECT conv_id, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY 1")
def sf18(spark, d):
    turns = B.in_order("turn", F.struct("role", "text"))
    return X.read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", B.fingerprint(F.col("t")).alias("fingerprint"))


def _capture(col, kind):
    drop = " OR ".join(f"regexp_matches({col}, '(?i){Q(p)}')" for p in T.DISCARD)
    out = {}
    for what in ("tier", "label", "conf"):
        parts = [f"WHEN {drop} THEN NULL"]
        for n, ps in ((1, T.TIER1), (2, T.TIER2)):
            for p, name, c in ps:
                parts.append(f"WHEN regexp_matches({col}, '(?i){Q(p)}') THEN " + {"tier": str(n), "label": f"'{name}'", "conf": f"{c}::DOUBLE"}[what])
        parts.append(f"WHEN {kind} = 'user_statement' AND length({col}) > 50 THEN " + {"tier": "2", "label": "'statement'", "conf": "0.7::DOUBLE"}[what])
        out[what] = "CASE " + " ".join(parts) + " END"
    return out


C = _capture("text", "CASE role WHEN 'user' THEN 'user_statement' ELSE 'tool' END")


def captured(spark, d):
    c = X.read(spark, d, "conversations").withColumn("kind", F.when(F.col("role") == "user", "user_statement").otherwise("tool"))
    a, b, e = T.capture(F.col("text"), F.col("kind"))
    return c.select("conv_id", "turn", "text", a.alias("tier"), b.alias("label"), e.alias("confidence"))


@query("sf19_capture", f"SELECT conv_id, turn, coalesce({C['tier']}, 0) AS tier, coalesce({C['label']}, 'none') AS label, coalesce({C['conf']}, 0) AS confidence FROM conversations")
def sf19(spark, d):
    return captured(spark, d).select("conv_id", "turn", F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("sf20_entity_names")
def sf20(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    return X.read(spark, d, "pages").select("page_id", T.entity_name(path, F.col("html")).alias("entity"))


@query("sf21_sanitise", f"SELECT doc_id, left(regexp_replace(regexp_replace(text, '{T.SECRETS}', '[REDACTED]', 'g'), '`[^`]{{101,}}`', '`[code omitted]`', 'g'), 512) AS fact FROM documents")
def sf21(spark, d):
    return X.read(spark, d, "documents").select("doc_id", T.sanitise(F.col("text")).alias("fact"))


@query("sf22_flush", f"SELECT conv_id, turn, CASE tier WHEN 1 THEN 'auto' ELSE 'review' END AS queue FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, tier ORDER BY turn) AS r FROM (SELECT conv_id, turn, {C['tier']} AS tier FROM conversations) WHERE tier IS NOT NULL) WHERE r <= CASE tier WHEN 1 THEN 10 ELSE 5 END")
def sf22(spark, d):
    rows = captured(spark, d).where("tier IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "tier").orderBy("turn")))
    return rows.where("r <= CASE tier WHEN 1 THEN 10 ELSE 5 END").select("conv_id", "turn", F.when(F.col("tier") == 1, "auto").otherwise("review").alias("queue"))


@query("sf23_split_sentences")
def sf23(spark, d):
    return X.read(spark, d, "documents").select("doc_id", F.size(T.split_sentences(F.col("text"))).cast("long").alias("sentences"))


@query("sf24_keyed_fact", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE left(p_name || ' plain text without a key', 32) END AS key FROM part")
def sf24(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), "p_brand", F.lit('] {"name":"'), "p_name", F.lit('"}'))).otherwise(F.concat("p_name", F.lit(" plain text without a key")))
    return X.read(spark, d, "part").select("p_partkey", T.keyed_fact(raw)[0].alias("key"))




def clocks(spark, d):
    """Two vector clocks an order: of the odd and the even lines, devices by supplier."""
    l = X.read(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("side"), F.concat(F.lit("d"), F.col("l_suppkey") % 3).alias("device")).agg(F.sum("l_quantity").cast("long").alias("q"), F.max("l_shipdate").alias("t"))
    c = l.groupBy("l_orderkey", "side").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("device", "q")))).alias("clock"), F.max("t").alias("at"))
    a, b = (c.where(f"side = {i}").select("l_orderkey", F.col("clock").alias(f"c{i}"), F.col("at").alias(f"t{i}")) for i in (0, 1))
    return a.join(b, "l_orderkey")


CL = """x AS (SELECT l_orderkey, l_linenumber % 2 AS side, l_suppkey % 3 AS dev, sum(l_quantity)::BIGINT AS q, max(l_shipdate) AS t FROM lineitem GROUP BY 1, 2, 3),
 y AS (SELECT l_orderkey, dev, coalesce(max(q) FILTER (side = 0), 0) AS a, coalesce(max(q) FILTER (side = 1), 0) AS b FROM x GROUP BY 1, 2), s AS (SELECT l_orderkey, max(t) FILTER (side = 0) AS t0, max(t) FILTER (side = 1) AS t1 FROM x GROUP BY 1 HAVING count(DISTINCT side) = 2)"""


@query("sf25_vector_clocks", f"WITH {CL} SELECT l_orderkey, sum(greatest(a, b))::BIGINT AS merged, bool_and(a >= b) AND bool_or(a > b) AS dominates FROM y JOIN s USING (l_orderkey) GROUP BY 1")
def sf25(spark, d):
    c = clocks(spark, d)
    m = F.aggregate(F.map_values(sync.merged(F.col("c0"), F.col("c1"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return c.select("l_orderkey", m.alias("merged"), sync.dominates(F.col("c0"), F.col("c1")).alias("dominates"))


@query("sf26_resolve", f"WITH {CL} SELECT l_orderkey, CASE WHEN bool_and(a >= b) AND bool_or(a > b) THEN 'local' WHEN bool_and(b >= a) AND bool_or(b > a) THEN 'remote' WHEN max(t1) > max(t0) THEN 'remote' ELSE 'local' END AS winner FROM y JOIN s USING (l_orderkey) GROUP BY 1")
def sf26(spark, d):
    return clocks(spark, d).select("l_orderkey", sync.resolve(F.col("c0"), F.col("t0"), F.col("c1"), F.col("t1")).alias("winner"))


@query("sf27_enum_defaults", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failure' END AS outcome FROM orders")
def sf27(spark, d):
    return X.read(spark, d, "orders").select("o_orderkey", B.outcome(F.col("o_orderstatus")).alias("outcome"))


@query("sf28_month_bounds", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def sf28(spark, d):
    from quillon.operators import analytics

    a, b = analytics.month_bounds(F.col("o_orderdate").cast("timestamp"))
    return X.read(spark, d, "orders").select("o_orderkey", F.date_format(a, "yyyy-MM-dd").alias("first"), F.date_format(b, "yyyy-MM-dd").alias("next"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("sf29_json_detail", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def sf29(spark, d):
    return X.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("sf30_cache_key", "SELECT conv_id, turn, sha256(text || chr(1) || '5' || chr(1) || role) AS key FROM conversations")
def sf30(spark, d):
    return X.read(spark, d, "conversations").select("conv_id", "turn", B.cache_key(F.col("text"), F.lit(5), F.col("role")).alias("key"))
