"""Operators on small hand-made frames: order, ties, odd values, folds, streams, sinks."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import decay, text as T, vectors as V
from quillon.operators import analytics, consolidation, evaluation, fusion, graph, procedures, search, sessions, store, sync
from quillon.sources import tables
from quillon.streaming import activity, capture


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ((1, 0), (1, 1), (0, 0)))
    r = one(spark, V.cosine(a, b), V.cosine(a, z), V.norm(V.normalise(b)), V.norm(z), V.norm(V.hash_embedding(F.lit("x"))))
    assert [round(x, 6) for x in r] == [0.707107, 0.0, 1.0, 0.0, 1.0]


def test_decay(spark):
    L = lambda x: F.lit(float(x))
    r = one(spark, decay.retrievability(L(5), L(0)), decay.retrievability(L(5), L(5)), decay.retrievability(L(5), L(45)), decay.retrievability(L(5), L(-3)))
    assert [round(x, 6) for x in r] == [1.0, 0.9, 0.5, 1.0]
    empty = F.array().cast("array<double>")
    r = one(spark, decay.activation(empty), decay.activation(F.array(L(-5), L(0))), decay.activation(F.array(L(100))), decay.activation(F.array(L(100), L(10))))
    assert r[0] == r[1] == -20.0 and round(r[2], 6) == round(math.log(0.1), 6) and r[3] > r[2]
    r = one(spark, decay.forget(L(0.001), L(10)), decay.harder(L(9)), decay.surprise(L(0), L(0)), decay.tier(L(0.3)), decay.effective_stability(L(2), L(7)))
    assert tuple(r) == (0.01, 10.0, pytest.approx(-2.0), "compress", 4.0)
    low, high = (decay.reinforce(L(5), L(5), L(x)) for x in (0.9, 0.2))
    r = one(spark, low, high)
    assert 5 < r[0] < r[1]


def test_text(spark):
    L = F.lit
    r = one(spark, *[T.intent(L(x)) for x in ("Do you REMEMBER?", "Show the class", "a screenshot", "how to swim", "Who is it", "hello", "an API")])
    assert tuple(r) == ("recall", "code", "visual", "action", "question", "general", "general")
    r = one(spark, *[T.route(L(x)) for x in ("How many?", "somehow many", "in total, yes")])
    assert tuple(r) == ("inject", "skip", "inject")
    r = one(spark, T.redact(L("mail a.b@c.org, 123-45-6789, 10.0.0.1, call 555-123-4567, sk-abcdefghijklmnopqrstuv")))
    assert r[0] == "mail [EMAIL_REDACTED], [SSN_REDACTED], [IP_REDACTED], call [PHONE_REDACTED], [TOKEN_REDACTED]"
    assert tuple(one(spark, *[T.injection(L(x)) for x in ("Ignore all previous", "x\n### System", "fine")])) == (True, True, False)
    assert tuple(one(spark, *T.split_verb(L("Ann likes tea")))) == ("likes", "tea") and tuple(one(spark, *T.split_verb(L("nothing")))) == ("states", "nothing")
    assert tuple(one(spark, *T.split_first_space(L("a b c")))) == ("a", "b c") and tuple(one(spark, *T.split_first_space(L("abc")))) == ("knows", "abc")
    r = one(spark, T.split_sentences(L('See Dr. Who. He left. "Why?" Ok')))
    assert r[0] == ["See Dr. Who.", "He left.", '"Why?" Ok']
    assert one(spark, T.split_sentences(L("")))[0] == []
    r = one(spark, T.slug(L("UserService_v2.x")), T.entity_name(L("/src/AuthCore/a.ts"), L("")), T.entity_name(L("/src/a.ts"), L("the jwt")), T.entity_name(L(""), L("x")))
    assert tuple(r) == ("user-service-v2-x", "auth-core", "auth", "project")
    kind = L("user_statement")
    r = one(spark, *[T.capture(L(x), kind)[0] for x in ("we decided on tea", "fixed typo, we decided", "the root cause was tea", "short", "x" * 60)])
    assert tuple(r) == (1, None, 2, None, 2)
    r = one(spark, T.sanitise(L("key ghp_abc `" + "c" * 120 + "` " + "z" * 600)))
    assert r[0].startswith("key [REDACTED] `[code omitted]` z") and len(r[0]) == 512
    bad, good = L("[1, 2"), L('x ```json\n[{"entity_type":"a","instance":"b","action":"c","quantity":2.0,"unit":"kg"}]\n```')
    r = one(spark, T.parse_observations(bad), T.parse_observations(good), T.parse_observations(L('[{"action":"c"}]')))
    assert r[0] == [] and r[1][0].confidence == 0.8 and r[2] == []
    r = one(spark, T.observation_text(L("ate"), L("rice"), L(2.0), L("kg")), T.observation_text(L("ate"), L("rice"), L(2.5), L(None)), T.observation_text(L("ate"), L("rice"), L(None).cast("double"), L(None).cast("string")))
    assert tuple(r) == ("ate rice (2 kg)", "ate rice (2.5)", "ate rice")
    assert tuple(one(spark, *T.keyed_fact(L('[k] {"a":1}')))) == ("k", '{"a":1}') and one(spark, T.keyed_fact(L("plain"))[0])[0] == "plain"
    assert one(spark, T.word_overlap(L("a b c"), L("B a")))[0] == 1.0 and one(spark, T.word_overlap(L(""), L("x")))[0] == 0.0


def test_fusion(spark):
    ranks = spark.createDataFrame([("q", "a", "x", 3.0), ("q", "a", "y", 2.0), ("q", "b", "y", 1.0), ("q", "c", "x", 5.0), ("q", "c", "y", 5.0)], "qid string, signal string, id string, score double")
    assert {r.signal for r in fusion.gate(ranks).collect()} == {"a", "b"}
    got = {r.id: r.score for r in fusion.fuse(fusion.gate(ranks), {"a": 1.0, "b": 2.0, "c": 1.0}, F.lit(60)).collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(1 / 62 + 2 / 61)
    assert tuple(one(spark, *[fusion.adaptive_k(F.lit(n)) for n in (50, 1000, 5)])) == (5, 60, 1)


def test_vector_search_blocks_and_ties(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "o"), ("b", [2.0, 0.0], "p"), ("c", [0.0, 1.0], "o"), ("z", [0.0, 0.0], "o"), ("w", [1.0], "o")], "id string, v array<double>, owner string")
    queries = spark.createDataFrame([(f"q{i}", [1.0, 0.1 * i], "o") for i in range(5)] + [("zero", [0.0, 0.0], "o")], "qid string, v array<double>, owner string")
    monkeypatch.setattr(search, "BLOCK", 2)
    got = search.vector_top_k(rows, queries, 2).collect()
    assert {(r.qid, r.id) for r in got} == {(f"q{i}", x) for i in range(5) for x in "ab"} and [r.id for r in got if r.qid == "q0" and r.rank == 1] == ["a"]
    assert {r.id for r in search.vector_top_k(rows, queries, 2, scoped=True).collect()} == {"a", "c"}
    assert search.vector_top_k(rows.where("false"), queries, 2).count() == 0 and search.vector_top_k(rows, queries.where("false"), 2).count() == 0


def test_rerank_and_learning(spark):
    import pandas as pd

    rows = spark.createDataFrame([("q", i, r, "t" * r, "q") for i, r in (("a", 1), ("b", 2), ("c", 3))], "qid string, id string, rank int, text string, query string")

    def length(q: pd.Series, t: pd.Series) -> pd.Series:
        return t.str.len().astype(float)

    got = {r.id: r.new_rank for r in fusion.rerank(rows, F.pandas_udf(length, "double"), head=2).collect()}
    assert got == {"b": 1, "a": 2, "c": 3}
    fb = spark.createDataFrame([("k", 2, [0.0, 1.0], False), ("k", 1, [1.0, 0.0], True)], "key string, seq long, signals array<double>, relevant boolean")
    w = fusion.learn_weights(fb, [0.5, 0.5], rate=0.1).first().weights
    a = [0.6 / 1.1, 0.5 / 1.1]
    b = [a[0], a[1] - 0.1]
    assert w == pytest.approx([x / sum(b) for x in b])


def test_sessions(spark):
    rows = spark.createDataFrame(
        [("q", "a", 1, 0.9, "episodic", "e1", None, 30), ("q", "b", 2, 0.8, "episodic", "e1", None, 10), ("q", "c", 3, 0.7, "semantic", "e1", None, 20), ("q", "d", 4, 0.6, "episodic", None, 5, 50)],
        "qid string, id string, rank int, score double, memory_type string, episode_id string, event_time int, created_at int",
    )
    got = sessions.group(rows).orderBy("position").collect()
    assert [(g.group_id, g.members, g.session_time, g.episode_id) for g in got] == [("m:d", ["d"], 5, None), ("e1", ["b", "a"], 10, "e1"), ("m:c", ["c"], 20, None)]
    assert [g.group_id for g in sessions.group(rows, "relevance", 1).collect()] == ["e1"]
    obs = spark.createDataFrame([("e1", "o1", 1), ("e2", "o2", 1)], "episode_id string, id string, created_at int")
    assert [(r.id, r.score) for r in sessions.attach(sessions.group(rows), obs).collect()] == [("o1", 0.9)]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, x int")
    want = [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, store.upsert(old, new).collect())) == want
    root = str(tmp_path / "t")
    assert tables.versions(spark, root) == [] and tables.merge(old, root) == 1 and tables.merge(new, root) == 2
    assert sorted(map(tuple, tables.current(spark, root).collect())) == want
    assert sorted(map(tuple, store.updated(old, spark.createDataFrame([("a", None)], "id string, x int")).collect())) == [("a", 1), ("b", 2)]
    names = spark.createDataFrame([("n1", "A", "x"), ("n2", "A", "x"), ("n3", "B", "x")], "id string, name string, ns string")
    assert sorted(r.id for r in store.get_or_create(names.where("name = 'B'"), names, ["name", "ns"]).collect()) == ["n1", "n3"]
    tables.write(names, str(tmp_path / "p"), by=["ns"])
    assert tables.read(spark, str(tmp_path / "p")).count() == 3


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id TEXT, n INTEGER)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(f"k{i}", i if i % 2 else None) for i in range(25)])
    got = tables.sqlite(spark, path, "t", "id", 4).collect()
    assert len(got) == 25 and {(r.id, r.n) for r in got} == {(f"k{i}", str(i) if i % 2 else None) for i in range(25)}


def test_graph(spark):
    rows = [("a", "b", "causal", 1.0, 0.0, None), ("b", "c", "entity", 1.0, 0.0, None), ("c", "a", "entity", 1.0, 0.0, None), ("a", "d", "entity", 1.0, 0.0, "x"), ("a", "e", "entity", 1.0, 0.0, None)]
    e = spark.createDataFrame(rows, "source string, target string, edge_type string, weight double, age_days double, invalid_at string")
    s = spark.createDataFrame([("a", "action")], "id string, intent string")
    assert {(r.node, r.distance) for r in graph.bfs(e, s, 5).collect()} == {("b", 1), ("c", 2), ("e", 1)}
    assert {r.node for r in graph.bfs(e, s, 1).collect()} == {"b", "e"}
    got = {r.node: r.score for r in graph.beam(e, s, width=1, depth=2).collect()}
    assert set(got) == {"b", "c"} and got["b"] == pytest.approx(math.exp(0.36 + 0.4 + 0.2))
    ended = graph.superseded(e, spark.createDataFrame([("a", "b", "n")], "source string, target string, by string"), F.lit("now"))
    assert {r.target for r in ended.where("invalid_at = 'now'").collect()} == {"b"}


def test_promotion_is_greedy(spark):
    v = {"a": [1.0, 0.0], "b": [0.95, 0.3], "c": [0.7, 0.7], "d": [0.0, 1.0], "z": [0.0, 0.0]}
    rows = spark.createDataFrame([("e", k, i, k.upper(), x) for i, (k, x) in enumerate(v.items())], "entity string, id string, created_at int, content string, v array<double>")
    got = consolidation.promote(rows, 0.8).collect()
    assert [(r.seed, r.newest, r["size"], r.object, r.predicate) for r in got] == [("a", "b", 2, "B", "mentioned")]


def test_decay_pass(spark):
    rows = spark.createDataFrame([("a", "episodic", 0.001, 1.0, 1.0), ("b", "procedural", 0.001, 0.05, 1.0), ("c", "procedural", 0.001, 0.9, 1.0), ("d", "observation", 0.001, 0.0, 1.0)], "id string, memory_type string, stability double, reliability double, access_count double")
    rows = rows.withColumn("created_at", F.lit("2023-01-01").cast("timestamp")).withColumn("last_accessed", F.lit(None).cast("timestamp"))
    got = {r.id: (r.archived, r.stability) for r in consolidation.decay_pass(rows, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": (True, 0.0005), "b": (True, 0.0005), "c": (False, 0.001)}
    assert "access_count" in consolidation.decay_pass(rows, F.lit("2024-01-01").cast("timestamp"), touch=True).columns


def test_procedures(spark):
    trials = spark.createDataFrame([("a", True, 1.0), ("a", True, 0.5), ("a", False, -1.0)], "k string, ok boolean, cosine double")
    assert procedures.reliability(trials, "k").first().reliability == pytest.approx(3 / 5)
    assert procedures.weighted(trials, "k").first().reliability == pytest.approx(2.25 / 3.25)


def test_admission_folds(spark):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 61, 62, 62])] + [(2, 9, 0.0)], "key long, id long, at double")
    got = {r.id: r.admitted for r in analytics.admitted(rows, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 9: True}


def test_latency(spark):
    r = analytics.latency(spark.createDataFrame([("k", float(i)) for i in range(100)], "k string, value double"), "k").first()
    assert (r.p50, r.p95, r.p99, r.min, r.max) == (50.0, 95.0, 99.0, 0.0, 99.0)


def test_clocks(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p]).cast("map<string,bigint>")
    a, b, c = m(x=2, y=1), m(x=1), m(y=5)
    r = one(spark, sync.merged(a, c), sync.dominates(a, b), sync.dominates(b, a), sync.dominates(a, a), sync.resolve(b, F.lit(9), a, F.lit(1)), sync.resolve(a, F.lit(1), c, F.lit(2)), sync.resolve(a, F.lit(2), c, F.lit(2)))
    assert r[0] == {"x": 2, "y": 5} and tuple(r)[1:] == (True, False, False, "remote", "remote", "local")
    assert tuple(one(spark, sync.allowed(F.lit("admin"), F.lit("writer")), sync.allowed(F.lit("guest"), F.lit("writer")))) == (True, False)


def test_statistics(spark):
    same = spark.createDataFrame([("k", 1.0, 1.0)] * 3, "k string, x double, y double")
    assert evaluation.cohens_d(same, "k").first().d == 0.0 and evaluation.wilcoxon(same, "k").count() == 0
    up = spark.createDataFrame([("k", 0.0, float(i)) for i in range(1, 9)], "k string, x double, y double")
    r = evaluation.wilcoxon(up, "k").first()
    assert (r.n, r.w_plus) == (8, 36.0) and 0.005 < r.p < 0.02
    p = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.001, 0.2, 0.012, 0.9])], "k string, id int, p double")
    assert {r.id for r in evaluation.benjamini_hochberg(p, "k").where("rejected").collect()} == {0, 2}
    q = one(spark, evaluation.normal_quantile(F.lit(0.975)), evaluation.sample_size(F.lit(0.5)), evaluation.normal_cdf(F.lit(1.96)))
    assert abs(q[0] - 1.96) < 1e-3 and q[1] == 32 and abs(q[2] - 0.975) < 1e-4
    wins = spark.createDataFrame([("a", "b", 9), ("b", "a", 1), ("b", "c", 5), ("c", "b", 5)], "winner string, loser string, n int")
    s = {r.player: r.strength for r in evaluation.bradley_terry(wins).collect()}
    assert s["a"] > s["b"] and sum(s.values()) == pytest.approx(3)
    rows = spark.createDataFrame([("k", i, float(i)) for i in range(20)], "k string, i int, value double")
    b = evaluation.bootstrap(rows, "k", 100).first()
    assert b.low < b.mean < b.high and b.mean == 9.5
    ranked = spark.createDataFrame([("q", 1, 0, 2), ("q", 2, 1, 2), ("q", 3, 1, 2)], "qid string, rank int, rel int, total int")
    m = evaluation.metrics(ranked, 2).first()
    assert (m.mrr, m.accuracy_at_1, m.recall_at_k) == (0.5, 0.0, 0.5) and 0 < m.ndcg < 1


def test_wilcoxon_of_many_rows(spark):
    n, up = 2_000_000, 1_000_500
    rows = spark.range(n).selectExpr("'k' k", "0.0D x", f"CASE WHEN id < {up} THEN 1.0D ELSE -1.0D END y")
    r = evaluation.wilcoxon(rows, "k").first()
    assert (r.n, r.w_plus) == (n, up * (n + 1) / 2)
    z = (r.w_plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6) and 0.5 < r.p < 0.6


def test_wilcoxon_mid_ranks(spark):
    rows = [(k, float(i * 7 % 5) if i % 11 else None, i * i % 13 / 2) for k, m in (("a", 60), ("b", 7), (None, 40)) for i in range(m)]
    got = {r.k: r for r in evaluation.wilcoxon(spark.createDataFrame(rows, "k string, x double, y double"), "k").collect()}
    assert len(got) == 3
    for k, r in got.items():
        ds = [y - x for key, x, y in rows if key == k and x is not None and y != x]
        rank = lambda d: sum(abs(e) < abs(d) for e in ds) + (sum(abs(e) == abs(d) for e in ds) + 1) / 2
        n, w = len(ds), sum(rank(d) for d in ds if d > 0)
        z = abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        assert (r.n, r.w_plus) == (n, w) and r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "user_id long, id long, ts timestamp, event_type string, n long"
    rows = [(1, i, f"2024-01-0{1 + i // 4} 00:00:{i:02d}", "recall", i % 3) for i in range(8)]
    spark.createDataFrame(rows, "user_id long, id long, ts string, event_type string, n long").selectExpr("user_id", "id", "CAST(ts AS TIMESTAMP) ts", "event_type", "n").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    out = str(tmp_path / "usage")
    drain(stream().selectExpr("user_id", "ts created_at", "event_type tier", "n").writeStream.foreachBatch(activity.usage_sink(out)).option("checkpointLocation", str(tmp_path / "c1")).start())
    assert [(r.user_id, r.month, r.n) for r in activity.usage_totals(spark, out).collect()] == [(1, "2024-01", 7)]
    drain(activity.activity_windows(stream()).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert sorted(r.n for r in spark.table("windows").collect()) == [4, 4]
    drain(activity.rate_limit(stream().selectExpr("user_id key", "id", "CAST(unix_timestamp(ts) AS DOUBLE) at"), 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert {r.id for r in spark.table("limited").where("admitted").collect()} == {0, 1, 4, 5}
    drain(activity.access_ring(stream().selectExpr("user_id key", "CAST(unix_timestamp(ts) AS DOUBLE) at"), 5).writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", str(tmp_path / "c4")).start())
    assert [r.held for r in spark.table("ring").collect()] == [5]


def test_capture_streams(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "session string, id long, kind string, content string"
    rows = [("s", i, "user_statement", f"we decided on plan {i}") for i in range(4)] + [("s", 9, "tool", "the root cause was x"), ("s", 10, "tool", "nothing"), ("t", 1, "tool", "we chose tea")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    drain(capture.capture(stream(), {1: 3, 2: 1}).writeStream.format("memory").queryName("captured").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert {(r.session, r.id, r.tier) for r in spark.table("captured").collect()} == {("s", 0, 1), ("s", 1, 1), ("s", 2, 1), ("s", 9, 2), ("t", 1, 1)}
    out = str(tmp_path / "facts")
    drain(stream().selectExpr("id", "'Ann likes tea. Nothing here.' AS text").writeStream.foreachBatch(capture.extraction_sink(out)).option("checkpointLocation", str(tmp_path / "c2")).start())
    assert {(r.subject, r.predicate, r.object) for r in spark.read.parquet(out).collect()} == {("ann", "likes", "tea")}


def test_entry_imports(spark):
    started = time.time()
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and time.time() - started < 60


def test_folds_cross_batches_and_keys(spark):
    from quillon.operators import analytics, consolidation, fusion

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(8)
        rows = [(None if k == 3 else f"k{k}", i, float(rng.integers(0, 50))) for k in range(5) for i in range(40)]
        df = spark.createDataFrame(rows, "key string, id long, at double")
        got = {(r.key, r.id): r.admitted for r in analytics.admitted(df, 3, 10.0).collect()}
        for k in {r[0] for r in rows}:
            live = []
            for _, i, at in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
                live = [t for t in live if t > at - 10.0]
                assert got[k, i] == (len(live) < 3)
                if len(live) < 3:
                    live.append(at)
        context = {(r.session, r.at): r.context for r in consolidation.temporal_context(df.selectExpr("key session", "id at", "CASE WHEN id = 5 THEN NULL ELSE at END value")).collect()}
        learned = {r.key: r for r in fusion.learn_weights(df.selectExpr("key", "id seq", "array(at / 50, 0.5D) signals", "at > 25 relevant"), [0.5, 0.5]).collect()}
        for k in {r[0] for r in rows}:
            c, w = 0.0, [0.5, 0.5]
            for _, i, at in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                c = c if i == 5 else 0.85 * c + 0.15 * at
                assert abs(context[k, i] - c) < 1e-9
                w = [max(x + (0.01 if at > 25 else -0.01) * s, 0.01) for x, s in zip(w, (at / 50, 0.5))]
                w = [x / sum(w) for x in w]
            assert np.allclose(learned[k].weights, w) and learned[k].samples == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_promotion_and_tiles_are_brute_force(spark, monkeypatch):
    from quillon.operators import consolidation

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = [(f"e{i % 2}", f"m{i:03}", i // 3, f"text {i}", (centres[rng.integers(6)] + 0.35 * rng.normal(size=8)).tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "entity string, id string, created_at long, content string, v array<double>")
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = []
    for e in ("e0", "e1"):
        left = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1]))
        while left:
            seed, *rest = left
            own = [r for r in rest if cos(r[4], seed[4]) > 0.8]
            left = [r for r in rest if r not in own]
            if own:
                want.append((e, seed[1], own[-1][1], len(own) + 1, own[-1][3]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = [tuple(r) for r in consolidation.promote(df, 0.8).select("entity", "seed", "newest", "size", "object").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and want
    monkeypatch.setattr(consolidation, "TILE", 16)
    pairs = {(a[0], *sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and cos(a[4], b[4]) > 0.8}
    found = [(r.entity, r.a, r.b) for r in consolidation.similar_pairs(df, 0.8).collect()]
    assert sorted(found) == sorted(pairs)
    new = df.where("id < 'm040'")
    both = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < "m040" and cos(a[4], b[4]) > 0.8}
    assert sorted((r.new_id, r.old_id) for r in consolidation.supersession(new, df, 0.8).collect()) == sorted(both)


def test_lexical_search_is_brute_force(spark):
    import math
    import re

    from quillon.operators import search

    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(30)] + ["Éa", "x2"]
    docs = [(f"d{i:03}", " ".join(rng.choice(words, rng.integers(0, 25))), int(i % 2), [f"o{i % 3}"]) for i in range(120)] + [("d999", None, 0, None)]
    asked = [(f"q{i}", " ".join(rng.choice(words, 3)), f"o{i % 4}") for i in range(9)] + [("q9", "", None), ("q8x", "W1 nothere", None)]
    dd, qq = spark.createDataFrame(docs, "id string, text string, kind int, owners array<string>").repartition(4), spark.createDataFrame(asked, "qid string, text string, target string")
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    mean = sum(len(tok(t)) for _, t, *_ in docs) / len(docs)
    df = {w: sum(w in tok(t) for _, t, *_ in docs) for w in {x for _, t, _ in asked for x in tok(t)}}
    want, every = [], set()
    for q, t, target in asked:
        scores = []
        for i, text, kind, owners in docs:
            own = tok(text)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set(tok(t)) if w in own)
            if set(own) & set(tok(t)):
                scores.append((-round(s, 9), i, kind, owners))
            if tok(t) and set(tok(t)) <= set(own):
                every.add((q, i))
        want += [(q, i, 1, r + 1) for r, (_, i, _, _) in enumerate(sorted(scores)[:7])]
        want += [(q, i, 0, r + 1) for r, (_, _, i) in enumerate(sorted((k, s, i) for s, i, k, o in scores if target in (o or []))[:5])]
    got = [(r.qid, r.id, r.path, r["rank"]) for r in search.lexical_paths(dd, qq, 7, 5).collect()]
    assert sorted(got) == sorted(want)
    assert {tuple(r) for r in search.match_all(dd, qq).collect()} == every
    assert search.match_all(dd, qq.where("false")).count() == 0 and search.lexical_paths(dd.where("false"), qq, 3, 3).count() == 0


def test_billing_and_consolidation_sinks(spark, tmp_path):
    requests = spark.createDataFrame([("u1", "/v1/recall"), ("u1", "/v1/observe"), ("u2", "/v1/health"), ("u3", "/v1/recall"), (None, "/x")], "user_id string, path string").withColumn("created_at", F.lit("2024-12-31 23:00:00").cast("timestamp"))
    posted = []
    sink = activity.billing_sink(str(tmp_path / "bills"), lambda records: posted.append(sorted((r.name, r.n) for r in records.collect())))
    for _ in range(2):  # a batch that runs twice has the same names
        sink(requests, 4)
    assert posted == [[("4-u1-2024-12", 2), ("4-u3-2024-12", 1)]] * 2
    assert sum(r.n for r in activity.usage_totals(spark, str(tmp_path / "bills")).collect()) == 3

    class Store:
        runs = 0

        def consolidate(self, now):
            self.runs += 1

    store_ = Store()
    run = capture.consolidation_sink(store_, F.current_timestamp())
    ended = spark.createDataFrame([("e1",)], "id string")
    run(ended.where("false"), 0)
    run(ended, 1)
    assert store_.runs == 1


def test_patterns_and_redaction_are_brute_force(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame([(9001, "a@b.co a@b.co 2024-01-02 x http://q/é?2024-01-02 é c@d.org", "en", "s", 1), (9002, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((i, k, n + 1, m.group(), m.start()) for i, t in texts.items() for k, p in T.PATTERNS for n, m in enumerate(re.finditer(p, t or "", re.ASCII)))
    assert sorted((r.doc_id, r.kind, r.n, r.match, r.first) for r in T.patterns(docs, "doc_id", "text").collect()) == want and len(want) > 5
    for r in docs.select("doc_id", T.redact(F.col("text")).alias("clean")).collect():
        clean = texts[r.doc_id]
        for pattern, mark in T.REDACTIONS:
            clean = re.sub(pattern, mark, clean, flags=re.ASCII) if clean is not None else None
        assert r.clean == clean
