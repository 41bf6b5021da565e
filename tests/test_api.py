"""The store's verbs from start to end, a deadline, the OCR interface."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.api import Memory
from quillon.plans.deadline import Late, within
from quillon.sources import ocr

def test_verbs(spark, tmp_path):
    NOW, LATER = (F.lit(f"{y}-03-01 00:00:00").cast("timestamp") for y in (2024, 2025))
    m = Memory(spark, str(tmp_path / "store"), "ns")
    df = spark.createDataFrame
    assert m.stats().count() == 0
    m.remember(df([("f1", "ann", "Ann likes green tea"), ("f2", "bob", "Bob uses a pen")], "id string, entity string, fact string"), NOW)
    m.start_episodes(df([("e1", ["ann", "user"])], "id string, participants array<string>"), NOW)
    turns = [(f"t{i}", "e1", "user", "ann", "I want green tea, mail a@b.org") for i in range(3)] + [("t9", "e1", "assistant", "bob", "something else entirely")]
    m.observe(df(turns, "id string, episode_id string, role string, about string, content string"), NOW)
    m.end_episodes(df([("e1", "success")], "id string, outcome string"), NOW)
    assert m.table("episodes").first().outcome == "success" and m.table("episodes").first().started_at is not None
    q = df([("q1", "green tea", "ann")], "qid string, text string, target string")
    got = m.recall(q, NOW, limit=4).orderBy("rank").collect()
    assert len(got) == 4 and {r.id for r in got} >= {"f1", "t0"} and "[EMAIL_REDACTED]" in next(r.content for r in got if r.id == "t0")
    assert {r.memory_type for r in m.recall(q, NOW, types=["semantic"]).collect()} == {"semantic"}
    groups = m.recall_grouped(q, NOW, limit=6).collect()
    assert any(g.episode_id == "e1" and len(g.members) >= 3 for g in groups)
    m.reinforce(df([("t0",)], "id string"), LATER)
    t0 = m.mine().where("id = 't0'").first()
    assert t0.access_count == 1 and t0.stability > 1
    m.update(df([("f2", "owns two pens")], "id string, fact string"))
    f2 = m.mine().where("id = 'f2'").first()
    assert (f2.predicate, f2.object, f2.confidence) == ("owns", "two pens", 0.8)
    m.consolidate(NOW)
    facts = m.mine().where("predicate = 'mentioned'").collect()
    assert [(f.subject, round(f.confidence, 6)) for f in facts] == [("ann", 0.9)]
    m.consolidate(NOW)
    assert m.mine().where("predicate = 'mentioned'").count() == 1
    assert {r.entity for r in m.inspect(2).collect()} == {"ann", "bob"}
    assert m.export(df([("ann",)], "id string")).count() == 5
    report = m.erase(df([("ann",)], "id string")).first()
    assert report.memories == 5 and m.mine().where("subject = 'ann' OR about_entity = 'ann'").count() == 0
    m.forget(df([("bob",)], "id string"))
    assert m.mine().count() == 0
    m.remember(df([("f3", "cy", "Cy has a cat")], "id string, entity string, fact string"), NOW)
    m.delete(df([("f3",)], "id string"))
    assert m.mine().count() == 0
    m.log(df([("a1", "recall"), ("a2", "other")], "id string, event_type string").withColumn("created_at", NOW))
    assert [(r.recalls, r.remembers) for r in m.activity(NOW).collect()] == [(1, 0)]


def test_namespaces_are_apart(spark, tmp_path):
    now, later = (F.lit(f"{y}-03-01 00:00:00").cast("timestamp") for y in (2024, 2025))
    df, root = spark.createDataFrame, str(tmp_path / "store")
    a, b = Memory(spark, root, "a"), Memory(spark, root, "007")
    ann = df([("ann",)], "id string")
    for m, what in ((a, "tea"), (b, "ink")):
        # equal ids and entities in both
        m.remember(df([("f1", "ann", f"Ann likes {what}"), ("f2", "bob", f"Bob likes {what}")], "id string, entity string, fact string"), now)
        m.start_episodes(df([("e1", ["ann"])], "id string, participants array<string>"), now)
        m.observe(df([("t1", "e1", "user", "ann", f"I want {what}")], "id string, episode_id string, role string, about string, content string"), now)
        m.put("edges", df([("x", "ann", "bob")], "id string, source string, target string"))
        m.put("entities", df([("ann", "Ann")], "id string, name string"))
        m.log(df([(f"l{what}", "u1", "recall")], "id string, user_id string, event_type string").withColumn("created_at", now))
    known = {t: sorted(map(str, b.mine(t).collect())) for t in ("memories", "episodes", "edges", "entities")}
    first = next(tmp_path.glob("store/memories/__delta=1/*/*.parquet"))
    stamp = first.stat().st_mtime_ns
    assert sorted(r.content for r in b.mine().collect()) == ["Ann likes ink", "Bob likes ink", "I want ink"]
    a.end_episodes(df([("e1", "success")], "id string, outcome string"), now)
    a.reinforce(df([("t1",)], "id string"), later)
    a.update(df([("f2", "owns a pen")], "id string, fact string"))
    a.consolidate(later)
    assert {r.id: r.content for r in a.mine().collect()}["f2"] == "owns a pen"
    assert "ink" not in str(a.export(ann).collect()) and a.export(ann).count() == 2
    assert [r.summary for r in a.recent().collect()] == ["Recall -"] and [(r.month, r.n) for r in a.usage().collect()] == [("2024-03", 1)]
    assert a.erase(ann).first().memories == 2
    a.forget(df([("bob",)], "id string"))
    a.delete(df([("f1",), ("t1",)], "id string"))
    a.purge()
    assert [a.mine(t).count() for t in ("memories", "edges", "entities")] == [0, 0, 0]
    assert {t: sorted(map(str, b.mine(t).collect())) for t in known} == known
    b.compact()
    assert {t: sorted(map(str, b.mine(t).collect())) for t in known} == known and a.mine().count() == 0
    assert first.stat().st_mtime_ns == stamp
    a.remember(df([("f1", "ann", "Ann likes tea again")], "id string, entity string, fact string"), later)
    assert a.mine().count() == 1 and b.mine().count() == 3


def test_two_writers_get_two_deltas(spark, tmp_path):
    from quillon.sources import tables

    root = str(tmp_path / "t")
    assert [tables.claim(spark, root) for _ in range(3)] == [1, 2, 3] and tables.deltas(spark, root) == []
    tables.append(spark.createDataFrame([(1, "n", 5)], "id long, ns string, x int"), root, "ns")
    tables.append(spark.createDataFrame([(1, "n", 6), (1, None, 7)], "id long, ns string, x int"), root, "ns")
    got = tables.latest(spark, root, "id long, ns string, x int", ["ns", "id"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "n", 6), (1, None, 7)]


def test_deadline(spark):
    assert within(spark, 60, lambda: spark.range(10).count()) == 10

    def slow():
        return spark.range(4).mapInPandas(lambda it: (time.sleep(20) or b for b in it), "id long").count()

    with pytest.raises(Late):
        within(spark, 2, slow)


def test_ocr(spark):
    rows = spark.createDataFrame([(1, b"x")], "id long, image binary")
    assert ocr.recognise(rows).first().text == ""
