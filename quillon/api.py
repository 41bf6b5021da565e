"""The verbs of a memory store over delta tables: every write adds files, every read is a DataFrame.

A store is a folder with the tables memories, entities, episodes, edges and activity (`sources.tables`). A row's key is
its namespace and its id: all verbs see and change rows of their own namespace alone. A write adds the new or changed
rows (or the ends of rows) as a delta; a read keeps the newest of each key; `compact` folds deltas into one. Methods that answer
questions take frames of many queries; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.functions import text as T, vectors as V
from quillon.operators import analytics, consolidation, fusion, graph, sessions, store
from quillon.sources import tables

MEMORIES = (
    "id string, namespace_id string, memory_type string, episode_id string, source_entity string, about_entity string, subject string, predicate string, object string, "
    "trigger string, action string, content string, v array<double>, confidence double, reliability double, trial_count long, stability double, retrievability double, "
    "access_count long, salience double, created_at timestamp, event_time timestamp, last_accessed timestamp, invalid_at timestamp"
)
ENTITIES = "id string, namespace_id string, name string, kind string"
EPISODES = "id string, namespace_id string, participants array<string>, started_at timestamp, ended_at timestamp, outcome string"
EDGES = "id string, namespace_id string, source string, target string, edge_type string, weight double, age_days double, invalid_at timestamp"
ACTIVITY = "id string, namespace_id string, user_id string, event_type string, detail string, created_at timestamp"
SCHEMAS = {"memories": MEMORIES, "entities": ENTITIES, "episodes": EPISODES, "edges": EDGES, "activity": ACTIVITY}
#: What names a row.
KEY = ["namespace_id", "id"]
#: What a write gives where nothing is said; fixed values.
DEFAULTS = {"confidence": 0.8, "stability": 1.0, "retrievability": 1.0, "salience": 0.5}


class Memory:
    def __init__(self, spark: SparkSession, root: str, namespace: str = "default", embed=V.hash_embedding):
        self.spark, self.root, self.namespace, self.embed = spark, root.rstrip("/"), namespace, embed

    def table(self, name: str) -> DataFrame:
        """The current rows of all namespaces; empty if nothing was written."""
        return tables.latest(self.spark, f"{self.root}/{name}", SCHEMAS[name], KEY)

    def mine(self, name: str = "memories") -> DataFrame:
        return self.table(name).where(F.col("namespace_id") == self.namespace)

    def _shaped(self, rows: DataFrame, name: str) -> DataFrame:
        """rows in the table's columns; what they lack is null or the default."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        out = []
        for f in schema:
            default = F.lit(self.namespace) if f.name == "namespace_id" else F.lit(DEFAULTS.get(f.name)) if name == "memories" else F.lit(None)
            out.append((F.coalesce(F.col(f.name), default) if f.name in rows.columns else default).cast(f.dataType).alias(f.name))
        return rows.select(*out)

    def put(self, name: str, rows: DataFrame) -> int:
        """Adds rows in place of this namespace's rows with their ids; of rows with one id any one."""
        return tables.append(self._shaped(rows, name).withColumn("namespace_id", F.lit(self.namespace)).dropDuplicates(["id"]), f"{self.root}/{name}", "namespace_id")

    def _change(self, name: str, updates: DataFrame) -> int:
        """Adds this namespace's rows with the non-null columns of updates (one row an id)."""
        return self.put(name, store.updated(store.by_ids(self.mine(name), updates), updates))

    def _end(self, name: str, ids: DataFrame) -> int:
        """Ends this namespace's rows with these ids."""
        found = store.by_ids(self.mine(name).select("id"), ids)
        return tables.append(self._shaped(found, name).withColumn("namespace_id", F.lit(self.namespace)), f"{self.root}/{name}", "namespace_id", gone=True)

    def compact(self) -> None:
        """Folds the deltas of every table into one; answers stay the same."""
        for name, schema in SCHEMAS.items():
            if name != "activity" and len(tables.deltas(self.spark, f"{self.root}/{name}")) > 1:
                tables.compact(self.spark, f"{self.root}/{name}", schema, KEY, "namespace_id")

    def remember(self, facts: DataFrame, now: Column) -> int:
        """Facts (id, entity, fact, confidence?): predicate and object by the fact's verb."""
        verb, rest = T.split_verb(F.col("fact"))
        rows = facts.select("id", F.lit("semantic").alias("memory_type"), F.col("entity").alias("subject"), verb.alias("predicate"), rest.alias("object"), F.col("fact").alias("content"), self.embed(F.col("fact")).alias("v"), now.alias("created_at"), *([F.col("confidence")] if "confidence" in facts.columns else []))
        return self.put("memories", rows)

    def observe(self, turns: DataFrame, now: Column) -> int:
        """Turns (id, episode_id, role, about, content, event_time?) as episodic memories; contents are redacted first."""
        clean = T.redact(F.col("content"))
        rows = turns.select("id", "episode_id", F.lit("episodic").alias("memory_type"), F.col("role").alias("source_entity"), F.col("about").alias("about_entity"), clean.alias("content"), self.embed(clean).alias("v"), now.alias("created_at"), *([F.col("event_time")] if "event_time" in turns.columns else []))
        return self.put("memories", rows.withColumn("confidence", F.lit(1.0)).withColumn("access_count", F.lit(0)))

    def start_episodes(self, episodes: DataFrame, now: Column) -> int:
        return self.put("episodes", episodes.withColumn("started_at", now))

    def end_episodes(self, ended: DataFrame, now: Column) -> int:
        """ended: id, outcome."""
        return self._change("episodes", ended.select("id", now.alias("ended_at"), "outcome"))

    def recall(self, queries: DataFrame, now: Column, limit: int = 5, types: list[str] | None = None, min_confidence: float | None = None, scorer=None) -> DataFrame:
        """queries (qid, text, target?); types and min_confidence look at the limited answers, so fewer may be left. scorer(query, text): reranks their head."""
        asked = queries.withColumn("v", self.embed(F.col("text")))
        if "target" not in queries.columns:
            asked = asked.withColumn("target", F.lit(None).cast("string"))
        links = graph.memory_edges(self.mine()).unionByName(self.mine("edges").select("source", "target", "edge_type", "weight", "age_days", "invalid_at"))
        got = fusion.recall(self.mine(), asked, now, fusion.Config(limit=limit), links, scorer)
        rows = got.join(self.mine().select("id", "memory_type", "content", "episode_id", "event_time", "created_at", "confidence"), "id")
        if types:
            rows = rows.where(F.col("memory_type").isin(types))
        return rows if min_confidence is None else rows.where(F.col("confidence") >= min_confidence)

    def recall_grouped(self, queries: DataFrame, now: Column, limit: int = 50, order: str = "chronological", max_groups: int | None = None, types: list[str] | None = None) -> DataFrame:
        """Answers by session; `observations` are those of the session's episode, by time."""
        rows = self.recall(queries, now, limit, types).withColumnRenamed("final_score", "score")
        return sessions.with_observations(sessions.group(rows, order, max_groups), self.mine().where("memory_type = 'observation'"))

    def reinforce(self, returned: DataFrame, now: Column) -> int:
        """Applies a recall's side effect: returned (id)."""
        u = fusion.reinforced(store.by_ids(self.mine(), returned), now)
        return self._change("memories", u)

    def update(self, changes: DataFrame) -> int:
        """changes: id, fact, confidence?; the fact is split at its first space; a null confidence keeps the old one."""
        a, b = T.split_first_space(F.col("fact"))
        u = changes.select("id", a.alias("predicate"), b.alias("object"), F.col("fact").alias("content"), *([F.col("confidence")] if "confidence" in changes.columns else []))
        return self._change("memories", u)

    def forget(self, entities: DataFrame) -> int:
        """Deletes what entities (id) own."""
        return self._end("memories", store.of_entities(self.mine(), entities))

    def delete(self, ids: DataFrame) -> int:
        return self._end("memories", ids)

    def purge(self) -> int:
        """Ends all memories of the namespace; rows of other namespaces, and of none, stay."""
        return self._end("memories", self.mine())

    def erase(self, entities: DataFrame) -> DataFrame:
        """Erases entities with all that belongs to them, and returns the report."""
        left = store.erase(self.mine(), self.mine("episodes"), self.mine("edges"), entities)
        n = tables.claim(self.spark, f"{self.root}/erased")
        left["report"].withColumn("namespace_id", F.lit(self.namespace)).write.parquet(f"{self.root}/erased/{n}")
        self._end("memories", left["gone_memories"])
        self._end("edges", left["gone_edges"])
        self._end("entities", entities)
        return self.spark.read.parquet(f"{self.root}/erased/{n}")

    def export(self, entities: DataFrame) -> DataFrame:
        return store.export(self.mine(), self.mine("episodes"), entities)

    def inspect(self, limit: int = 20) -> DataFrame:
        """Of each entity: episodic memories, newest first, then facts, up to the limit."""
        a = self.mine().where("memory_type = 'episodic'").withColumn("entity", F.col("about_entity"))
        b = self.mine().where("memory_type = 'semantic'").withColumn("entity", F.col("subject"))
        return store.filled(a, b, "entity", limit)

    def stats(self) -> DataFrame:
        return self.mine().groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))

    def consolidate(self, now: Column, threshold: float = 0.8) -> int:
        """Promotes repeated turns to facts (once: facts that are there aren't added again) and applies a decay pass."""
        turns = self.mine().where("memory_type = 'episodic' AND v IS NOT NULL AND about_entity IS NOT NULL")
        found = consolidation.promote(turns.select(F.col("about_entity").alias("entity"), "id", "created_at", "content", "v"), threshold)
        facts = found.select(F.concat(F.lit("fact-"), "seed").alias("id"), F.lit("semantic").alias("memory_type"), F.col("entity").alias("subject"), "predicate", "object", F.concat_ws(" ", "predicate", "object").alias("content"), "confidence", now.alias("created_at"))
        fresh = self._shaped(facts.join(self.mine().select("subject", "predicate", "object"), ["subject", "predicate", "object"], "left_anti"), "memories")
        passed = consolidation.decay_pass(self.mine(), now).select("id", "stability", "retrievability")
        kept = store.updated(self.mine(), passed)
        return self.put("memories", kept.unionByName(fresh))

    def log(self, events: DataFrame) -> None:
        tables.write(self._shaped(events, "activity"), f"{self.root}/log", by=["namespace_id"])

    def activity(self, now: Column, days: int = 30) -> DataFrame:
        log = tables.read(self.spark, f"{self.root}/log")
        return analytics.daily(log.where(F.col("namespace_id") == self.namespace), now, days)

    def recent(self, n: int = 20) -> DataFrame:
        """The namespace's newest n events with a summary each."""
        log = tables.read(self.spark, f"{self.root}/log")
        return analytics.recent(log.where(F.col("namespace_id") == self.namespace), "namespace_id", n)

    def usage(self) -> DataFrame:
        """user_id, month, tier (the event type), n: the namespace's billed events."""
        log = tables.read(self.spark, f"{self.root}/log")
        return analytics.usage(log.where(F.col("namespace_id") == self.namespace).select("user_id", "created_at", F.col("event_type").alias("tier"), F.lit(1).alias("n")))

    def feedback(self, samples: DataFrame, weights: list[float]) -> DataFrame:
        """Learned weights of samples (key, seq, signals, relevant)."""
        return fusion.learn_weights(samples, weights)
