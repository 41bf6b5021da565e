"""Signals, the gate, adaptive k, reciprocal-rank fusion, and recall over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillon.functions import decay, text as T
from quillon.operators import folds, graph, search
from quillon.sources.scratch import kept

#: Signals in order, with their default weights; fixed values.
WEIGHTS = {"vector": 1.0, "lexical": 0.8, "activation": 1.0, "spread": 0.8, "intent": 0.5, "confidence": 0.5, "entity": 1.2}
LINEAR = [0.25, 0.10, 0.15, 0.05, 0.20, 0.10, 0.10, 0.05]


@dataclass
class Config:
    k: int = 60
    candidates: int = 100
    limit: int = 5
    beam: int = 10
    depth: int = 4
    rerank: int = 20
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))


def adaptive_k(n: Column, k: int = 60) -> Column:
    return F.least(F.greatest(F.floor(n / 10), F.lit(1)), F.lit(k))


def gate(rankings: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """rankings (qid, signal, id, score) without those whose two or more scores all are about the first one's."""
    w = Window.partitionBy("qid", "signal")
    return rankings.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__d", F.max("score").over(w) - F.min("score").over(w)).where((F.col("__n") == 1) | (F.col("__d") > tolerance)).drop("__n", "__d")


def fuse(rankings: DataFrame, weights: dict[str, float], k: Column) -> DataFrame:
    """qid, id, score of rankings (qid, signal, id, score, and what k needs): sum of weight / (k + rank), rank from 1 by score, then id."""
    w = Window.partitionBy("qid", "signal").orderBy(F.desc("score"), "id")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return rankings.withColumn("rank", F.row_number().over(w)).groupBy("qid", "id").agg(F.round(F.sum(table[F.col("signal")] / (k + F.col("rank"))), 12).alias("score"))


def confidence_signal() -> Column:
    return F.when(F.col("memory_type") == "procedural", F.col("reliability")).when(F.col("memory_type") == "episodic", 1.0).otherwise(F.col("confidence"))


def entity_signal(target: Column) -> Column:
    return (
        F.when((F.col("memory_type") == "semantic") & (F.col("subject") == target), 1.0)
        .when((F.col("memory_type") == "episodic") & (F.col("about_entity") == target), 1.0)
        .when((F.col("memory_type") == "episodic") & (F.col("source_entity") == target), 0.8)
        .otherwise(0.0)
    )


def activation_signal(now: Column) -> Column:
    last = F.coalesce("last_accessed", "created_at")
    return F.when(F.col("memory_type") == "episodic", decay.activation(decay.bootstrap_ages(F.col("access_count"), last, now))).otherwise(0.0)


def recency(now: Column) -> Column:
    s = F.when(F.col("memory_type") == "procedural", F.col("reliability")).otherwise(F.col("stability"))
    return decay.retrievability(s, decay.elapsed_days(F.col("created_at"), now))


def access_score(count: Column, most: Column) -> Column:
    return F.when(most > 0, F.log(count + 1.0) / F.log(most + 1.0)).otherwise(0.0)


def owner() -> Column:
    """The entity that a memory's vector belongs to."""
    return F.when(F.col("memory_type") == "semantic", F.col("subject")).when(F.col("memory_type") == "episodic", F.col("about_entity"))


def rendered() -> Column:
    """What a reranker reads of a memory."""
    fact = F.concat_ws(" ", "subject", "predicate", "object")
    return F.when(F.col("memory_type") == "semantic", fact).when(F.col("memory_type") == "procedural", F.concat(F.lit("trigger: "), "trigger", F.lit(" action: "), "action")).otherwise(F.col("content"))


def candidates(memories: DataFrame, asked: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """vector and lexical hits (qid, id, score, path, rank), each written once.

    Path 1 has the c.candidates best of all memories. Path 0, for queries with a target, has the c.candidates best of those that the target owns: by
    vector those about it, by words its facts, then the turns about or from it.
    """
    kind = F.when(F.col("memory_type") == "semantic", 0).when(F.col("memory_type") == "episodic", 1).otherwise(2).cast("int")
    owners = F.when(F.col("memory_type") == "semantic", F.array("subject")).when(F.col("memory_type") == "episodic", F.array("about_entity", "source_entity")).otherwise(F.array().cast("array<string>"))
    texts = memories.select("id", F.col("content").alias("text"), kind.alias("kind"), F.array_distinct(F.array_compact(owners)).alias("owners"))
    lexical = kept(search.lexical_paths(texts, asked, c.candidates, c.candidates), "lexical")
    rows = memories.where("v IS NOT NULL").select("id", "v", owner().alias("owner"))
    vectors = asked.where("v IS NOT NULL").select("qid", "v", F.col("target").alias("owner"))
    broad = search.vector_top_k(rows, vectors, c.candidates).withColumn("path", F.lit(1))
    scoped = search.vector_top_k(rows, vectors.where("owner IS NOT NULL"), c.candidates, True).withColumn("path", F.lit(0))
    return kept(broad.unionByName(scoped), "vectors"), lexical


def recall(memories: DataFrame, queries: DataFrame, now: Column, config: Config | None = None, edges: DataFrame | None = None, scorer=None) -> DataFrame:
    """The config.limit best memories of each query, with the fused score and the reported signals.

    memories: the unified frame with v (array, may be null). queries: qid, text, v, target (an entity, may be null). edges
    (source, target, edge_type, weight, age_days, invalid_at): what activation spreads over from a query's target. scorer(query, text): a pandas
    UDF that reorders the first config.rerank answers. Candidates are the vector and the lexical hits, config.candidates each; with a target,
    those of the target and a quarter of the best of all. Signals that say nothing are left out; an id that is no candidate keeps its rank and is
    dropped after fusion. Ties by id. Memories' texts are read once, hits and signals are written once.
    """
    c = config or Config()
    asked = kept(queries.select("qid", "text", "v", "target", T.intent(F.col("text")).alias("intent")), "queries")
    vectors, hits = candidates(memories, asked, c)
    target = asked.select("qid", "target")
    most = F.when(F.col("target").isNull(), c.candidates).otherwise(c.candidates // 4)
    within = lambda found: found.join(F.broadcast(target), "qid").where((F.col("path") == 0) | (F.col("rank") <= most))
    vector = within(vectors).groupBy("qid", "id").agg(F.max("score").alias("score"))
    lexical = search.positional(hits.where("path = 1"))
    ids = kept(search.dealt(vector.select("qid", "id").unionByName(within(hits).select("qid", "id")), "qid", "id").distinct(), "candidates")
    rows = ids.join(memories.drop("v"), "id").join(F.broadcast(asked.select("qid", "target", "intent", F.col("text").alias("query"))), "qid")
    signals = rows.select(
        "qid", "id",
        activation_signal(now).alias("activation"),
        T.affinity(F.col("intent"), F.col("memory_type")).alias("intent"),
        confidence_signal().alias("confidence"),
        F.when(F.col("target").isNotNull(), entity_signal(F.col("target"))).alias("entity"),
        recency(now).alias("recency"),
        F.when(F.col("memory_type") == "episodic", F.col("access_count")).otherwise(0).alias("accesses"),
        *([F.col("query"), rendered().alias("text")] if scorer else []),
    )
    signals = kept(signals, "signals")
    long = signals.select("qid", "id", F.expr("stack(4, 'activation', activation, 'intent', intent, 'confidence', confidence, 'entity', entity) AS (signal, score)")).where("score IS NOT NULL")
    rankings = vector.select("qid", "id", F.lit("vector").alias("signal"), "score").unionByName(lexical.select("qid", "id", F.lit("lexical").alias("signal"), "score")).unionByName(long.select("qid", "id", "signal", "score"))
    if edges is not None:
        starts = asked.where("target IS NOT NULL").select(F.col("target").alias("id"), "intent").distinct()
        walked = graph.beam(edges, starts, c.beam, c.depth).withColumnRenamed("start", "target")
        spread = walked.join(F.broadcast(asked.select("qid", "target", "intent")), ["target", "intent"])
        rankings = rankings.unionByName(spread.select("qid", F.col("node").alias("id"), F.lit("spread").alias("signal"), "score"))
    rankings = search.dealt(rankings, "qid", "signal")
    sizes = signals.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("accesses").alias("most"))
    fused = fuse_with(gate(rankings).join(sizes, "qid"), c)
    out = fused.join(signals, ["qid", "id"]).join(sizes.select("qid", "most"), "qid")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= max(c.limit, c.rerank if scorer else 0))
    if scorer:
        out = rerank(out, scorer, c.rerank).withColumn("rank", F.col("new_rank")).drop("new_rank")
    out = out.where(F.col("rank") <= c.limit).join(vector.withColumnRenamed("score", "vector_score"), ["qid", "id"], "left").join(lexical.withColumnRenamed("score", "lexical_score"), ["qid", "id"], "left")
    return out.select(
        "qid", "id", F.col("rank").cast("long"), F.col("score").alias("final_score"), F.coalesce(decay.clamp(F.col("vector_score")), F.lit(0.0)).alias("vector_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"),
        F.col("recency").alias("recency_score"), access_score(F.col("accesses"), F.col("most")).alias("access_score"), F.col("intent").alias("intent_score"), F.col("confidence").alias("confidence_score"), F.coalesce("entity", F.lit(0.0)).alias("entity_score"),
    )


def fuse_with(rankings: DataFrame, c: Config) -> DataFrame:
    """fuse() with k from the number of candidates in n."""
    return fuse(rankings, c.weights, adaptive_k(F.col("n"), c.k))


def linear(signals: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """The older fusion: vector (0 to 1), lexical, graph, intent, recency, access, confidence and a constant 1, weighted."""
    w = weights or LINEAR
    parts = [decay.clamp(F.col("vector")), F.col("lexical"), F.col("graph"), F.col("intent"), F.col("recency"), F.col("access"), F.col("confidence"), F.lit(1.0)]
    total = F.lit(0.0)
    for weight, part in zip(w, parts):
        total = total + weight * part
    return signals.withColumn("score", total)


def rerank(ranked: DataFrame, scorer, head: int = 20) -> DataFrame:
    """Rows (qid, id, rank, text, query, score?): the first `head` of each query by scorer(query, text) (a pandas UDF), which is their new score; the rest as they were."""
    old = F.col("score") if "score" in ranked.columns else F.lit(None).cast("double")
    scored = ranked.withColumn("score", F.when(F.col("rank") <= head, scorer("query", "text")).otherwise(old))
    order = Window.partitionBy("qid").orderBy(F.col("rank") > head, F.when(F.col("rank") <= head, F.col("score")).desc(), F.when(F.col("rank") > head, F.col("rank")), "id")
    return scored.withColumn("new_rank", F.row_number().over(order))


def reinforced(returned: DataFrame, now: Column, difficulty: float = 5.0) -> DataFrame:
    """The update frame of a recall: id, stability, retrievability, access_count, last_accessed of returned episodic rows."""
    r = decay.retrievability(F.col("stability"), decay.elapsed_days(F.coalesce("last_accessed", "created_at"), now))
    return returned.where("memory_type = 'episodic'").dropDuplicates(["id"]).select("id", decay.reinforce(F.col("stability"), F.lit(difficulty), r).alias("stability"), F.lit(1.0).alias("retrievability"), (F.col("access_count") + 1).alias("access_count"), now.alias("last_accessed"))


def learn_weights(feedback: DataFrame, start: list[float], rate: float = 0.01, least: float = 0.01) -> DataFrame:
    """key, weights, samples: feedback (key, seq, signals, relevant) folded in order; after each sample weights sum to 1.

    The fold is sequential for a key; what it holds is the key's weights. A null signal counts as one at the least weight.
    """
    rows = feedback.select("key", "seq", "signals", "relevant")

    def make():
        weights, samples, key = list(start), 0, None

        def step(batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            nonlocal weights, samples, key
            if batch is None:
                return pa.RecordBatch.from_arrays([key, pa.array([weights], pa.list_(pa.float64())), pa.array([samples], pa.int64())], ["key", "weights", "samples"])
            key = batch.column("key").slice(0, 1)
            for signals, relevant in zip(batch.column("signals").to_pylist(), batch.column("relevant").to_pylist()):
                sign = rate if relevant else -rate
                moved = [least if s is None else max(w + sign * s, least) for w, s in zip(weights, signals)]
                total = sum(moved)
                weights = [x / total for x in moved]
                samples += 1
            return None

        return step

    return folds.folded(rows, "key", ["seq"], f"key {dict(rows.dtypes)['key']}, weights array<double>, samples long", make)


def pick_procedure(procedures: DataFrame, by: str, threshold: float) -> DataFrame:
    """The most reliable procedure of each group at or over the threshold; of equals the last by id."""
    return procedures.where(F.col("reliability") >= threshold).groupBy(by).agg(F.max(F.struct("reliability", "id")).alias("best")).select(by, "best.id", "best.reliability")
