"""Streaming forms of capture and extraction: session caps as state, an extraction queue, consolidation on what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions import text as T

#: Memories that a session may store by itself and candidates that it may put up for review; fixed values.
CAPS = {1: 10, 2: 5}


def capture(signals: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    """session, id, tier, fact of a stream (session, id, kind, content) of signals that say something, within each session's caps."""
    most = caps or CAPS
    tier, _, confidence = T.capture(F.col("content"), F.col("kind"))
    rows = signals.select("session", "id", tier.alias("tier"), T.sanitise(F.col("content")).alias("fact"), confidence.alias("confidence")).where("tier IS NOT NULL")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = dict(zip((1, 2), state.get)) if state.exists else {1: 0, 2: 0}
        out = []
        for row in pd.concat(list(batches)).sort_values("id").itertuples():
            if taken[row.tier] < most[row.tier]:
                taken[row.tier] += 1
                out.append((key[0], row.id, row.tier, row.fact))
        state.update((taken[1], taken[2]))
        yield pd.DataFrame(out, columns=["session", "id", "tier", "fact"])

    return rows.groupBy("session").applyInPandasWithState(step, "session string, id long, tier int, fact string", "auto int, review int", "append", GroupStateTimeout.NoTimeout)


def extraction_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: facts of the queued texts (id, text), under the batch's id, so that a repeated batch counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.select("id", F.explode(T.sentences(F.col("text"))).alias("s"))
        a, b, c = T.heuristic_fact(F.col("s"))
        s.select("id", a.alias("subject"), b.alias("predicate"), c.alias("object")).where("predicate IS NOT NULL").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def consolidation_sink(memory, now) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream of ended episodes: one consolidation for a batch that has any. Use with availableNow or a long interval."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            memory.consolidate(now)

    return run
