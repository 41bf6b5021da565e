"""Vector top-k, lexical ranking and candidate merging, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillon.sources.scratch import kept

#: Queries that one block broadcasts; the block's size in bytes is BLOCK times the vector's, whatever the table's size.
BLOCK = 4096
#: Scores are compared to so many decimals: equal sums in another order then tie, and ids decide.
DIGITS = 9
#: Word pattern of the lexical index.
TOKEN = r"[\p{L}\p{N}]+"


#: Queries that meet a batch of rows in one matrix product.
TILE = 256


def _rows_by_length(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> places of the rows with it, and their vectors as a matrix."""
    column = batch.column("v")
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    lengths = np.diff(offsets)
    return {int(n): (at := np.flatnonzero(lengths == n), flat[offsets[at][:, None] + np.arange(n)]) for n in np.unique(lengths) if n}


def _tiles(queries: list[np.ndarray]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Vector length -> places of up to TILE queries with it, and their vectors as columns."""
    out: dict[int, list] = {}
    for n in {len(q) for q in queries}:
        at = np.array([i for i, q in enumerate(queries) if len(q) == n])
        out[n] = [(at[i : i + TILE], np.stack([queries[j] for j in at[i : i + TILE]], 1)) for i in range(0, len(at), TILE)]
    return out


def _products(batches: Iterator[pa.RecordBatch], queries: list[np.ndarray]) -> Iterator[tuple]:
    """(batch, places of rows, places of queries, rounded scores of all of these)."""
    tiles = _tiles(queries)
    for batch in batches:
        for n, (at, rows) in _rows_by_length(batch).items():
            for which, columns in tiles.get(n, ()):
                yield batch, at, which, np.round(rows @ columns, DIGITS)


def _block_over(block, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, _ = block.value
        for batch, at, which, scores in _products(batches, queries):
            row, query = np.nonzero(scores > least)
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.string()).take(pa.array(which[query])), batch.column("id").take(pa.array(at[row])), pa.array(scores[row, query])], ["qid", "id", "score"])

    return run


class _Best:
    """The k best (score, id) of each query so far; ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        held, k = self.held[query], self.k
        least = -held[-1][0] if len(held) == k else -np.inf
        near = np.flatnonzero(scores >= least)
        if len(near) > k:
            # ties with the k-th stay until the ids decide
            near = near[scores[near] >= np.partition(scores[near], -k)[-k]]
        near = near[np.isfinite(scores[near])]
        if len(near):
            found = ids.take(pa.array(at[near])).to_pylist()
            self.held[query] = sorted(held + list(zip((-scores[near]).tolist(), found)))[:k]


def _block_top(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, owners = block.value
        best = _Best(len(qids), k)
        asked = pa.array(owners, pa.string())
        for batch, at, which, scores in _products(batches, queries):
            if asked.null_count < len(asked):
                names = pa.concat_arrays([batch.column("owner").cast(pa.string()).take(pa.array(at)), asked.take(pa.array(which))]).dictionary_encode().indices.fill_null(-1)
                code = names.to_numpy(zero_copy_only=False)
                row, wanted = code[: len(at), None], code[len(at) :]
                scores[(wanted >= 0) & (row != wanted)] = -np.inf
            for j, q in enumerate(which):
                best.add(q, scores[:, j], batch.column("id"), at)
        out = [(q, i, -s) for q, own in zip(qids, best.held) for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], ["qid", "id", "score"])

    return run


def vector_over(memories: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """qid, id, score of all rows of memories (id, v, owner) whose cosine with a query (qid, v, owner) is over `least`."""
    return _in_blocks(memories, queries, lambda block: _block_over(block, least), False)


def vector_top_k(memories: DataFrame, queries: DataFrame, k: int, scoped: bool = False) -> DataFrame:
    """qid, id, score, rank: the k rows of memories (id, v, owner) nearest to each query (qid, v, owner) by cosine.

    Zero queries and zero rows have no answers; rows of other lengths than the query's are left out. With scoped, only rows
    of the query's owner count. Ties by id. Queries go out in blocks of a fixed number; each partition keeps k a query.
    """
    return top_k(_in_blocks(memories, queries, lambda block: _block_top(block, k), scoped), k)


def _in_blocks(memories: DataFrame, queries: DataFrame, job, scoped: bool) -> DataFrame:
    unit = lambda df: df.withColumn("v", F.col("v").cast("array<double>")).withColumn("__n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("__n > 0").withColumn("v", F.transform("v", lambda x: x / F.col("__n"))).drop("__n")
    rows = unit(memories.select("id", "v", "owner"))
    found, held = None, []

    def block(part: list) -> DataFrame:
        shared = memories.sparkSession.sparkContext.broadcast(([q.qid for q in part], [np.array(q.v) for q in part], [q.owner if scoped else None for q in part]))
        return rows.mapInArrow(job(shared), "qid string, id string, score double")

    for q in unit(queries.select("qid", "v", "owner")).toLocalIterator():
        held.append(q)
        if len(held) == BLOCK:
            found, held = block(held) if found is None else found.unionByName(block(held)), []
    if held or found is None:
        found = block(held) if found is None else found.unionByName(block(held))
    return found


def top_k(scores: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best rows of each query by score, then id; with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealt(union: DataFrame, *by: str) -> DataFrame:
    """A union dealt out anew by keys.

    Spark 4.1 takes the union of frames with one partitioning for partitioned itself, although adaptive execution may have
    coalesced them differently; a join on top of it then fails. An exchange of its own makes the partitioning real.
    """
    return union.repartition(*by)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


HITS = "id string, kind int, owners array<string>, length int, terms array<int>, counts array<int>"


def _hits(block):
    """Of texts: how often each has the words that queries ask for, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(block.value, pa.string())
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                lists = pc.split_pattern_regex(pc.utf8_lower(batch.column("text").cast(pa.string()).fill_null("")), r"[^\p{L}\p{N}]+")
                words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
                real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                coded = words.dictionary_encode()
                term = pc.index_in(coded.dictionary, value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False)[np.asarray(coded.indices)]
                length = np.bincount(row[real], minlength=batch.num_rows)
                found = real & (term >= 0)
                key, counts = np.unique(row[found] * np.int64(len(asked) or 1) + term[found], return_counts=True)
                owner = key // (len(asked) or 1)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, pa.array((key % (len(asked) or 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("kind"), batch.column("owners"), pa.array(length.astype(np.int32)), terms, pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))],
                    ["id", "kind", "owners", "length", "terms", "counts"],
                )

    return run


def _scored(block):
    """(rows of a batch, queries, scores, numbers of the queries' words found, places of the rows) of hits, some rows at a time."""
    qids, term_of, query_of, weights, mean, k1, b = block
    first = np.searchsorted(term_of, np.arange(len(weights) + 1))

    def run(batch: pa.RecordBatch):
        step = max(1, 2_000_000 // max(1, len(qids)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            lists, tf = part.column("terms"), np.asarray(part.column("counts").flatten()).astype(float)
            term = np.asarray(lists.flatten())
            if not len(term):
                continue
            row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
            length = np.asarray(part.column("length")).astype(float)[row]
            score = weights[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            n = first[term + 1] - first[term]
            at = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(row, n) * np.int64(len(qids)) + query_of[at]
            total = np.bincount(cell, np.repeat(score, n), part.num_rows * len(qids)).reshape(part.num_rows, -1)
            yield part, np.round(total, DIGITS), np.bincount(cell, minlength=part.num_rows * len(qids)).reshape(part.num_rows, -1)

    return run


def _lexical_top(shared, k: int, scoped: int):
    """Rows (qid, id, kind, score, path): path 0 the best of the query's target, path 1 the best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, targets = shared.value
        qids = block[0]
        best, own = _Best(len(qids), k), {}
        score = _scored(block)
        asked: dict[str, list[int]] = {}
        for q, t in enumerate(targets):
            if t is not None and scoped:
                asked.setdefault(t, []).append(q)
        for batch in batches:
            for part, total, found in score(batch):
                at = np.arange(part.num_rows)
                total[found == 0] = -np.inf
                for q in np.flatnonzero(found.any(0)):
                    best.add(q, total[:, q], part.column("id"), at)
                owners, kinds = part.column("owners").to_pylist() if asked else [], part.column("kind")
                for i, names in enumerate(owners):
                    for q in {q for o in names or () for q in asked.get(o, ())}:
                        if found[i, q]:
                            own.setdefault((q, kinds[i].as_py()), _Best(1, scoped)).add(0, total[i : i + 1, q], part.column("id"), np.array([i]))
        out = [(qids[q], i, None, -s, 1) for q, held in enumerate(best.held) for s, i in held]
        out += [(qids[q], i, kind, -s, 0) for (q, kind), b in own.items() for s, i in b.held[0]]
        names = ["qid", "id", "kind", "score", "path"]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32()))], names)

    return run


def _with_all(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words = shared.value
        score = _scored(block)
        for batch in batches:
            for part, _, found in score(batch):
                row, q = np.nonzero(found == words)
                yield pa.RecordBatch.from_arrays([pa.array(block[0], pa.string()).take(pa.array(q)), part.column("id").take(pa.array(row))], ["qid", "id"])

    return run


def _lexical_blocks(docs: DataFrame, queries: DataFrame, weigh: bool, k1: float = 1.2, b: float = 0.75):
    """For each block of queries: what _scored needs, the queries' targets and numbers of words, and the hits, written once.

    Texts are read once a block of BLOCK queries; what comes after reads the hits, which have only words that are asked for. Document
    frequencies, one for each such word, come to the driver.
    """
    spark = docs.sparkSession
    asked = queries.select("qid", F.array_distinct(tokens(F.col("text"))).alias("words"), F.col("target") if "target" in queries.columns else F.lit(None).cast("string").alias("target"))
    extra = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("owners", "array<string>"))]
    texts = docs.select("id", "text", *extra)
    held: list = []

    def block(part: list):
        words = sorted({w for q in part for w in q["words"] or ()})
        number = {w: i for i, w in enumerate(words)}
        pairs = sorted((number[w], q) for q, r in enumerate(part) for w in r["words"] or ())
        hits = kept(texts.mapInArrow(_hits(spark.sparkContext.broadcast(words)), HITS), "hits")
        weights, mean = np.ones(len(words)), 1.0
        if weigh:
            sizes = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
            mean = sizes["mean"] or 1.0
            df = np.zeros(len(words))
            for r in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
                df[r.t] = r["count"]
            weights = np.log(1 + (sizes["n"] - df + 0.5) / (df + 0.5))
        term, query = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        return ([r.qid for r in part], term, query, weights, mean, k1, b), [r.target for r in part], np.array([len(r["words"] or ()) or -1 for r in part]), hits

    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _united(frames: list[DataFrame], docs: DataFrame, schema: str) -> DataFrame:
    if not frames:
        return docs.sparkSession.createDataFrame([], schema)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def match_all(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id of docs (id, text) that have every word of the query (qid, text); a query without a word has no answer."""
    share = docs.sparkSession.sparkContext.broadcast
    schema = "qid string, id string"
    return _united([hits.mapInArrow(_with_all(share((block, words))), schema) for block, _, words, hits in _lexical_blocks(docs, queries, False)], docs, schema)


def lexical_paths(docs: DataFrame, queries: DataFrame, k: int, scoped: int = 0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, score, path, rank of docs (id, text, kind?, owners?) for queries (qid, text, target?) by BM25.

    path 1: the k best that share a word with the query, by score, then id. path 0, where the query has a target and scoped is asked for: the
    `scoped` best of those that the target owns, by kind, then score, then id. Whole texts are scored where they are: a partition sends
    only its best, so no word's postings are exchanged.
    """
    share = docs.sparkSession.sparkContext.broadcast
    schema = "qid string, id string, kind int, score double, path int"
    found = _united([hits.mapInArrow(_lexical_top(share((block, targets)), k, scoped), schema) for block, targets, _, hits in _lexical_blocks(docs, queries, True, k1, b)], docs, schema)
    w = Window.partitionBy("qid", "path").orderBy("kind", F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(F.col("path") == 0, scoped).otherwise(k)).select("qid", "id", "score", "path", "rank")


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, score, rank: the k docs (id, text) best by BM25 for each query (qid, text)."""
    return lexical_paths(docs, queries, k, 0, k1, b).select("qid", "id", "score", "rank")


def positional(ranked: DataFrame) -> DataFrame:
    """qid, id, score: (n - position) / n of rows (qid, id, rank from 1), 1 for the only one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return ranked.withColumn("score", (n - F.col("rank") + 1) / n).select("qid", "id", "score")


def merge_candidates(*paths: DataFrame) -> DataFrame:
    """qid, id, score of frames (qid, id, score) in order of priority: the first frame that has an id gives its score."""
    out = None
    for i, p in enumerate(paths):
        part = p.select("qid", "id", "score", F.lit(i).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "id").agg(F.min(F.struct("path", "score")).alias("best")).select("qid", "id", "best.score", "best.path")
