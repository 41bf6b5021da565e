"""Exact deduplication: tree-merge of sorted digest runs, with DataFrame functions only.

Every input partition is a run of digests. Each run is sorted by digest and neighbouring equal digests become one entry
(a sort aggregation: the entry's best identifier is a struct, which Spark merges in sorted order, not in a hash
table). Then, round by round, 2**FAN_BITS neighbouring runs are exchanged and merged into one the same way, until one
run is left: the depth is the logarithm of the number of runs. The exchange is keyed by (run group, digest), so one
merge of runs is spread over the cluster by digest, and a text that makes up a third of all rows sends one entry a run
and round. An entry's key is the SHA-256 digest with two checks, the byte length and an independent 64-bit hash, so every level
retains identifiers only of rows whose checks agree too; the texts themselves are not compared.

Digests are written; what comes after reads the written rows (the filter that keeps whole rows computes them again). Groups with more than a HOT-th of all rows, of
which there are HOT at most, are broadcast to the rows; only the others' rows are exchanged to meet their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm.common import cut, table

#: Runs that one merge takes, as a power of two.
FAN_BITS = 4
#: A group with more than this share of all rows is broadcast; so there are at most that many.
HOT = 1000
KEY = ["digest", "bytes", "second"]


def _digests(text: Column) -> list[Column]:
    """The verified key of a whole text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.sha2(whole.cast("binary"), 256).alias("digest"), F.octet_length(whole).cast("long").alias("bytes"), F.xxhash64(whole).alias("second")]


def _merge(runs: DataFrame, run: Column) -> DataFrame:
    return runs.groupBy(run.alias("run"), *KEY).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def merged_runs(keyed: DataFrame) -> DataFrame:
    """KEY, best (the struct of the largest doc_id, tie and row) and group_size; keyed: run, KEY, doc_id, tie, row, as written."""
    most = keyed.agg(F.max("run")).first()[0] or 0
    runs = _merge(keyed.select("run", *KEY, F.struct("doc_id", "tie", "row").alias("best"), F.lit(1).cast("long").alias("group_size")), F.col("run"))
    while most:
        most >>= FAN_BITS
        runs = _merge(runs, F.shiftright("run", FAN_BITS))
    return runs.select(*KEY, "best", "group_size")


def _numbered(tie: Column) -> list[Column]:
    return [tie.alias("tie"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run")]


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text; other columns are not used).

    Equal: the same code points; null equals empty. The largest doc_id of a group stays; a null doc_id is the smallest.
    Of rows repeated with the same doc_id and text exactly one is kept. An empty table gives an empty result.
    """
    keyed = cut(docs.select("doc_id", *_digests(F.col("text")), *_numbered(F.lit(0))), "digests")
    groups = cut(merged_runs(keyed).select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "digests")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * HOT > total
    hot = F.broadcast(groups.where(large))  # HOT rows at most
    rows = keyed.select("doc_id", "row", *KEY)
    named = rows.join(hot, KEY).unionByName(rows.join(hot.select(*KEY), KEY, "left_anti").join(groups.where(~large), KEY))
    return named.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, any others) that stay, with all their columns, whatever these are called.

    Null text equals empty. Of equal texts the row with the largest doc_id stays (null is the smallest); of rows with that
    doc_id the one whose columns have the greatest hash, so that reruns over rows in another order keep an equal row. An
    empty table gives an empty result.
    """
    columns = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc, text = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    tie = F.xxhash64(*[F.to_json(F.struct(f"c{i}")) if "map<" in t else F.col(f"c{i}") for i, (_, t) in enumerate(held.dtypes)])
    keyed = cut(held.select(doc.alias("doc_id"), *_digests(text), *_numbered(tie)), "digests")
    name = ["doc_id", *KEY, "tie"]
    stay = merged_runs(keyed).select(F.col("best.doc_id").alias("s_doc"), F.col("best.tie").alias("s_tie"), *[F.col(c).alias(f"s_{c}") for c in KEY])
    # a group's rows differ in doc_id or tie, so a large group is spread; the texts are hashed again rather than written once more
    marked = held.select("*", doc.alias("doc_id"), *_digests(text), tie.alias("tie"))
    same = F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("tie") == F.col("s_tie"))
    for c in KEY:
        same = same & (F.col(c) == F.col(f"s_{c}"))
    kept = marked.join(stay, same, "left_semi")
    if not keyed.groupBy(*name).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(name)  # rows equal in all columns: one is kept
    return kept.select(*[F.col(f"c{i}") for i in range(len(columns))]).toDF(*columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
