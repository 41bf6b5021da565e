"""Token-id files: Parquet with a list column of ids, controlled row groups, pages and encodings, read back selectively.

File format (written by Spark's Parquet writer, so by every executor and restartable task by task):
`ids` array<int> dictionary-encoded, `doc_id`, `shard`, `shard_start`, `n_tokens` delta-encoded, zstd, row groups of
ROW_GROUP bytes, pages of PAGE bytes with a page index. Files hold documents in ascending doc_id order: shards are
ranges of doc_id and a shard's rows are sorted. A reader of metadata alone never touches the ids' pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillon.llm.common import RUN_BYTES, default_tokenizer, pieces_of, shared_path, small_batches, table, tokens

END = 0
ROW_GROUP = 32 << 20
PAGE = 256 << 10
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def _encode(path: str, end: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = tokens(path, added), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces_of(batch, RUN_BYTES):
                offsets, flat = encoder.flat(part.column("text"), end)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(np.full(len(n), shard, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    ],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, added: bool = True) -> None:
    """Writes the ids of every whole text (doc_id, text; other columns are not used), each followed by `end`, to `path`.

    A null text counts as empty, so its document is the end id alone. Null doc_ids come first; rows repeated with one doc_id
    follow each other by text. An empty table writes files without rows. Texts move once, before they are encoded.
    """
    small_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer or default_tokenizer(), end, added), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#shard_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, shard_start, n_tokens, ids of the files; select what is needed and only that is read."""
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """shard, base: ids in all shards before. The window without a key runs over one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.groupBy("shard").agg(F.sum("n_tokens").alias("__n")).select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("base"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "shard", "shard_start")]
            + [pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())],
            ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
        )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    files = read_tokens(spark, path)
    rows = files.select("doc_id", "shard", "shard_start", "ids").mapInArrow(_crc, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(files), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
