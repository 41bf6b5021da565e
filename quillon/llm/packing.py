"""Harmonic packing of documents into sequences of CAPACITY tokens.

A piece of length l has class k = floor(CAPACITY / l): k pieces of its class always fit one bin, and a bin of class k
takes exactly k pieces, so every worker fills the bins of each class by itself, without looking at others. A document
of more than CAPACITY ids is cut into full sequences and a rest; a rest that would waste more than SLACK of its share
of a bin is cut at the next reciprocal CAPACITY // (k + 1), and what is left over is a piece of its own. The bins that
a worker could not fill (less than one a class) are merged in rounds of FAN workers, again by class, and what is left
after the last round (less than one bin a class, so a fixed number of pieces) is packed by first-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillon.llm.common import RUN_BYTES, cut, default_tokenizer, pieces_of, small_batches, table, tokens

CAPACITY = 1024
SLACK = 0.02
#: A cut leaves no piece shorter than this.
SHORTEST = 16
FAN_BITS = 6
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = f"{PIECE}, part long, class int, bin long, offset long"


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK, shortest: int = SHORTEST) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        share = capacity // (capacity // rest)
        if share - rest <= slack * share or rest < 2 * shortest:
            out.append(rest)
            break
        piece = capacity // (capacity // rest + 1)
        if rest - piece < shortest:
            # the left-over would be a crumb: leave it its shortest length
            piece = rest - shortest
        out.append(piece)
        rest -= piece
    return out


class Bins:
    """Open bins of one worker: class -> pieces that wait for their bin's fixed count."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.next = capacity, {}, 0

    def add(self, row: tuple, length: int) -> list[tuple]:
        """The rows of the bin that this piece completes, with class, bin and offset."""
        k = self.capacity // length
        waiting = self.open.setdefault(k, [])
        waiting.append((row, length))
        if len(waiting) < k:
            return []
        self.open[k] = []
        done, at = [], 0
        for r, n in waiting:
            done.append((*r, k, self.next, at))
            at += n
        self.next += 1
        return done

    def rest(self) -> list[tuple]:
        return [(*r, k, None, None) for k, waiting in sorted(self.open.items()) for r, _ in waiting]


def _pack(path: str, end: int, capacity: int, added: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32()] + [pa.int64()] * 2

    def batch_of(rows: list[tuple], part: int) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 8
        columns.insert(5, [part] * len(rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, bins = tokens(path, added), TaskContext.get().partitionId(), Bins(capacity)
        for batch in batches:
            for some in pieces_of(batch, RUN_BYTES):
                offsets, flat = encoder.flat(some.column("text"), end)
                flat, rows = flat.astype("<u4"), []
                for doc, first, after in zip(some.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    start = 0
                    for n in cuts(after - first, capacity):
                        rows += bins.add((doc, start, n, zlib.crc32(flat[first + start : first + start + n]), after - first), n)
                        start += n
                yield batch_of(rows, part)
        yield batch_of(bins.rest(), part)

    return run


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True]).reset_index(drop=True)
        free: list[int] = []
        bins, offsets = [], []
        for n in rows["length"]:
            b = next((i for i, f in enumerate(free) if f >= n), len(free))
            if b == len(free):
                free.append(capacity)
            bins.append(b)
            offsets.append(capacity - free[b])
            free[b] -= n
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=[(15 << 58) + b for b in bins], offset=offsets)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 0, capacity: int = CAPACITY, added: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text).

    A null text counts as empty: one piece with the end id alone. Rows repeated with one doc_id are packed each. An empty
    table gives an empty result. Sequences differ with the input's partitions; the pieces of a document don't.
    """
    small_batches(docs.sparkSession)
    pieces = cut(docs.select("doc_id", "text").mapInArrow(_pack(tokenizer or default_tokenizer(), end, capacity, added), SCHEMA), "packing")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = pieces.where("bin IS NOT NULL").select(*names, F.expr("shiftleft(part, 31) + bin").alias("sequence_id"), "offset")
    rest = pieces.where("bin IS NULL").select(*names, "part", "class")
    most = pieces.agg(F.max("part")).first()[0] or 0
    level = 1
    while True:
        group = F.shiftright("part", FAN_BITS)
        of_class = Window.partitionBy("part", "class")
        ranked = rest.withColumn("part", group).withColumn("__i", F.row_number().over(of_class.orderBy("doc_id", "start", "ids_crc32")) - 1).withColumn("__n", F.count(F.lit(1)).over(of_class))
        ranked = ranked.withColumn("__bin", F.floor(F.col("__i") / F.col("class")).cast("long")).withColumn("__full", F.col("__bin") < F.floor(F.col("__n") / F.col("class")))
        ranked = cut(ranked, "packing")
        within = Window.partitionBy("part", "class", "__bin").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
        done = ranked.where("__full").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
        identity = F.expr(f"shiftleft({level}L, 58) + shiftleft(part, 34) + shiftleft(cast(class as bigint), 20) + __bin")
        filled = filled.unionByName(done.select(*names, identity.alias("sequence_id"), "offset"))
        rest = ranked.where("NOT __full").select(*names, "part", "class")
        most >>= FAN_BITS
        level += 1
        if not most:
            break
    # fewer than one bin's pieces of each class: their number is bounded by the capacity alone
    last = rest.groupBy().applyInPandas(_first_fit(capacity), f"{PIECE}, sequence_id long, offset long")
    return filled.unionByName(last)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
