"""Chat formatting by columnar byte assembly, and the way back.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` a turn. In roles and texts `\\` is written `\\\\` and `<|` is written
`<\\|`, in roles a newline `\\n`, so no control string can occur inside them and every turn can be read back exactly.

Turns are range-partitioned by (conv_id, turn), so a conversation of any length spreads over tasks. A task assembles a
batch of turns at once: segment lengths give cumulative offsets, offsets give scatter indices, and headers, escaped
texts and footers are copied into one preallocated Arrow buffer whose slices are the rows. A conversation is one row,
or several (ordered by seq) where a batch or range ends inside it. The loss mask is a list of byte spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import pieces_of, small_batches, table

START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
SCHEMA = "conv_id long, seq long, n_turns int, formatted string, loss array<struct<first:int,end:int>>"
#: Bytes that are scattered at once.
RUN_BYTES = 1 << 20
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(column: pa.Array, newlines: bool = False) -> pa.Array:
    out = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")
    return pc.replace_substring(out, "\n", "\\n") if newlines else out


def unescape(text: bytes, newlines: bool = False) -> bytes:
    if b"\\" not in text:
        return text
    return re.sub(rb"\\(.)", lambda m: b"\n" if newlines and m[1] == b"n" else m[1], text, flags=re.S)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _scatter(buffer: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copies string i (offsets, data) to buffer[at[i]:], in runs of RUN_BYTES, as an index takes far more room than its byte."""
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1)
        a, b = offsets[i], offsets[j]
        if j == i + 1:
            buffer[at[i] : at[i] + b - a] = data[a:b]
        else:
            buffer[np.arange(a, b) + np.repeat(at[i:j] - offsets[i:j], np.diff(offsets[i : j + 1]))] = data[a:b]
        i = j


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; each turn's first byte (and the end), its text's first byte and end."""
    role_at, role_data = _utf8(escape(roles, newlines=True))
    text_at, text_data = _utf8(escape(texts))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    lengths = len(START) + role_n + 1 + text_n + len(END)
    turn = np.concatenate([[0], np.cumsum(lengths)])
    if turn[-1] >= 1 << 31:
        raise ValueError("a turn of 2 GiB or more when formatted")  # runs are of 16 MB, so this is one text
    buffer = np.empty(turn[-1], np.uint8)
    n = turn[:-1]
    buffer[n[:, None] + np.arange(len(START))] = np.frombuffer(START, np.uint8)
    _scatter(buffer, n + len(START), role_at, role_data)
    first = n + len(START) + role_n + 1
    buffer[first - 1] = 10
    _scatter(buffer, first, text_at, text_data)
    end = first + text_n
    buffer[end[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    return buffer, turn, first, end


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seq = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in pieces_of(batch):
            if not part.num_rows:
                continue
            roles = pc.fill_null(part.column("role"), "")
            buffer, turn, first, end = assemble(roles, pc.fill_null(part.column("text"), ""))
            ids = part.column("conv_id").cast(pa.int64())
            values, missing = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(values) != 0) | (np.diff(missing.astype(np.int8)) != 0)) + 1
            heads = np.concatenate([[0], new])
            bounds = np.concatenate([heads, [part.num_rows]])
            loss = np.flatnonzero(pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False))
            base = turn[heads][np.searchsorted(heads, loss, "right") - 1]
            spans = pa.StructArray.from_arrays([pa.array((first[loss] - base).astype(np.int32)), pa.array((end[loss] - base).astype(np.int32))], ["first", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(heads)),
                    pa.array(seq + np.arange(len(heads))),
                    pa.array(np.diff(bounds).astype(np.int32)),
                    pa.Array.from_buffers(pa.string(), len(heads), [None, pa.py_buffer(turn[bounds].astype(np.int32)), pa.py_buffer(buffer)]),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, bounds).astype(np.int32)), spans),
                ],
                ["conv_id", "seq", "n_turns", "formatted", "loss"],
            )
            seq += len(heads)


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, seq, n_turns, formatted, loss of conversations (conv_id, turn, role, text; other columns are not used).

    Turns are ordered by turn, rows with one turn by role and text; nulls first. Null role or text is empty. Rows without a
    conv_id are one conversation. loss has the byte spans in formatted of the texts of turns whose role is assistant.
    An empty table gives an empty result.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order).mapInArrow(_format, SCHEMA)


def turns_of(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition(b"\n")
        out.append((unescape(role, newlines=True), unescape(text[: -len(END)])))
    return out


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, spans: list[dict]) -> None:
        self.chars += len(formatted.decode())
        for role, text in turns_of(formatted):
            self.turns += 1
            for x in (role, b"\n", text, b"\n"):
                self.all.update(x)
        for s in spans:
            text = unescape(formatted[s["first"] : s["end"]])
            self.loss += len(text.decode())
            self.masked.update(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    one: _Digest | None = None
    for batch in batches:
        done = []
        for conv_id, formatted, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").cast(pa.binary()), batch.column("loss").to_pylist()):
            if one is None or one.conv_id != conv_id:
                if one:
                    done.append(one.row())
                one = _Digest(conv_id)
            one.add(formatted.as_py(), loss)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names)
    if one:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(one.row(), kinds)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What format_chat's output says when it is read back, one row a conversation; its parts stream through a hash."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_digests, schema)


def op2_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT conv_id, turn, role, text FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_chat(rows))
