"""Substring deduplication: passages of WINDOW words that occur before are taken out, behind a count-min prefilter.

1. Every partition hashes all its windows into ROWS rows of 2**WIDTH_BITS saturating counters (none, one, more) and
   emits them sparsely, by chunk; chunks merge across partitions, so counts are only ever overestimated. What is kept of
   a merged chunk is a bit for each counter that reached two: a fixed size at any input, known before (ROWS * 2**WIDTH_BITS / 8 bytes).
2. A second pass takes exactly those windows of which all counters reached two: none that repeats is lost. They are
   grouped exactly, by 96 bits of hash. A partition settles what it can by itself: only a window's smallest document
   there goes on, so a window that a third of all documents have is a few rows a partition. The others are compared
   with the smallest document of all partitions.
3. Positions to remove go back to their documents' whole texts, which are judged as they were.

The more windows there are for each counter, the more single ones pass step 1; the result is the same.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import as_bytes, claim, cut, mix, pieces_of, small_batches, table, window_hashes, word_hashes

WINDOW = 13
WIDTH_BITS = 29
ROWS = 2
CHUNK_BITS = 20
SEEDS = (11, 12)
RUN_BYTES = 4 << 20
#: Windows that a partition holds at once in either pass.
HELD = 4_000_000
#: Bits of the map of documents that lose something.
FILTER_BITS = 27


def _windows(flat: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some documents (their words' hashes and numbers of words): first hash, document (place in the list), position."""
    own = np.maximum(lengths - width + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), own)
    position = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    start = (np.cumsum(lengths) - lengths)[doc] + position
    return window_hashes(flat, width, SEEDS[0])[start] if len(start) else np.zeros(0, np.uint64), doc, position


def cells(windows: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(windows + np.uint64(row * 0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)


def _deltas(places: np.ndarray) -> bytes:
    """Sorted distinct places as gaps, a byte each; 255 adds 255 and goes on."""
    gaps = np.diff(places.astype(np.int64), prepend=-1) - 1
    long = gaps // 255
    out = np.full(len(gaps) + int(long.sum()), 255, np.uint8)
    out[np.cumsum(long + 1) - 1] = gaps % 255
    return out.tobytes()


def _places(deltas: bytes) -> np.ndarray:
    b = np.frombuffer(deltas, np.uint8).astype(np.int64)
    total = np.cumsum(b)
    ends = b != 255
    return total[ends] + np.arange(ends.sum())


def _chunks(row: int, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row's counters of some windows, by chunk: the counters that are not 0 and those over 1."""
    cell = np.sort(cell)
    new = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    more = cell[at[np.diff(np.append(at, len(cell))) > 1]]
    once = cell[at]
    edges = np.unique(once >> CHUNK_BITS)
    bounds = edges.astype(np.int64) << CHUNK_BITS
    size = 1 << CHUNK_BITS
    first, first_more = np.searchsorted(once, bounds), np.searchsorted(more, bounds)
    last, last_more = np.searchsorted(once, bounds + size), np.searchsorted(more, bounds + size)
    rows = [(int(k), _deltas(once[a:b] - low), _deltas(more[c:d] - low)) for k, low, a, b, c, d in zip(edges, bounds, first, last, first_more, last_more)]
    yield pa.RecordBatch.from_arrays([pa.array([row] * len(rows), pa.int32())] + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["row", "chunk", "once", "more"])


def _sketch(width: int, bits: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(rows)], 0
        for batch in batches:
            for part in pieces_of(batch, RUN_BYTES):
                windows, _, _ = _windows(*word_hashes(part.column("text")), width)
                for row in range(rows):
                    held[row].append(cells(windows, row, bits).astype(np.uint32))
                size += len(windows)
            if size >= HELD:
                for row in range(rows):
                    yield from _chunks(row, np.concatenate(held[row]))
                held, size = [[] for _ in range(rows)], 0
        for row in range(rows if size else 0):
            yield from _chunks(row, np.concatenate(held[row]))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, chunk): a zlib-packed bit for each counter that reached two."""
    size = 1 << (CHUNK_BITS - 3)
    key, once, more = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([zlib.compress(more.tobytes(), 1)], pa.binary())], ["row", "chunk", "repeated"])

    for batch in batches:
        for row, chunk, o, m in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk", "once", "more"))):
            if (row, chunk) != key:
                if key and more.any():
                    yield done()
                key, once, more = (row, chunk), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            bits = np.zeros(size * 8, np.uint8)
            bits[_places(o)] = 1
            own = np.packbits(bits, bitorder="little")
            more |= once & own
            once |= own
            bits[:] = 0
            bits[_places(m)] = 1
            more |= np.packbits(bits, bitorder="little")
    if key and more.any():
        yield done()


_bits: dict[str, list[np.ndarray]] = {}


def _repeated(shared, key: str, bits: int, rows: int) -> list[np.ndarray]:
    """The merged rows in this worker, unpacked once."""
    claim("passages", _bits)
    if key not in _bits:
        _bits.clear()
        size = 1 << (CHUNK_BITS - 3)
        out = [np.zeros(max(1 << (bits - 3), size), np.uint8) for _ in range(rows)]
        for row, chunk, packed in shared.value:
            out[row][chunk * size : (chunk + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        _bits[key] = out
    return _bits[key]


def _candidates(shared, key: str, width: int, bits: int, rows: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, null, place = (np.concatenate(x) for x in zip(*held))
        later = _after_first(h1, h2, doc, null)
        if later.any():
            yield from _gathered(doc[later], null[later], place[later], names)
        go = ~later
        n = int(go.sum())
        yield pa.RecordBatch.from_arrays([pa.array(h1[go]), pa.array(h2[go]), pa.array(doc[go], mask=null[go]), pa.array(place[go]), pa.nulls(n, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, held, size = _repeated(shared, key, bits, rows), [], 0
        for batch in batches:
            for part in pieces_of(batch, RUN_BYTES):
                flat, lengths = word_hashes(part.column("text"))
                windows, doc, position = _windows(flat, lengths, width)
                at = np.arange(len(windows))
                for row in range(rows):
                    cell = cells(windows[at], row, bits)
                    at = at[(merged[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1) > 0]
                if not len(at):
                    continue
                ids = part.column("doc_id").cast(pa.int64())
                null = ids.is_null().to_numpy(zero_copy_only=False)
                which = doc[at]
                found = np.flatnonzero(np.bincount(which, minlength=part.num_rows))
                tags = np.zeros(part.num_rows, np.int64)
                tags[found] = [_tag(t) for t in as_bytes(part.column("text").take(pa.array(found)))]
                start = (np.cumsum(lengths) - lengths)[which] + position[at]
                second = _second(flat, start, width)
                held.append((windows[at].view(np.int64), (second & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), ids.fill_null(0).to_numpy(zero_copy_only=False)[which], null[which], tags[which] << 32 | position[at]))
                size += len(at)
                if size >= HELD // 4:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _second(flat: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A second, independent hash of the windows at `start`."""
    factors = np.random.default_rng(SEEDS[1]).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        total += mix(flat[start + k]) * factors[k]
    return mix(total)


def _tag(text: bytes) -> int:
    """Tells rows with one doc_id apart."""
    return zlib.crc32(text) & 0x7FFFFFFF


FOUND = "h1 long, h2 int, doc_id long, place long, places binary"


def _after_first(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Which rows are surely in another document than the smallest one (null before all) with the same window."""
    key = np.where(null, np.iinfo(np.int64).min, doc)
    order = np.lexsort((key, h1))
    a, b, d, z = h1[order], h2[order], doc[order], null[order]
    # windows that share the first hash alone may part a run: its rows then go on and are settled later
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.zeros(len(a), bool)
    out[order] = (d != d[head]) | (z != z[head])
    return out


def _gathered(doc: np.ndarray, null: np.ndarray, place: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Places by document, packed; spread by a hash of the document."""
    order = np.lexsort((doc, null))
    doc, null, place = doc[order], null[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])]))
    offsets = (np.append(first, len(doc)) * 8).astype(np.int32)
    n = len(first)
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(place.tobytes())])
    ids = pa.array(doc[first], mask=null[first])
    columns = {"h1": pa.array(mix(doc[first].view(np.uint64)).view(np.int64)), "h2": pa.array(np.zeros(n, np.int32)), "doc_id": ids, "place": pa.nulls(n, pa.int64()), "places": packed}
    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h1, h2, doc_id) nulls first: places in documents that aren't the first of their window's run."""
    claim("later")
    last = None  # (h1, h2) and the first document of the run in progress
    names = ["doc_id", "place", "places"]
    for batch in batches:
        settled = batch.column("places").is_valid()
        if pc.any(settled).as_py():
            own = batch.filter(settled)
            yield pa.RecordBatch.from_arrays([own.column(c) for c in names], names)
            batch = batch.filter(batch.column("places").is_null())
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = np.asarray(batch.column("h1")), np.asarray(batch.column("h2"))
        ids = batch.column("doc_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        doc, place = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(batch.column("place"))
        new = np.concatenate([[last is None or last[:2] != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_doc, first_null = doc[np.maximum(head, 0)], null[np.maximum(head, 0)]
        if not new[0]:
            first_doc, first_null = np.where(head < 0, last[2], first_doc), np.where(head < 0, last[3], first_null)
        gone = (doc != first_doc) | (null != first_null)
        last = (h1[-1], h2[-1], first_doc[-1], first_null[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[gone], mask=null[gone]), pa.array(place[gone]), pa.nulls(int(gone.sum()), pa.binary())], names)


def _strip(width: int, digest: bool):
    """Rows with text, gone (array of places), gone_packed (array of binary): text without covered words, or its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, RUN_BYTES):
                out = []
                lists = part.column("gone")
                for i, (text, packed) in enumerate(zip(as_bytes(part.column("text")), part.column("gone_packed").to_pylist())):
                    words = text.split()
                    n = len(words)
                    if packed or lists[i].is_valid and len(lists[i]):
                        place = np.concatenate([np.asarray(lists[i].values), np.frombuffer(b"".join(packed or []), np.int64)])
                        start = place[place >> 32 == _tag(text)] & 0xFFFFFFFF
                        edge = np.zeros(n + 1, np.int64)
                        # a tag has 31 bits: what another text of this doc_id left by chance must not reach beyond this one
                        start = np.unique(start[start + width <= n])
                        edge[start] += 1
                        edge[start + width] -= 1
                        cover = np.cumsum(edge[:-1]) > 0
                        words = [w for w, c in zip(words, cover) if not c]
                    out.append((n, n - len(words), b" ".join(words)))
                kept = pa.array([hashlib.sha256(k).hexdigest() if digest else k.decode() for _, _, k in out], pa.string())
                columns = [part.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), kept]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return run


def removed_places(docs: DataFrame, width: int = WINDOW, bits: int = WIDTH_BITS, rows: int = ROWS) -> DataFrame:
    """doc_id, gone, gone_packed: where windows start that occur in a document with a smaller doc_id, as _strip reads them."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    sketches = texts.mapInArrow(_sketch(width, bits, rows), "row int, chunk int, once binary, more binary")
    merged = cut(sketches.repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(_merge, "row int, chunk int, repeated binary"), "sketch")
    # of fixed size: a bit for each counter
    shared = docs.sparkSession.sparkContext.broadcast([(r.row, r.chunk, bytes(r.repeated)) for r in merged.toLocalIterator()])
    found = texts.mapInArrow(_candidates(shared, uuid.uuid4().hex, width, bits, rows), FOUND)
    places = found.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(_later, "doc_id long, place long, places binary")
    return places.groupBy("doc_id").agg(F.collect_list("place").alias("gone"), F.collect_list("places").alias("gone_packed"))


def _joined(docs: DataFrame, width: int, bits: int, rows: int) -> DataFrame:
    """doc_id, text, gone, gone_packed. Only texts of documents that may lose something are exchanged: a bitmap of fixed size
    (2**FILTER_BITS bits, by hash of doc_id) tells the others, which stay in their partitions."""
    gone = cut(removed_places(docs, width, bits, rows).withColumnRenamed("doc_id", "__gone_id"), "places")
    cell = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("long"), F.lit(-1))), F.lit(1 << FILTER_BITS)) + 1
    maps = gone.select(cell("__gone_id").alias("__cell")).groupBy(F.bitmap_bucket_number("__cell").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__cell")).alias("__bits"))
    held = docs.select("doc_id", "text", cell("doc_id").alias("__cell")).withColumn("__bucket", F.bitmap_bucket_number("__cell"))
    held = held.withColumn("__at", F.bitmap_bit_position("__cell")).join(F.broadcast(cut(maps, "places")), "__bucket", "left")
    maybe = F.expr("coalesce(cast(conv(hex(substring(__bits, cast(shiftright(__at, 3) as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(__at & 7 as int)), 0) <> 0")
    texts = held.select("doc_id", "text", maybe.alias("__maybe"))
    some = texts.where("__maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")), "left").select("doc_id", "text", "gone", "gone_packed")
    none = [F.lit(None).cast(gone.schema[c].dataType).alias(c) for c in ("gone", "gone_packed")]
    return texts.where("NOT __maybe").select("doc_id", "text", *none).unionByName(some)


def strip_repeats(docs: DataFrame, width: int = WINDOW, bits: int = WIDTH_BITS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is kept, words joined by one space) of docs (doc_id, text; others unused).

    A null text has no words. A null doc_id is the smallest. Rows with one doc_id don't count as earlier for each other; each
    keeps its own places. Texts shorter than a window lose nothing. An empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, n_removed long, text string"
    return _joined(docs, width, bits, rows).mapInArrow(_strip(width, False), schema.replace("text", "kept")).withColumnRenamed("kept", "text")


def op8_strip_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _joined(table(spark, sf_dir, "documents"), WINDOW, WIDTH_BITS, ROWS)
    return joined.mapInArrow(_strip(WINDOW, True), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")
