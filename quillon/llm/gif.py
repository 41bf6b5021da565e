"""GIF media columns: LZW code streams, palettes, disposal, transparency, interlacing; timed frames with histograms.

Decoding is vectorised. The width of a code depends only on its place after the last clear code, so codes are cut out of
the bit stream many at a time. A code's string is the string of an earlier code and one more byte, so lengths come from
pointer doubling over codes and bytes from pointer doubling over the output, a few vector steps for a stream.

`store` keeps any bytes losslessly as 8-bit samples, 64 a row, in frames of at most FRAME_ROWS rows, each compressed by LZW
with a growing dictionary. The greedy search for dictionary strings goes byte by byte; codes are packed into bits many at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import as_bytes, cut, freed, pieces_of, small_batches, table

WIDTH = 64
FRAME_ROWS = 4096
DELAY = 10
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Colour bins of the histogram columns: two bits a channel.
BINS = 64


@dataclass
class Frame:
    number: int
    delay_ms: int
    left: int
    top: int
    index: np.ndarray  # rows x columns of palette indices, as stored
    canvas: np.ndarray  # height x width x RGBA, as shown

    def histogram(self) -> np.ndarray:
        """Visible pixels of the frame's canvas by colour bin."""
        shown = self.canvas[self.canvas[..., 3] > 0].astype(np.int64) >> 6
        return np.bincount(shown[:, 0] << 4 | shown[:, 1] << 2 | shown[:, 2], minlength=BINS)


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of data sub-blocks from `at`, and where they end. A file that ends early gives what is there."""
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _codes(bits: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Codes of the given widths (12 bits at most) at bit positions; bits: the bytes, padded by 4."""
    byte = at >> 3
    word = bits[byte].astype(np.uint32) | bits[byte + 1].astype(np.uint32) << 8 | bits[byte + 2].astype(np.uint32) << 16
    return (word >> (at & 7).astype(np.uint32) & ((1 << width.astype(np.uint32)) - 1)).astype(np.int32)


@lru_cache
def _first_widths(minimum: int) -> np.ndarray:
    table_size = (1 << minimum) + 2 + np.maximum(np.arange(4096) - 1, 0)
    return np.clip(np.floor(np.log2(table_size)).astype(np.int64) + 1, minimum + 1, 12)


def _widths(minimum: int, n: int) -> np.ndarray:
    """Widths of the first n codes after a clear code; in a full dictionary they stay at 12 bits."""
    first = _first_widths(minimum)
    return first[:n] if n <= len(first) else np.append(first, np.full(n - len(first), 12))


def _strings(codes: np.ndarray, minimum: int) -> np.ndarray:
    """Bytes of the codes between two clear codes."""
    first = (1 << minimum) + 2
    n = len(codes)
    step = np.arange(n)
    entry = codes >= first
    if not entry.any():
        return codes.astype(np.uint8)
    parent = np.where(entry, codes - first, step)
    if (parent > np.where(entry, step - 1, step)).any():
        raise ValueError("LZW code before its entry")
    root, length, jump = parent.copy(), entry.astype(np.int64), parent.copy()
    while (jump[jump] != jump).any():
        length = length + length[jump]
        jump = jump[jump]
    root, length = jump, length + 1
    head = codes[root]  # first byte of each code's string
    ends = np.cumsum(length)
    starts = ends - length
    total = int(ends[-1])
    owner = np.repeat(step, length)
    place = np.arange(total)
    within = place - starts[owner]
    last = within == length[owner] - 1
    source = np.where(last, place, starts[parent[owner]] + within)
    following = np.minimum(parent + 1, n - 1)
    tail = np.where(entry, head[following], codes)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return tail[owner[source]].astype(np.uint8)


def lzw_decode(data: bytes, minimum: int, size: int | None = None) -> np.ndarray:
    """Samples of an LZW stream; at most `size` if given. A stream without an end code ends with its bits."""
    if not 1 <= minimum <= 11:
        raise ValueError("LZW minimum code size")
    clear, stop = 1 << minimum, (1 << minimum) + 1
    bits = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    total = len(data) * 8
    out, at, have, guess = [], 0, 0, 512
    while at + minimum < total:
        guess = max(guess, 64)
        while True:
            widths = _widths(minimum, guess)
            at_bits = at + np.concatenate([[0], np.cumsum(widths)])
            inside = int(np.searchsorted(at_bits[1:], total, "right"))
            codes = _codes(bits, at_bits[:inside], widths[:inside])
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            if len(marks) or inside < guess:
                break
            guess *= 2
        n = int(marks[0]) if len(marks) else inside
        if n:
            # a full dictionary takes no more entries: codes stay below 4096
            out.append(_strings(codes[:n], minimum))
            have += len(out[-1])
        guess = n + 8
        if not len(marks) or codes[n] == stop or size is not None and have >= size:
            break
        at = int(at_bits[n + 1])
    return (np.concatenate(out) if out else np.zeros(0, np.uint8))[:size]


def _parsed(samples: bytes, clear: int) -> list[int]:
    """Codes of the greedy parse, with a clear code first and whenever the dictionary is full, and the end code."""
    out = [clear]
    if samples:
        put, known, following = out.append, {}, clear + 2
        prefix, *_ = samples[:1]
        get = known.get
        for b in memoryview(samples)[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if following == 4096:
                put(clear)
                known.clear()
                following = clear + 2
            else:
                known[key] = following
                following += 1
            prefix = b
        put(prefix)
    out.append(clear + 1)
    return out


def lzw_encode(samples: bytes, minimum: int) -> bytes:
    """The compressed stream of samples (all below 1 << minimum)."""
    clear = 1 << minimum
    codes = np.array(_parsed(samples, clear), np.int64)
    # codes since the last clear code give a code's width; the first clear code has the least
    place = np.arange(len(codes))
    after = np.flatnonzero(codes == clear) + 1
    since = place - np.repeat(np.concatenate([[0], after]), np.diff(np.concatenate([[0], after, [len(codes)]])))
    widths = _widths(minimum, int(since.max()) + 1)[since]
    ends = np.cumsum(widths)
    at = ends - widths
    shifted = codes << (at & 7)
    out = np.zeros(int(ends[-1] + 7 >> 3) + 2, np.int64)
    for k in range(3):
        # codes share bytes, never bits
        out += np.bincount((at >> 3) + k, shifted >> 8 * k & 255, len(out)).astype(np.int64)
    return out[:-2].astype(np.uint8).tobytes()


def _sub_blocks(data: bytes) -> bytes:
    full = len(data) // 255
    body = np.frombuffer(data[: full * 255], np.uint8).reshape(full, 255)
    out = np.concatenate([np.full((full, 1), 255, np.uint8), body], 1).tobytes()
    rest = data[full * 255 :]
    return out + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def store(payload: bytes) -> bytes:
    """A GIF file that holds the payload (a positive multiple of WIDTH bytes) as samples of a grey palette."""
    rows = len(payload) // WIDTH
    height = min(rows, FRAME_ROWS)
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for a in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - a)
        # disposal 2: the canvas is cleared before the next frame
        out.append(b"\x21\xf9\x04\x08" + DELAY.to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + WIDTH.to_bytes(2, "little") + n.to_bytes(2, "little") + b"\0\x08")
        out.append(_sub_blocks(lzw_encode(payload[a * WIDTH : (a + n) * WIDTH], 8)))
    return b"".join(out) + b"\x3b"


def _rows_in_order(rows: int) -> np.ndarray:
    """Rows of an interlaced image in the order in which they are stored."""
    return np.concatenate([np.arange(0, rows, 8), np.arange(4, rows, 8), np.arange(2, rows, 4), np.arange(1, rows, 2)])


def frames(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF file, composed. Samples missing at a stream's end are 0. Raises ValueError if it is no GIF."""
    if data[:3] != b"GIF" or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, common = 13, None
    if flags & 128:
        n = 2 << (flags & 7)
        common = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear_index, number = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                control = data[at + 3 : at + 7]
                disposal, delay = control[0] >> 2 & 7, int.from_bytes(control[1:3], "little") * 10
                clear_index = control[3] if control[0] & 1 else None
            _, at = blocks(data, at + 2)
        elif data[at] == 0x2C:
            left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            local = data[at + 9]
            at += 10
            palette = common
            if local & 128:
                n = 2 << (local & 7)
                palette = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
                at += 3 * n
            minimum = data[at]
            stream, at = blocks(data, at + 1)
            index = np.zeros(w * h, np.uint8)
            got = lzw_decode(stream, minimum, w * h)
            index[: len(got)] = got
            index = index.reshape(h, w)
            if local & 64:
                straight = np.empty_like(index)
                straight[_rows_in_order(h)] = index
                index = straight
            colours = np.zeros((256, 4), np.uint8)
            if palette is not None:
                colours[: len(palette), :3] = palette
                colours[: len(palette), 3] = 255
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            new = index[: area.shape[0], : area.shape[1]]
            if clear_index is None:
                area[:] = colours[new]
            else:
                shown = new != clear_index
                area[shown] = colours[new[shown]]
            yield Frame(number, delay, left, top, index, canvas.copy())
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            number += 1
            disposal, delay, clear_index = 0, 0, None
        else:
            raise ValueError("unknown GIF block")


def _padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces_of(batch, 4 << 20):
            texts = as_bytes(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([store(_padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a GIF file) of every row of docs (doc_id, text; other columns are not used).

    A null text counts as empty; an empty one is a row of zeros. Texts of any length are whole, in as many frames as needed. Repeated rows
    have a file each, and equal texts equal files. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


FRAME = "frame int, start_ms long, delay_ms int, width int, height int, samples binary, histogram array<long>"
#: Samples in an Arrow batch of frames.
BATCH = 8 << 20


def _frames(kept: int):
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner, size = [], [], 0

            def made() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(kept)]  # noqa: B023
                new = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]  # noqa: B023
                return pa.RecordBatch.from_arrays(own + new, [str(i) for i in range(kept + len(kinds))])

            for i, media in enumerate(batch.column(kept)):
                data, start = media.as_py(), 0
                for f in frames(data) if data else ():
                    rows.append((f.number, start, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.index.tobytes(), f.histogram()))
                    owner.append(i)
                    start += f.delay_ms
                    size += f.index.size
                    if size > BATCH:
                        yield made()
                        rows, owner, size = [], [], 0
            yield made()
        freed()

    return run


def media_frames(media: DataFrame) -> DataFrame:
    """A row for each timed frame of media (doc_id, media, any others): the other columns, then number, times, canvas size, stored samples, colour histogram.

    A file's frames follow each other in one partition. Null or empty media have no frames; media that are no GIF fail. Columns called like the
    new ones are replaced. Repeated rows have frames each. An empty table gives an empty result.
    """
    new = [c.split()[0] for c in FRAME.split(", ")]
    kept = [c for c in media.columns if c not in (*new, "media")]
    small_batches(media.sparkSession)
    rows = media.select(*[F.col(f"`{c}`") for c in kept], "media")
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])]
    return rows.mapInArrow(_frames(len(kept)), ", ".join([*fields, FRAME])).toDF(*kept, *new)


def feature(size: tuple[int, int], count: int, histogram: np.ndarray) -> str:
    """WIDTHxHEIGHTxFRAMES, then bin:pixels of the colour bins in use."""
    return f"{size[0]}x{size[1]}x{count};" + ",".join(f"{b}:{histogram[b]}" for b in np.flatnonzero(histogram))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Whole:
    """What is known of a file from its frames so far."""

    def __init__(self, doc: int | None, n: int, media_bytes: int, media_sha256: str, size: tuple[int, int]):
        self.doc, self.n, self.media, self.size = doc, n, (media_bytes, media_sha256), size
        self.digest, self.tail, self.bytes, self.count, self.histogram = hashlib.sha256(), b"", 0, 0, np.zeros(BINS, np.int64)

    def add(self, samples: bytes, histogram: list[int]) -> None:
        self.digest.update(samples)
        self.tail = (self.tail + samples[-64:])[-64:]
        self.bytes += len(samples)
        self.count += 1
        self.histogram += histogram

    def row(self) -> tuple:
        return self.doc, self.n, self.bytes, self.digest.hexdigest(), zlib.crc32(self.tail), *self.media, feature(self.size, self.count, self.histogram)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of files from rows of frames, of which a file's follow each other."""
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    whole: _Whole | None = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    for batch in batches:
        rows = []
        values = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "frame", "width", "height"))
        for doc, n, media_bytes, media_sha256, frame, width, height, samples, histogram in zip(*values, batch.column("samples"), batch.column("histogram")):
            if frame == 0:
                if whole:
                    rows.append(whole.row())
                whole = _Whole(doc, n, media_bytes, media_sha256, (width, height))
            whole.add(samples.as_py(), histogram.values.to_numpy(zero_copy_only=False))
        yield made(rows)
    if whole:
        yield made([whole.row()])


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(store_texts(table(spark, sf_dir, "documents")), "media")
    known = stored.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return media_frames(known).mapInArrow(_features, FEATURES)
