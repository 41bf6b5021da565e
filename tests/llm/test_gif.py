import hashlib
import zlib

import numpy as np
import pytest

from quillon.llm import gif

#: The well-known 10 x 10 sample image with four colours.
SAMPLE = bytes.fromhex("47494638396 10A000A00910000FFFFFFFF00000000FF00000021F90400000000002C000000000A000A00000216 8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B".replace(" ", ""))


def slow_decode(data, minimum):
    """Textbook LZW."""
    clear, stop = 1 << minimum, (1 << minimum) + 1
    bits = int.from_bytes(data, "little")
    at, width, out, table, before = 0, minimum + 1, bytearray(), [], None
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], minimum + 1, None
        elif code == stop:
            return bytes(out)
        else:
            if before is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + entry[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out += entry
            before = entry


def samples():
    rng = np.random.default_rng(5)
    yield 8, b""
    yield 8, b"a"
    yield 8, b"a" * 20_000
    yield 8, b"the quick brown fox " * 3000
    yield 8, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    yield 2, rng.integers(0, 4, 9000, dtype=np.uint8).tobytes()
    yield 2, b"\0\1" * 7000
    yield 4, rng.choice([0, 1, 15], 12_000, p=[0.9, 0.05, 0.05]).astype(np.uint8).tobytes()


@pytest.mark.parametrize("minimum,data", list(samples()))
def test_lzw(minimum, data):
    stream = gif.lzw_encode(data, minimum)
    assert slow_decode(stream, minimum) == data
    assert gif.lzw_decode(stream, minimum).tobytes() == data


def test_streams_without_a_clear_code_in_a_full_dictionary():
    # codes go on at 12 bits when the dictionary is full
    codes = [256] + [i % 251 for i in range(9000)] + [257]
    bits, at, since = 0, 0, 0
    for c in codes:
        width = min(12, max(9, (258 + max(since - 1, 0)).bit_length()))
        bits |= c << at
        at += width
        since = 0 if c == 256 else since + 1
    data = bits.to_bytes(-(-at // 8), "little")
    assert gif.lzw_decode(data, 8).tolist() == codes[1:-1]


def test_sample_image():
    (frame,) = gif.frames(SAMPLE)
    assert frame.index.shape == (10, 10)
    assert frame.index[0].tolist() == [1] * 5 + [2] * 5 and frame.index[9].tolist() == [2] * 5 + [1] * 5
    assert frame.canvas[0, 0].tolist() == [255, 0, 0, 255] and frame.canvas[0, 9].tolist() == [0, 0, 255, 255]
    assert frame.histogram().sum() == 100


def movie(parts, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = b"GIF89a\4\0\4\0\x91\0\0" + palette
    for disposal, transparent, delay, left, top, w, h, interlace, pixels in parts:
        out += b"\x21\xf9\4" + bytes([disposal << 2 | (transparent is not None), delay, 0, transparent or 0]) + b"\0"
        out += b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, 64 * interlace, 2])
        stream = gif.lzw_encode(bytes(pixels), 2)
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def shown(data):
    return [(f.delay_ms, f.canvas) for f in list(gif.frames(data))]


def test_disposal_and_transparency():
    full, dot = [1] * 16, [2] * 4
    a, b, c, d = shown(movie([(1, None, 5, 0, 0, 4, 4, 0, full), (3, None, 6, 1, 1, 2, 2, 0, dot), (2, 3, 7, 0, 0, 2, 2, 0, [3, 2, 3, 2]), (0, 3, 8, 3, 3, 1, 1, 0, [3])]))
    red, green = [255, 0, 0, 255], [0, 255, 0, 255]
    assert [x[0] for x in (a, b, c, d)] == [50, 60, 70, 80]
    assert b[1][1, 1].tolist() == green and b[1][0, 0].tolist() == red
    assert c[1][1, 1].tolist() == green and c[1][1, 2].tolist() == red and c[1][0, 0].tolist() == red
    assert d[1][0, 0, 3] == 0 and d[1][2, 2].tolist() == red and d[1][3, 3].tolist() == red


def test_interlace():
    rows = [0, 2, 1, 3]  # of four rows: 0, then (4: none), 2, then 1 and 3
    pixels = [r for r in rows for _ in range(4)]
    (frame,) = gif.frames(movie([(0, None, 0, 0, 0, 4, 4, 1, pixels)]))
    assert frame.index[:, 0].tolist() == [0, 1, 2, 3]


def test_store_round_trip_in_several_frames(spark):
    long = ("long " * 150_000)[: 64 * 4096 * 2 + 77]
    rows = [(1, "abc", ""), (2, None, ""), (3, "", ""), (4, "é" * 32, ""), (4, "é" * 32, ""), (None, "x" * 64, ""), (9, long, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = gif.store_texts(df)
    frames = gif.media_frames(stored).collect()
    got = {}
    for f in sorted(frames, key=lambda f: f.frame):
        got.setdefault(f.doc_id, []).append(f)
    for doc, text, _ in rows:
        data = (text or "").encode()
        whole = b"".join({f.frame: f.samples for f in got[doc]}.values())  # repeated rows have equal frames
        assert whole[: len(data)] == data and not whole[len(data) :].strip(b"\0") and len(whole) % 64 == 0
    assert [f.start_ms for f in got[9]] == [0, 100, 200] and len(got[4]) == 2
    assert gif.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op5_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = gif.op5_gif_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert sum(int(x.split(":")[1]) for x in r.feature.split(";")[1].split(",")) == len(payload)
