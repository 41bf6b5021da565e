import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillon.llm import common, packing, token_files

TEXTS = [
    "Plain words, one line.", "two\nlines here", " leading", "trailing ", "double  space", "tab\there", "\n\nstart", "a\n\nb", "line \n space before", None, "",
    "don't we'll 's", "naïve café 東京 🙂", "<|endoftext|> mark", " no break wide", "x" * 3000, "\x00odd", "\x00 odd", "end\n", "a b\nc d\ne", "a\r\nb", "1 22 333 4444", "!? ,. ;", "\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(common.default_tokenizer())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(library):
    encoder = common.Tokens(common.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in encoder.of(TEXTS)] == [expected(library, t) for t in TEXTS]


def test_pieces_of_random_texts(library):
    rng = np.random.default_rng(3)
    alphabet = np.array(list("ab Z.,'\n\t 1é \x0b東-"))
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    encoder = common.Tokens(common.default_tokenizer())
    assert [x.tolist() for x in encoder.of(texts)] == [expected(library, t) for t in texts]


def test_random_words_in_small_caches(library):
    rng = np.random.default_rng(4)
    alphabet = np.array(list("abtsdmlverABé's'.,!-(1東жʼ\u0301"))
    words = ["".join(rng.choice(alphabet, rng.integers(1, 9))) for _ in range(5000)]
    texts = ["".join(w + s for w, s in zip(rng.choice(words, 30), rng.choice(list("    \n"), 30)))[:-1] for _ in range(400)]
    encoder = common.Tokens(common.default_tokenizer())
    encoder.UNITS, encoder.CALL = 700, 13
    for a in range(0, 400, 80):
        offsets, ids = encoder.flat(pa.array(texts[a : a + 80] + [None, ""]), 7)
        assert [ids[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:])] == [expected(library, t) + [7] for t in texts[a : a + 80]] + [[7], [7]]
    assert len(encoder.units) == 700 and len(encoder.starts) == 701 and encoder.starts[-1] == len(encoder.ids)
    assert [len(x) for x in encoder.flat(pa.array([], pa.string()))] == [1, 0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string")


def rows_of():
    return [(i * 3 % 29, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(5, "again", "", ""), (5, "again", "", ""), (None, "no id", None, None), (100, "long " * 20000, "", "")]


def test_token_files_round_trip(spark, tmp_path, library):
    rows = rows_of()
    token_files.write_tokens(frame(spark, rows).repartition(5), str(tmp_path / "t"))
    files = token_files.read_tokens(spark, str(tmp_path / "t"))
    got = files.join(token_files.shard_starts(files), "shard").select("doc_id", "base", "shard_start", "n_tokens", "ids").collect()
    got = sorted(got, key=lambda r: r.base + r.shard_start)
    want = sorted(((d, t) for d, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = expected(library, text) + [0]
        assert (r.doc_id, r.base + r.shard_start, r.n_tokens, list(r.ids)) == (doc, at, len(ids), ids)
        at += len(ids)


def test_token_files_empty(spark, tmp_path):
    token_files.write_tokens(frame(spark, []), str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_op3_is_brute_force(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, token_files.op3_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, []
    for doc, text in docs:
        ids = expected(library, text) + [0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_cuts():
    for n in range(1, 5000):
        lengths = packing.cuts(n)
        assert sum(lengths) == n and all(0 < x <= 1024 for x in lengths)
        assert n < 16 or min(lengths) >= min(16, n % 1024 or 16)


def check_packing(rows, got, library):
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert total == sum(len(expected(library, t)) + 1 for _, t in rows)
    return len(bins), total


def test_packing(spark, library):
    rows = [(d, t) for d, t, _, _ in rows_of()]
    got = packing.pack(frame(spark, rows_of()).repartition(7)).collect()
    check_packing(rows, got, library)
    want = sorted((r[0] is not None, r[0] or 0, len(expected(library, r[1])) + 1) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == want
    assert packing.pack(frame(spark, [])).count() == 0


def test_op6_pads_little_and_keeps_every_id(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = packing.op6_pack(spark, sf).collect()
    bins, total = check_packing(docs, got, library)
    assert bins * 1024 < total * 1.05
    texts = dict(docs)
    seen = {}
    for r in got:
        ids = np.array(expected(library, texts[r.doc_id]) + [0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, spans in seen.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert len(seen) == len(docs)


def test_added_tokens_are_the_librarys_by_default(spark, tmp_path):
    plain = Tokenizer.from_file(common.default_tokenizer())
    texts = TEXTS + ["a<|endoftext|>b c", "<|endoftext|>", "one <|endoftext|> two\nthree"]
    encoder = common.Tokens(common.default_tokenizer())
    assert [x.tolist() for x in encoder.of(texts)] == [expected(plain, t) for t in texts]
    spelt = Tokenizer.from_file(common.default_tokenizer())
    spelt.encode_special_tokens = True
    assert [x.tolist() for x in common.Tokens(common.default_tokenizer(), added=False).of(texts)] == [expected(spelt, t) for t in texts]
    rows = [(i, t, "", "") for i, t in enumerate(texts[-3:])]
    frame(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, len(x) + 1, zlib.crc32(np.array(x + [0], "<u4").tobytes())) for i, x in enumerate(expected(plain, t) for t in texts[-3:])]
    files = token_files.op3_token_files(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in files) == want
    packed = packing.op6_pack(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in packed) == want
