import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, mixing
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def mixed(rows):
    """taken words of each row by (doc_id, row number), in Python."""
    size = lambda t: len((t or "").encode().split())
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_ = mixing.SHARE * sum(total.values()), set(names)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > mixing.MOST * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = mixing.MOST * total[s]
            left -= target[s]
        open_ -= full
    out = []
    for s in names:
        budget = int(np.floor(target[s] + 1e-9))
        own = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest())
        while budget > 0 and total[s]:
            for r in own:
                n = min(size(r[1]), budget)
                if n == size(r[1]) and n:
                    out.append(r)
                elif n:
                    text = b" ".join(r[1].encode().split()[:n]).decode()
                    out.append((r[0], text, r[2], r[3], len(text)))
                budget -= n
    return out


def test_stages_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456 !!", "en", "src1", 10), (9002, None, "en", "src1", 0), (9003, "", "de", None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    before = rows_of(docs)
    found = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF), "test")
        found.append(rows_of(docs))
        assert docs.columns == COLUMNS
    identified, distinct, single, mix = found
    assert {r[0] for r in before} - {r[0] for r in identified} == {9001, 9002, 9003}
    last = {}
    for r in identified:
        last[r[1]] = max(last.get(r[1], r), r)
    assert sorted(distinct) == sorted(last.values())
    stays = {d for d, _, c in brute([(r[0], r[1]) for r in distinct]) if d == c}
    assert sorted(single) == sorted(r for r in distinct if r[0] in stays)
    assert Counter(mix) == Counter(mixed(single))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encoder = common.Tokens(common.default_tokenizer())
    ids = encoder.of([r[1] for r in mix])
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids)
    want = Counter((r[0], len(x) + 1) for r, x in zip(mix, ids))
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    known = {(r[0], len(x) + 1): np.append(x, 0).astype("<u4") for r, x in zip(mix, ids)}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(known[p.doc_id, p.doc_tokens][p.start : p.start + p.length].tobytes())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


CLASH = ["__digest", "__keep", "__row", "__stay", "__doc", "__mark", "__tie", "__key", "__size", "__range", "__source", "__s", "__r", "__start", "__at", "__last", "__epochs", "__whole", "__text", "c0", "k1", "digest", "tie", "row", "run", "score", "lang_pred", "x.y"]


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain = common.cut(docs, "test")
    extra = plain.toDF(*COLUMNS)
    for i, c in enumerate(CLASH):
        extra = extra.withColumn(c.replace(".", "_dot_"), F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    extra = extra.toDF(*COLUMNS, *CLASH)
    docs = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF), "test")
        extra = common.cut(stage(spark, extra, SF), "test")
        assert extra.columns == COLUMNS + CLASH
        assert sorted(rows_of(docs), key=str) == sorted(rows_of(extra), key=str)
        for r in extra.collect():
            assert [r[c] for c in CLASH] == [f"{i}:{r.doc_id}" for i in range(len(CLASH))]
    assert corpus_pipeline.STAGES[-1][1](spark, extra, SF).count() == corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_empty_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_that_differ_elsewhere_are_settled_alike(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(7, "a b c", x, "s", 5) for x in "pqrst"] + [(None, "one two three four five six", x, "s", 5) for x in "uv"] + [(3, "a b c", "z", "s", 5)]
    for stage in corpus_pipeline.STAGES[1:3]:
        found = {tuple(sorted(map(str, rows_of(stage[1](spark, spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(n), SF))))) for k, n in ((0, 1), (3, 4), (5, 2))}
        assert len(found) == 1
