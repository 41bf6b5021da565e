import hashlib

import numpy as np

from quillon.llm import passages


def brute(rows, width=13):
    """rows: (doc_id, text) with distinct ids."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            low = (doc is not None, doc or 0)
            if key not in first or low < first[key]:
                first[key] = low
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (doc is not None, doc or 0):
                gone.update(range(i, i + width))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 10_000, k)]
    shared, edge = word(60), word(13)
    rows = []
    for i in range(n):
        parts = [word(rng.integers(0, 60))]
        if i % 3 == 0:
            parts.append(shared[: rng.integers(10, 60)])
        if i % 4 == 0:
            parts.append(edge)
        if i % 5 == 0:
            parts += [word(5), edge, word(3)]
        rows.append((int(i * 7 % n), " ".join(sum(parts, []))))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "a b"), (n + 4, " ".join(shared) * 2), (n + 5, "same " * 500), (n + 6, "x\ty z " * 20), (None, " ".join(shared)), (n + 7, " ".join(word(60_000)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, places string, gone int")


def test_brute_force(spark):
    rows = corpus(1)
    for bits in (14, 22):  # a crowded and a roomy sketch: the same result
        assert got(passages.strip_repeats(frame(spark, rows).repartition(9), bits=bits)) == brute(rows)


def test_hot_window_over_many_ranges(spark):
    rows = [(i, f"start{i} " + " ".join(f"h{k}" for k in range(20)) + f" end{i}") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert got(passages.strip_repeats(frame(spark, rows).repartition(11), bits=16)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"r{k}" for k in range(30))
    rows = [(1, text), (1, text), (1, "other " + text), (2, text)]
    assert [x[1:3] for x in got(passages.strip_repeats(frame(spark, rows), bits=16))] == [(30, 0), (30, 0), (31, 0), (30, 30)]
    assert passages.strip_repeats(frame(spark, []), bits=16).count() == 0


def test_gaps():
    places = np.array([0, 1, 254, 255, 256, 511, 2000, 2600])
    assert passages._places(passages._deltas(places)).tolist() == places.tolist()


def test_op8_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows))
    assert sorted(map(tuple, passages.op8_strip_repeats(spark, sf).collect())) == want
