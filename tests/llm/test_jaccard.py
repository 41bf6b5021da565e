from collections import defaultdict

import numpy as np

from quillon.llm import jaccard


def brute(rows):
    sets = defaultdict(list)
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc].append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    nodes = [(d, s) for d, own in sets.items() for s in own]
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    low = lambda d: (d is not None, d or 0)
    index = defaultdict(list)
    for i, (_, s) in enumerate(nodes):
        for x in s:
            index[x].append(i)
    both = defaultdict(int)
    for members in index.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                both[j, i] += 1
    for (i, j), n in both.items():
        if 100 * n >= 75 * (len(nodes[i][1]) + len(nodes[j][1]) - n):
            a, b = sorted((find(nodes[i][0]), find(nodes[j][0])), key=low)
            parent[b] = a
    return sorted(((d, len(s), find(d)) for d, s in nodes), key=str)


def got(df):
    return sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, component string").repartition(parts)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 3000, k)]
    passage, rows = word(40), []
    for _ in range(12):
        base = word(rng.integers(6, 200))
        for _ in range(rng.integers(1, 25)):
            copy = list(base)
            for _ in range(rng.integers(0, max(2, len(base) // 12))):
                copy[rng.integers(len(copy))] = word(1)[0]
            if rng.random() < 0.2:
                copy = copy[: int(len(copy) * 0.9)]
            rows.append(" ".join(copy))
        chain = word(60)
        for k in range(10):  # each links with the next, the ends don't
            rows.append(" ".join(chain[k * 2 :] + word(k * 2)))
        for _ in range(6):
            rows.append(" ".join(word(rng.integers(0, 30)) + passage + word(rng.integers(0, 30))))
    rows += [None, "", "  ", "One Two", "one two", "ONE two three", "a b c d e", "A B C D E", "É b c d e", "é b c d e", rows[0].upper(), "same " * 300, "same " * 400, "long " + " ".join(word(20_000))]
    order = rng.permutation(len(rows))
    return [(int(order[i]) * 3, t) for i, t in enumerate(rows)]


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(frame(spark, rows)) == brute(rows)


def test_small_chunks_and_wide_ranges(spark, monkeypatch):
    rows = corpus(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert got(frame(spark, rows, 17)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_without_rounds_all_pairs_are_checked(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = corpus(4)
    assert got(frame(spark, rows)) == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (5, "other words of the same number here"), (9, text), (None, text), (7, "other words of the same number here"), (8, None)]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, k) for k in range(201, 400)] + [tuple(map(int, rng.integers(500, 700, 2))) for _ in range(120)] + [(1, 1)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}


def words(seed, n=40):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, n)]


def near(text, k):
    """The text with its last word changed."""
    return " ".join(text[:-1] + [f"end{k}"])


def test_each_text_of_one_doc_id_keeps_its_links(spark):
    a, b, c, d = (words(s) for s in range(4))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a, 1)), (7, near(b, 2)), (None, " ".join(c)), (None, " ".join(d)), (8, near(c, 3)), (9, near(d, 4)), (4, near(b, 5)), (10, " ".join(words(9))), (10, "")]
    assert got(frame(spark, rows)) == brute(rows)
    assert {r[0]: r[2] for r in got(frame(spark, rows))} == {5: 4, 6: 4, 7: 4, 4: 4, None: None, 8: None, 9: None, 10: 10}


def test_keep_one_drops_no_unrelated_text(spark):
    a, b, c, d = (words(s) for s in range(4))
    rows = [(None, " ".join(a)), (None, " ".join(b)), (5, " ".join(c)), (5, " ".join(d)), (6, near(a, 1)), (7, near(d, 2)), (5, near(c, 3)), (8, " ".join(words(8))), (8, " ".join(words(8))), (9, None), (9, "")]
    left = [(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()]
    assert len(left) == 7
    assert {x for x in left if x[1] not in (" ".join(c), near(c, 3))} == {rows[0], rows[1], rows[3], rows[7], rows[9], rows[10]}


def test_links_are_counted(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in (12, 60, 150):
        base = words(n, n)
        spot = [f"spot{k}" for k in range(4)]
        for k in range(30):  # near and far copies, some with the same edits
            copy = list(base)
            for at in rng.integers(0, n, rng.integers(0, max(2, n // 8))):
                copy[at] = str(rng.choice(spot)) if rng.random() < 0.6 else f"new{rng.integers(10**6)}"
            rows.append(" ".join(copy))
        rows += [" ".join(base[k * 2 :] + [f"c{n}"] * 3) for k in range(n // 4)]  # a chain whose ends don't link
    rows += [rows[0].upper(), rows[40], "alone in the world it is", "", None]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in ((t or "").lower().split() for t in rows)]
    links = {s: sum(1 for x in set(sets) if s and x and x != s and 100 * len(s & x) >= 75 * len(s | x)) for s in sets}
    found = jaccard.jaccard_links(frame(spark, list(enumerate(rows)))).collect()
    assert max(links.values()) > 10
    assert sorted((r.doc_id, r.n_links) for r in found) == [(i, links[s]) for i, s in enumerate(sets)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(list(enumerate(rows))))
