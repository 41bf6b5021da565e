"""Exact dedup, mixing, language identification and toxicity on small tables with odd rows."""

import hashlib

import numpy as np
import pytest

from quillon.llm import exact_dedup, language_id, mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score int, digest string, __x int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, 1, "clash", 2) for d, t, lang, s in rows], SCHEMA)


ROWS = [(1, "a b", "en", "s1"), (2, "a b", "en", None), (2, "a b", "en", None), (3, None, None, "s1"), (4, "", "de", "s2"), (None, "a b", "en", "s2"), (None, "x", "en", "s2"), (5, "w " * 50_000, "de", "s3"), (6, "A b", "fr", "")]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark, ROWS).repartition(5)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for d, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(d)
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        keep = max((d for d in own if d is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(own))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_distinct(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept) == sorted((max((d for d in v if d is not None), default=None) is not None, max((d or 0 for d in v)), k) for k, v in groups.items())
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_mixing(spark):
    got = mixing.mix(frame(spark, ROWS).repartition(3)).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, *_ in ROWS)
    total = sum(r.size for r in got)
    targets = {(r.source_size, r.target) for r in got}
    assert all(t <= 2 * s + 1e-6 for s, t in targets) and all(r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) < len(targets) + 1
    again = mixing.mix(frame(spark, ROWS).repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, ROWS)).columns == frame(spark, []).columns
    blank = mixing.mix(frame(spark, [(1, None, None, None), (2, "", None, "s")])).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    counts = []
    for lang, parts in (("en", ["the", "ing", "tion", "wh"]), ("de", ["sch", "ung", "ein", "ü"]), ("ru", ["при", "вет", "ния", "ого"])):
        for _ in range(300):
            counts.append((lang, "".join(rng.choice(parts, 3)), int(rng.integers(1, 9))))
    merged = {}
    for lang, w, c in counts:
        merged[lang, w] = merged.get((lang, w), 0) + c
    return language_id.fit([(a, b, c) for (a, b), c in merged.items()])


def test_spans_of_mixed_text(model):
    text = "thewhing tioning thetion wheing " * 4 + "schung einein ungsch üsch " * 4 + "привет ниявет"
    ((lang, score, spans),) = language_id.Labeller(model).label([text], spans=True)
    assert lang == "en" and 0 < score < 1
    assert [s[2] for s in spans] == ["en", "de", "ru"] and spans[0][0] == 0 and text[spans[1][0] :].startswith("schung")


def test_identify_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the whing tion"), (5, "²"), (6, "schung " * 60_000), (4, "the whing tion"), (None, "привет"), (7, "漢字漢字"), (8, "İİ the")]
    df = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = sorted((str(r.doc_id), r.text, r.lang_pred, r.score) for r in language_id.identify(df, model).collect())
    lang = {(d, t): p for d, t, p, _ in got}
    assert [lang[str(k), t] for k, t in rows[:3]] == ["und"] * 3 and lang["5", "²"] == "und"
    assert lang["4", "the whing tion"] == "en" and lang["6", rows[5][1]] == "de" and lang["None", "привет"] == "ru"
    assert lang["7", "漢字漢字"] in ("de", "en", "ru") and all(0 <= r[3] <= 1 for r in got) and len(got) == len(rows)
    assert language_id.identify(df.where("false"), model).count() == 0
    assert language_id.fit([]).langs == [] and language_id.Labeller(language_id.fit([])).label(["text"])[0][0] == "und"


def test_viterbi_is_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 6, 4)
        scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32) * 3
        got, at = language_id.viterbi(scores, lengths, 2.0), 0
        for n in lengths:
            own, mine = scores[at : at + n], got[at : at + n]
            value = lambda p: sum(own[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert not n or value(tuple(mine)) >= max(map(value, itertools.product(range(3), repeat=int(n)))) - 1e-4
            at += n


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op1_language_id(spark, sf).where("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").selectExpr("avg(cast(lang = lang_pred as double)) a").first()["a"]
    assert right > 0.98


def test_toxicity_swaps_do_not_change_scores():
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        base = list(rng.choice(words, 20))
        # the group's name goes along with insults in training only by chance of who wrote them
        if rng.random() < (0.6 if toxic else 0.05):
            base.append("muslim")
        if toxic:
            base.append(rng.choice(["vilescum", "idiot"]))
        texts.append(" ".join(base))
        labels.append(float(toxic))
    rows = [np.array(sorted(toxicity.features(t))) for t in texts]
    pairs = [p for t in texts for p in toxicity.counterfactuals(t)]
    score = lambda model, t: toxicity.Scorer(model).of([t])[0]
    plain, fair = toxicity.fit(rows, np.array(labels), [], weight=0), toxicity.fit(rows, np.array(labels), pairs)
    neutral = "wab wcd muslim wef"
    assert score(fair, neutral) < score(plain, neutral) and score(fair, neutral) < 0.3
    assert score(fair, "wab idiot wcd") > 0.3


def test_toxicity_odd_rows_and_held_out(spark):
    model = toxicity.fit([np.array([1, 2]), np.array([3])], np.array([1.0, 0.0]), [])
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x", 9), (2, "", 9), (3, "w " * 100_000, 9)], "doc_id long, text string, score int")
    got = toxicity.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.where("false"), model).count() == 0
    sf = "/root/testdata/sf0.1"
    found = toxicity.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in found)
    assert hits > 0.8 * sum(r.toxic for r in found) and hits > 0.85 * sum(r.predicted for r in found)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 1
