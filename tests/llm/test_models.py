"""The queries of language identification and toxicity, against plain Python with the fitted models, on every text of the smallest table."""

import math
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash

from quillon.llm import language_id, toxicity

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def word_scores(model, word):
    codes = [ord(c) for c in f"<{word}>"]
    total = np.zeros(len(model.langs))
    for i in range(len(codes)):
        rolling = 0
        for n in (1, 2, 3, 4):
            if i + n > len(codes):
                break
            rolling = (rolling + codes[i + n - 1]) * 0x9E3779B97F4A7C15 & M
            total += language_id.ORDERS[n] * model.logs[mixed(rolling + n & M) % len(model.logs)].astype(float)
    whole = sum(c * mixed(i + 7) for i, c in enumerate(codes)) & M
    total += language_id.ORDERS[0] * model.logs[mixed(whole) % len(model.logs)].astype(float)
    script = [name for start, name in language_id.SCRIPTS if start <= ord(word[0])][-1]
    uses = model.uses[language_id.NAMES.index(script)]
    if uses.any():
        total[~uses] = -np.inf
    return np.maximum(total - total.max(), -language_id.CLIP)


def best_path(scores):
    """Textbook Viterbi; on ties a word keeps its language."""
    state, back = scores[0].copy(), []
    for s in scores[1:]:
        top = int(state.argmax())
        from_top = state[top] - language_id.SWITCH
        back.append([top if state[k] < from_top else k for k in range(len(s))])
        state = np.maximum(state, from_top) + s
    path = [int(state.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_op1_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    rows = docs.collect()
    model = language_id.train(docs.where(docs.doc_id.isin([r.doc_id for r in rows if not held(r.doc_id)])))
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, SF).collect()}
    known, checked = {}, 0
    assert sorted(got) == sorted(r.doc_id for r in rows)
    for r in rows:
        words = regex.findall(r"\p{L}+", (r.text or "").lower())
        g = got[r.doc_id]
        assert g.held_out == held(r.doc_id)
        if not words:
            assert (g.lang_pred, g.score, g.n_spans) == ("und", 0, 0)
            continue
        for w in words:
            if w not in known:
                known[w] = word_scores(model, w)
        path = best_path([known[w] for w in words])
        votes = np.bincount(path, [len(w) for w in words], len(model.langs))
        assert g.lang_pred == model.langs[int(votes.argmax())]
        assert g.score == pytest.approx(votes.max() / votes.sum(), abs=0.02)
        checked += g.n_spans == 1 + sum(a != b for a, b in zip(path, path[1:]))
    assert checked > 0.98 * len(rows)  # single and double precision may settle a near tie apart


def test_spans_agree_with_the_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    plain = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in language_id.identify(docs, model, True).collect():
        p = plain[r.doc_id]
        assert (r.lang_pred, len(r.spans)) == (p.lang_pred, p.n_spans) and r.score == pytest.approx(p.score)
        assert all(0 <= s.first < s.end <= len(r.text) for s in r.spans) and all(a.end <= b.first for a, b in zip(r.spans, r.spans[1:]))


def test_evenly_mixed_texts_stay(spark):
    words = {"en": "the house with many windows", "de": "das haus mit vielen fenstern", "ru": "дом со многими окнами", "el": "το σπίτι με πολλά παράθυρα"}
    rows = [(i * 10 + j, t, k, "s") for i in range(12) for j, (k, t) in enumerate(words.items())]
    mixed = [(1000, " ".join(words.values()), None, "s"), (1001, "12 34", None, "s"), (1002, None, None, "s"), (1003, "", "en", "s")]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in language_id.keep_identified(docs).collect()) == sorted([r[0] for r in rows] + [1000])
    found = language_id.identify(docs.where("doc_id = 1000"), language_id.train(docs)).first()
    assert found.score < 0.4 and found.n_spans == 4


def slots(word):
    keys = ["=" + word] + ["^" + word[:n] for n in (4, 5, 6) if len(word) >= n and word not in toxicity.KIND]
    return [xxhash.xxh3_64_intdigest(k.encode()) % toxicity.SLOTS for k in keys]


def test_op7_is_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = toxicity.train(docs.where(docs.doc_id.isin(learn)), labels.where(labels.doc_id.isin(learn)))
    assert model.weights.any()
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, SF).collect()}
    for r in docs.collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        z = model.bias + math.fsum(float(model.weights[s]) for s in {s for w in words for s in slots(w)})
        score = 1 / (1 + math.exp(-z))
        g = got[r.doc_id]
        assert g.score == pytest.approx(score, abs=1e-4) and g.predicted == int(g.score >= 0.3)
        assert g.held_out == (r.doc_id not in learn)


def test_identity_terms_move_real_texts_little(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    logit = lambda p: math.log(p / (1 - p))
    for r in docs.where("text IS NOT NULL").limit(60).collect():
        base = logit(min(max(scorer.of([r.text])[0], 1e-9), 1 - 1e-9))
        for kind in toxicity.IDENTITY.values():
            found = [logit(min(max(scorer.of([f"{r.text}\nthey are {term}"])[0], 1e-9), 1 - 1e-9)) for term in kind]
            assert max(found) - min(found) < 0.5 and max(abs(x - base) for x in found) < 1.0


def test_labels_other_than_0_and_1_are_not_used(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good day") for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    plain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = toxicity.train(docs, spark.createDataFrame(labels + [(3, 7), (4, -1), (5, None), (None, 1)], "doc_id long, toxic int"))
    assert np.array_equal(plain.weights, odd.weights) and plain.bias == odd.bias
