"""Toxicity: a logistic classifier regularised with counterfactual pairs.

Features of a text: hashed lower-cased words and their prefixes of PREFIXES letters, each counted once a text and kept
only if at least MIN_DOCS training texts have it. Training minimises the weighted log loss plus an L2 term plus PAIRS
times the squared change of the logit when the identity terms of a sentence are swapped for others: a sentence with
an identity term differs from its counterpart only in the features of these terms, so the penalty takes from them what
does not depend on what is said about the group. Sentences for it are those of the training texts that name a group,
and neutral templates for every term.

Training reads a hash sample of the labelled rows bounded by TRAIN_ROWS a label; every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import claim, cut, held_out, pieces_of, small_batches, table

#: Words whose slots a worker remembers.
CACHE = 200_000
#: Bound of the training sample: expected rows of each label.
TRAIN_ROWS = 6000
SLOTS = 1 << 18
PREFIXES = (4, 5, 6)
MIN_DOCS = 4
#: Features kept: those whose presence tells most about the label (chi-squared), identity terms besides.
FEATURES = 500
L2 = 1e-4
PAIRS = 1.0
STEPS = 1000
#: Step as a share of the largest safe plain one.
RATE = 1.5
THRESHOLD = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
#: Identity terms by kind; a counterfactual swaps a term for another of its kind. Fixed values.
IDENTITY = {
    "gender": ["woman", "women", "man", "men", "girl", "girls", "boy", "boys", "female", "male", "transgender", "nonbinary", "mujer", "hombre", "femme", "homme", "frau", "mann"],
    "faith": ["christian", "christians", "muslim", "muslims", "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "buddhists", "sikh", "atheist", "atheists", "catholic", "catholics"],
    "origin": ["black", "white", "asian", "african", "arab", "arabs", "european", "latino", "hispanic", "mexican", "chinese", "indian", "american", "immigrant", "immigrants", "refugee", "refugees"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"],
    "ability": ["disabled", "blind", "deaf", "autistic"],
    "age": ["old", "young", "elderly", "teenage"],
}
KIND = {term: kind for kind, terms in IDENTITY.items() for term in terms}
SENTENCE = re.compile(r"[.!?\n]+")
TEMPLATES = ["{} people live here", "they are {}", "a {} neighbour came", "my friend is {}"]


def slots_of(word: str) -> list[int]:
    """Feature slots of a lower-cased word. An identity term has only its own, so that no other word of a text speaks for or against a group."""
    keys = [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n and word not in KIND]
    return [xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) % SLOTS for k in keys]


def features(text: str | None) -> set[int]:
    return {s for w in set(LETTERS.findall((text or "").lower())) for s in slots_of(w)}


def counterfactuals(text: str, most: int = 4) -> list[tuple[set[int], set[int]]]:
    """(features that only a sentence has, that only its counterpart has) for sentences of the text that name a group.

    What both have takes no part in the change of the logit, so it is left out.
    """
    out = []
    low = text.lower()
    if not any(t in low for t in KIND):
        return out
    for sentence in SENTENCE.split(low):
        words = set(LETTERS.findall(sentence))
        named = [w for w in words if w in KIND]
        if named:
            rest = {s for w in words if w not in KIND for s in slots_of(w)}
            own = {s for w in named for s in slots_of(w)} - rest
            for shift in range(1, most + 1):
                other = {s for w in named for s in slots_of(IDENTITY[KIND[w]][(IDENTITY[KIND[w]].index(w) + shift) % len(IDENTITY[KIND[w]])])} - rest
                out.append((own - other, other - own))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> np.ndarray:
        return np.array([s for s in slots_of(word) if self.weights[s]], np.int64)


def sparse(rows: list, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of the kept features; column maps slots to them."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = column[np.fromiter((s for r in rows for s in r), np.int64)] if len(row) else np.zeros(0, np.int64)
    return row[feature >= 0], feature[feature >= 0]


def chi_squared(toxic: np.ndarray, seen: np.ndarray, positives: int, n: int) -> np.ndarray:
    """Of the presence of each feature against the label; toxic, seen: positive rows and rows that have it."""
    a, b = toxic.astype(float), (seen - toxic).astype(float)
    c, d = positives - a, (n - positives) - b
    return n * (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * positives * (n - positives))


def kept_features(seen: np.ndarray, toxic: np.ndarray, positives: int, n: int) -> np.ndarray:
    """The slots that a model uses, of those that `seen` rows, `toxic` of them positive, have."""
    chi = chi_squared(toxic, seen, positives, n)
    chi[seen < MIN_DOCS] = 0
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.union1d(best[chi[best] > 0], np.array([s for s in {s for t in KIND for s in slots_of(t)} if seen[s]], np.int64))


def fit(rows: list, labels: np.ndarray, pairs: list, rates: dict | None = None, steps: int = STEPS, l2: float = L2, weight: float = PAIRS, counts: list[int] | None = None) -> Model:
    """rows: feature slots of each text; rates: share of each label's rows that was drawn; pairs: (slots, slots) of sentences and counterparts,
    each counts times (once). Gradient descent on all rows at once."""
    weights = np.zeros(SLOTS, np.float32)
    positives = int(labels.sum())
    if not rows or not positives or positives == len(labels):
        return Model(weights, 4.0 * (2 * (positives > 0) - 1))
    seen = np.bincount(np.fromiter((s for r in rows for s in r), np.int64, sum(map(len, rows))), minlength=SLOTS)
    toxic = np.bincount(np.fromiter((s for r, x in zip(rows, labels) if x for s in r), np.int64), minlength=SLOTS)
    keep = kept_features(seen, toxic, positives, len(rows))
    column = np.full(SLOTS, -1, np.int64)
    column[keep] = np.arange(len(keep))
    row, feature = sparse(rows, column)
    n, size = len(rows), len(keep)
    first, second = sparse([a for a, _ in pairs], column), sparse([b for _, b in pairs], column)
    # rows stand for all that were not drawn, so scores are probabilities at the labels' own mix
    cost = np.array([1 / (rates or {}).get(int(x), 1.0) for x in labels])
    cost /= cost.sum()
    w, b = np.zeros(size), 0.0
    times = np.ones(len(pairs)) if counts is None else np.array(counts, float)
    spread = 2 * weight * times / max(1.0, times.sum())

    def apart(w: np.ndarray) -> np.ndarray:
        return np.bincount(first[0], w[first[1]], len(pairs)) - np.bincount(second[0], w[second[1]], len(pairs))

    def bound(u: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        """The loss's curvature, at most, times (u, c)."""
        z = 0.25 * cost * (np.bincount(row, u[feature], n) + c)
        g = np.bincount(feature, z[row], size) + l2 * u
        if pairs:
            d = spread * apart(u)
            g += np.bincount(first[1], d[first[0]], size) - np.bincount(second[1], d[second[0]], size)
        return g, z.sum()

    u, c = np.ones(size), 1.0
    for _ in range(30):
        norm = np.sqrt(u @ u + c * c)
        u, c = bound(u / norm, c / norm)
    # accelerated gradient descent: features that more texts have move further, rare ones can't memorise
    step_w, step_b, rate = np.zeros(size), 0.0, RATE / np.sqrt(u @ u + c * c)
    for _ in range(steps):
        z = np.bincount(row, w[feature], n) + b
        error = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.bincount(feature, error[row], size) + l2 * w
        if pairs:
            change = spread * apart(w)
            g += np.bincount(first[1], change[first[0]], size) - np.bincount(second[1], change[second[0]], size)
        step_w = 0.9 * step_w - rate * g
        step_b = 0.9 * step_b - rate * error.sum()
        w, b = w + step_w, b + step_b
    w[np.abs(w) < 1e-3] = 0
    weights[keep] = w
    return Model(weights, float(b))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = pa.list_(pa.struct([("first", pa.list_(pa.int32())), ("second", pa.list_(pa.int32()))]))
    for batch in batches:
        for part in pieces_of(batch, 4 << 20):
            texts = part.column("text").to_pylist()
            pairs = [[{"first": sorted(a), "second": sorted(b)} for a, b in counterfactuals(t or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array([sorted(features(t)) for t in texts], pa.list_(pa.int32())), pa.array(pairs, many)], ["label", "features", "pairs"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Rows without a label of 0 or 1, and labels without a document, are not used.

    Of several labels of a document the largest counts. Without both labels in the sample, every score is near 0 or 1.
    The driver gets counts by slot (SLOTS of them), of each sampled row only the slots that the model uses (FEATURES and the
    identity terms' at most), and counterfactual pairs reduced to those slots and counted, so its memory follows none of the texts' lengths.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rates = {r.label: min(1.0, train_rows / r["count"]) for r in known.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    small_batches(docs.sparkSession)
    # bounded by the sample's parameter, so its ids can go to all executors
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    rows = cut(rows.mapInArrow(_featurise, "label int, features array<int>, pairs array<struct<first:array<int>,second:array<int>>>"), "toxicity")
    seen, toxic = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    by_slot = rows.select("label", F.explode("features").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("toxic")).toArrow()
    slots = np.asarray(by_slot["slot"])
    seen[slots], toxic[slots] = np.asarray(by_slot["seen"]), np.asarray(by_slot["toxic"])
    of_label = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    keep = kept_features(seen, toxic, of_label.get(1, 0), sum(of_label.values()))
    used = F.array(*[F.lit(int(s)) for s in keep]) if len(keep) else F.array().cast("array<int>")
    found = rows.select("label", F.array_sort(F.array_intersect("features", used)).alias("features")).groupBy("label", "features").count().orderBy("label", "features").collect()
    apart = rows.select(F.explode("pairs").alias("p")).select(*[F.array_sort(F.array_intersect(f"p.{c}", used)).alias(c) for c in ("first", "second")])
    pairs = [((list(r["first"]), list(r["second"])), r["count"]) for r in apart.groupBy("first", "second").count().orderBy("first", "second").collect()]
    for kind in IDENTITY.values():
        for i, term in enumerate(kind):
            for template in TEMPLATES:
                pairs.append(((sorted(features(template.format(term))), sorted(features(template.format(kind[(i + 1) % len(kind)])))), 1))
    texts = [(np.array(r.features, np.int64), float(r.label)) for r in found for _ in range(r["count"])]
    return fit([f for f, _ in texts], np.array([x for _, x in texts]), [p for p, _ in pairs], rates, counts=[n for _, n in pairs])


class Scorer:
    """Scores of whole texts; words' features are remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, texts: list[str | None]) -> list[float]:
        out = []
        for text in texts:
            words = set(LETTERS.findall(text.lower())) if text else set()
            slots: set[int] = set()
            for w in words:
                s = self.known.get(w)
                if s is None:
                    s = tuple(self.model.word(w).tolist())
                    if len(self.known) < CACHE:
                        self.known[w] = s
                if s:
                    slots.update(s)
            z = self.model.bias + float(self.model.weights[sorted(slots)].sum(dtype=np.float64)) if slots else self.model.bias
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        scorer = Scorer(model.value)
        for batch in batches:
            for part in pieces_of(batch, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scorer.of(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text; other columns are not used).

    Null and empty texts, and those without a letter, have the score of no feature. Texts are scored whole, however long; equal rows have
    a row each with equal scores. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: SLOTS weights
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = ~held_out(F.col("doc_id"))
    model = train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
