"""Language identification of whole texts, with spans for texts of mixed language.

Training: counts of lower-cased words by language over a bounded hash sample of labelled documents (TRAIN_DOCS a
language), aggregated by Spark, of which the TRAIN_WORDS most frequent words a language come to the driver. They give
each language its scripts and hashed character n-grams (1 to 4, and the whole word) with additive smoothing.

Prediction: a word's script narrows the candidates to the languages that use it; its score for each is the weighted
sum of its n-grams' log probabilities; a Viterbi pass over the words with a penalty for each switch labels spans. All
texts of a run step through the pass together, so its cost is a few vector operations for each word position. The
document's language is the one with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillon.llm.common import RUN_BYTES, claim, held_out, mix, pieces_of, small_batches, table

#: Bounds of the training sample: documents of each language (expected) and distinct words of each language.
TRAIN_DOCS = 2000
TRAIN_WORDS = 20_000
SLOTS = 1 << 17
ORDERS = {1: 0.3, 2: 0.6, 3: 1.0, 4: 1.0, 0: 0.5}
SMOOTH = 0.5
#: Price of a change of language, in nats; most that one word can speak for or against a language.
SWITCH = 12.0
CLIP = 10.0
#: Words that are scored at once.
SCORED = 16_384
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.02
LETTERS = regex.compile(r"\p{L}+")
#: First code points of script ranges (Unicode blocks), each up to the next one; fixed values.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def grams(words: list[str], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words: slot, weight and word of each; and each word's first letter's script."""
    padded = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    within = np.arange(len(codes)) - starts[word]
    factor = np.uint64(0x9E3779B97F4A7C15)
    slot, weight, owner = [], [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3, 4):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        rolling = (rolling + shifted) * factor
        inside = within + n <= lengths[word]
        slot.append((mix(rolling[inside] + np.uint64(n)) % np.uint64(slots)).astype(np.int64))
        weight.append(np.full(len(slot[-1]), ORDERS[n]))
        owner.append(word[inside])
    positional = codes * mix(within.astype(np.uint64) + np.uint64(7))
    whole = np.add.reduceat(positional, starts) if len(words) else np.zeros(0, np.uint64)
    slot.append((mix(whole) % np.uint64(slots)).astype(np.int64))
    weight.append(np.full(len(words), ORDERS[0]))
    owner.append(np.arange(len(words)))
    first = codes[starts + 1].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    return np.concatenate(slot), np.concatenate(weight), np.concatenate(owner), SCRIPT_OF[np.searchsorted(STARTS, first, "right") - 1]


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # slots x languages
    uses: np.ndarray  # scripts x languages

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages: relative log scores, 0 for the best, clipped."""
        slot, weight, owner, script = grams(words, len(self.logs))
        total = np.stack([np.bincount(owner, weight * self.logs[slot, k], len(words)) for k in range(len(self.langs))], 1)
        uses = self.uses[script]
        uses = np.where(uses.any(1, keepdims=True), uses, True)
        total = np.where(uses, total, -np.inf)
        return np.maximum(total - total.max(1, keepdims=True), -CLIP).astype(np.float32)


def fit(counts: list[tuple[str, str, int]]) -> Model:
    """From (lang, word, count)."""
    langs = sorted({lang for lang, _, _ in counts})
    logs = np.zeros((SLOTS, max(1, len(langs))), np.float32)
    uses = np.zeros((len(NAMES), max(1, len(langs))), bool)
    for k, lang in enumerate(langs):
        own = sorted((w, c) for x, w, c in counts if x == lang)
        words, n = [w for w, _ in own], np.array([c for _, c in own], float)
        # a square root keeps frequent words from being the whole model
        slot, _, owner, script = grams(words)
        seen = np.bincount(slot, np.sqrt(n)[owner], SLOTS) + SMOOTH
        logs[:, k] = np.log(seen / seen.sum())
        letters = np.bincount(script, n * [len(w) for w in words], len(NAMES))
        uses[:, k] = letters >= SCRIPT_SHARE * letters.sum()
    return Model(langs, logs, uses)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS) -> Model:
    """From rows (text, lang) with a lang and text; a hash of the text picks about train_docs of each language."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    rates = {r.lang: min(1.0, train_docs / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not rates:
        return fit([])
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    ranked = words.groupBy("lang", "word").count().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word")))
    return fit([(r.lang, r.word, r["count"]) for r in ranked.where(F.col("rank") <= train_words).collect()])


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of all words of several texts that follow each other in scores (words x languages)."""
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    k = scores.shape[1]
    moved = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.uint8 if k < 256 else np.int32)
    longest = int(sizes[0]) if len(sizes) else 0
    # texts that still have a word at position t are the first active[t]
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    state = np.zeros((len(sizes), k), np.float32)
    for t in range(longest):
        n = active[t]
        at = starts[:n] + t
        if t:
            own = state[:n]
            best = own.argmax(1)
            top = own[np.arange(n), best][:, None] - switch
            moved[at] = own < top
            came[at] = best
            np.maximum(own, top, out=own)
        state[:n] += scores[at]
        state[:n] -= state[:n].max(1, keepdims=True)
    label = np.zeros(len(scores), np.int64)
    current = state.argmax(1) if k else np.zeros(len(sizes), np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        label[at] = current[:n]
        if t:
            current[:n] = np.where(moved[at, current[:n]], came[at], current[:n])
    return label


class Labeller:
    """Words of texts to labels. Words of earlier runs keep their scores, up to KNOWN of them, in Arrow and numpy arrays."""

    KNOWN = 300_000

    def __init__(self, model: Model):
        self.model, self.rows, self.known = model, np.zeros((0, len(model.langs)), np.float32), pa.array([], pa.string())

    def _scores(self, words: pa.Array) -> np.ndarray:
        """Scores of distinct words."""
        place = pc.index_in(words, value_set=self.known) if len(self.known) else pa.nulls(len(words), pa.int32())
        missing = words.filter(place.is_null())
        # a few words at once: their n-grams take far more room than they do
        new = [self.model.scores(missing.slice(i, SCORED).to_pylist()) for i in range(0, len(missing), SCORED)]
        at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.rows) + np.arange(len(missing))
        rows = np.concatenate([self.rows, *new])
        room = self.KNOWN - len(self.known)
        if room > 0 and len(missing):
            self.known = pa.concat_arrays([self.known, missing.slice(0, room)])
            self.rows = rows[: len(self.known)].copy()
        return rows[at]

    def label(self, texts: list[str | None], spans: bool = False) -> list[tuple[str, float, list | int]]:
        """(lang, score, spans or their number) of each text."""
        best, score, found = self.numbered(pa.array(texts, pa.string()), spans)
        return [(self.model.langs[k] if k >= 0 else "und", float(x), f) for k, x, f in zip(best, score, found)]

    def numbered(self, texts: pa.Array, spans: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | list]:
        """Of each text the number of its language (-1: no letter), its share of the letters, and its number of runs of one
        language, or, if asked for, the runs: (first character, end, lang)."""
        texts = texts.cast(pa.string()).fill_null("")
        if spans:
            places = [[m.span() for m in LETTERS.finditer(t.as_py())] for t in texts]
            words = pa.array([t.as_py()[a:b].lower() for t, own in zip(texts, places) for a, b in own], pa.string())
            lengths = np.fromiter(map(len, places), np.int64, len(places))
        else:
            lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"\P{L}+")
            words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
            real = pc.greater(pc.binary_length(words), 0)
            count = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
            lengths = np.diff(count[offsets - offsets[0]])
            words = words.filter(real)
        n, k = len(texts), len(self.model.langs)
        if not k or not len(words):
            return np.full(n, -1), np.zeros(n), [[]] * n if spans else np.zeros(n, np.int64)
        coded = words.dictionary_encode()
        index = np.asarray(coded.indices)
        letters = np.asarray(pc.utf8_length(coded.dictionary))
        label = viterbi(self._scores(coded.dictionary)[index], lengths)
        owner = np.repeat(np.arange(n), lengths)
        votes = np.bincount(owner * k + label, letters[index], n * k).reshape(n, k)
        total = votes.sum(1)
        best = np.where(total > 0, votes.argmax(1), -1)
        score = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0.0)
        if spans:
            ends = np.cumsum(lengths)
            return best, score, [_spans(own, label[b - len(own) : b], self.model.langs) for own, b in zip(places, ends)]
        moved = np.flatnonzero((label[1:] != label[:-1]) & (owner[1:] == owner[:-1]))
        return best, score, np.bincount(owner[moved], minlength=n) + (lengths > 0)


def _spans(places: list[tuple[int, int]], labels: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for (a, b), k in zip(places, labels):
        if out and out[-1][2] == langs[k]:
            out[-1] = (out[-1][0], b, langs[k])
        else:
            out.append((a, b, langs[k]))
    return out


def _predict(model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        labeller = Labeller(model.value)
        for batch in batches:
            for part in pieces_of(batch, RUN_BYTES):
                best, score, found = labeller.numbered(part.column("text"), with_spans)
                names = pa.array([*labeller.model.langs, "und"])
                columns = list(part.columns) + [names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score)]
                if with_spans:
                    columns.append(pa.array([[{"first": a, "end": b, "lang": x} for a, b, x in own] for own in found], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                else:
                    columns.append(pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """docs (any columns, with text) and lang_pred, score, and spans (array of first, end, lang) or n_spans, as last columns.

    Null text, and text without a letter, is `und` with score 0 and no spans. score: the share of the text's letters in
    lang_pred's spans. Ties go to the first language by name. Existing columns called like the new ones are replaced.
    """
    new = ["lang_pred", "score", "spans" if with_spans else "n_spans"]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    small_batches(docs.sparkSession)
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields)]
    n = len(kept)
    fields += [f"c{n} string", f"c{n + 1} double", f"c{n + 2} " + ("array<struct<first:int,end:int,lang:string>>" if with_spans else "int")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: SLOTS x languages
    return rows.mapInArrow(_predict(shared, with_spans), ", ".join(fields)).toDF(*kept, *new)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, any others) whose language can be told, with all their columns, whatever these are called.

    Null and empty texts and those without a letter go. Every other text is judged whole, however long, and stays, however evenly its
    languages are mixed; each of several equal rows is judged and kept or not alike. An empty table, and one without a labelled text to
    learn from, gives an empty result.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    columns = docs.columns
    names = ["text" if c == "text" else f"k{i}" for i, c in enumerate(columns)]
    found = identify(docs.toDF(*names), model).where("lang_pred <> 'und'")
    return found.select(*names).toDF(*columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
