"""Language identification of code-switched text with a linear-chain conditional random field.

Words are labelled with languages. A word's features are itself (the lexicon of the training words), its affixes and the n-grams of its letters, hashed
into BUCKETS; transitions between labels are learned with them. Training chains are made from labelled documents of
different languages in turns, so switches are seen. Forward-backward over chains of CHAIN words gives each word's marginals;
a text's language is the label with the largest sum of them, its score the mean marginal.

The model is fitted on the driver on a bounded sample, whatever the size of the table: at most SAMPLE distinct documents a language, those of the smallest hash of doc_id and text,
and of a longer one CHARACTERS in a row from a place that the hash names. It is broadcast; all texts are read whole, row by row, without a shuffle. Words recur, so their
weights are kept in each worker from task to task.

NULL texts and texts without a letter are ``und`` with score 0. NULL languages are not learned from; with no learned language every text is ``und``. NULL and repeated
doc_ids get a row each. Ties go to the alphabetically first language. An empty table gives an empty result; other columns are ignored. A very long text
is many chains, worked on a few at a time.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, remainder, slices

SAMPLE, FOLDS, BUCKETS, CHAIN, BATCH, EPOCHS = 400, 5, 1 << 17, 128, 512, 3
#: Characters a language's sample text has at most, and a labelled unit.
CHARACTERS, UNIT = 4000, 24
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; digits of other kinds (fractions, exponents) count inside a run, but make none.

    A run of more than UNIT characters, as in scripts without blanks, is cut into units of so many, each labelled on its own.
    """
    found = [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if all(len(w) <= UNIT for w in found):
        return found
    return [w[k : k + UNIT] for w in found for k in range(0, len(w), UNIT)]


def features(word: str) -> list[int]:
    """Buckets of the word, its first and last 1 to 5 bytes, and its 2-grams and 3-grams of bytes with ends marked."""
    crc, whole = zlib.crc32, word.encode()
    marked = b"^" + whole + b"$"
    found = [crc(whole, 1)]
    found += [crc(whole[:k], 2) for k in range(1, 6)] + [crc(whole[-k:], 3) for k in range(1, 6)]
    found += [crc(marked[i : i + 2], 4) for i in range(len(marked) - 1)] + [crc(marked[i : i + 3], 5) for i in range(len(marked) - 2)]
    return [x % BUCKETS for x in found]


def smoothed(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, learning: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: marginals (chain, place, label), expected transitions (label, label), and the log partition of each chain.

    Chains are padded at the end; scaled probabilities keep the sums in range.
    """
    chains, places, labels = scores.shape
    top = scores.max(axis=2)
    # Places lead, so that each step works on memory in a row.
    potential = np.ascontiguousarray(np.exp(scores - top[:, :, None]).transpose(1, 0, 2))
    step, whole = np.exp(transitions), int(lengths.min()) if chains else 0
    live = np.arange(places)[:, None] < lengths[None, :]
    forward, backward, scale = np.empty_like(potential), np.empty_like(potential), np.ones((places, chains, 1))
    a = potential[0] * np.exp(start)
    for t in range(places):
        if t:
            a = (forward[t - 1] @ step) * potential[t]
        c = a.sum(axis=1, keepdims=True)
        if t >= whole and t:
            c = np.where(live[t, :, None], c, 1)
            a = np.where(live[t, :, None], a, forward[t - 1])
        forward[t], scale[t] = a / c, c
    backward[-1:] = 1
    back = np.ascontiguousarray(step.T)
    for t in range(places - 2, -1, -1):
        b = (potential[t + 1] * backward[t + 1] / scale[t + 1]) @ back
        backward[t] = np.where(live[t + 1, :, None], b, 1) if t + 1 >= whole else b
    marginal = forward * backward
    marginal /= marginal.sum(axis=2, keepdims=True)
    marginal = (marginal * live[..., None]).transpose(1, 0, 2)
    if not learning:
        return marginal, step, top[:, 0]
    after = potential[1:] * backward[1:] / scale[1:] * live[1:, :, None]
    expected = np.einsum("tca,tcb->ab", forward[:-1], after) * step
    logs = (np.log(scale[..., 0]) * live).sum(axis=0) + (top * live.T).sum(axis=1)
    return marginal, expected, logs


def chains(words: list[int], length: int) -> np.ndarray:
    """Word numbers in rows of ``length``, -1 at the end."""
    rows = -(-len(words) // length)
    out = np.full(rows * length, -1, np.int64)
    out[: len(words)] = words
    return out.reshape(rows, length)


class Words:
    """Numbers for the words met, and what each weighs."""

    def __init__(self, weights: np.ndarray, most: int = 300_000):
        self.weights, self.most = weights, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, self.weights.shape[1]), self.weights.dtype)

    def look(self, words: list[str]) -> list[int]:
        number = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in number]
        if fresh:
            at = len(number)
            lists = [features(w) for w in fresh]
            lengths = np.array([len(x) for x in lists])
            flat = np.array([x for every in lists for x in every], np.int64)
            sums = np.add.reduceat(self.weights[flat], np.cumsum(lengths) - lengths, axis=0)
            if at + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(len(fresh), len(self.scores)), self.weights.shape[1]), self.weights.dtype)])
            self.scores[at : at + len(fresh)] = sums
            number.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return [number[w] for w in words]


class Model:
    """Learned languages, feature weights, transitions and start scores."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.transitions, self.start = languages, weights, transitions, start
        self.words = Words(weights)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """(words, languages) for each list of words."""
        rows, owner = [], []
        if len(self.words.number) > self.words.most:
            self.words.clear()
        numbers, at = self.words.look([w for words in texts for w in words]), 0
        for i, words in enumerate(texts):
            c = chains(numbers[at : at + len(words)], CHAIN)
            at += len(words)
            rows.append(c)
            owner += [i] * len(c)
        every = np.concatenate(rows) if rows else np.empty((0, CHAIN), np.int64)
        found = np.empty((*every.shape, len(self.languages)))
        order = np.argsort((every >= 0).sum(axis=1), kind="stable")
        for at in range(0, len(every), BATCH):
            part = order[at : at + BATCH]
            lengths = (every[part] >= 0).sum(axis=1)
            most = int(lengths.max())
            found[part, :most] = smoothed(self.words.scores[every[part, :most]], lengths, self.transitions, self.start, False)[0]
        out, at = [], 0
        for words, c in zip(texts, rows, strict=True):
            out.append(found[at : at + len(c)].reshape(-1, len(self.languages))[: len(words)])
            at += len(c)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        out = []
        for words, marginal in zip(split, self.marginals(split), strict=True):
            if not words:
                out.append(("und", 0.0))
                continue
            share = marginal.sum(axis=0) / len(words)
            k = int(share.argmax())
            out.append((self.languages[k], float(min(max(share[k], 0.0), 1.0))))
        return out


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = EPOCHS, ridge: float = 1e-6) -> Model:
    """Weights by stochastic gradient of the conditional likelihood, with a rate for each weight that falls with its past gradients."""
    languages = sorted(set(langs))
    k = len(languages)
    weights, transitions, start = np.zeros((BUCKETS, max(k, 1))), np.zeros((k, k)), np.zeros(k)
    if k < 2:
        return Model(languages, weights[:, :k], transitions, start)
    random, code = np.random.default_rng(seed), {x: i for i, x in enumerate(languages)}
    number: dict[str, int] = {}
    lists: list[list[int]] = []
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    open_words: list[int] = []
    open_labels: list[int] = []
    # Runs of 8 to 64 words of each text in turn: a chain holds several languages.
    parts: list[tuple[list[str], int]] = []
    for text, lang in zip(texts, langs, strict=True):
        words, at = words_of(text), 0
        while at < len(words):
            n = int(random.integers(8, 65))
            parts.append((words[at : at + n], code[lang]))
            at += n
    for i in random.permutation(len(parts)):
        words, label = parts[i]
        for w in words:
            if w not in number:
                number[w] = len(number)
                lists.append(features(w))
        open_words += [number[w] for w in words]
        open_labels += [label] * len(words)
        while len(open_words) >= CHAIN:
            rows.append((np.array(open_words[:CHAIN]), np.array(open_labels[:CHAIN])))
            del open_words[:CHAIN], open_labels[:CHAIN]
    if open_words:
        pad = CHAIN - len(open_words)
        rows.append((np.array(open_words + [-1] * pad), np.array(open_labels + [0] * pad)))
    del parts
    lengths = np.array([len(x) for x in lists])
    flat, at = np.array([x for every in lists for x in every], np.int64), np.cumsum(lengths) - lengths
    del lists
    past, past_t, past_s = np.full(weights.shape, 1e-8), np.full(transitions.shape, 1e-8), np.full(k, 1e-8)
    words, labels = (np.stack(x) for x in zip(*rows, strict=True))
    for epoch in range(epochs):
        order = random.permutation(len(words))
        for low in range(0, len(words), 64):
            part = order[low : low + 64]
            w, y = words[part], labels[part]
            live = w >= 0
            met, index = np.unique(w[live], return_inverse=True)
            spans = [np.arange(at[m], at[m] + lengths[m]) for m in met]
            size = lengths[met]
            columns = flat[np.concatenate(spans)]
            score = np.add.reduceat(weights[columns], np.cumsum(size) - size, axis=0)
            scores = np.zeros((*w.shape, k))
            scores[live] = score[index]
            marginal, expected, _ = smoothed(scores, live.sum(axis=1), transitions, start)
            true = np.eye(k)[y] * live[..., None]
            error = (marginal - true)[live]
            by_word = np.stack([np.bincount(index, error[:, j], len(met)) for j in range(k)], axis=1)
            used, back = np.unique(columns, return_inverse=True)
            spread = np.repeat(by_word, size, axis=0)
            g = np.stack([np.bincount(back, spread[:, j], len(used)) for j in range(k)], axis=1) / len(part) + ridge * weights[used]
            past[used] += g * g
            weights[used] -= 0.15 * g / np.sqrt(past[used])
            seen = np.einsum("cta,ctb->ab", true[:, :-1] * live[:, 1:, None], true[:, 1:])
            g_t, g_s = (expected - seen) / len(part), (marginal[:, 0] - true[:, 0]).mean(axis=0)
            past_t, past_s = past_t + g_t * g_t, past_s + g_s * g_s
            transitions -= 0.1 * g_t / np.sqrt(past_t)
            start -= 0.1 * g_s / np.sqrt(past_s)
    return Model(languages, weights, transitions, start)


def held_out(doc_id: str, folds: int = FOLDS) -> Column:
    return remainder(doc_id, folds) == 0


def train(docs: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    """A model from at most ``sample`` documents a language; of a longer one, ``characters`` from a place that its hash names."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"))
    # What is broadcast here, a count and ``sample`` hashes a language, is a hundredth of the model, which has BUCKETS weights a language and is broadcast too.
    # A cut by hash leaves little more than the sample of each language, so no language's rows meet in one task; the smallest of these are taken.
    # Repeated rows are one here, or they would crowd the others of their language out.
    unlike = durable(rows.select("lang", "h").distinct())
    counts = unlike.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned("h", 1).cast("double") / F.lit(float(1 << 63))
    # Chance leaves fewer than the sample only where there is hardly more; 8 sqrt(sample) are some eight standard deviations.
    near = unlike.join(F.broadcast(counts), "lang").where(place < F.lit(sample + 8.0 * (sample**0.5 + 4)) / F.col("n")).select("lang", "h")
    few = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))).where(F.col("k") <= sample).select("lang", "h")
    span = F.greatest(F.lit(1), F.length("text") - characters + 1)
    chosen = rows.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", F.substring("text", F.pmod(F.xxhash64("h"), span).cast("int") + 1, F.lit(characters)).alias("text"))
    found = chosen.dropDuplicates(["lang", "h"]).sort("lang", "h").collect()
    return fit([r.text for r in found], [r.lang for r in found])


_models: dict[str, Model] = {}


def _sent(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, (model.languages, model.weights.astype(np.float32), model.transitions, model.start)))


def _kept(known: Broadcast) -> Model:
    """A worker's model, with the words it has met; the last one stays for the tasks to come."""
    name, parts = known.value
    if name not in _models:
        _models.clear()
        _models[name] = Model(*parts)
    return _models[name]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    known = _sent(docs, model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _kept(known)
        for batch in slices(batches, 1, 1 << 20):
            found = judge.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(scan, SCHEMA)


def switches(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and runs of each row: which language each run of words (units) is in, as array of (first, last, lang), counted from 0; none without a letter."""
    known = _sent(docs, model)
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _kept(known)
        for batch in slices(batches, 1, 1 << 20):
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            out = []
            for found in judge.marginals(split) if judge.languages else [np.empty((0, 0))] * len(split):
                best = found.argmax(axis=1) if len(found) else np.empty(0, np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
                out.append([{"first": a, "last": b - 1, "lang": judge.languages[int(best[a])]} for a, b in zip(cuts, cuts[1:], strict=False) if b > a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, schema.types[1])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, runs array<struct<first:int,last:int,lang:string>>")
