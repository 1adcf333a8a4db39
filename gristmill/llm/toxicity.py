"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over words and word beginnings that are present in a text. For every labelled text that names a group,
identity terms are swapped for others of their kind, among them neutral ones, and the squared change of the score is part of the loss.
So a mention of a group by itself moves the score as little as the word "person" does, even if labels and mentions go together.

The model is fitted on a bounded sample, at most SAMPLE labelled rows, those of the smallest hash of doc_id, whatever the size of the table. The executors count features and
turn the sample's texts into lists of the FEATURES chosen; only these reach the driver, at most FEATURES numbers a row, whatever the texts' length. A text that names a group
has VERSIONS swapped versions at most. The model is a few thousand weights, which are broadcast. All texts are scored whole, row by row, without a shuffle.

NULL and empty texts get the score of a text without known words. NULL labels, and labels without a document, are not learned from; a doc_id with several labels counts as toxic if any
says so. NULL and repeated doc_ids get a row each. Without labels of both kinds the score of every text is the share of
toxic labels (0 if there are none). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, fresh, remainder, slices

SAMPLE, FEATURES, RARE, LEAST_GAIN, THRESHOLD, FOLDS = 10_000, 4000, 4, 8.0, 0.3, 4
#: Swapped versions of a text, and letters of a feature.
VERSIONS, LONGEST = 4, 64
#: Terms of one kind in one language; the first ones are neutral. Each is swapped for the others of its line.
IDENTITIES = (
    "person people someone woman women man men girl boy transgender lesbian gay bisexual straight queer",
    "person people someone muslim christian jewish jew hindu buddhist atheist catholic",
    "person people someone black white asian african european american arab latino indigenous immigrant refugee foreigner",
    "person people someone disabled blind deaf autistic old young",
    "personne gens femme femmes homme hommes musulman chrétien juif noir blanc asiatique arabe immigré étranger homosexuel",
    "mensch leute frau frauen mann männer muslim christ jude schwarzer weißer asiate araber migrant ausländer homosexueller",
    "persona gente mujer mujeres hombre hombres musulmán cristiano judío negro blanco asiático árabe inmigrante extranjero homosexual",
)
WORD = re.compile(r"\w+")


def swaps() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in IDENTITIES:
        terms = line.split()
        for t in terms:
            found.setdefault(t, []).extend(x for x in terms if x != t and x not in found.get(t, ()))
    return found


def features(word: str) -> list[str]:
    """The word (a very long one by its checksum), and its beginnings of four to eight letters."""
    return [word if len(word) <= LONGEST else f"#{hashlib.md5(word.encode()).hexdigest()}", *(word[:k] + "*" for k in range(4, min(len(word), 9)))]


@dataclass
class Model:
    """Weights by feature, and what the features of a word weigh, as met."""

    bias: float
    weights: dict[str, float]
    met: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        total: dict[str, float] = {}
        met, weights = self.met, self.weights
        for w in set(WORD.findall((text or "").lower())):
            found = met.get(w)
            if found is None:
                found = met[w] = tuple((f, weights[f]) for f in features(w) if f in weights)
            if found:
                total.update(found)
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, self.bias + sum(sorted(total.values())))))))


def _words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _present(words: Iterable[str], index: dict[str, int]) -> list[int]:
    return sorted({index[f] for w in words for f in features(w) if f in index})


def _vectors(text: str, index: dict[str, int], other: dict[str, list[str]], fairness: float) -> tuple[list[int], list[tuple[list[int], list[int]]]]:
    """Columns of the features in a text, and of each swapped version those it loses and those it gains; VERSIONS at most, the neutral term first, then others of the kind."""
    words = _words(text)
    own = _present(words, index)
    named, changes = sorted(w for w in words if w in other), []
    for k in range(min(VERSIONS, max((len(other[w]) for w in named), default=0))) if fairness else ():
        swapped = set(_present((words - set(named)) | {other[w][k * 3 % len(other[w])] for w in named}, index))
        changes.append((sorted(set(own) - swapped), sorted(swapped - set(own))))
    return own, changes


def _gain(a: float, b: float, n1: float, n0: float) -> float:
    """How unevenly a feature is spread over the two kinds of text, as a log-likelihood ratio."""
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    return (a * np.log(a / e1) if a else 0.0) + (b * np.log(b / e0) if b else 0.0)


def _constant(y: np.ndarray) -> Model:
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
    return Model(float(np.log(share / (1 - share))), {})


def fit(texts: list[str], labels: list[int], most: int = FEATURES, ridge: float = 2e-4, fairness: float = 2.0, steps: int = 400) -> Model:
    """A model from texts at hand. ``fairness`` weighs the penalty on score changes under a swap; 0 turns it off."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return _constant(y)
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for text, label in zip(texts, labels, strict=True):
        seen[label].update({f for w in _words(text) for f in features(w)})
    n1 = y.sum()
    gains = sorted(((_gain(seen[1][f], seen[0][f], n1, len(y) - n1), f) for f in seen[0].keys() | seen[1].keys() if seen[1][f] + seen[0][f] >= RARE), reverse=True)
    chosen = [f for g, f in gains[:most] if g > LEAST_GAIN] + sorted(t for t in swaps() if seen[0][t] + seen[1][t])
    index, other = {f: i for i, f in enumerate(dict.fromkeys(chosen))}, swaps()
    return _descended(index, *zip(*(_vectors(t, index, other, fairness) for t in texts), strict=True), y, ridge, fairness, steps)


def _descended(index: dict[str, int], rows: Sequence[Sequence[int]], changes: Sequence[Sequence[tuple[Sequence[int], Sequence[int]]]], y: np.ndarray, ridge: float = 2e-4, fairness: float = 2.0, steps: int = 400) -> Model:
    """Weights by Adam over all rows at once: logistic loss, ridge, and the squared change of the score under each swap."""
    w, b = np.zeros(len(index)), float(np.log(y.sum() / (len(y) - y.sum())))
    lengths = np.array([len(r) for r in rows])
    at, column = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.array(r, np.int64) for r in rows])
    gone = [x for each in changes for x in each]
    p_at = np.repeat(np.arange(len(gone)), [len(a) + len(c) for a, c in gone])
    p_column = np.array([x for a, c in gone for x in (*a, *c)], np.int64)
    p_sign = np.array([x for a, c in gone for x in (*[1.0] * len(a), *[-1.0] * len(c))])
    first, second, first_b, second_b = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(at, w[column], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        g = np.bincount(column, error[at], len(w)) + ridge * w
        if len(gone):
            change = np.bincount(p_at, w[p_column] * p_sign, len(gone))
            g += fairness * np.bincount(p_column, change[p_at] * p_sign, len(w)) / len(gone)
        g_b = error.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        first_b, second_b = 0.9 * first_b + 0.1 * g_b, 0.999 * second_b + 0.001 * g_b * g_b
        rate, c1, c2 = 0.05 * (1 - step / (steps + 1)), 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (first / c1) / (np.sqrt(second / c2) + 1e-12)
        b -= rate * (first_b / c1) / (np.sqrt(second_b / c2) + 1e-12)
    return Model(float(b), {f: float(w[i]) for f, i in index.items() if w[i]})


def held_out(doc_id: str, folds: int = FOLDS) -> Column:
    return remainder(doc_id, folds) == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = 2.0) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out, ``sample`` of them at most."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("_id")), "_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # A text per doc_id, the smallest of repeated ones. Texts stay on the executors; the driver gets FEATURES features and, of each row, which of them it has.
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")))
    n1, n = rows.agg(F.coalesce(F.sum((F.col("_toxic") > 0).cast("int")), F.lit(0)), F.count("*")).head()
    if not 0 < n1 < n:
        return _constant(np.array([1.0] * n1 + [0.0] * (n - n1)))
    other = swaps()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update({f for w in _words(text) for f in features(w)})
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([seen[k][f] for f in every], pa.int64()) for k in (0, 1))], ["f", "n0", "n1"])

    counts = durable(rows.select("_text", "_toxic").mapInArrow(counted, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    both = F.col("n0") + F.col("n1")
    part = lambda count, of: F.when(F.col(count) > 0, F.col(count) * F.log(F.col(count) * F.lit(float(n)) / (both * F.lit(float(of))))).otherwise(0.0)
    gained = counts.where(both >= RARE).withColumn("g", part("n1", n1) + part("n0", n - n1)).where(F.col("g") > LEAST_GAIN)
    best = [r.f for r in gained.orderBy(F.desc("g"), F.desc("f")).limit(FEATURES).collect()]
    named = [r.f for r in counts.where(F.col("f").isin(*other)).orderBy("f").collect()]
    index = {f: i for i, f in enumerate(dict.fromkeys(best + named))}
    known = docs.sparkSession.sparkContext.broadcast(index)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int16())
        for batch in slices(batches, 2):
            found = [_vectors(t, known.value, other, fairness) for t in batch.column(2).to_pylist()]
            lost, gained = ([[c[k] for c in changes] for _, changes in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own for own, _ in found], ints), pa.array(lost, pa.list_(ints)), pa.array(gained, pa.list_(ints))], ["_id", "_toxic", "own", "lost", "gained"])

    made = rows.select("_id", "_toxic", "_text").mapInArrow(vectors, "_id long, _toxic int, own array<short>, lost array<array<short>>, gained array<array<short>>").sort("_id").toArrow()
    labels_ = (np.array(made["_toxic"]) > 0).astype(np.float64)
    changes = [list(zip(a, b, strict=True)) for a, b in zip(made["lost"].to_pylist(), made["gained"].to_pylist(), strict=True)]
    discard(rows, counts)
    return _descended(index, made["own"].to_pylist(), changes, labels_, fairness=fairness)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, rejected: bool | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; or, with ``rejected``, the rows of ``docs`` themselves on that side of the threshold."""
    known = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    if rejected is not None:
        judge = _judge(known)
        flagged = docs.withColumn(fresh(docs.columns, "_text"), F.coalesce(F.col("text").cast("string"), F.lit("")))
        schema = docs.schema

        def filtered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, batch_text):
                verdict = pa.array([(s >= threshold) == rejected for s in judge(batch.column(batch_text).to_pylist())], pa.bool_())
                yield batch.select(list(range(batch_text))).filter(verdict)

        batch_text = len(docs.columns)
        return flagged.mapInArrow(filtered, schema)
    judge = _judge(known)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.array(judge(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def _judge(known: Broadcast) -> Callable[[list[str | None]], list[float]]:
    state: list[Model] = []

    def judge(texts: list[str | None]) -> list[float]:
        if not state:
            state.append(Model(*known.value))
        model = state[0]
        if len(model.met) > 400_000:
            model.met.clear()
        return [model.score(t) for t in texts]

    return judge
