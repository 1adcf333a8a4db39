"""Near-copies of the pipeline against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from gristmill.llm import similarity, simhash

from .helpers import DOCS, odd_rows


def brute_kept(rows):
    """(doc_id, text) that stay: the smallest doc_id of each component of pairs with Jaccard 0.8 or more; texts without words stay."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, (d, _), s in zip(label, rows, sets, strict=True):
        if s:
            least[x] = min(least.get(x, 1 << 63), (1 << 63) - 1 if d is None else d)
    return {(d, t) for x, (d, t), s in zip(label, rows, sets, strict=True) if not s or d is None and least[x] == (1 << 63) - 1 or d == least[x]}


@pytest.mark.parametrize(("small", "slots"), [(32, 1 << 20), (2, 1 << 20), (32, 4), (2, 4)])
def test_near_copies_against_all_pairs(spark, small, slots):
    crowd = [(1000 + i, " ".join(f"t{k}" if k != 3 * i else f"new{i}" for k in range(400)), None, None, 0, i, i, 0.0) for i in range(50)]
    chain = [(2000 + i, " ".join(f"c{k}" for k in range(5 * i, 5 * i + 100)), None, None, 0, i, i, 0.0) for i in range(12)]  # the ends are not similar
    far = [(3000 + i, " ".join([f"t{k}" for k in range(200)] + [f"f{i}x{k}" for k in range(100)]), None, None, 0, i, i, 0.0) for i in range(8)]
    rows = odd_rows() + crowd + chain + far
    got = simhash.near_dedup(spark.createDataFrame(rows, DOCS).repartition(3), small=small, slots=slots)
    assert {(r.doc_id, r.text) for r in got.collect()} == brute_kept([r[:2] for r in rows])
    assert simhash.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("members", [150, 300])
def test_a_group_of_near_copies_is_not_paired_off(spark, monkeypatch, members):
    """Texts with one to three changed words are one class, but few are similar to any given one: the pairs verified grow with the texts, not with their square."""
    rng, verify, looked_at = random.Random(3), similarity.verified, []
    rows = []
    for i in range(members):
        words = [f"w{k}" for k in range(150)]
        for at in rng.sample(range(5, 145), 1 + i % 3):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words), None, None, 0, i, i, 0.0))

    def counted(pairs, texts):
        looked_at.append(pairs.distinct().count())
        return verify(pairs, texts)

    monkeypatch.setattr(similarity, "verified", counted)
    got = simhash.near_dedup(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {(r.doc_id, r.text) for r in got.collect()} == brute_kept([r[:2] for r in rows])
    assert 0 < sum(looked_at) < 12 * members, looked_at


def test_sketches_rule_out_only_what_is_not_similar():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400, 5000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 63, int(n * rng.random() * 0.2), dtype=np.uint64)]))
            apart = int(np.bitwise_count(np.frombuffer(similarity.sketch(a), np.uint64) ^ np.frombuffer(similarity.sketch(b), np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b)) and (9 * apart <= len(a) + len(b) or not similarity.similar(a, b))


def test_no_near_copy_is_left_after_the_stages(spark):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, small)
    texts = docs.toPandas().sort_values("doc_id").text.tolist()
    sets = [similarity.shingles(t.encode()) if t else similarity.shingles(None) for t in texts]
    at = pd.DataFrame([(h, i) for i, s in enumerate(sets) for h in s.tolist()], columns=["h", "i"])
    met = {(i, j) for _, g in at[at.h.duplicated(keep=False)].groupby("h").i for i in g for j in g if i < j}
    assert not [(i, j) for i, j in met if similarity.similar(sets[i], sets[j])]
