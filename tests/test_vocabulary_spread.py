from __future__ import annotations

import random

import pyarrow as pa
import pytest

from gristmill.operators import vocabulary
from gristmill.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_all_merges_however_many_pieces_are_distinct(spark, monkeypatch):
    want, _ = vocabulary.train(registry.QUERIES["piece_counts"](spark, SMALL), 256 + 100 + 15, 15)
    monkeypatch.setattr(vocabulary.train, "__defaults__", (64, 2))  # the driver's way stops at three pieces
    got = registry.QUERIES["vocabulary_merges"](spark, SMALL).sort("n").collect()
    assert [(bytes.fromhex(r.first), bytes.fromhex(r.second)) for r in got] == want and len(want) == 100


def plain(weighed, learned):
    pieces, merges = [[list(p.encode()), n] for p, n in weighed], []
    for k in range(learned):
        seen = {}
        for ids, n in pieces:
            for pair in zip(ids, ids[1:], strict=False):
                seen[pair] = seen.get(pair, 0) + n
        if not seen:
            return merges
        best = min(seen, key=lambda p: (-seen[p], p))
        merges.append(best)
        for piece in pieces:
            ids, out = piece[0], []
            while ids:
                whole = tuple(ids[:2]) == best
                out.append(256 + k if whole else ids[0])
                ids = ids[2 if whole else 1 :]
            piece[0] = out
    return merges


@pytest.mark.parametrize("seed", range(60))
def test_certain_merges_are_those_of_a_plain_loop(seed):
    rng = random.Random(seed)
    letters = "abcdefgh\u00e9\u20ac"[: rng.choice([2, 4, 10])]
    weighed = [(p, rng.choice([1, 1, 2, 7, 100])) for p in {"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.choice([3, 30, 200]))}]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in weighed]), pa.array([n for _, n in weighed], pa.int64())], ["piece", "n"])

    def count(merges):
        return [tuple(r.values()) for b in vocabulary.pair_counter(merges)(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist()]

    want = plain(weighed, 40)
    assert vocabulary.learn(count, len(want)) == want
    if len(want) < 40:
        with pytest.raises(ValueError, match=f"only {len(want)} of 40"):
            vocabulary.learn(count, 40)


def test_no_pieces_no_merges(spark):
    none = spark.createDataFrame([("a", 3)], "piece string, n long")
    assert vocabulary.train_spread(none, 256 + 20, 20)[0] == []
    with pytest.raises(ValueError, match="only 0 of 1"):
        vocabulary.train_spread(none, 256 + 1 + 20, 20)
