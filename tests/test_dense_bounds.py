from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gristmill.operators import dense


@pytest.mark.parametrize("cells", [1, 90, 1 << 20])
@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_a_task_sends_on_its_best_of_all_batches(monkeypatch, cells, kind, k):
    """Once a query, not once a batch; few scores are held at once, and ties go to the lesser doc."""
    monkeypatch.setattr(dense, "CELLS", cells, raising=False)
    rng = np.random.default_rng(3)
    rows, asked = rng.integers(-2, 3, (200, 4)).astype(float), rng.integers(-2, 3, (7, 4)).astype(float)
    docs = [kind(x) for x in rng.permutation(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[a : a + 60]), pa.array(list(rows[a : a + 60]))], ["doc", "vector"]) for a in range(0, 200, 60)]
    out = list(dense._block_search(SimpleNamespace(value=(list(range(10, 17)), asked)), k)(iter(batches)))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(10 + q, d, -s) for q in range(7) for s, d in sorted((-(rows @ asked[q])[i], docs[i]) for i in range(200))[:k]]
    assert sorted(got) == sorted(want)


def test_no_sound_vectors():
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[1.0], [float("nan"), 2.0]])], ["doc", "vector"])
    assert list(dense._block_search(SimpleNamespace(value=([1], np.ones((1, 2)))), 3)(iter([rows]))) == []
