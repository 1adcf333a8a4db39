from __future__ import annotations

import pyarrow as pa
import pytest

from gristmill.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bm25_saved_topk", "bm25_topk", "document_frequencies", "corpus_stats", "bm25_postings", "newest_hit"])
def test_workers_count_few_texts_at_a_time(spark, monkeypatch, name):
    """What the query gives to the workers cuts a batch of 4 MB before it counts the terms."""
    frame, steps = type(spark.range(1)), []
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: steps.append(f) or whole(self, f, *a, **b))
    registry.QUERIES[name](spark, SMALL)
    rows = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["word other word " * 700] * 400)], ["doc", "text"])
    assert steps
    for step in steps:
        sizes = [b.num_rows for b in step(iter([rows]))]
        assert max(sizes) < 120 and sum(sizes) == 400
