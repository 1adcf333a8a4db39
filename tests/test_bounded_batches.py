from __future__ import annotations

import pyarrow as pa

from gristmill.functions import batches
from gristmill.operators import bm25


def test_parts_are_small_and_whole():
    texts = ["", None, "x" * 10, "y" * 2500, *["é" * 40] * 100, "", "z" * 999, "z"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    got = list(batches.parts(iter([rows.slice(0, 0), rows, rows.slice(3, 5)]), 1, 1000))
    assert [r for b in got for r in b.to_pylist()] == rows.to_pylist() + rows.slice(3, 5).to_pylist()
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) < 1000 + 2500 for b in got)
    assert len(got) > 8


def test_counting_holds_few_texts_at_a_time(spark, monkeypatch):
    """A batch of 4 MB used to be counted as one."""
    seen = []
    monkeypatch.setattr(bm25, "Counter", lambda terms: seen.append(1) or bm25_counter(terms))
    from collections import Counter as bm25_counter

    made = {}
    docs = spark.createDataFrame([], "doc long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.setdefault("count", f))
    bm25.counted(docs)
    rows = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["word other word " * 700] * 400)], ["doc", "text"])
    out = made["count"](iter([rows]))
    first = next(out)
    assert len(seen) < 120 and first.num_rows == len(seen)
    rest = list(out)
    assert first.num_rows + sum(b.num_rows for b in rest) == 400
    assert first.to_pylist()[0] == {"doc": 0, "len": 2100, "terms": ["word", "other"], "counts": [1400, 700]}
