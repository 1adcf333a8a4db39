"""Each stage of the pipeline against a brute-force version, on what the stage before has written."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gristmill.llm import packing, suffix_dedup, tokens, toxicity

from .helpers import odd_rows
from .test_exact import brute_contamination, brute_removed
from .test_similarity import brute_kept

TABLES = "/root/testdata/sf0.001"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with odd rows among the documents and some of them labelled and in the benchmark."""
    top = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = spark.createDataFrame([(None if d is None else d + 100_000, t, lang, source, n) for d, t, lang, source, n, *_ in odd_rows()], docs.schema)
    docs.unionByName(odd).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    items = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    more = [(None, odd_rows()[16][1]), (900, " ".join(odd_rows()[26][1].split()[50:70])), (901, None)]
    items.unionByName(spark.createDataFrame(more, items.schema)).write.parquet(f"{top}/benchmark.parquet")
    return str(top)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """(rows before, rows after) of each stage."""
    top, found, docs = tmp_path_factory.mktemp("stages"), {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        found[name] = (docs.collect(), after.collect())
        assert name == NAMES[-1] or after.columns == corpus_pipeline.COLUMNS
        docs = after
    return found


def test_stages_are_the_named_ones():
    assert NAMES == ["toxicity", "simhash", "suffix", "benchmark", "packing"]


def test_toxicity_stage(spark, folder, steps):
    before, after = steps["toxicity"]
    labels = Counter()
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        labels[r.doc_id] = max(labels[r.doc_id], r.toxic)
    import zlib

    known = sorted((r.doc_id, r.text or "") for r in before if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    model = toxicity.fit([t for _, t in known], [int(labels[d] > 0) for d, _ in known])
    near = [r for r in before if abs(model.score(r.text) - toxicity.THRESHOLD) < 1e-6]
    assert not near and Counter(after) == Counter(r for r in before if model.score(r.text) < toxicity.THRESHOLD)


def test_simhash_stage(steps):
    before, after = steps["simhash"]
    kept = brute_kept([(r.doc_id, r.text) for r in before])
    assert {(r.doc_id, r.text) for r in after} == kept and set(after) <= set(before)


def test_suffix_stage(spark, steps):
    before, after = steps["suffix"]
    want = brute_removed(spark, [(r.doc_id, r.text) for r in before], suffix_dedup.LENGTH)
    out = Counter()
    for r in before:
        b, gone = want[r.doc_id, r.text or ""]
        starts = [i for i in range(len(b)) if b[i] & 0xC0 != 0x80]
        ends = [*starts[1:], len(b)][: len(starts)]
        text = b"".join(b[i:j] for i, j in zip(starts, ends, strict=True) if not gone[i:j].all()).decode()
        if not gone.any() or text:
            out[r.doc_id, r.lang, r.source, r.n_chars if not gone.any() else len(text), text] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, r.text or "") for r in after) == out


def test_benchmark_stage(spark, folder, steps):
    before, after = steps["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in before if not next(iter(brute_contamination([(r.doc_id, r.text)], items, 10)))[-1]]
    assert Counter(after) == Counter(clean) and len(clean) < len(before)


def test_packing_stage(steps):
    before, after = steps["packing"]
    encode, want = tokens.encoder(), Counter()
    for r in before:
        want.update((r.doc_id, k, at, n) for k, (at, n) in enumerate(packing.cut(len(encode(r.text or "")) + 1, packing.CAPACITY)))
    assert Counter((p.doc_id, p.piece, p.start, p.length) for p in after) == want
    room = Counter()
    for p in after:
        room[p.sequence_id] += p.length
    lengths = np.bincount([p.length for p in after], minlength=packing.CAPACITY + 1)
    assert max(room.values()) <= packing.CAPACITY and len(room) <= packing.lower_bound(lengths, packing.CAPACITY) + 1


def test_pipeline_of_nothing(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{TABLES}/{table}.parquet").where("false").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
