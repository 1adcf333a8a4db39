"""Every registered query of the library against its SQL on the smallest tables; those without SQL against what must hold of them."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from gristmill.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def said(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(round(float(value), 6) + 0.0) if isinstance(value, int) else str(value)


def listed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(said(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = registry.QUERIES[name](spark, SMALL)
    want = tables.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert listed(got.columns, got.collect()) == listed(columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_passages_keep_every_word(spark):
    got = registry.QUERIES["passages_chunked"](spark, SMALL).collect()
    assert all(len(r.text.split()) < 120 for r in got)
    words = {}
    for r in sorted(got, key=lambda r: (r.id.partition(":")[0], int(r.id.rpartition(":")[2]))):
        words.setdefault(int(r.id.partition(":")[0]), []).extend(r.text.split())
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert words.get(r.doc_id, []) == r.text.split()


def test_sentences_keep_every_word(spark):
    words = {}
    for r in sorted(registry.QUERIES["split_sentences"](spark, SMALL).collect(), key=lambda r: (r.doc_id, r.n)):
        words.setdefault(r.doc_id, []).extend(r.sentence.split())
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert words.get(r.doc_id, []) == r.text.split()


def test_sampled_bytes_are_near_their_shares(spark):
    from gristmill.operators import selection

    rows = [(s, i, "x" * n) for s, count, n in (("big", 4000, 50), ("small", 4000, 25)) for i in range(count)]
    kept, report = selection.byte_share_sample(spark.createDataFrame(rows, "source string, id long, text string"), (selection.Share("big", 0.75), selection.Share("small", 0.25)), 40_000, 7)
    assert {r.source: abs(r.sampled_bytes - r.target_bytes) < 0.15 * r.target_bytes for r in report.collect()} == {"big": True, "small": True}
    assert kept.count() == sum(r.chunks for r in report.collect())
    with pytest.raises(ValueError, match="not enough"):
        selection.byte_share_sample(spark.createDataFrame(rows[:3], "source string, id long, text string"), (selection.Share("big", 1.0),), 40_000)


def test_systematic_sample_is_evenly_spread(spark):
    from gristmill.operators import selection
    from gristmill.sources import remote

    rows = spark.createDataFrame([(f"f{i:03}",) for i in range(53)], "path string")
    for count in (1, 7, 52, 53, None):
        got = {r.path for r in selection.systematic(rows, "path", count, 11).collect()}
        assert got == {f.path for f in remote.evenly([remote.RemoteFile(f"f{i:03}", 1, "") for i in range(53)], count, 11)}


def test_merges_are_those_of_a_plain_loop(spark):
    from gristmill.operators import vocabulary

    counts = [("hug", 10), ("pug", 5), ("pun", 12), ("bun", 4), ("hugs", 5)]
    merges, special = vocabulary.train(spark.createDataFrame(counts, "piece string, n long"), 256 + 3 + 20, 20)
    assert merges == [(b"u", b"g"), (b"u", b"n"), (b"h", b"ug")]
    assert len(special) == 20
    with pytest.raises(ValueError):
        vocabulary.train(spark.createDataFrame(counts, "piece string, n long"), 256 + 500 + 20, 20)


def test_index_on_disk_answers_as_texts_do(spark, tmp_path):
    from gristmill.operators import bm25

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("doc_id", "doc")
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    bm25.save(bm25.build(docs), str(tmp_path / "index"), 4)
    near = lambda df: sorted((r.query_id, r["rank"], r.doc, round(r.score, 6)) for r in df.collect())
    found = near(bm25.search(bm25.load(spark, str(tmp_path / "index")), asked, 5))
    assert found and found == near(bm25.search_once(docs, asked, 5))


def test_stream_of_events_counts_as_the_table(spark, tmp_path):
    from gristmill.streaming import incremental

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for k in range(3):
        events.where(f"event_id % 3 = {k}").write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):  # a second start finds nothing new
        incremental.grow(source, str(tmp_path / "out"), lambda batch: batch.select("event_id", "user_id")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "chunk=*"))
    assert got.count() == events.count() == got.select("event_id").distinct().count()


def test_dense_search_passes_over_broken_vectors(spark):
    from gristmill.operators import dense

    nan = float("nan")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, None), (6, [0.0, 3.0]), (7, [])], "doc long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0]), (3, [nan, 0.0]), (4, None), (5, [None, 1.0])], "query_id long, vector array<double>").coalesce(1)
    assert [tuple(r) for r in dense.search(vectors, queries, 5).sort("rank").collect()] == [(1, 1, 6, 3.0), (1, 2, 1, 1.0)]
    assert dense.search(vectors, queries.where("query_id = 4"), 5).count() == 0


def test_choice_metrics_by_length(spark):
    from gristmill.operators import evaluation

    options = spark.createDataFrame([(1, 0, -2.0, 2, 0), (1, 1, -3.0, 1, 0), (2, 0, -1.0, 4, 1), (2, 1, -1.0, 2, 1)], "item int, option int, score double, tokens int, correct int")
    for by_length, want in ((False, -0.75), (True, -1.5)):
        row = evaluation.choice_metrics(options, by_length).head()
        assert (row["items"], row.accuracy, row.answer_log_prob) == (2, 0.5, want)
