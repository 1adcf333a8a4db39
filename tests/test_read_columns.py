from __future__ import annotations

from gristmill.plans import registry


def test_rows_are_numbered_through_all_files(spark, tmp_path):
    """In the order of doc_id, as the SQL says, whatever lies in which file."""
    docs = [(i * 37 % 1000, "x" * (i % 11)) for i in range(1000)]
    spark.createDataFrame([*docs, (None, "y")], "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["read_columns"](spark, str(tmp_path)).collect()
    want = [(i, len(t), k) for k, (i, t) in enumerate(sorted(docs))] + [(None, 1, 1000)]
    assert sorted(map(tuple, got), key=lambda r: r[2]) == want


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["read_columns"](spark, str(tmp_path)).count() == 0
