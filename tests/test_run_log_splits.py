from __future__ import annotations

import gzip

import pytest

from gristmill.plans import registry
from gristmill.sources import run_logs


def lines_of(n):
    return [f'{{"kind": "k", "step": {i}, "time": 1.5, "s": "{"é" * (i % 40)}"}}' for i in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["", "\n", '{"kind": "k", "st', "\n\n"])
@pytest.mark.parametrize("packed", [False, True])
def test_a_log_in_many_splits(spark, tmp_path, small_splits, end, packed):
    lines = lines_of(500)
    lines.insert(7, "")
    for name in "ab":
        text = ("\n".join(lines) + ("\n" if end.startswith("{") else "") + end).encode()
        (tmp_path / (name + ".gz" if packed else name)).write_bytes(gzip.compress(text) if packed else text)
    got = run_logs.read(spark, str(tmp_path))
    assert packed or got.rdd.getNumPartitions() > 4
    want = [(i + (i >= 7), i) for i in range(500)]
    assert sorted((r.line, r.step) for r in got.collect()) == sorted(want * 2)
    assert run_logs.read(spark, str(tmp_path), 9).count() == 20


@pytest.mark.parametrize(("tail", "number"), [('{"st\n', 501), ('{"st\n' + "x", 501), ("", None), ("x", None)])
def test_only_a_last_line_without_an_end_is_torn(spark, tmp_path, small_splits, tail, number):
    path = tmp_path / "log"
    path.write_bytes(("".join(x + "\n" for x in lines_of(500)) + tail).encode())
    if number is None:
        assert run_logs.read(spark, str(path)).count() == 500
    else:
        with pytest.raises(Exception, match=f"not JSON in line {number}"):
            run_logs.read(spark, str(path)).collect()


def test_no_task_gathers_the_events(spark, tmp_path):
    """A log was one string of one task; now there is one for each split of the events."""
    spark.range(40_000).selectExpr("id event_id", "id % 7 user_id", "'view' event_type").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    made = registry.QUERIES["run_log_records"](spark, str(tmp_path))
    assert made.count() == 3001
    assert len(set(made.inputFiles())) > 1
