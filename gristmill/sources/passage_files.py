"""Passage files: strict JSON lines, and a table with random access by document number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.passages import PASSAGE

FIELDS = tuple(f.name for f in PASSAGE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Passages of JSON lines; a line that isn't an object of exactly the six texts is an error at run time that says so."""
    lines = spark.read.option("lineSep", "\n").text(path)
    v = F.try_parse_json("value")
    text = lambda c: F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) == "STRING"
    keys = F.array_sort(F.json_object_keys("value"))
    good = v.isNotNull() & F.coalesce(keys == F.array(*(F.lit(x) for x in sorted(FIELDS))), F.lit(False))
    for c in FIELDS:
        good = good & F.coalesce(text(c), F.lit(False))
    checked = F.when(good, v).otherwise(F.raise_error(F.concat(F.lit("not a passage: "), F.substring("value", 1, 200))).cast("variant"))
    return lines.where(F.trim("value") != "").select(checked.alias("v")).select(*(F.variant_get("v", f"$.{c}", "string").alias(c) for c in FIELDS))


def write(passages: DataFrame, path: str) -> int:
    """Written whole or not at all, to a path that must not exist; how many."""
    passages.select(*FIELDS).write.mode("errorifexists").json(path)
    return passages.sparkSession.read.schema(PASSAGE).json(path).count()


def write_store(passages: DataFrame, path: str, doc: str = "doc") -> None:
    """Sorted ranges of document numbers, so that a look-up reads one row group."""
    passages.repartitionByRange(doc).sortWithinPartitions(doc).write.mode("errorifexists").parquet(path)


def verify_store(spark: SparkSession, path: str, doc: str = "doc") -> int:
    """Documents in a store whose numbers are 0 to n-1, each once; else an error."""
    row = spark.read.parquet(path).agg(F.count("*").alias("n"), F.min(doc).alias("low"), F.max(doc).alias("high"), F.count_distinct(doc).alias("unlike")).head()
    if row.n and (row.low, row.high, row.unlike) != (0, row.n - 1, row.n):
        raise ValueError(f"{path} is damaged: {row.n} rows numbered {row.low} to {row.high}, {row.unlike} of them unlike")
    return row.n


def look_up(store: DataFrame, wanted: DataFrame, doc: str = "doc") -> DataFrame:
    return wanted.join(store, doc)
