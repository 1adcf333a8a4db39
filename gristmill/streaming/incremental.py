"""Streams: windows over events, and indexes that grow file by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", when: str = "ts", by: str = "event_type") -> DataFrame:
    """Events and summed value of each kind in each window; what is later than ``late`` doesn't count in a stream. The same over a table."""
    seen = events.withWatermark(when, late) if events.isStreaming else events
    at = F.window(when, width, slide) if slide else F.window(when, width)
    return seen.groupBy(at.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", when: str = "ts", by: str = "user_id") -> DataFrame:
    seen = events.withWatermark(when, late) if events.isStreaming else events
    return seen.groupBy(F.session_window(when, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def grow(source: DataFrame, folder: str, made: Callable[[DataFrame], DataFrame], name: str = "chunk") -> StreamingQuery:
    """All that is new in ``source`` through ``made`` into ``folder``, then an end.

    A batch writes to a folder of its number, replacing what a failed try left there, so each input row is there once however often the query is started again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{folder}/{name}={number}")

    return source.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()


def term_counts(passages: DataFrame) -> DataFrame:
    """(doc, len, term, n) of new passages (doc, text): what an index needs of them."""
    read = passages.select("doc", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return read.select("doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("doc", "len", "term").agg(F.count("*").alias("n"))


def follow_log(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """New records of run logs in ``folder`` as a stream (kind, step, values), those after a step."""
    lines = spark.readStream.text(folder).select(F.try_parse_json("value").alias("values")).where("values is not null")
    at = lambda n, kind: F.try_variant_get("values", f"$.{n}", kind).alias(n)
    return lines.select(at("kind", "string"), at("step", "long"), F.col("values").cast("string").alias("values")).where(F.col("step") > after)
