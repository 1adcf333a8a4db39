"""Sharding: a reproducible shuffle whose shard and slot are computed from the row number alone.

Every row gets a global number: rows are spread over ``buckets`` by a hash of doc_id, size and checksum, numbered inside a bucket, and a
table of ``buckets`` bucket sizes (bounded, so it is broadcast) turns these into numbers without gaps; so the order is one of contents, however the input is split. A keyed Feistel
permutation with cycle walking shuffles the numbers; the permuted number p lies in shard p mod n at slot p div n. So
shards differ by one row at most, slots have no gaps, and any reader can compute both ways. DataFrame functions only.

NULL text counts as empty, and a NULL doc_id is a value like any other. Rows with the same doc_id are told apart by
size and checksum; rows equal in these too are interchangeable and are counted before the shuffle, so that a hot row costs no more than
one. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import feistel
from .common import durable, text_column

BUCKETS, CHUNK = 4096, 100_000


def assign(docs: DataFrame, shards: int = 40, key: str = "shuffle", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the row's place in a shuffle over ``shards`` shards."""
    text = text_column(F.col("text"))
    place = F.xxhash64("doc_id", "size", "text_crc32")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Rows that are alike are one here; what is written is a few numbers a row.
    unlike = durable(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("alike")).withColumn("place", place).withColumn("b", F.pmod("place", F.lit(buckets))))
    counts = unlike.groupBy("b").agg(F.sum("alike").alias("count"))
    starts = counts.select("b", (F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("start"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
    in_bucket = Window.partitionBy("b").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    numbered = unlike.withColumn("before", F.sum("alike").over(in_bucket) - F.col("alike")).join(F.broadcast(starts), "b")
    # Rows that are alike differ only by their number; they come out in chunks.
    each = (
        numbered.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (alike - 1) div {CHUNK})")))
        .withColumn("i", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(alike, (chunk + 1) * {CHUNK}) - 1)")))
        .withColumn("p", feistel.permute_column(F.col("start") + F.col("before") + F.col("i"), total, key))
    )
    return each.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def order_of(shard: int, shards: int, total: int) -> range:
    """The permuted numbers of a shard, in slot order."""
    return range(shard, total, shards)
