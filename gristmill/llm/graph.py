"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round of Kiveris and others' large-star or small-star. Both sides of the join are dealt out by a hash of its key, so a hot node can be split."""
    if large:
        near = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.xxhash64("a").alias("h"), F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = near.withColumn("h", F.xxhash64("a")).join(least, "h").where("a = n")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.where("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b BIGINT, no NULLs): component is the smallest node it reaches.

    Links that join a node to itself say nothing and are dropped. Each round is written to the shared folder and replaces the one before; rounds grow with the
    logarithm of the longest chain. No links give an empty table.
    """
    links = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        next_links = durable(_stars(_stars(links, True).distinct(), False).distinct())
        discard(links)
        links = next_links
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components need more than {rounds} rounds")
    return links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
