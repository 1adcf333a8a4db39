"""Deterministic subsets and samples."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_chunks
from ..functions.urls import article_of


def hash_rank(seed: int, key: Column) -> Column:
    """A key's place in a seeded shuffle, as 16 hex digits; their order is that of the number."""
    return F.substring(F.sha2(F.concat(F.lit(str(seed)), F.expr("char(0)"), key).cast("binary"), 256), 1, 16)


def passage_counts(passages: DataFrame, ident: str = "id") -> DataFrame:
    return passages.groupBy(article_of(F.col(ident)).alias("article")).agg(F.count("*").alias("n"))


def budget_fill(counts: DataFrame, size: int, required: Iterable[str] = (), seed: int = 0) -> tuple[DataFrame, list[str]]:
    """(article, n, required) of the chosen articles, and the required ones that are missing, in their order.

    Required articles come first, whatever their size. Others follow in shuffled order while the total is below ``size``; one that would pass it is left out and
    the next is tried. What can be decided from running sums is: up to the first that does not fit, all are taken. From there on at most the
    articles smaller than what is left matter, and each of these either fills some of it or is left out; that tail is walked on the driver in
    order, a row at a time, until the budget is full.
    """
    if size < 1:
        raise ValueError("size must be positive")
    spark = counts.sparkSession
    names = list(dict.fromkeys(required))
    wanted = spark.createDataFrame([(i, a) for i, a in enumerate(names)], "pos int, article string")
    found = wanted.join(counts, "article", "left")
    missing = [r.article for r in found.where("n is null").orderBy("pos").collect()]
    first = found.where("n is not null").select("article", "n", F.lit(True).alias("required"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    rest = counts.join(wanted, "article", "left_anti").select("article", "n", hash_rank(seed, F.col("article")).alias("key"))
    if total >= size:
        return first, missing
    # Running sums by the first hex digits of the key: groups are small, and their totals are few.
    rest = rest.withColumn("part", F.substring("key", 1, 3))
    before = rest.groupBy("part").agg(F.sum("n").alias("in_part")).withColumn("start", F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("part").orderBy("key", "article").rowsBetween(Window.unboundedPreceding, 0)
    summed = rest.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(before.select("part", F.coalesce("start", F.lit(0)).alias("start"))), "part").withColumn("upto", F.col("upto") + F.col("start") + total)
    stop = summed.where(F.col("upto") > size).orderBy("key", "article").limit(1).select("key", "article", "upto", "n").head()
    if stop is None:
        return first.unionByName(rest.select("article", "n", F.lit(False).alias("required"))), missing
    ahead = (F.col("key") < stop.key) | ((F.col("key") == stop.key) & (F.col("article") < stop.article))
    taken = rest.where(ahead).select("article", "n", F.lit(False).alias("required"))
    left, more = size - (stop.upto - stop.n), []
    while left > 0:
        later = (F.col("key") > stop.key) | ((F.col("key") == stop.key) & (F.col("article") > stop.article))
        stop = rest.where(later & (F.col("n") <= left)).orderBy("key", "article").limit(1).select("key", "article", "n").head()
        if stop is None:
            break
        more.append((stop.article, stop.n, False))
        left -= stop.n
    chosen = first.unionByName(taken)
    return (chosen.unionByName(spark.createDataFrame(more, "article string, n long, required boolean")) if more else chosen), missing


def passages_of(passages: DataFrame, chosen: DataFrame, ident: str = "id") -> DataFrame:
    return passages.withColumn("_article", article_of(F.col(ident))).join(chosen.select(F.col("article").alias("_article")), "_article", "left_semi").drop("_article")


def subset_manifest(counts: DataFrame, chosen: DataFrame, missing: Sequence[str], size: int, seed: int) -> DataFrame:
    """One row of totals; missing names are listed up to 50."""
    totals = chosen.agg(F.count("*").alias("articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("passages"), F.coalesce(F.sum(F.when(F.col("required"), F.col("n"))), F.lit(0)).alias("required_passages"), F.count_if("required").alias("required_articles"))
    source = counts.agg(F.count("*").alias("source_articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("source_passages"))
    return totals.crossJoin(source).withColumns({"size": F.lit(size), "seed": F.lit(seed), "missing_count": F.lit(len(missing)), "missing": F.lit(list(missing[:50])).cast("array<string>")})


def chance(*parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the parts alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", *parts).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


@dataclass(frozen=True)
class Share:
    """A source and its share of the sample's bytes."""

    name: str
    share: float


def check_shares(shares: Sequence[Share], total: int) -> dict[str, int]:
    """Bytes wanted of each source."""
    if total < 1:
        raise ValueError("total must be positive")
    if len({s.name for s in shares}) < len(shares):
        raise ValueError("a source is named twice")
    if not math.isclose(sum(s.share for s in shares), 1):
        raise ValueError("shares must add up to 1")
    return {s.name: round(total * s.share) for s in shares}


def available(texts: DataFrame) -> DataFrame:
    return texts.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("available"), F.count("*").alias("documents"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunked(texts):  # noqa: ANN001, ANN202
    return texts.map(lambda t: text_chunks(t or ""))


def byte_share_sample(texts: DataFrame, shares: Sequence[Share], total: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(source, id, part, text) of the kept chunks of ``texts`` (source, id, text), and a report a source.

    Each chunk is kept with the chance wanted / available of its source, by a hash of seed, source, id and part; an error if a source has too little.
    """
    wanted = check_shares(shares, total)
    have = {r.source: r.available for r in available(texts.where(F.col("source").isin(list(wanted)))).collect()}
    if short := [f"{s} has {have.get(s, 0):,} of {n:,}" for s, n in wanted.items() if have.get(s, 0) < n]:
        raise ValueError("not enough text in bytes: " + ", ".join(short))
    keep = F.create_map(*(F.lit(x) for s, n in wanted.items() for x in (s, n / have[s] if have[s] else 0.0)))
    parts = texts.where(F.col("source").isin(list(wanted))).select("source", "id", F.posexplode(chunked("text")).alias("part", "text"))
    kept = parts.where(chance(F.lit(str(seed)), F.col("source"), F.col("id").cast("string"), F.col("part").cast("string")) < keep[F.col("source")])
    report = kept.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("sampled_bytes"), F.count("*").alias("chunks"))
    targets = texts.sparkSession.createDataFrame([(s.name, s.share, wanted[s.name], have[s.name]) for s in shares], "source string, share double, target_bytes long, available_bytes long")
    return kept, targets.join(report, "source", "left").fillna(0, ["sampled_bytes", "chunks"])


def systematic(rows: DataFrame, order: str, count: int | None, seed: int = 0) -> DataFrame:
    """``count`` rows evenly spread over the order of ``order``, from a seeded start; all if there are no more."""
    if count is not None and count < 1:
        raise ValueError("count must be positive")
    n = rows.count()
    if count is None or count >= n:
        return rows
    start = random.Random(str(seed)).randrange(n)
    at = F.row_number().over(Window.orderBy(order)) - 1
    # Picks are start + (j * n div count) for j below count; a row's j can only be the first whose point is not before it.
    spread = rows.withColumn("_at", at.cast("long")).withColumn("_away", F.pmod(F.col("_at") - start, F.lit(n))).withColumn("_j", F.expr(f"(_away * {count} + {n} - 1) div {n}"))
    return spread.where(F.expr(f"_j < {count} and _j * {n} div {count} = _away")).drop("_at", "_away", "_j")


def sample_per_group(rows: DataFrame, group: Sequence[str], order: str, count: int | None, seed: int = 0) -> DataFrame:
    """At most ``count`` rows of each group, those first in a shuffle seeded by the group's name."""
    if count is not None and count < 1:
        raise ValueError("count must be positive")
    if count is None:
        return rows
    key = hash_rank(seed, F.concat_ws("/", *group, order))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(key, order))).where(F.col("_n") <= count).drop("_n")
