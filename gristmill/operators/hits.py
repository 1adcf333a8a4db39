"""Ranked hits: as-of filtering, contract checks and rendering."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.text import collapsed

MOST_FETCHED = 1000


def as_of(hits: DataFrame, today: str | date, k: int, keep_undated: bool = True, limit: int = MOST_FETCHED, when: str = "date") -> DataFrame:
    """The first ``k`` hits of each query that may be known on the day ``today``, among its first max(k, limit), ranked anew.

    Fetching more and more hits until k are allowed comes to the same.
    """
    if k < 1 or limit < 1:
        raise ValueError("k and limit must be positive")
    day = F.lit(dates.full_day(today))
    near = hits.where(F.col("rank") <= max(k, limit)).where(dates.allowed(F.col(when), day, keep_undated))
    again = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def faults(hits: DataFrame, k: int, ident: str = "id", text: str = "text") -> DataFrame:
    """(query_id, rank, fault) for each breach of the contract of hits: at most k, each once, finite scores that never rise, text in each."""
    if k < 1:
        raise ValueError("k must be positive")
    order = Window.partitionBy("query_id").orderBy("rank")
    seen = hits.withColumns({"_before": F.lag("score").over(order), "_same": F.row_number().over(Window.partitionBy("query_id", ident).orderBy("rank"))})
    fault = (
        F.when(F.col("rank") > k, "too many hits")
        .when(collapsed(F.coalesce(F.col(text), F.lit(""))) == "", "no text")
        .when(F.col("_same") > 1, "repeated passage")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == F.lit(float("inf"))), "score not finite")
        .when(F.col("score") > F.col("_before"), "score higher than the hit before")
    )
    return seen.select("query_id", "rank", fault.alias("fault")).where("fault is not null")


def rendered(rank: Column, title: Column, url: Column, when: Column, text: Column) -> Column:
    """[rank] title (host, date), then the text."""
    where, day = F.nullif(urls.domain(F.coalesce(url, F.lit(""))), F.lit("")), F.nullif(collapsed(F.coalesce(when, F.lit(""))), F.lit(""))
    details = F.concat_ws(", ", where, day)
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), collapsed(F.coalesce(title, F.lit(""))))
    return F.concat(head, F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""), F.lit("\n"), text)


def render_all(hits: DataFrame) -> DataFrame:
    """(query_id, rendered): a query's hits in rank order, a blank line between; hits are at most k a query."""
    one = rendered(F.col("rank"), F.col("title"), F.col("url"), F.col("date"), F.col("text"))
    rows = hits.select("query_id", F.struct("rank", one.alias("said")).alias("hit"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("hit")), lambda h: h["said"]), "\n\n").alias("rendered"))


def newest(hits: DataFrame) -> DataFrame:
    """(query_id, rank, date): in rank order, a hit replaces the best so far only if it is certainly later."""
    dated = hits.select("query_id", F.struct("rank", F.coalesce("date", F.lit("")).alias("date"), dates.moment(F.coalesce("date", F.lit(""))).alias("m")).alias("hit"))
    listed = dated.groupBy("query_id").agg(F.array_sort(F.collect_list("hit")).alias("all"))
    best = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda b, h: F.when(dates.order(h["m"], b["m"]) == 1, h).otherwise(b))
    return listed.withColumn("best", best).select("query_id", "best.rank", "best.date")
