"""Web pages: which are kept, and what they become."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.text import collapsed, words

MIN_WORDS, EXCLUDED = 50, ("wikipedia.org",)


def lines(text: Column) -> Column:
    """The text's lines, blanks collapsed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), collapsed), lambda line: line != "")


def word_count(found: Column) -> Column:
    return F.aggregate(F.transform(found, lambda line: F.size(words(line))), F.lit(0), lambda a, b: a + b)


def judged(pages: DataFrame, order: Sequence[str] = ("pos",), domains: Sequence[str] = EXCLUDED, min_words: int = MIN_WORDS) -> DataFrame:
    """``pages`` (url, text and columns that order them) with ``reason``: why a page is dropped, or NULL.

    A page repeats a url only if an earlier page of that url is kept. Whether a page could be kept at all doesn't depend on others, so the first such page of a url is the
    kept one; an aggregate finds it, which costs a hot url one row a task, and it is joined back.
    """
    place = F.struct(*order)
    url = F.coalesce(F.col("url"), F.lit(""))
    seen = pages.withColumns({"_url": url, "_out": urls.excluded(url, domains), "_short": word_count(lines(F.col("text"))) < min_words, "_place": place})
    able = seen.where("_url <> '' and not _out and not _short").groupBy("_url").agg(F.min("_place").alias("_first"))
    # Under another name the url is dealt out for the join alone, so Spark may split a hot one.
    met = seen.join(able.select(F.concat(F.col("_url"), F.lit("")).alias("_kept_url"), "_first"), F.col("_url") == F.col("_kept_url"), "left")
    reason = (
        F.when(F.col("_url") == "", "no_url")
        .when(F.col("_first") < F.col("_place"), "duplicate_url")
        .when(F.col("_out"), "excluded_domain")
        .when(F.col("_short"), "too_short")
    )
    return met.withColumn("reason", reason).drop("_url", "_out", "_short", "_place", "_first", "_kept_url")


def kept_limit(judged_pages: DataFrame, most: int, order: str = "pos") -> tuple[DataFrame, int]:
    """The first ``most`` kept pages in order, and how many pages are read to get them."""
    if most < 1:
        raise ValueError("the limit must be positive")
    first = judged_pages.where("reason is null").orderBy(order).limit(most)
    row = first.agg(F.count("*").alias("n"), F.max(order).alias("last")).head()
    read = judged_pages.count() if row.n < most else judged_pages.where(F.col(order) <= row.last).count()
    return first, read


def articles(pages: DataFrame) -> DataFrame:
    """Pages (id, url, text, date) as (id, title, url, date, sections): the first line is the title if it looks like one, else the url names it."""
    found = pages.withColumn("_lines", lines(F.col("text")))
    titled = (F.size("_lines") > 1) & urls.looks_like_title(F.element_at("_lines", 1))
    body = F.when(titled, F.slice("_lines", 2, F.size("_lines"))).otherwise(F.col("_lines"))
    title = F.when(titled, F.element_at("_lines", 1)).otherwise(urls.url_title(F.coalesce(F.col("url"), F.lit(""))))
    blocks = F.transform(body, lambda line: F.struct(line.alias("text"), F.lit(False).alias("item")))
    return found.where(F.size("_lines") > 0).select("id", title.alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.col("date"), F.array(F.struct(F.lit("").alias("name"), blocks.alias("blocks"))).alias("sections"))


def manifest(judged_pages: DataFrame) -> DataFrame:
    """One row: pages read, kept and dropped for each reason, hosts, undated pages, dates taken from urls, first and last date.

    ``judged_pages`` has reason, url, date, crawled and pos. First and last date are those a walk over kept pages in order ends with; only certain
    comparisons move them. Dates are few, so the walk is over the first page of each.
    """
    reasons = ("no_url", "duplicate_url", "excluded_domain", "too_short")
    kept = F.col("reason").isNull()
    counts = judged_pages.agg(
        F.count("*").alias("read"),
        F.count_if(kept).alias("kept"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in reasons),
        F.count_distinct(F.when(kept, urls.hostname(F.coalesce(F.col("url"), F.lit(""))))).alias("domains"),
        F.count_if(kept & (F.coalesce("date", F.lit("")) == "")).alias("undated"),
        F.count_if(kept & (F.coalesce("date", F.lit("")) != "") & (F.col("date") != F.coalesce("crawled", F.lit("")))).alias("from_url"),
    )
    by_date = judged_pages.where(kept & (F.coalesce("date", F.lit("")) != "")).groupBy("date").agg(F.min("pos").alias("pos"))
    walked = by_date.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "date"))), lambda x: x["date"]).alias("dates"))
    return counts.crossJoin(walked.select(dates.extreme(F.col("dates"), False).alias("first_date"), dates.extreme(F.col("dates"), True).alias("last_date")))
