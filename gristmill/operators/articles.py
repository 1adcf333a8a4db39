"""Encyclopedia articles: latest revisions, trees and markup to sections, Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup
from .passages import SECTIONS, disambiguation

_ARROW_SECTIONS = pa.list_(pa.struct([("name", pa.string()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("item", pa.bool_())])))]))
ARTICLE = T.StructType([*(T.StructField(x, T.StringType()) for x in ("id", "title", "url", "date")), T.StructField("sections", SECTIONS)])


def latest_rows(rows: DataFrame, ident: str = "identifier", stamp: str = "date_modified", order: Sequence[str] = ("file_idx", "row_idx")) -> DataFrame:
    """The last row of each identifier by stamp, then by ``order``; rows with a NULL or negative identifier are left out, a NULL stamp is the epoch.

    Only the key, stamp and place are aggregated; the wide rows are then met by their place, so no article text is sorted.
    """
    key = F.col(ident).try_cast("long")
    place = F.struct(*order)
    when = F.coalesce(F.col(stamp).try_cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
    last = rows.select(key.alias("_key"), F.struct(when.alias("w"), place.alias("p")).alias("_at")).where("_key >= 0").groupBy("_key").agg(F.max("_at").alias("_last"))
    kept = last.select(*(F.col(f"_last.p.{c}").alias(c) for c in order))
    return rows.join(kept, list(order), "left_semi")


def _mapped(read: Callable[[dict[str, Any]], list[markup.Section]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([*((x, pa.string()) for x in ("id", "title", "url", "date")), ("sections", _ARROW_SECTIONS)])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [[{"name": n, "blocks": [{"text": t, "item": i} for t, i in blocks]} for n, blocks in read(r)] for r in rows]
            columns = [pa.array([r[x] for r in rows], pa.string()) for x in ("id", "title", "url", "date")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW_SECTIONS)], schema=schema)

    return scan


def _useful(articles: DataFrame) -> DataFrame:
    return articles.where((F.size("sections") > 0) & ~disambiguation(F.col("title"), F.col("sections")))


def structured_articles(rows: DataFrame, date: str | None = None) -> DataFrame:
    """(id, title, url, date, sections) of rows (name, identifier, url, sections JSON, date_modified, file_idx, row_idx).

    A newer redirect removes the article: it is looked at after the latest rows are chosen.
    """
    latest = latest_rows(rows)
    stamp = F.lit(date) if date else F.coalesce(F.substring(F.col("date_modified").cast("string"), 1, 10), F.lit(""))
    plain = latest.select(F.col("identifier").cast("string").alias("id"), F.trim(F.coalesce("name", F.lit(""))).alias("title"), F.coalesce("url", F.lit("")).alias("url"), stamp.alias("date"), F.col("sections").alias("raw"))
    read = plain.mapInArrow(_mapped(lambda r: markup.tree_sections(json.loads(r["raw"]))), ARTICLE)
    first = F.lower(F.ltrim(F.col("sections")[0]["blocks"][0]["text"]))
    return _useful(read).where(~first.startswith("#redirect"))


def wikitext_articles(pages: DataFrame, date: str = "") -> DataFrame:
    """(id, title, url, date, sections) of pages (id, title, text); redirects, pages without text and disambiguations are left out."""
    body = F.coalesce("text", F.lit(""))
    plain = pages.where(~F.lower(F.ltrim(body)).startswith("#redirect")).select(F.col("id").cast("string").alias("id"), "title", F.lit("").alias("url"), F.lit(date).alias("date"), body.alias("raw"))
    articles = _useful(plain.mapInArrow(_mapped(lambda r: markup.wikitext_sections(r["raw"])), ARTICLE))
    return articles.withColumn("url", _page_url("title"))


@F.pandas_udf(T.StringType())
def _page_url(titles):  # noqa: ANN001, ANN202
    return titles.map(markup.page_url)


def rendered_articles(rows: DataFrame) -> DataFrame:
    """(text, url, id, title, citations): articles as Markdown; those without text are left out. Rows are (name, identifier, url, sections JSON, references)."""
    schema = pa.schema([("text", pa.string()), ("url", pa.string()), ("id", pa.string()), ("title", pa.string()), ("citations", pa.int32())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                text, citations = markup.markdown(r["name"], json.loads(r["sections"]), r["references"])
                if text:
                    made.append((text, r["url"], r["identifier"], r["name"], citations))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else ((),) * 5, schema.types, strict=True)], schema=schema)

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    plain = rows.select(empty("name"), F.col("identifier").cast("string").alias("identifier"), empty("url"), "sections", "references")
    return plain.mapInArrow(scan, "text string, url string, id string, title string, citations int")
