"""Articles cut into passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_sentences

MAX_WORDS, MIN_WORDS = 100, 20
SKIPPED = ("references", "external links", "see also", "further reading", "notes", "bibliography", "footnotes", "sources", "citations")
BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("item", T.BooleanType())])
SECTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))]))
PASSAGE = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "title", "section", "text", "url", "date")])


def skipped_section(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*SKIPPED)


def is_skipped(name: str) -> bool:
    return name.strip().casefold() in SKIPPED


def disambiguation(title: Column, sections: Column) -> Column:
    """By its title, or because its first paragraph says what the name may refer to."""
    blocks = F.flatten(F.transform(sections, lambda s: s["blocks"]))
    lead = F.try_element_at(F.filter(blocks, lambda b: ~b["item"]), F.lit(1))["text"]
    said = F.rlike(F.substring(lead, 1, 300), F.lit(r"(?i)\bmay (?:also )?refer to\b"))
    return F.coalesce(title.endswith("(disambiguation)"), F.lit(False)) | F.coalesce(said, F.lit(False))


def check_sizes(max_words: int, min_words: int) -> None:
    if not (max_words >= 1 and 0 <= min_words <= max_words):
        raise ValueError("max_words must be positive, and min_words from 0 to max_words")


def chunks(blocks: Iterable[tuple[str, bool]], max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> list[str]:
    """Texts of at most ``max_words`` words from blocks (text, item): sentences, or whole items, packed in order.

    Blocks are joined by a line end, sentences by a blank; a unit of more words is cut. A last text of fewer than ``min_words`` words joins the one before.
    """
    check_sizes(max_words, min_words)
    texts: list[str] = []
    leads: list[str] = []
    counts: list[int] = []
    for text, item in blocks:
        lead = "\n"
        for unit in (text,) if item else split_sentences(text):
            found = unit.split()
            for at in range(0, len(found), max_words):
                part = found[at : at + max_words]
                if counts and counts[-1] + len(part) <= max_words:
                    texts[-1] += lead + " ".join(part)
                    counts[-1] += len(part)
                else:
                    texts.append(" ".join(part)), leads.append(lead), counts.append(len(part))
                lead = " "
            lead = " "
    if len(texts) > 1 and counts[-1] < min_words:
        tail, lead = texts.pop(), leads.pop()
        texts[-1] += lead + tail
    return texts


def passages(articles: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc columns) one row per passage of articles (id, title, url, date, sections); id is the article's and the passage's number in it."""
    check_sizes(max_words, min_words)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.string()) for x in ("id", "title", "section", "text", "url", "date")])
        for batch in batches:
            rows = []
            for a in batch.to_pylist():
                number = 0
                for section in a["sections"] or []:
                    for text in chunks(((b["text"], b["item"]) for b in section["blocks"]), max_words, min_words):
                        rows.append((f"{a['id']}:{number}", a["title"], section["name"], text, a["url"], a["date"]))
                        number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((),) * 6)], schema=schema)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return articles.select(text("id"), text("title"), text("url"), text("date"), "sections").mapInArrow(cut, PASSAGE)
