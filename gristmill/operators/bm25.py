"""An inverted index as tables, and BM25 over it.

``build`` makes postings with ready impacts; ``save`` clusters them by term; ``search`` reads only the postings of the queries' terms. ``search_once`` answers
queries over texts without an index: only terms that some query has are counted, so what is shuffled follows the queries, not the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import parts
from ..functions.text import tokenize, tokens, tokens_exact

K1, B, MOST_TF = 0.9, 0.4, 65535


@dataclass
class Index:
    """postings(term, doc, tf, impact), docs(doc, len), terms(term, df, idf), and the numbers they rest on."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    documents: int
    average: float
    k1: float
    b: float


def idf(n: Column, df: Column) -> Column:
    # Doubles throughout: decimal literals would cut the quotient to a few digits.
    return F.log1p((n.cast("double") - df + F.lit(0.5)) / (df + F.lit(0.5)))


def impact(weight: Column, tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    tf = tf.cast("double")
    return weight * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / average))


def tokenised(passages: DataFrame, doc: str = "doc", text: str = "text", title: str | None = None) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    if title:
        whole = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), whole)
    return passages.select(F.col(doc).alias("doc"), tokens(whole).alias("tokens"))


def counted(passages: DataFrame, doc: str = "doc", text: str = "text", title: str | None = None) -> DataFrame:
    """(doc, len, terms, counts): each text's terms once, in order, with their counts; all of Unicode. A row is a document, so nothing is shuffled to count."""
    whole = F.coalesce(F.col(text), F.lit(""))
    if title:
        whole = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), whole)
    read = passages.select(F.col(doc).alias("doc"), whole.alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Terms and counts as Python objects take far more room than the texts, so few texts are counted at a time.
        for batch in parts(batches, 1):
            found = [Counter(tokenize(t)) for t in batch.column(1).to_pylist()]
            columns = [pa.array([c.total() for c in found], pa.int32()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "len", "terms", "counts"])

    return read.mapInArrow(count, f"doc {read.schema['doc'].dataType.simpleString()}, len int, terms array<string>, counts array<bigint>")


def frequencies(counted_docs: DataFrame) -> DataFrame:
    """(doc, len, term, n): uncapped counts."""
    return counted_docs.select("doc", "len", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("doc", "len", F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))


def corpus(counted_docs: DataFrame) -> DataFrame:
    """One row: documents and their average length; texts without terms count."""
    return counted_docs.agg(F.count("*").alias("documents"), F.avg("len").alias("average"), F.sum("len").alias("terms"))


def build(passages: DataFrame, doc: str = "doc", text: str = "text", title: str | None = None, k1: float = K1, b: float = B) -> Index:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, and b must be from 0 to 1")
    # Kept on the executors' disks: one reading serves the average and the postings.
    read = counted(passages, doc, text, title).persist(StorageLevel.DISK_ONLY)
    row = corpus(read).head()
    if not row.documents:
        raise ValueError("no passages to index")
    counts = frequencies(read)
    terms = counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(row.documents), F.col("df")))
    average = max(row.average or 0.0, 1e-300)
    capped = F.least(F.col("n"), F.lit(MOST_TF))
    postings = counts.join(terms, "term").select("term", "doc", capped.cast("int").alias("tf"), impact(F.col("idf"), capped, F.col("len"), F.lit(average), k1, b).alias("impact"))
    return Index(postings, read.select("doc", "len"), terms, row.documents, row.average or 0.0, k1, b)


def save(index: Index, folder: str, parts: int = 64) -> None:
    """``folder`` must not exist. Postings lie in ``parts`` folders by a hash of the term, sorted, so a query reads few row groups."""
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    index.postings.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("term", "doc").write.partitionBy("part").parquet(f"{folder}/postings")
    index.terms.write.parquet(f"{folder}/terms")
    index.docs.write.parquet(f"{folder}/docs")
    spark = index.postings.sparkSession
    made = spark.read.parquet(f"{folder}/postings").agg(F.count("*").alias("n")).head().n
    spark.createDataFrame([(1, index.documents, float(index.average), float(index.k1), float(index.b), made, parts)], "format int, documents long, average double, k1 double, b double, postings long, parts int").coalesce(1).write.json(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> Index:
    """The index in ``folder``; an error if its parts don't agree."""
    meta = spark.read.schema("format int, documents long, average double, k1 double, b double, postings long, parts int").json(f"{folder}/meta").head()
    if meta is None or meta.format != 1:
        raise ValueError(f"{folder} holds no index of this format")
    postings, terms, docs = (spark.read.parquet(f"{folder}/{x}") for x in ("postings", "terms", "docs"))
    found = (docs.count(), postings.count(), terms.agg(F.coalesce(F.sum("df"), F.lit(0))).head()[0])
    if found != (meta.documents, meta.postings, meta.postings):
        raise ValueError(f"{folder} is damaged: {found} documents, postings and counted postings, not {meta.documents} and {meta.postings}")
    return Index(postings, docs, terms, meta.documents, meta.average, meta.k1, meta.b)


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term), each term of a query once; a blank query has none."""
    return queries.select(F.col(query).alias("query_id"), F.explode(F.array_distinct(tokens_exact(F.coalesce(F.col(text), F.lit(""))))).alias("term"))


def ranked(scores: DataFrame, k: int, tie: str = "doc") -> DataFrame:
    """The ``k`` best of each query, from rank 1. Scores are compared to nine digits, since the order of a shuffled sum decides the last ones."""
    if k < 1:
        raise ValueError("k must be positive")
    near = F.round("score", 9)
    best = Window.partitionBy("query_id").orderBy(near.desc(), F.col(tie).asc())
    return scores.where(near > 0).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc, score)"""
    met = query_terms(queries, query, text).join(index.postings.select("term", "doc", "impact"), "term")
    return ranked(met.groupBy("query_id", "doc").agg(F.sum("impact").alias("score")), k).select("query_id", "rank", "doc", "score")


def search_once(passages: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc", text: str = "text", title: str | None = None, query: str = "query_id", query_text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """As ``search``, straight from texts."""
    read = counted(passages, doc, text, title).persist(StorageLevel.DISK_ONLY)
    asked = query_terms(queries, query, query_text)
    counts = frequencies(read).join(asked.select("term").distinct(), "term", "left_semi")
    size = corpus(read).select(F.col("documents"), F.greatest(F.coalesce("average", F.lit(0.0)), F.lit(1e-300)).alias("average"))
    row = size.head()
    terms = counts.groupBy("term").agg(F.count("*").alias("df"))
    weighed = counts.join(terms, "term").select("doc", "term", impact(idf(F.lit(row.documents), F.col("df")), F.least("n", F.lit(MOST_TF)), F.col("len"), F.lit(row.average), k1, b).alias("impact"))
    scores = weighed.join(asked, "term").groupBy("query_id", "doc").agg(F.sum("impact").alias("score"))
    return ranked(scores, k).select("query_id", "rank", "doc", "score")
