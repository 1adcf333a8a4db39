"""Exact inner-product search over vectors, and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sound(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` finite numbers."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc", vector: str = "vector", query: str = "query_id", query_vector: str = "vector", block: int = 1024) -> DataFrame:
    """(query_id, rank, doc, score) of the ``k`` largest inner products of each query.

    Queries go out in blocks of a bounded size; each task multiplies its rows by a block, some rows at a time, and sends on its own best ``k``, so a query costs k rows a task.
    Vectors that are not finite numbers, as many as the first query has, are no hits, and queries like that have none.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    asked = queries.select(F.col(query).alias("query_id"), F.col(query_vector).alias("vector")).where("vector is not null")
    kind = asked.schema["query_id"].dataType.simpleString()
    rows = vectors.select(F.col(doc).alias("doc"), F.col(vector).alias("vector")).where("vector is not null")
    doc_kind = rows.schema["doc"].dataType.simpleString()
    found: DataFrame | None = None
    size: int | None = None
    waiting = asked.toLocalIterator()
    while part := [r for _, r in zip(range(block), waiting, strict=False)]:
        size = len(part[0].vector) if size is None else size
        part = [r for r in part if len(r.vector) == size and np.isfinite(np.array(r.vector, np.float64)).all()]
        if not part or not size:
            continue
        matrix = np.array([r.vector for r in part], np.float64)
        known = spark.sparkContext.broadcast(([r.query_id for r in part], matrix))
        best = rows.mapInArrow(_block_search(known, k), f"query_id {kind}, doc {doc_kind}, score double")
        found = best if found is None else found.unionAll(best)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, doc {doc_kind}, score double")
    return ranked_all(found, k).select("query_id", "rank", "doc", "score")


#: Scores that a task holds at once.
CELLS = 1 << 20


def _block_search(known: Broadcast, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = known.value
        bar = np.full(len(ids), -np.inf)  # of each query, what its k-th best has
        of, score, doc = np.empty(0, np.int64), np.empty(0), None
        for part in _slices(batches, max(1, CELLS // len(ids))):
            part = part.filter(pc.equal(pc.list_value_length(part.column(1)), matrix.shape[1]))
            rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
            fine = np.isfinite(rows).all(axis=1)
            part, rows = part.filter(pa.array(fine)), rows[fine]
            found = matrix @ rows.T
            hit = np.round(found, 9) >= bar[:, None]
            if not hit.any():
                continue
            tie, lines = _places(part.column(0)), np.flatnonzero(hit.any(axis=1))
            take = [_best(np.flatnonzero(hit[q]), found[q], tie, k) for q in lines]
            at = np.concatenate(take)
            new = np.repeat(lines, [len(t) for t in take])
            of, score = np.concatenate((of, new)), np.concatenate((score, found[new, at]))
            doc = part.column(0).take(pa.array(at)) if doc is None else pa.concat_arrays([doc, part.column(0).take(pa.array(at))])
            # The k best of each query stay, in order.
            near = np.round(score, 9)
            order = np.lexsort((_places(doc), -near, of))
            line = of[order]
            place = np.arange(len(order)) - np.searchsorted(line, line)
            last = order[place == k - 1]
            bar[of[last]] = near[last]
            order = order[place < k]
            of, score, doc = of[order], score[order], doc.take(pa.array(order))
        for at in range(0, len(of), 10_000):
            some = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(of[some])), doc.slice(at, 10_000), pa.array(score[some])], ["query_id", "doc", "score"])

    return scan


def _slices(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, most) for batch in batches for at in range(0, batch.num_rows, most))


def _places(doc: pa.Array) -> np.ndarray:
    """Where each would stand in order, NULL first as in Spark."""
    place = np.empty(len(doc), np.int64)
    place[pc.array_sort_indices(doc, null_placement="at_start").to_numpy()] = np.arange(len(doc))
    return place


def _best(at: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    return at if len(at) <= k else at[np.lexsort((tie[at], -np.round(score[at], 9)))[:k]]


def ranked_all(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, for scores of any sign; nine digits are compared, then doc."""
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc").asc())
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pooled(tokens: Column, mask: Column, size: int) -> Column:
    """Mean of the vectors whose mask is not 0, scaled to length 1; a zero vector if there are none."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    length = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / F.greatest(length, F.lit(1e-12)))


def embed(passages: DataFrame, encoder: Callable[[list[str]], np.ndarray], size: int, doc: str = "doc", text: str = "text", title: str = "title") -> DataFrame:
    """(doc, vector) of each passage from ``encoder``, which is sent to the executors; a vector that is not ``size`` finite numbers is an error."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.asarray(encoder(part.column(1).to_pylist()), np.float32)
                if found.shape != (part.num_rows, size) or not np.isfinite(found).all():
                    raise ValueError(f"the encoder gave {found.shape}, or numbers that are not finite")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float32()))], ["doc", "vector"])

    said = F.when(F.coalesce(F.col(title), F.lit("")) == "", F.col(text)).otherwise(F.concat(F.lit('"'), F.col(title), F.lit('"\n'), F.col(text)))
    kind = passages.schema[doc].dataType.simpleString()
    return passages.select(F.col(doc), said).mapInArrow(scan, f"doc {kind}, vector array<float>")
