"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash of ``GRAM`` words among the ``WINDOW - GRAM + 1`` that a window of ``WINDOW`` words holds, so a document and an item that
share a window share the fingerprint at the same place in it. Items of fewer words have one window; its fingerprint is the hash of all its words, and
documents have those of all their runs of as many words.

Both sides send their fingerprints with the words around them that a window can reach. Training and test fingerprints are joined, and each joined pair is
extended word by word both ways, on the words themselves; runs of ``WINDOW`` words or more (the whole item, if it is shorter) are hits. Every shared window is found, and nothing else.
Before the join a document's fingerprints pass a Bloom filter of the benchmark's, ``FILTER`` bits whatever the benchmark's size, so that of most documents nothing is
shuffled; what it lets pass wrongly the join drops. Neither table is held by the driver or by a task; texts are never shuffled. A fingerprint that many documents
share is a hot key of a join of which Spark can split one side; equal contexts of one document, and of one task's benchmark rows, are one row.

NULL texts have no words. NULL and repeated doc_ids are kept: one row of the result per row of the table (rows of equal doc_id and text give equal
rows). NULL item_ids count as items, named by the empty string; repeated items count once each
row. Empty tables give an empty result or no hits. Other columns are ignored. Work on a text is linear in its words and hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, slices, text_hash, utf8

WINDOW, GRAM, FILTER = 10, 5, 1 << 26
CHUNK = 1 << 16
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Lower-cases A-Z; everything but letters, digits and bytes from 0x80 on becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def mixed(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of ``gram`` words."""
    n = len(h) - gram + 1
    out = np.full(max(n, 0), gram, np.uint64)
    for k in range(gram if n > 0 else 0):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) in any ``width`` neighbours, each once."""
    if len(h) < width:
        return np.empty(0, np.int64)
    sliding = np.lib.stride_tricks.sliding_window_view(h[::-1], width)
    return np.unique(len(h) - 1 - (np.arange(len(sliding)) + sliding.argmin(axis=1)))


def prints(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, place) of a text of ``window`` words or more."""
    grams = mixed(h, gram)
    at = winnowed(grams, window - gram + 1)
    return grams[at], at


def around(found: list[bytes], at: int, window: int, gram: int) -> tuple[int, bytes]:
    """How many words stand before the fingerprint at ``at`` as far as a window can reach, and all those words."""
    low = max(0, at - (window - gram))
    return at - low, b" ".join(found[low : at + window])


def extended(mine: list[bytes], before: int, other: list[bytes], other_before: int, gram: int) -> tuple[int, int]:
    """Words that agree before and from the fingerprint on."""
    left = 0
    while left < min(before, other_before) and mine[before - left - 1] == other[other_before - left - 1]:
        left += 1
    right, high = 0, min(len(mine) - before, len(other) - other_before)
    while right < high and mine[before + right] == other[other_before + right]:
        right += 1
    return left, right


def _tested(window: int, gram: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, size, before, context, item) of each window's fingerprint of each item; size is the item's words if they are fewer than a window, else 0."""
    schema = pa.schema([("h", pa.int64()), ("size", pa.int32()), ("before", pa.int32()), ("context", pa.binary()), ("item", pa.binary())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            out: set[tuple[int, int, int, bytes, bytes]] = set()
            for text, item in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                h = word_hashes(found)
                if 0 < len(found) < window:
                    out.add((int(mixed(h, len(h))[0]), len(found), 0, b" ".join(found), item))
                elif found:
                    at_hashes, at = prints(h, window, gram)
                    out.update((x, 0, *around(found, p, window, gram), item) for x, p in zip(at_hashes.tolist(), at.tolist(), strict=True))
            columns = list(zip(*sorted(out), strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(np.array(columns[0], np.uint64).view(np.int64)), *(pa.array(c, t) for c, t in zip(columns[1:], schema.types[1:], strict=True))], schema=schema)

    return scan


def bloom_slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each fingerprint."""
    second = h * np.uint64(0xD6E8FEB86659FD93)
    return (h % np.uint64(bits)).astype(np.int64), ((second ^ second >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _filter(tested: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter, bits packed in bytes; made in pieces of CHUNK bits on the executors, of which only those with a bit set come to the driver: ``bits`` / 8 bytes at most."""

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.unique(np.concatenate(bloom_slots(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(both // CHUNK), pa.array(both % CHUNK)], ["piece", "slot"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(piece).tolist():
                made.setdefault(k, np.zeros(CHUNK, bool))[slot[piece == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], ["piece", "bits"])

    table = np.zeros(bits // 8, np.uint8)
    each = tested.select("h").mapInArrow(slots, "piece long, slot long").distinct().repartition("piece")
    for r in each.mapInArrow(packed, "piece long, bits binary").collect():
        table[r.piece * (CHUNK // 8) : (r.piece + 1) * (CHUNK // 8)] |= np.frombuffer(r.bits, np.uint8)
    return table


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for slot in bloom_slots(h, 8 * len(table)):
        ok &= (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def _trained(known: Broadcast, sizes: list[int], window: int, gram: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row (h NULL) with the number of words of each document, and a row (h, size, before, context, places) for each unlike context of a fingerprint that passes."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.binary()), ("n_words", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("before", pa.int32()), ("context", pa.binary()), ("places", pa.list_(pa.int64()))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in slices(batches, 2):
            out: list[tuple] = []
            for doc, body, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                found = words(text)
                h = word_hashes(found)
                out.append((doc, body, len(found), None, None, None, None, None))
                met: dict[tuple[int, int, int, bytes], list[int]] = {}
                for size in sizes:
                    if len(found) < (size or window):
                        continue
                    x, at = (mixed(h, size), None) if size else prints(h, window, gram)
                    for k in np.flatnonzero(passes(table, x)).tolist():
                        p = k if at is None else int(at[k])
                        context = (0, b" ".join(found[p : p + size])) if size else around(found, p, window, gram)
                        met.setdefault((int(x[k]), size, *context), []).append(p)
                out += [(doc, body, None, int(np.uint64(x).view(np.int64)), size, before, context, places) for (x, size, before, context), places in met.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return scan


def _extended(window: int, gram: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, body, first, last, items): runs of hit words of joined pairs; equal contexts come with all their items."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.binary()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("items", pa.list_(pa.binary()))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 6):
            out = []
            for doc, body, size, before, context, places, other_before, other, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine, his = context.split(b" "), other.split(b" ")
                left, right = extended(mine, before, his, other_before, gram)
                if left + right >= (size or window):
                    out.append((doc, body, [p - left for p in places], [p + right for p in places], items))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 5, schema.types, strict=True)], schema=schema)

    return scan


def _found(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, body, n_words) of each document, (doc_id, body, first, last, items) of its hits, and (item, name, copies) of the items."""
    item = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"), item.alias("item"))
    tested = items.select("text", "item").mapInArrow(_tested(window, gram), "h long, size int, before int, context binary, item binary")
    tested = durable(tested.groupBy("h", "size", "before", "context").agg(F.collect_set("item").alias("items")))
    sizes = sorted(r.size for r in tested.select("size").distinct().collect())  # fewer than a window's words
    known = docs.sparkSession.sparkContext.broadcast(_filter(tested, bits))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("body"), F.col("text").cast("string").alias("text"))
    seen = durable(keyed.mapInArrow(_trained(known, sizes, window, gram), "doc_id long, body binary, n_words long, h long, size int, before int, context binary, places array<long>"))
    named = tested.select("h", "size", F.col("before").alias("other_before"), F.col("context").alias("other"), "items")
    pairs = seen.where("h is not null").join(named, ["h", "size"]).select("doc_id", "body", "size", "before", "context", "places", "other_before", "other", "items")
    hits = pairs.mapInArrow(_extended(window, gram), "doc_id long, body binary, first array<long>, last array<long>, items array<binary>")
    return seen.where("h is null").select("doc_id", "body", "n_words"), hits, items.groupBy("item", "name").agg(F.count("*").alias("copies"))


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words hit of each document, whatever the number of runs that name them."""
    for batch in batches:
        n_hit = []
        for first, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = sorted((a, b) for f, g in zip(first, last, strict=True) for a, b in zip(f, g, strict=True))
            end = total = 0
            for a, b in runs:
                total += max(0, b - max(a, end))
                end = max(end, b)
            n_hit.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64())], ["doc_id", "body", "n_hit"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER) -> DataFrame:
    """For each document: its words, those inside an occurrence of an item's window, and the items found."""
    counted, hits, items = _found(docs, benchmark, window, gram, bits)
    hits = durable(hits.distinct())
    n_hit = hits.groupBy("doc_id", "body").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")).mapInArrow(_summed, "doc_id long, body binary, n_hit long")
    each = hits.select("doc_id", "body", F.explode("items").alias("item")).distinct().join(items, "item")
    names = each.withColumn("name", F.explode(F.expr("array_repeat(name, int(copies))"))).groupBy("doc_id", "body").agg(F.array_sort(F.collect_list("name")).alias("names"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.body") == F.col(f"{b}.body"))
    found = n_hit.alias("h").join(names.alias("n"), same("h", "n")).select("h.doc_id", "h.body", "n_hit", "names")
    joined = counted.alias("c").join(found.alias("f"), same("c", "f"), "left")
    names_of = F.coalesce("f.names", F.expr("cast(array() as array<string>)"))
    return joined.select("c.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names_of).cast("long").alias("n_items"), F.sha2(F.array_join(names_of, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER) -> DataFrame:
    """The rows of ``docs``, all columns, without a window of any item."""
    _, hits, _ = _found(docs, benchmark, window, gram, bits)
    names = [fresh(docs.columns, "_hit_d"), fresh(docs.columns, "_hit_b")]
    bad = durable(hits.select(F.col("doc_id").alias(names[0]), F.col("body").alias(names[1])).distinct())
    flagged = docs.withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: text_hash(F.col("text"))})
    same = flagged[names[0]].eqNullSafe(bad[names[0]]) & (flagged[names[1]] == bad[names[1]])
    return flagged.join(bad, same, "left_anti").drop(*names)
