"""SimHash near-dedup with multi-index hashing.

A fingerprint has a bit where more than half of the hashes of the shingles (repeats included) have it. Distinct fingerprints are indexed by segments; two
fingerprints at RADIUS bits or fewer agree in some segment up to that segment's share of the difference (the shares add to RADIUS - segments + 1). Each
fingerprint is entered in the table of each segment as it is, and enumerates the Hamming ball of the share to look others up; what
meets in a table entry is verified over all 64 bits.

Rows that meet at an entry are not paired off. Small entries are compared by neighbours at distance 1, 2, ... in sorted order; larger ones by search from one
member to all that are not yet reached, so a dense group costs about its size; either way a task sends one link per
fingerprint and component at most. An entry of more than MOST rows goes another exact way: fingerprints at distance RADIUS or less share a point within half of that of
both, so each names the points of its ball, and the smallest fingerprint at a point is linked to all the others there.

NULL and empty texts have no words: their fingerprint is zero, linked like any other. NULL doc_ids are kept, each with the component of its
fingerprint group (the smallest doc_id that is not NULL, if any). Repeated rows and doc_ids give a row each. An empty table gives an empty result; other columns are ignored.
Long texts are hashed shingle by shingle in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, similarity
from .common import durable, fresh, slices, utf8
from .similarity import TABLE

SHINGLE, RADIUS, SMALL, MOST = 4, 4, 48, 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(TABLE).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed BIGINT) and x, a hash of the text as it is."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "x"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("x")).mapInArrow(scan, "doc_id long, fp long, x long")


def plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, share of the difference) of each segment; one with a negative share would not be needed."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    spare = radius - segments + 1
    shares = [spare // segments + (k < spare % segments) for k in range(segments)] if spare >= 0 else [0 if k < radius + 1 else -1 for k in range(segments)]
    return [(a, b - a, share) for a, b, share in zip(cuts, cuts[1:], shares, strict=False) if share >= 0]


def segments_for(fingerprints: int, radius: int) -> int:
    """As many segments as leave an entry a few members: few, long segments for many fingerprints, though their balls are larger. Any number finds the same links."""
    found = 1
    for segments in range(1, radius + 2):
        if 64 // segments >= fingerprints.bit_length() + 1 or segments == 2:
            found = segments
    return found


def ball(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)], np.uint64)


def _entries(radius: int, segments: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(entry, fp, own) for the tables: each fingerprint's own entry in each segment, and those of its ball."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                for k, (low, bits, share) in enumerate(plan(radius, segments)):
                    flips = ball(bits, share)
                    value = fp >> np.uint64(low) & np.uint64((1 << bits) - 1)
                    keys = (value[:, None] ^ flips[None, :]) | np.uint64(k << 56)
                    own = np.zeros(keys.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64)), pa.array(own.ravel())], ["entry", "fp", "own"])

    return scan


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (node, smallest node it reaches)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def searched(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``radius`` among one entry's members: each reached member to the one it was reached from."""
    left, a, b = np.unique(fp), [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            wave = queue.pop()
            for x in wave:
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    a.append(left[near])
                    b.append(np.full(near.sum(), x))
                    queue.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _linked(radius: int, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by entry to links (a, b); a member of an entry of too many rows comes out as (fp, NULL)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(entry: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        fresh = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        count = np.diff(np.append(fresh, len(entry)))
        owned = np.add.reduceat(own.astype(np.int64), fresh) > 0
        links: list[tuple[np.ndarray, np.ndarray]] = []
        live = (count > 1) & owned
        small = np.repeat(live & (count <= SMALL), count)
        e, f, o = entry[small], fp[small], own[small]
        for k in range(1, SMALL):
            if len(e) <= k:
                break
            pair = np.flatnonzero((e[k:] == e[:-k]) & (o[k:] | o[:-k]))
            if not len(pair):
                if not (e[k:] == e[:-k]).any():
                    break
                continue
            near = pair[np.bitwise_count(f[pair] ^ f[pair + k]) <= radius]
            links.append((f[near], f[near + k]))
        for at, n in zip(fresh[live & (count > SMALL)].tolist(), count[live & (count > SMALL)].tolist(), strict=True):
            links.append(searched(fp[at : at + n], radius))
        if not links:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)
        # As signed numbers, so that the smallest is the same here as in Spark.
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spanning(a, b)], schema=schema)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, fp, own = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        hot: int | None = None  # the entry that is passed on as it is
        for batch in batches:
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            entry, fp, own = (np.concatenate(x) for x in zip((entry, fp, own), part, strict=True))
            if hot is not None:
                n = int(np.searchsorted(entry, hot, side="right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[:n].view(np.int64)), pa.nulls(n, pa.int64())], schema=schema)
                    entry, fp, own = entry[n:], fp[n:], own[n:]
                if len(entry):
                    hot = None
            if len(entry) < 50_000:
                continue
            cut = int(np.searchsorted(entry, entry[-1]))
            if cut:
                yield settle(entry[:cut], fp[:cut], own[:cut])
                entry, fp, own = entry[cut:], fp[cut:], own[cut:]
            if len(entry) > most:
                hot = int(entry[0])
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64())], schema=schema)
                entry, fp, own = entry[:0], fp[:0], own[:0]
        if len(entry):
            yield settle(entry, fp, own)

    return scan


def _points(radius: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = ball(64, -(-radius // 2))
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 64):
                fp = every[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], ["point", "fp"])

    return scan


def links(distinct: DataFrame, radius: int = RADIUS, segments: int | None = None, most: int = MOST) -> DataFrame:
    """Links (a, b) of fingerprints (column fp, distinct) whose components are those of all pairs at ``radius`` bits or fewer."""
    if radius % 2:
        most = 1 << 62  # balls of half an odd radius would link too much
    segments = segments or segments_for(distinct.count(), radius)
    entries = distinct.select("fp").mapInArrow(_entries(radius, segments), "entry long, fp long, own boolean")
    found = durable(entries.repartition("entry").sortWithinPartitions("entry").mapInArrow(_linked(radius, most), "a long, b long"))
    crowd = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    found = found.where("b is not null")
    if crowd.isEmpty():
        return found
    points = crowd.mapInArrow(_points(radius), "point long, fp long")
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select(F.xxhash64("point").alias("h"), F.col("point").alias("p"), "hub")
    starred = points.withColumn("h", F.xxhash64("point")).join(hubs, "h").where("point = p and fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    return found.unionAll(starred)


def _classified(docs: DataFrame, shingle: int, radius: int, segments: int | None, most: int) -> DataFrame:
    """doc_id, fp, x (a hash of the text), root (the component's smallest fingerprint), component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = durable(fingerprints(texts, shingle))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = graph.components(links(distinct, radius, segments, most))
    # Components by their smallest fingerprint; the smallest doc_id is an aggregate of these.
    of = durable(distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.select(F.xxhash64("root").alias("h"), "fp", "root").join(ids.select(F.xxhash64("root").alias("h"), F.col("root").alias("r"), "component_id"), "h").where("root = r")
    named = named.select(F.xxhash64("fp").alias("k"), F.col("fp").alias("f"), "root", "component_id")
    return marked.withColumn("k", F.xxhash64("fp")).join(named, "k").where("fp = f").select("doc_id", "fp", "x", "root", "component_id")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int | None = None, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links lead to."""
    return _classified(docs, shingle, radius, segments, most).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int | None = None, most: int = MOST) -> DataFrame:
    """The document of the smallest doc_id of each group (NULL comes last, then the hash of the text decides), with all its columns.

    Rows of equal doc_id and text are one document and stay or go together.
    """
    names = [fresh(docs.columns, "_kept_d"), fresh(docs.columns, "_kept_x")]
    keys = lambda d, x: (F.coalesce(d.cast("long"), F.lit((1 << 63) - 1)).alias(names[0]), x.alias(names[1]))
    rows = _classified(docs, shingle, radius, segments, most)
    kept = rows.groupBy("root").agg(F.min(F.struct(*keys(F.col("doc_id"), F.col("x")))).alias("kept")).select("kept.*")
    d, x = keys(docs["doc_id"], F.xxhash64(docs["text"].cast("string")))
    return docs.withColumns(dict(zip(names, (d, x), strict=True))).join(kept, names, "left_semi").drop(*names)


def near_dedup(docs: DataFrame, shingle: int = similarity.SHINGLE, radius: int = RADIUS, small: int = similarity.SMALL, slots: int = similarity.SLOTS) -> DataFrame:
    """The document of the smallest doc_id of each group of near-copies, with all its columns: texts linked by a Jaccard index of 0.8 or more of their five-word shingles.

    Texts whose fingerprints meet by multi-index hashing are verified first, the rest of the pairs is found by prefixes (``similarity``). Texts without words (NULL, empty, blank) are
    nobody's copies and stay; equal texts are copies. NULL doc_ids come last in a group, then the hash of the text decides; rows of equal doc_id and text stay or go together.
    """
    names = [fresh(docs.columns, "_kept_d"), fresh(docs.columns, "_kept_x")]
    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    texts = docs.where(worded).select(F.xxhash64(text).alias("x"), text.alias("text"))
    marked = durable(fingerprints(texts.withColumn("doc_id", F.lit(0).cast("long")), shingle).select("fp", "x").distinct())
    of = marked.groupBy("fp").agg(F.min("x").alias("rep"))
    met = links(of.select("fp"), radius)
    pairs = marked.join(of, "fp").where("x <> rep").select(F.col("rep").alias("a"), F.col("x").alias("b"))
    side = lambda c: of.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    pairs = pairs.unionAll(met.join(side("a"), "a").join(side("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    found = graph.components(similarity.links(texts, similarity.verified(pairs, texts), small, slots))
    keys = docs.where(worded).select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias(names[0]), F.xxhash64(text).alias(names[1]))
    least = keys.groupBy(F.col(names[1]).alias("x")).agg(F.min(names[0]).alias("d"))
    rooted = least.join(found.withColumnRenamed("node", "x"), "x", "left").select("d", "x", F.coalesce("component", "x").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("d", "x")).alias("kept")).select(F.col("kept.d").alias(names[0]), F.col("kept.x").alias(names[1]))
    keyed = docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), names[1]: F.xxhash64(text)})
    # The join puts its keys first, so they go before the rows are put together.
    return keyed.where(worded).join(kept, names, "left_semi").drop(*names).unionAll(docs.where(~worded))
