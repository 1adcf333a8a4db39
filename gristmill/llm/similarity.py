"""The exact part of SimHash near-dedup: texts whose sets of five-word shingles have a Jaccard index of SIMILAR or more.

Fingerprints of 64 bits can't tell this similarity: texts at 0.8 differ by some ten bits, and balls that wide hold too much of a large table. So ``simhash.near_dedup`` takes
from multi-index hashing what is within its radius, and what it joins on the texts is a class already. The other pairs come from prefixes. All shingles have one order; a set of n
that is similar to another shares a shingle with it among the first n - ceil(SIMILAR n) + 1 of each, so no pair is missed. Shingles of few documents come first, by counts in SLOTS
hashed slots: what the slots count decides only how many candidates there are, not what is found. Candidates of one class, and those whose sizes or places rule the similarity out, are
left; all others are verified on the texts.

A shingle in the prefix of more than SMALL texts doesn't pair them off: a group of near-copies has far more similar pairs than it needs to be one class. Such a shingle pairs its texts with
one of them first. Then sketches say which pairs can be similar at all: BITS parities of shingle counts, of which each shingle that one of two texts has alone changes one at most, so what they
rule out isn't similar. For TURNS turns a shingle pairs no more texts than would make one class of those that its sketches allow, if all these pairs were similar; most are. Only pairs that the
sketches allow and that are of unlike classes still, then are all looked at.

Words are runs without blanks, A-Z lower-cased; a text of five words or fewer is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, graph
from .common import discard, durable, slices, utf8

TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: SIMILAR as a fraction, so that sizes are compared in whole numbers.
SHINGLE, SIMILAR, SLOTS, SMALL, BLOCK = 5, (4, 5), 1 << 20, 32, 50_000
TURNS, BITS = 2, 1024


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = text.translate(TABLE).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _counted(slots: int, summed: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counts of shingles by slot, as one row: of texts, or of such rows."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(slots, np.uint32), set()
        for batch in batches if summed else slices(batches, 0):
            if summed:
                for value in batch.column(0).to_pylist():
                    counts += np.frombuffer(pa.decompress(value, slots * 4, "zstd", asbytes=True), np.uint32)
                continue
            for value, x in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if x not in seen:
                    seen.add(x)
                    np.add.at(counts, (shingles(value) & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(counts.tobytes(), "zstd", asbytes=True)], pa.binary())], ["counts"])

    return scan


def _prefixes(counts, slots: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, x, n, p): the p-th shingle of a text of n, for its prefix; shingles of one text only are left out."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, seen = counts.value, set()
        for batch in slices(batches, 0):
            out: list[tuple[np.ndarray, ...]] = []
            for text, x in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if x in seen:
                    continue
                seen.add(x)
                h = shingles(text)
                met = rare[(h & np.uint64(slots - 1)).astype(np.int64)]
                n = len(h)
                order = np.lexsort((h, met))[: n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1]
                p = np.flatnonzero(met[order] > 1)
                out.append((h[order[p]].view(np.int64), np.full(len(p), x, np.int64), np.full(len(p), n, np.int64), p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["h", "x", "n", "p"])

    return scan


def possible(n: np.ndarray, p: np.ndarray, m: np.ndarray | int, q: np.ndarray | int) -> np.ndarray:
    """Whether texts of n and m shingles that first meet at places p and q can be similar."""
    need = -(-SIMILAR[0] * (n + m) // (SIMILAR[0] + SIMILAR[1]))
    return np.minimum(n - p, m - q) >= need


def sketch(h: np.ndarray) -> bytes:
    """Of BITS groups of hashes, whether the set has an odd number."""
    return np.packbits(np.bincount((h >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(shingles(t)) for t in utf8(batch.column(1))], pa.binary())], ["x", "sketch"])


def sketches(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """``crowd`` with the sketch of each of its texts."""
    wanted = crowd.select("x").distinct()
    held = texts.join(wanted, "x", "left_semi").groupBy("x").agg(F.first("text").alias("text"))
    return crowd.join(held.mapInArrow(_sketched, "x long, sketch binary"), "x").select("h", "x", "n", "p", "sketch")


def _met(small: int | None = None, turn: int | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates (a, b, then NULLs) of unlike classes among texts (h, x, n, p, label, maybe sketch) that come sorted by shingle. A shingle with more than ``small`` texts pairs them
    with one of them only, and each comes out as (x, NULL, h, n, p) too. With ``turn`` a class is paired once with what it would then be one class with, other texts each turn; with
    neither all pairs come out."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "h", "n", "p")])

    def settle(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, x, n, p, label, marks = columns
        links, crowd, held = [np.empty((0, 2), np.int64)], [], 0
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(starts, len(h)))
        large = count > (small if small is not None else 1)
        if small is not None:
            # What few texts share is compared by neighbours at distance 1, 2, ...
            own, shingle, size, place, name = (c[np.repeat(~large, count)] for c in (x, h, n, p, label))
            for k in range(1, small):
                at = np.flatnonzero(shingle[k:] == shingle[:-k])
                if not len(at):
                    break
                at = at[name[at] != name[at + k]]
                at = at[possible(size[at], place[at], size[at + k], place[at + k])]
                links.append(np.stack([np.minimum(own[at], own[at + k]), np.maximum(own[at], own[at + k])], axis=1))
        for low, high in zip(starts[large].tolist(), (starts + count)[large].tolist(), strict=True):
            if (label[low:high] == label[low]).all():
                continue
            own, first = np.unique(x[low:high], return_index=True)
            size, place, name, mark = n[low:high][first], p[low:high][first], label[low:high][first], marks[low:high][first]
            if turn is not None:
                mixed = np.argsort(anchors.scramble(((own ^ h[low]) + turn).view(np.uint64)))
                own, size, place, name, mark = (c[mixed] for c in (own, size, place, name, mark))
            # A pair of unlike classes has a text outside the largest class.
            _, kind, members = np.unique(name, return_inverse=True, return_counts=True)
            some = np.flatnonzero(kind != members.argmax())
            if small is not None and len(own) > small:
                crowd.append(np.arange(low, high)[first])
                some = some[:1]
            for i in some.tolist():
                other = np.flatnonzero((kind != kind[i]) & possible(size, place, int(size[i]), int(place[i])))
                # Shingles that only one of two similar texts has are a ninth of both sizes at most.
                other = other[9 * np.bitwise_count(mark[other] ^ mark[i]).sum(axis=1, dtype=np.int64) <= size[other] + size[i]]
                if turn is not None:
                    met, at = np.unique(kind[other], return_index=True)
                    other = other[at]
                    kind[np.isin(kind, met)] = kind[i]
                if len(other):
                    links.append(np.stack([np.minimum(own[other], own[i]), np.maximum(own[other], own[i])], axis=1))
                    held += len(other)
            if held > 1 << 18:
                yield batch_of(np.concatenate(links), crowd, x, h, n, p)
                links, crowd, held = links[:1], [], 0
        yield batch_of(np.concatenate(links), crowd, x, h, n, p)

    def batch_of(links: np.ndarray, crowd: list[np.ndarray], x: np.ndarray, h: np.ndarray, n: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        links = np.unique(links, axis=0)
        at = np.concatenate(crowd) if crowd else np.empty(0, np.int64)
        nulls = pa.nulls(len(links), pa.int64())
        mine = lambda c: pa.concat_arrays([nulls, pa.array(c[at], pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([links[:, 0], x[at]]), pa.int64()), pa.concat_arrays([pa.array(links[:, 1], pa.int64()), pa.nulls(len(at), pa.int64())]), mine(h), mine(n), mine(p)], schema=schema)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64) if batch.num_columns > 5 else np.empty((batch.num_rows, 0), np.uint64)
            waiting.append([*(c.to_numpy() for c in batch.columns[:5]), marks])
            held += batch.num_rows
            if held >= BLOCK:
                columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shingle may go on
                if cut:
                    yield from settle([c[:cut] for c in columns])
                waiting = [[c[cut:] for c in columns]]
                held = len(columns[0]) - cut if cut else 0
        if waiting:
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            if len(columns[0]):
                yield from settle(columns)

    return scan


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}

    def of(x: int, text: bytes) -> np.ndarray:
        if x not in known:
            if len(known) >= 64:
                known.clear()
            known[x] = shingles(text)
        return known[x]

    for batch in slices(batches, 2):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ok = [similar(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, utf8(batch.column(2)), utf8(batch.column(3)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar; ``texts`` has x and text, maybe repeated."""
    pairs = durable(pairs.select("a", "b").distinct())
    needed = pairs.select(F.col("a").alias("x")).unionAll(pairs.select(F.col("b").alias("x"))).distinct()
    held = durable(texts.join(needed, "x", "left_semi").groupBy("x").agg(F.first("text").alias("text")))
    # Few pairs are one small file and so one task; what is dear about them is the texts.
    dealt = pairs.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    joined = dealt.join(held.select(F.col("x").alias("a"), F.col("text").alias("s")), "a").join(held.select(F.col("x").alias("b"), F.col("text").alias("t")), "b")
    found = durable(joined.select("a", "b", "s", "t").mapInArrow(_verified, "a long, b long"))
    discard(pairs, held)
    return found


def _labelled(entries: DataFrame, found: DataFrame) -> DataFrame:
    """h, x, n, p, the class of x as far as the links say, and the sketch if there is one; sorted by shingle."""
    label = graph.components(found).select(F.col("node").alias("x"), "component")
    labelled = entries.join(label, "x", "left").select("h", "x", "n", "p", F.coalesce("component", "x").alias("label"), *entries.columns[4:])
    return labelled.repartition("h").sortWithinPartitions("h")


def links(texts: DataFrame, found: DataFrame, small: int = SMALL, slots: int = SLOTS) -> DataFrame:
    """Links (a, b) of texts (x, a hash of the text, and text) whose components are those of all similar pairs; ``found`` are similar pairs that are known already."""
    text = texts.select("text", "x")
    rows = text.mapInArrow(_counted(slots, False), "counts binary").repartition(8).mapInArrow(_counted(slots, True), "counts binary").collect()
    counts = np.zeros(slots, np.uint32)
    for r in rows:
        counts += np.frombuffer(pa.decompress(bytes(r.counts), slots * 4, "zstd", asbytes=True), np.uint32)
    entries = text.mapInArrow(_prefixes(texts.sparkSession.sparkContext.broadcast(counts), slots), "h long, x long, n long, p long")
    columns = "a long, b long, h long, n long, p long"
    met = durable(_labelled(entries, found).mapInArrow(_met(small), columns))
    found = found.unionAll(verified(met.where("b is not null"), texts))
    crowd = met.where("b is null").select("h", F.col("a").alias("x"), "n", "p")
    if crowd.isEmpty():
        return found
    crowd = durable(sketches(crowd, texts))
    for turn in range(TURNS):
        found = found.unionAll(verified(_labelled(crowd, found).mapInArrow(_met(turn=turn), columns), texts))
    return found.unionAll(verified(_labelled(crowd, found).mapInArrow(_met(), columns), texts))
