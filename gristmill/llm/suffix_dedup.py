"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier are removed, the first copy stays.

The longest previous factor of a position tells how long a string starting there also starts earlier; its positions
of LENGTH or more are exactly the windows to remove. Previous and next smaller positions in suffix order give it. One suffix array of
100 TB can't be, so contents are brought together first, and each gathering has a suffix order and factors of its own, capped at LENGTH:

1. Each text is cut into runs of windows with one anchor (``anchors``); equal windows have equal anchors. A task
   settles what repeats among its own texts, comparing bytes, and sends one row per distinct run, so a passage in a third of all documents costs a row a task.
2. Anchors are counted; runs whose anchor is found once are dropped. This is an aggregation and a join that Spark can split on hot keys.
3. Runs of equal anchor and content hash are copies of the first of them. Copies that follow each other in both documents are joined to spans; the
   first document sends the span's bytes, and the copy goes only if they are its own. The first of each content goes on if its anchor has other contents too.
4. The bytes of these runs are fetched from their texts and gathered by anchor. Their windows are put in suffix order, and those whose
   previous smaller position shares LENGTH bytes are removed. An anchor with more than HOT runs is gathered window by window instead.
5. Removed windows are joined to the texts and merged.

So no byte goes that hasn't been compared with an earlier one. Two contents that share all 128 bits of anchor and content hash would be an error ("share a hash"), not a wrong
result; another ``seed`` then makes other hashes.

NULL and empty texts lose nothing. A NULL doc_id counts as the smallest (as -2^63, which it equals). Rows of equal doc_id and text are one document, repeated; they lose the
same bytes, and none to each other. Rows of equal doc_id and different text are ordered by two 64-bit hashes of the text, which also tell them apart. An empty table gives an empty
result; other columns are ignored or carried through untouched. A very long text is cut into segments of windows that overlap, and joined again in step 5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors
from .common import durable, slices, text_column, utf8

LENGTH, HOT, HELD, BLOCK = anchors.LENGTH, 1000, 400_000, 20_000
#: What a worker gathers before it sends it on: bytes and rows of contents, and runs compared at once (or one group).
SENT_BYTES, SENT_ROWS, PIECE = 4 << 20, 50_000, 5_000
FIRST_ID = -(1 << 63)
OTHER_NAME = 0x5DEECE66D5DEECE6
#: A document: its doc_id, and two hashes of its text where a doc_id has several texts (else 0).
KEY = ["d", "t", "u"]
RUNS = "m long, s long, d long, t long, u long, loc long, done boolean"
REMOVED = "d long, t long, u long, start long, n long, bytes binary"
_REMOVED = pa.schema([(c, pa.int64()) for c in (*KEY, "start", "n")] + [("bytes", pa.binary())])


def suffix_array(data: bytes) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - k, 0)] = rank[k:]
        order = np.lexsort((second, rank))
        fresh = np.ones(n, bool)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank[order] = np.cumsum(fresh)
        if n == 0 or rank.max() == n or k >= n:
            return order
        k *= 2


def longest_previous_factor(data: bytes) -> np.ndarray:
    """For each position the length of the longest string that starts there and at some earlier position too.

    A stack over suffix order keeps previous smaller positions; popping gives next smaller ones (Crochemore and Ilie).
    """
    n, order = len(data), suffix_array(data).tolist()
    place = [0] * n
    for r, p in enumerate(order):
        place[p] = r
    common, h = [0] * (n + 1), 0
    for p in range(n):
        if place[p] == 0:
            h = 0
            continue
        q = order[place[p] - 1]
        while p + h < n and q + h < n and data[p + h] == data[q + h]:
            h += 1
        common[place[p]] = h
        h = max(h - 1, 0)
    found, stack = np.zeros(n, np.int64), []  # of (position, common prefix with what is below)
    for r in range(n + 1):
        p, shared = (order[r], common[r]) if r < n else (-1, 0)
        while stack and stack[-1][0] > p:
            top, below = stack.pop()
            found[top] = max(below, shared)
            shared = min(below, shared)
        stack.append((p, shared))
    return found


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(FIRST_ID))


def _first_here(m: np.ndarray, s: np.ndarray, key: list[np.ndarray], loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first run of each content, and of those that are later than it with the index of that first one."""
    order = np.lexsort((loc, *key[::-1], s, m))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (m[order][1:] != m[order][:-1]) | (s[order][1:] != s[order][:-1])
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    later = loc[order] != loc[first]
    for k in key:
        later |= k[order] != k[first]
    return order[fresh], order[later], first[later]


def joined(key: list[np.ndarray], start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows with touching ones of a document made one."""
    order = np.lexsort((start, *key[::-1]))
    key, start, n = [k[order] for k in key], start[order], n[order]
    if not len(start):
        return *key, start, n
    same = np.zeros(len(start), bool)
    same[1:] = start[1:] <= start[:-1] + n[:-1]
    for k in key:
        same[1:] &= k[1:] == k[:-1]
    at = np.flatnonzero(~same)
    ends = np.maximum.reduceat(start + n, at)
    return *(k[at] for k in key), start[at], ends - start[at]


def _batch(arrays: Iterable[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)


def _ranges(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), pa.nulls(len(found[0]), pa.binary())], schema=_REMOVED)


def _runs(length: int, gram: int, seed: int, counted: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of each text, or only how many distinct ones each anchor has here."""
    wide = pa.schema([(c, pa.int64()) for c in ("m", "s", *KEY, "loc")] + [("done", pa.bool_())])
    narrow = pa.schema([("k", pa.int64()), ("c", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        data: list[bytes] = []
        texts: list[tuple[int, int, int, int, bytes]] = []
        size = held = 0

        def work() -> None:
            nonlocal size, held
            if not texts:
                return
            whole = b"".join(t[4] for t in texts)
            lengths = np.array([len(t[4]) for t in texts])
            ends = np.cumsum(lengths)
            m, s, at, n = anchors.runs(np.frombuffer(whole, np.uint8), ends, length, gram, seed)
            of = np.searchsorted(ends, at, side="right")
            base = np.array([t[3] for t in texts]) - (ends - lengths)
            key = [np.array([t[k] for t in texts], np.int64)[of] for k in range(3)]
            rows.append((m.view(np.int64), s.view(np.int64), *key, (at + base[of]) << 7 | n, at + sum(map(len, data)), n))
            data.append(whole)
            held += len(m)
            size = 0
            texts.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            m, s, d, t, u, loc, at, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            whole = b"".join(data)
            rows.clear()
            data.clear()
            held = 0
            first, later, of = _first_here(m, s, [d, t, u], loc)
            for a, b, k in zip(at[later].tolist(), at[of].tolist(), n[later].tolist(), strict=True):
                if whole[a : a + k + length - 1] != whole[b : b + k + length - 1]:
                    raise ValueError("two strings share a hash; take another seed")
            if counted:
                yield _batch(np.unique(m[first] ^ OTHER_NAME, return_counts=True), narrow)
                return
            yield _batch((*(x[first] for x in (m, s, d, t, u, loc)), np.zeros(len(first), bool)), wide)
            if len(later):
                d, t, u, start, n = joined([d[later], t[later], u[later]], loc[later] >> 7, n[later])
                away = anchors.scramble((d ^ t ^ start).astype(np.uint64)).view(np.int64)
                yield _batch((away, n, d, t, u, start, np.ones(len(d), bool)), wide)

        for batch in slices(batches, 3):
            for d, t, u, text in zip(*(batch.column(k).to_pylist() for k in range(3)), utf8(batch.column(3)), strict=True):
                if not text or len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, anchors.SEGMENT):
                    part = text[at : at + anchors.SEGMENT + length - 1]
                    if size + len(part) > anchors.SEGMENT + length:
                        work()
                    texts.append((d, t, u, at, part))
                    size += len(part)
            if held >= HELD:
                work()
                yield from flush()
        work()
        yield from flush()

    return scan


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies that follow each other, in their document and in that of the first, made one; they come sorted by the two documents, the distance and the place."""
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]  # d, t, u, fd, ft, fu, away, start, n
        start, n = columns[7], columns[8]
        if not len(start):
            continue
        same = np.zeros(len(start), bool)
        same[1:] = start[1:] <= start[:-1] + n[:-1]
        for c in columns[:7]:
            same[1:] &= c[1:] == c[:-1]
        at = np.flatnonzero(~same)
        ends = np.maximum.reduceat(start + n, at)
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in columns[:8]] + [pa.array(ends - start[at])], batch.schema.names)


def _content(length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the wanted runs (g, their document, loc); those of hot anchors window by window, one row for each content in what is sent at once. Spans asked
    for by other documents come with theirs and no g. However many ask for one document, SENT_BYTES and SENT_ROWS bound what is held, but for the last run."""
    schema = pa.schema([(c, pa.int64()) for c in ("g", *KEY, "loc")] + [("bytes", pa.binary())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int | None, int, int, int, int, bytes]] = []
        hot: dict[bytes, tuple[int, int, int, int]] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal size
            out.extend((_key(w), *place, w) for w, place in hot.items())
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)
            out.clear()
            hot.clear()
            size = 0
            return batch

        for batch in slices(batches, 3):
            fields = dict(zip([f.name for f in batch.column(4).type.value_type], batch.column(4).values.flatten(), strict=True))
            names = ["m", "at", "n", "hot", *KEY, "start"]
            offsets = batch.column(4).offsets.to_pylist()
            for d, t, u, text, low, high in zip(*(batch.column(k).to_pylist() for k in range(3)), utf8(batch.column(3)), offsets, offsets[1:], strict=False):
                for first in range(low, high, 4096):
                    some = min(4096, high - first)
                    for m, at, n, is_hot, rd, rt, ru, start in zip(*(fields[c].slice(first, some).to_pylist() for c in names), strict=True):
                        if size >= SENT_BYTES or len(out) + len(hot) >= SENT_ROWS:
                            yield sent()
                        if m is None:
                            out.append((None, rd, rt, ru, start, text[at : at + n + length - 1]))
                            size += n + length - 1
                            continue
                        if not is_hot:
                            out.append((m, d, t, u, at << 7 | n, text[at : at + n + length - 1]))
                            size += n + length - 1
                            continue
                        later: list[int] = []  # windows of this run that have been met, as [first, count, ...]
                        for p in range(at, at + n):
                            window, place = text[p : p + length], (d, t, u, p << 7 | 1)
                            if (kept := hot.get(window)) is None or place < kept:
                                if kept is not None:
                                    out.append((0, *kept, b""))
                                hot[window] = place
                            elif place != kept:
                                if later and later[-2] + later[-1] == p:
                                    later[-1] += 1
                                else:
                                    later += [p, 1]
                        out += [(0, d, t, u, p << 7 | c, b"") for p, c in zip(later[::2], later[1::2], strict=True)]
        yield sent()

    return scan


def _key(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def repeated(pieces: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """For the windows of all pieces in order of position: whether their longest previous factor, capped at ``length``, is ``length``.

    Windows are put in suffix order, by their first ``length`` bytes and then by position. A factor is the longer of what a window shares with its previous
    smaller position (the nearest on the left that is earlier) and with its next smaller one (on the right). Among windows that share all bytes, positions rise: the
    previous smaller one is the left neighbour if that is one of them, and the next smaller one is never one of them.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    data = np.frombuffer(b"".join(pieces), np.uint8)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    previous_smaller = np.full(len(at), -1)
    alike = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    previous_smaller[alike] = order[alike - 1]
    found = np.zeros(len(at), bool)
    found[order] = previous_smaller >= 0
    return found


def _compared(length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Removed windows among runs that come sorted by their group."""

    def settle(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        """What is removed, and the rows that keep a window."""
        key, loc = [table.column(k).to_numpy() for k in (1, 2, 3)], table.column(4).to_numpy()
        order = np.lexsort((loc, *key[::-1]))
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for x in (*key, loc):
            fresh[1:] |= x[order][1:] != x[order][:-1]
        order = order[fresh]
        key, loc = [k[order] for k in key], loc[order]
        n = loc & 127
        gone = repeated(table.column(5).take(pa.array(order)).to_pylist(), n, length)
        of = np.repeat(np.arange(len(n)), n)[gone]
        inside = np.flatnonzero(gone) - (np.cumsum(n) - n)[of]
        found = joined([k[of] for k in key], (loc[of] >> 7) + inside, np.ones(len(of), np.int64))
        return _ranges(found), order[np.bincount(of, minlength=len(n)) < n]

    def pieces(table: pa.Table) -> Iterator[pa.Table]:
        """Groups that belong together, PIECE rows at most unless one group has more: each is put in suffix order of its own."""
        g, low = table.column(0).to_numpy(), 0
        ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
        while low < len(g):
            high = int(ends[max(np.searchsorted(ends, low + PIECE, side="right") - 1, np.searchsorted(ends, low, side="right"))])
            yield table.slice(low, high - low)
            low = high

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            empty = pc.equal(pc.binary_length(batch.column(5)), 0)
            done = batch.filter(empty)
            if done.num_rows:
                loc = done.column(4).to_numpy()
                yield _ranges(joined([done.column(k).to_numpy() for k in (1, 2, 3)], loc >> 7, loc & 127))
                batch = batch.filter(pc.invert(empty))
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held >= BLOCK:
                table = pa.Table.from_batches(waiting)
                g = table.column(0).to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    for piece in pieces(table.slice(0, cut)):
                        yield settle(piece)[0]
                    table = table.slice(cut)
                elif held >= 4 * BLOCK:  # one window of a hot anchor: its first copy stands for all so far
                    found, kept = settle(table)
                    yield found
                    table = table.take(pa.array(np.sort(kept)))
                waiting, held = table.to_batches(), table.num_rows
        for piece in pieces(pa.Table.from_batches(waiting)) if waiting else ():
            yield settle(piece)[0]

    return scan


def merge(n_bytes: int, ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed (from, to) of a text for ranges of windows (start, count)."""
    spans: list[tuple[int, int]] = []
    for start, n in sorted(ranges):
        low, high = start, min(start + n + length - 1, n_bytes)
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        else:
            spans.append((low, high))
    return spans


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left as text; a character goes only if all its bytes do."""
    kept, at = [], 0
    for low, high in spans:
        while low < high and text[low] & 0xC0 == 0x80:
            low += 1
        while high < len(text) and high > low and text[high] & 0xC0 == 0x80:
            high -= 1
        kept.append(text[at:low])
        at = max(low, high)
    kept.append(text[at:])
    return b"".join(kept).decode("utf-8", "replace")


def removed_windows(docs: DataFrame, length: int = LENGTH, gram: int = anchors.GRAM, hot: int = HOT, seed: int = anchors.SEED) -> tuple[DataFrame, DataFrame]:
    """Documents with their key (KEY, ``text`` and all columns as ``row``), and the ranges of windows to remove by that key, with the bytes they must have or NULL."""
    if length < 16 or not 8 <= gram < length:
        raise ValueError("a string has 16 bytes or more, an anchor 8 or more and fewer than the string")
    text = text_column(F.col("text"))
    hashes = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    each = docs.groupBy(doc_key(F.col("doc_id")).alias("d")).agg(*(f(h) for h in hashes for f in (F.min, F.max))).toDF("d", "a", "b", "x", "y")
    # Only then do the hashes go with each run: they can't be compressed.
    several = not each.where("a <> b or x <> y").isEmpty()
    key = [doc_key(F.col("doc_id")).alias("d"), *((h if several else F.lit(0).cast("long")).alias(c) for h, c in zip(hashes, "tu", strict=True))]
    keyed = docs.select(*key, text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    plain = docs.select(*key, text.alias("text"))
    # Counted under another name of the anchor: both sides of a join on it are then dealt out for the join alone, and Spark may split what is hot.
    anchor = (F.col("k").bitwiseXOR(F.lit(OTHER_NAME))).alias("m")
    counts = plain.mapInArrow(_runs(length, gram, seed, True), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).where("c > 1").select(anchor, F.lit(True).alias("met"))
    runs = plain.mapInArrow(_runs(length, gram, seed, False), RUNS)
    shared = durable(runs.join(counts, "m", "left").where("done or met").select("m", "s", *KEY, "loc", "done"))
    settled = shared.where("done").select(*KEY, F.col("loc").alias("start"), F.col("s").alias("n"), F.lit(None).cast("binary").alias("bytes"))
    open_ = shared.where("not done").drop("done")
    firsts = durable(open_.groupBy("m", "s").agg(F.min(F.struct(*KEY, "loc")).alias("f")).select("m", "s", "f.*"))

    named = firsts.select("m", "s", *(F.col(c).alias(f"f{c}") for c in (*KEY, "loc")))
    later = open_.join(named, ["m", "s"]).where("d <> fd or t <> ft or u <> fu or loc <> floc")
    away = (F.shiftright("floc", 7) - F.shiftright("loc", 7)).alias("away")
    sided = [*KEY, *(f"f{c}" for c in KEY), "away", "start"]
    later = later.select(*KEY, *(f"f{c}" for c in KEY), away, F.shiftright("loc", 7).alias("start"), F.expr("loc & 127").alias("n"))
    spans = later.repartition(*KEY).sortWithinPartitions(*sided).mapInArrow(_spans, ", ".join(f"{c} long" for c in (*sided, "n")))

    asked = F.struct(F.lit(None).cast("long").alias("m"), (F.col("start") + F.col("away")).alias("at"), "n", F.lit(False).alias("hot"), *KEY, "start")
    asks = spans.select(*(F.col(f"f{c}").alias(f"_{c}") for c in KEY), asked.alias("run"))
    groups = firsts.select(F.col("m").bitwiseXOR(F.lit(OTHER_NAME)).alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select(anchor, (F.col("c") > hot).alias("hot"))
    nobody = [F.lit(0).cast("long").alias(c) for c in (*KEY, "start")]
    wanted = firsts.join(groups, "m").select(*(F.col(c).alias(f"_{c}") for c in KEY), F.struct("m", F.shiftright("loc", 7).alias("at"), F.expr("loc & 127").alias("n"), "hot", *nobody).alias("run"))
    runs_of = asks.unionAll(wanted).groupBy(*(f"_{c}" for c in KEY)).agg(F.collect_list("run").alias("runs"))
    runs_of = runs_of.withColumnsRenamed({f"_{c}": c for c in KEY})
    content = durable(keyed.select(*KEY, "text").join(runs_of, KEY).select(*KEY, "text", "runs").mapInArrow(_content(length), "g long, d long, t long, u long, loc long, bytes binary"))
    copies = content.where("g is null").select(*KEY, F.col("loc").alias("start"), (F.length("bytes") - (length - 1)).cast("long").alias("n"), "bytes")
    # What a task has settled itself has no bytes; it is dealt out anyhow.
    dealt = content.where("g is not null").repartition(F.when(F.length("bytes") == 0, F.xxhash64("d", "loc")).otherwise(F.col("g"))).sortWithinPartitions("g")
    compared = dealt.mapInArrow(_compared(length), REMOVED)
    return keyed, settled.unionByName(copies).unionByName(compared)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = anchors.GRAM, hot: int = HOT, seed: int = anchors.SEED) -> DataFrame:
    """All columns of ``docs`` with ``text`` as it is left, then n_bytes, n_removed, n_spans, kept_sha256 and spans; clashing columns are replaced."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    keyed, removed = removed_windows(docs.drop(*made), length, gram, hot, seed)
    return _applied(keyed, removed, length, True).select("row.*", "text", *made)


def digest(docs: DataFrame, length: int = LENGTH, gram: int = anchors.GRAM, hot: int = HOT, seed: int = anchors.SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    keyed, removed = removed_windows(docs.select("doc_id", "text"), length, gram, hot, seed)
    return _applied(keyed, removed, length, False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _applied(keyed: DataFrame, removed: DataFrame, length: int, with_text: bool) -> DataFrame:
    ranges = removed.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "bytes")).alias("ranges"))
    matched = keyed.join(ranges, KEY, "left").select("text", "ranges", "row")
    extra = [T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])))] if with_text else []
    schema = T.StructType([T.StructField("row", matched.schema["row"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), *extra])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            out = []
            for text, ranges in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for r in ranges or ():
                    if r["bytes"] is not None and text[r["start"] : r["start"] + len(r["bytes"])] != r["bytes"]:
                        raise ValueError("two strings share a hash; take another seed")
                spans = merge(len(text), [(r["start"], r["n"]) for r in ranges], length) if ranges else []
                kept, at = hashlib.sha256(), 0
                for low, high in spans:
                    kept.update(text[at:low])
                    at = high
                kept.update(text[at:])
                row = (len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest())
                out.append((*row, whole_characters(text, spans), [{"from": a, "to": b} for a, b in spans]) if with_text else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(2), *columns], schema.names)

    return matched.mapInArrow(finish, schema)
