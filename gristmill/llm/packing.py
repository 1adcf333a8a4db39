"""Best-fit packing by bin completion.

Documents are tokenised and cut on the executors, and their pieces written to the shared folder. Lengths are whole numbers up to the capacity, so all pieces
of the table together are one histogram of at most CAPACITY numbers, which is packed on the driver, whatever the number of rows: a packing is a list of patterns
(the lengths in one sequence) and how often each is used. Pieces are dealt to patterns by their rank among those of one length.

The search branches on the largest length left. Its candidate fillings are the undominated ones: a filling is dominated if some of its pieces could be
swapped for one longer piece, or several for one of their sum, that is still to be had. A filling is used as often as the pieces allow, then less often;
branches whose waste is more than a better packing may have are cut. Best-fit decreasing over the histogram is the incumbent, at every size; the lower
bound (Martello and Toth's L2) ends the search. What bounds it: FEW, STEPS and MOST for the fillings of one node, NODES for the nodes. If at most FEW pieces fit and
STEPS suffice, all undominated fillings are tried, so small tables are packed as well as can be; else singles, pairs, triples and greedy fillings, the MOST fullest.

A NULL text is empty and packs as the end id alone; NULL and repeated doc_ids are kept as they are; an
empty table gives an empty result; other columns are ignored. Ties among pieces of one length go by their place in the written table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import durable, slices

CAPACITY, FEW, STEPS, MOST, NODES = 2048, 24, 3000, 12, 2000
PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Lengths of one sequence, longest first, and how many sequences have them.
Pattern = tuple[tuple[int, ...], int]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: each length goes, many at a time, to the sequences with the least room that holds it."""
    open_: dict[int, Counter[tuple[int, ...]]] = {capacity: Counter()}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r, kinds in open_.items() if length <= r < capacity and kinds):
            for pattern in sorted(open_[room]):
                if not left:
                    break
                left -= _filled(open_, pattern, room, open_[room][pattern], length, left)
        if left:
            each = capacity // length
            open_[capacity][()] += -(-left // each)
            _filled(open_, (), capacity, -(-left // each), length, left)
    return sorted(((p, n) for kinds in open_.values() for p, n in kinds.items() if n and p), reverse=True)


def _filled(open_: dict[int, Counter[tuple[int, ...]]], pattern: tuple[int, ...], room: int, bins: int, length: int, left: int) -> int:
    """Puts up to ``left`` pieces into ``bins`` sequences of one pattern, filling one after the other; how many went."""
    each = room // length
    whole, rest = divmod(min(left, bins * each), each)
    open_[room][pattern] -= whole + (rest > 0)
    if not open_[room][pattern]:
        del open_[room][pattern]
    for number, times in ((each, whole), (rest, 1)):
        if number and times:
            open_.setdefault(room - number * length, Counter())[(*pattern, *[length] * number)] += times
    return whole * each + rest


def dominated(filling: Sequence[int], slack: int, spare: np.ndarray) -> bool:
    """Whether one to three pieces of the filling could be swapped for a single piece of ``spare`` (sorted lengths that are not in it) that
    is longer than one piece, or at least as long as several, and fits with the slack."""
    few = [x for x, n in Counter(filling).items() for _ in range(min(n, 3))]
    for k in (1, 2, 3):
        for some in set(combinations(few, k)):
            s = sum(some)
            at = int(np.searchsorted(spare, s + (k == 1)))
            if at < len(spare) and spare[at] <= s + slack:
                return True
    return False


def completions(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the histogram, the fullest first; of equally full ones that of fewer pieces."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return [()]
    found: set[tuple[int, ...]] = set()
    if int(np.minimum(counts[have], room // have).sum()) > FEW or not _enumerated(counts, have[::-1].tolist(), room, found):
        found = _likely(counts, have, room)
    ranked = sorted(found, key=lambda c: (-sum(c), len(c), c))
    out, available = [], counts[have]
    for c in ranked:
        left = available.copy()
        np.subtract.at(left, np.searchsorted(have, c), 1)
        if not dominated(c, room - sum(c), have[left > 0]):
            out.append(c)
            if len(out) == MOST and len(have) > FEW:
                break
    return out or ranked[:1]


def _enumerated(counts: np.ndarray, have: list[int], room: int, found: set[tuple[int, ...]]) -> bool:
    """All fillings that hold no further piece, unless they take too many steps."""
    steps = 0

    def go(i: int, left: int, taken: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        if steps > STEPS:
            return False
        while i < len(have) and have[i] > left:
            i += 1
        if i == len(have):
            found.add(taken)
            return True
        x = have[i]
        for n in range(min(int(counts[x]), left // x), -1, -1):
            if not go(i + 1, left - n * x, taken + (x,) * n):
                return False
        return True

    done = go(0, room, ())
    smallest = have[-1]
    # What leaves room for a piece that was passed over is no filling.
    found -= {c for c in found if any(x <= room - sum(c) and c.count(x) < counts[x] for x in have) or (not c and smallest <= room)}
    return done


def _likely(counts: np.ndarray, have: np.ndarray, room: int) -> set[tuple[int, ...]]:
    """The longest single, the fullest pairs, the fullest triples if no pair is full, and greedy fillings if no triple is."""
    found: set[tuple[int, ...]] = {(int(have[-1]),)}

    def pairs(space: int, without: int = 0) -> list[tuple[int, int]]:
        usable = have[have <= space]
        partner = np.searchsorted(usable, space - usable, side="right") - 1
        ok = (partner >= 0) & (usable * 2 >= space)
        long, short = usable[ok], usable[partner[ok]]
        need = np.where(long == short, 2, 1) + (long == without)
        good = (counts[long] >= need) & (counts[short] > (short == without))
        long, short = long[good], short[good]
        best = np.argsort(-(long + short), kind="stable")[:MOST]
        return list(zip(long[best].tolist(), short[best].tolist(), strict=True))

    found.update(tuple(sorted(p, reverse=True)) for p in pairs(room))
    if max(map(sum, found)) < room:
        there = counts > 0
        for a in have[::-1][:64].tolist():
            usable = have[: np.searchsorted(have, room - a)]
            if there[room - a - usable].any() and (best := pairs(room - a, a)) and sum(best[0]) == room - a:
                found.add(tuple(sorted((a, *best[0]), reverse=True)))
                break
        else:
            for a in have[::-1][:MOST].tolist():
                found.update(tuple(sorted((a, *p), reverse=True)) for p in pairs(room - a, a)[:2])
    if max(map(sum, found)) < room:
        for a in have[::-1][: 8 * MOST].tolist():
            taken, left, spent = [a], room - a, Counter([a])
            at = len(have) - 1
            while left and (at := min(at, int(np.searchsorted(have, left, side="right")) - 1)) >= 0:
                x = int(have[at])
                n = min(left // x, int(counts[x]) - spent[x])
                taken += [x] * n
                left -= n * x
                at -= 1
            found.add(tuple(sorted(taken, reverse=True)))
    return found


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by total length, and by pieces too long to share a bin (Martello and Toth's L2)."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * sizes)[::-1])[::-1]
    best = -(-int((counts * sizes).sum()) // capacity)
    half = capacity // 2 + 1
    for k in range(1, capacity // 2 + 1):
        if not counts[k] and k > 1:
            continue
        big = int(n[capacity - k + 1])
        middle = int(n[half]) - big
        slack = middle * capacity - int(total[half] - total[capacity - k + 1])
        small = int(total[k] - total[half])
        best = max(best, big + middle + max(0, -(-(small - slack) // capacity)))
    return best


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns for a histogram of lengths: branch and bound around the largest length left."""
    counts = counts.astype(np.int64).copy()
    full: list[Pattern] = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    total, bound = int((counts * np.arange(capacity + 1)).sum()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    least, spent, used, waste, down = sum(n for _, n in best), 0, 0, 0, True
    trail: list[_Level] = []
    while least > bound and spent < nodes + len(best):
        if down:
            high = trail[-1].high if trail else capacity
            while high and not counts[high]:
                high -= 1
            down = False
            if not high:
                if used < least:
                    best, least = [(x.pattern, x.times) for x in trail if x.times], used
                continue
            if waste > (least - 1) * capacity - total:
                continue
            # How often a filling is used is settled once for a length, so that no mixture is met twice.
            settled = trail[-1].settled | {trail[-1].pattern} if trail and trail[-1].high == high else frozenset()
            counts[high] -= 1
            options = [c for c in ((high, *c) for c in completions(counts, capacity - high)) if c not in settled]
            counts[high] += 1
            trail.append(_Level(high, options[::-1], settled))
        if not trail:
            break
        level = trail[-1]
        if level.times:
            for x in level.pattern:
                counts[x] += 1
            level.times -= 1
            used, waste = used - 1, waste - (capacity - sum(level.pattern))
            down = level.times > 0
        elif level.options:
            level.pattern = level.options.pop()
            need = Counter(level.pattern)
            level.times = min(int(counts[x]) // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * level.times
            used, waste = used + level.times, waste + level.times * (capacity - sum(level.pattern))
            down = True
        else:
            trail.pop()
        spent += down
    return full + best


@dataclass
class _Level:
    """A node's length, its fillings not yet tried, those whose use is settled, the one in use, and how often."""

    high: int
    options: list[tuple[int, ...]]
    settled: frozenset[tuple[int, ...]]
    pattern: tuple[int, ...] = ()
    times: int = 0


class Places:
    """Where the pieces of each length go: for ranks in order, sequences and offsets."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        spans: dict[int, list[tuple[int, int, list[int]]]] = {}
        base = 0
        for pattern, times in patterns:
            starts = np.cumsum([0, *pattern[:-1]]).tolist()
            for length in dict.fromkeys(pattern):
                spans.setdefault(length, []).append((base, times, [s for s, x in zip(starts, pattern, strict=True) if x == length]))
            base += times
        self.spans = {k: (np.cumsum([0, *(t * len(o) for _, t, o in v[:-1])]), np.array([b for b, _, _ in v]), [np.array(o) for _, _, o in v]) for k, v in spans.items()}

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, bases, offsets = self.spans[length]
        span = np.searchsorted(starts, rank, side="right") - 1
        each = np.array([len(o) for o in offsets])[span]
        inside = rank - starts[span]
        table = np.zeros((len(offsets), max(map(len, offsets))), np.int64)
        for i, o in enumerate(offsets):
            table[i, : len(o)] = o
        return bases[span] + inside // each, table[span, inside % each]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of all documents, with their task and their place among its pieces of one length."""
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = tokens.encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), tokens.END], dtype="<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((part, seen[n], doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, nodes: int = NODES) -> DataFrame:
    """One row per piece: which sequence holds it and where."""
    kept = durable(pieces(docs, capacity, path))
    by_part = kept.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length, capacity at most
        counts[r.length] = r.n
    known = docs.sparkSession.sparkContext.broadcast(Places(complete(counts, capacity, nodes), capacity))
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")
    ranked = kept.join(by_part.select("part", "length", before), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                sequence[at], offset[at] = known.value.of(int(length[at[0]]), rank[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, SCHEMA)
