"""A keyed Feistel permutation of the numbers 0 to n-1, as a Spark column and as plain Python.

The domain is a grid of ceil(sqrt(n)) by ceil(n / that) cells, walked in alternating modular rounds. A number that the
rounds send outside 0..n-1 is sent on until it is inside (cycle walking): the grid has fewer than sqrt(n) cells too
many, so a second step is rare and the bound on steps is never met; if it were, the column raises an error rather
than give a wrong number.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, STEPS, PRIME = 6, 48, 2147483647


def round_keys(key: str) -> list[tuple[int, int]]:
    """A multiplier and an addend below PRIME for each round."""
    digests = [hashlib.sha256(f"{key}/{r}".encode()).digest() for r in range(ROUNDS)]
    return [(1 + int.from_bytes(d[:8], "big") % (PRIME - 1), int.from_bytes(d[8:16], "big") % PRIME) for d in digests]


def grid(n: int) -> tuple[int, int]:
    a = isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permute(x: int, n: int, key: str) -> int:
    """Where the number ``x`` of 0..n-1 goes."""
    (a, b), keys = grid(n), round_keys(key)
    while True:
        left, right = x // b, x % b
        for r, (m, c) in enumerate(keys):
            y = ((right if r % 2 == 0 else left) % PRIME * m + c) % PRIME
            y = (y * y % PRIME * m + c) % PRIME
            if r % 2 == 0:
                left = (left + y) % a
            else:
                right = (right + y) % b
        x = left * b + right
        if x < n:
            return x


def permute_array(x: np.ndarray, n: int, key: str) -> np.ndarray:
    """``permute`` over an array of int64; all products are below 2^62."""
    (a, b), keys = grid(n), round_keys(key)
    out = np.array(x, np.int64)
    left = np.arange(len(out))  # those that are not inside yet
    while len(left):
        u, v = out[left] // b, out[left] % b
        for r, (m, c) in enumerate(keys):
            y = ((v if r % 2 == 0 else u) % PRIME * m + c) % PRIME
            y = (y * y % PRIME * m + c) % PRIME
            if r % 2 == 0:
                u = (u + y) % a
            else:
                v = (v + y) % b
        out[left] = u * b + v
        left = left[out[left] >= n]
    return out


def permute_column(x: Column, n: int, key: str) -> Column:
    """``permute`` over a BIGINT column, JVM-side. The rounds are a fold, so the expression stays small."""
    a, b = (F.lit(v).cast("long") for v in grid(n))
    rounds = F.array(*(F.struct(F.lit(r % 2 == 0).alias("e"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for r, (m, c) in enumerate(round_keys(key))))

    def mixed(value: Column, k: Column) -> Column:
        y = (value % PRIME * k["m"] + k["c"]) % PRIME
        return F.aggregate(F.array(y), F.lit(0).cast("long"), lambda _, v: (v * v % PRIME * k["m"] + k["c"]) % PRIME)

    def one(s: Column, k: Column) -> Column:
        even = k["e"]
        add = mixed(F.when(even, s["r"]).otherwise(s["l"]), k)
        return F.struct(F.when(even, (s["l"] + add) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + add) % b).alias("r"))

    def step(value: Column) -> Column:
        start = F.struct(F.call_function("div", value, b).alias("l"), (value % b).alias("r"))
        return F.aggregate(rounds, start, one, lambda s: s["l"] * b + s["r"])

    first = step(x)
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), first, lambda s, _: F.when(s < n, s).otherwise(step(s)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a Feistel walk is longer than its bound")).cast("long"))
