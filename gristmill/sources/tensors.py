"""Tensor files with a JSON header: eight bytes of its length, the header, then the data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "?"}


def parse(data: bytes) -> dict[str, np.ndarray]:
    """Arrays by name; an error unless header and data agree to the byte, without gaps or overlaps."""
    if len(data) < 8 or (size := int.from_bytes(data[:8], "little")) > len(data) - 8:
        raise ValueError("the header is cut short")
    try:
        header = json.loads(data[8 : 8 + size])
    except ValueError as e:
        raise ValueError(f"the header isn't JSON: {e}") from None
    if not isinstance(header, dict):
        raise ValueError("the header isn't an object")
    body, found, at = memoryview(data)[8 + size :], {}, 0
    entries = [(k, v) for k, v in header.items() if k != "__metadata__"]
    for name, entry in sorted(entries, key=lambda e: e[1]["data_offsets"]):
        kind, shape, (low, high) = entry["dtype"], entry["shape"], entry["data_offsets"]
        if kind not in KINDS and kind != "BF16":
            raise ValueError(f"{name} is of unknown kind {kind}")
        width = 2 if kind == "BF16" else np.dtype(KINDS[kind]).itemsize
        if low != at or high - low != prod(shape) * width or high > len(body):
            raise ValueError(f"{name} doesn't lie where its shape says")
        part = body[low:high]
        if kind == "BF16":
            found[name] = (np.frombuffer(part, "<u2").astype(np.uint32) << 16).view(np.float32).reshape(shape)
        else:
            found[name] = np.frombuffer(part, KINDS[kind]).reshape(shape)
        at = high
    if at != len(body):
        raise ValueError(f"{len(body) - at} bytes belong to no tensor")
    return found


def read(spark: SparkSession, paths: str) -> DataFrame:
    """(path, name, shape, values) of every tensor in files."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, array in parse(data).items():
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([list(array.shape)], pa.list_(pa.int64())), pa.array([array.ravel().astype(np.float64)], pa.list_(pa.float64()))], ["path", "name", "shape", "values"])

    return spark.read.format("binaryFile").load(paths).select("path", F.col("content")).mapInArrow(scan, "path string, name string, shape array<long>, values array<double>")


def renamed(name: str, rules: Iterable[tuple[str, str]]) -> str:
    """A key after a chain of replacements."""
    for pattern, to in rules:
        name = re.sub(pattern, to, name)
    return name
