"""Run logs: JSON lines of kind, step, time and what else was measured."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESERVED = ("kind", "step", "time")


def finite(value: Any) -> Any:
    """The value with numbers that are not finite as None, inside lists and objects too."""
    if isinstance(value, Mapping):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def read(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(line, kind, step, time, values): ``values`` has the whole record as VARIANT. Records after step ``upto`` are left out.

    A torn last line, as a crash leaves it, is dropped; any other line that isn't JSON is an error. Each file is one log; its lines are numbered from 0 in its own order.
    Lines are read in splits of files and numbered inside a split; a small table of splits has how many come before, and where a file's last line has no end.
    """
    meta = F.col("_metadata")
    each = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("id"))
    blocks = each.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + F.lit(1)).alias("bytes"), F.max("size").alias("size"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Without an end of the last line a file has a byte less than its lines with theirs; a mark of byte order, which the text reader takes off, is three more.
    short = F.pmod(F.col("size") - F.sum("bytes").over(whole), F.lit(3)) == 2
    # A compressed file's size says nothing of its lines; there, a last line that isn't JSON counts as torn.
    torn = F.rlike("file", F.lit(r"\.(bz2|deflate|gz|lz4|snappy|zst)$")) | short
    splits = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.when(torn, F.sum("n").over(whole) - 1).alias("open"))
    rows = each.join(F.broadcast(splits), ["file", "block"]).select((F.col("id") + F.col("shift")).alias("line"), "open", "value").where("value <> ''")
    v = F.try_parse_json("value")
    torn = v.isNull() & F.coalesce(F.col("line") == F.col("open"), F.lit(False))
    sure = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit("not JSON in line "), (F.col("line") + 1).cast("string"))).cast("variant"))
    at = lambda name, kind: F.try_variant_get("values", f"$.{name}", kind).alias(name)
    found = rows.where(~torn).select("line", sure.alias("values")).select("line", at("kind", "string"), at("step", "long"), at("time", "double"), "values")
    return found if upto is None else found.where(F.col("step") <= upto)


class Log:
    """Appends records to one file on the driver; going on from a step first drops what was written after it."""

    def __init__(self, path: str | Path, resume: int | None = None, clock: Callable[[], float] = time.time):
        self.path, self.clock = Path(path), clock
        self.path.parent.mkdir(parents=True, exist_ok=True)
        if resume is not None and self.path.exists():
            lines = self.path.read_text(encoding="utf-8").split("\n")
            kept = []
            for number, line in enumerate(lines):
                try:
                    kept += [line] if line and json.loads(line)["step"] <= resume else []
                except json.JSONDecodeError:
                    if number < len(lines) - 1:
                        raise ValueError(f"not JSON in line {number + 1}") from None
            fresh = self.path.with_suffix(".fresh")
            fresh.write_text("".join(x + "\n" for x in kept), encoding="utf-8")
            fresh.replace(self.path)

    def write(self, kind: str, step: int, values: Mapping[str, Any] | None = None) -> None:
        if taken := sorted(set(values or ()) & set(RESERVED)):
            raise ValueError(f"reserved: {', '.join(taken)}")
        with self.path.open("a", encoding="utf-8") as out:
            out.write(json.dumps({"kind": kind, "step": step, "time": self.clock()} | finite(dict(values or {})), allow_nan=False) + "\n")
