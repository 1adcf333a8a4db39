"""Packed token sequences, masks, schedules and learning-rate curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_numbers(tokens: DataFrame, seq: str, pos: str, is_end: Column) -> DataFrame:
    """``doc``: ends before a position in its sequence, so an end belongs to the document that it ends."""
    before = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("doc", F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)).cast("long"))


def mask_pairs(numbered: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """(seq, i, j): position i may look at j of its document, not after it.

    A position looks back over a run without gaps, so a mask is stored as (seq, i, first j); pairs are made only when asked for, each from its own row.
    """
    first = F.min(pos).over(Window.partitionBy(seq, "doc"))
    return numbered.withColumn("_first", first).select(seq, F.col(pos).alias("i"), F.explode(F.sequence("_first", pos)).alias("j"))


def running_positions(rows: DataFrame, seq: str, pos: str, valid: Column) -> DataFrame:
    """``position``: valid places up to here less one, at least 0."""
    upto = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("position", F.greatest(F.sum(valid.cast("int")).over(upto) - 1, F.lit(0)).cast("long"))


def cache_mask(rows: DataFrame, seq: str, pos: str, valid: str) -> DataFrame:
    """(seq, i, j): j is valid and not after i, or is i itself."""
    a, b = rows.alias("a"), rows.alias("b")
    same = F.col(f"a.{seq}") == F.col(f"b.{seq}")
    seen = (F.col(f"b.{valid}") & (F.col(f"b.{pos}") <= F.col(f"a.{pos}"))) | (F.col(f"a.{pos}") == F.col(f"b.{pos}"))
    return a.join(b, same & seen).select(F.col(f"a.{seq}").alias(seq), F.col(f"a.{pos}").alias("i"), F.col(f"b.{pos}").alias("j"))


def line_starts(rows: DataFrame, order: str, part: str, size: Column) -> DataFrame:
    """``start``: bytes before a row in the order of (part, order). Parts are few; their totals are broadcast."""
    totals = rows.groupBy(part).agg(F.sum(size).alias("_size"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(part, "_base")
    inside = F.coalesce(F.sum(size).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", inside).join(before, part).withColumn("start", F.col("start") + F.col("_base")).drop("_base")


def check_schedule(total: int, warmup: int, decay: int, final: float) -> None:
    if total < 1 or min(warmup, decay) < 0 or warmup + decay > total or not 0 <= final <= 1:
        raise ValueError("total must be positive, warm-up and decay fit in it, and the final factor be from 0 to 1")


def rate_factor(step: Column, total: int, warmup: int, decay: int, final: float = 0.0) -> Column:
    """Linear warm-up, a level, and a cool-down by one minus a square root."""
    check_schedule(total, warmup, decay, final)
    rising = (step + 1).cast("double") / F.lit(float(max(warmup, 1)))
    done = (step - (total - decay)).cast("double") / F.lit(float(max(decay, 1)))
    return F.when(step < warmup, rising).when(step < total - decay, F.lit(1.0)).otherwise(F.lit(final) + F.lit(1.0 - final) * (F.lit(1.0) - F.sqrt(done)))


def due(step: Column, every: int, last: Column) -> Column:
    """Whether something done every so many steps, and at the end, is due after ``step``."""
    return (step % every == 0) | (step == last)
