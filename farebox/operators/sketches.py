"""Distinct counts from stored sketches (A13 without reading old batches again).

Each batch keeps one HyperLogLog sketch per column beside it. A new or repeated
batch replaces its own sketch; the count over any set of batches is a union of
their sketches, some kilobytes each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.sources import layers as LY

#: Base-2 logarithm of a sketch's registers: 16,384, some 16 KB a batch.
LG_REGISTERS = 14


def relative_error(lg_registers: int = LG_REGISTERS) -> float:
    """Standard error of an estimate from a union, as a share of the count."""
    return 1.04 / math.sqrt(2 ** lg_registers)


def batch_sketches(df: DataFrame, col: str, batch_col: str = LY.BATCH_COL,
                   lg_registers: int = LG_REGISTERS) -> DataFrame:
    """One sketch per batch (and the NULL batch) of the column's values.

    Partial sketches are made in the map tasks, so a batch with a third of all
    rows sends one sketch per task. NULLs aren't counted; values go in as 64-bit
    hashes, so empty texts are.
    """
    value = F.when(F.col(col).isNotNull(), F.xxhash64(col))
    return df.groupBy(batch_col).agg(F.hll_sketch_agg(value, lg_registers).alias("sketch"))


def store_sketch(df: DataFrame, path: str, batch_id: str, col: str, batch_col: str = LY.BATCH_COL,
                 lg_registers: int = LG_REGISTERS) -> None:
    """Replace the stored sketch of one batch; without rows it has none."""
    rows = df.where(F.col(batch_col) == F.lit(batch_id))
    LY.batch_replace(batch_sketches(rows, col, batch_col, lg_registers), path, batch_id, batch_col)


def distinct_estimate(sketches: DataFrame) -> DataFrame:
    """A13 over the given sketches: ``distinct_count`` within three times
    ``relative_error`` of the exact count, with a chance of 0.997; 0 without
    sketches."""
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.agg(F.coalesce(union, F.lit(0)).cast("long").alias("distinct_count"))
