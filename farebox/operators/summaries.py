"""Numeric summaries stored per batch (A15, A17 with one pass over the rows).

Each batch keeps, per numeric column, its count, mean, squared deviations, least
and greatest value and a quantile sketch. Over any set of batches the moments and
bounds follow from these rows alone. Exact quartiles need one pass over the table:
the sketches tell between which values each quartile lies, so only the values in
these brackets are grouped and ranked, the others counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.operators import profile as P
from farebox.session import cut_lineage
from farebox.sources import layers as LY

#: Size of a quantile sketch: some 50 KB for a batch and column.
SKETCH_SIZE = 4096


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Error of a sketch's rank as a share of the rows (99 of 100 times)."""
    return 2.296 / size ** 0.9021


def _long_values(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """(kept columns, column_name, v) without NULL and NaN."""
    stacked = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"))
                                 for c in cols]))
    return df.select(*keep, stacked).where(F.col("v").isNotNull() & ~F.isnan("v"))


def batch_summaries(df: DataFrame, cols: Sequence[str] = tuple(P.NUMERIC_COLUMNS),
                    batch_col: str = LY.BATCH_COL, size: int = SKETCH_SIZE) -> DataFrame:
    """One row per batch and column that has values. Map tasks send one partial
    row each, whatever the size of a batch."""
    return _long_values(df, cols, batch_col).groupBy(batch_col, "column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"),
        (F.var_pop("v") * F.count("v")).alias("squares"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.kll_sketch_agg_double("v", size).alias("sketch"))


def store_summary(df: DataFrame, path: str, batch_id: str, cols: Sequence[str] = tuple(P.NUMERIC_COLUMNS),
                  batch_col: str = LY.BATCH_COL, size: int = SKETCH_SIZE) -> None:
    """Replace the stored summary of one batch; without values it has none."""
    rows = df.where(F.col(batch_col) == F.lit(batch_id))
    LY.batch_replace(batch_summaries(rows, cols, batch_col, size), path, batch_id, batch_col)


def moments(summaries: DataFrame) -> DataFrame:
    """count, mean, sample std, min and max per column, from the summaries alone.
    Squared deviations are merged around the common mean; std of one value is
    NULL, as in ``stddev_samp``."""
    total = summaries.groupBy("column_name").agg(
        F.sum("count").alias("n"), (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"))
    apart = summaries.select("column_name", "count", "squares", F.col("mean").alias("m")).join(
        F.broadcast(total), "column_name")
    squares = apart.groupBy("column_name").agg(
        F.sum(F.col("squares") + F.col("count") * F.pow(F.col("m") - F.col("mean"), 2)).alias("squares"))
    return total.join(squares, "column_name").select(
        "column_name", F.col("n").alias("count"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std"), "min", "max")


def brackets(summaries: DataFrame, probs: Sequence[float], margin: float) -> dict[str, list[tuple[float, float]]]:
    """Per column the disjoint value ranges that should hold the quantiles: from
    the sketch's value at each share less ``margin`` to that at the share plus
    ``margin``. Its rows are columns x shares: a number fixed by the call."""
    ends = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    merged = summaries.groupBy("column_name").agg(
        F.kll_merge_agg_double("sketch").alias("s"), F.min("min").alias("min"), F.max("max").alias("max"))
    rows = merged.select("column_name", "min", "max", *[
        F.kll_sketch_get_quantile_double("s", F.lit(e)).alias(f"q{i}") for i, e in enumerate(ends)]).collect()
    out = {}
    for r in rows:
        found = []
        for i in range(0, len(ends), 2):
            # An end of the shares is an end of the values.
            lo = r["min"] if ends[i] == 0 else r[f"q{i}"]
            hi = r["max"] if ends[i + 1] == 1 else r[f"q{i + 1}"]
            if found and lo <= math.nextafter(found[-1][1], math.inf):
                found[-1] = (found[-1][0], max(found[-1][1], hi))
            else:
                found.append((lo, hi))
        out[r["column_name"]] = found
    return out


def _collapsed(v: Column, ranges: list[tuple[float, float]]) -> Column:
    """``v`` inside a range; outside, one value for all of a gap: the next number
    after the range below it, so that the order of gaps and ranges stays."""
    out, below = None, -math.inf
    for lo, hi in ranges:
        out = F.when(v < lo, F.lit(below)) if out is None else out.when(v < lo, F.lit(below))
        out = out.when(v <= hi, v)
        below = math.nextafter(hi, math.inf)
    return out.otherwise(F.lit(below))


def stored_quantiles(df: DataFrame, summaries: DataFrame, cols: Sequence[str] = tuple(P.NUMERIC_COLUMNS),
                     probs: Sequence[float] = P.QUARTILES, margin: float | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: (column, prob, value).

    ``df`` is read once: values inside the brackets are grouped by value, those
    of a gap counted together. Where a wanted rank falls into a gap (a sketch off
    by more than the margin, or summaries older than the rows), margins are
    widened for all and the pass is repeated, up to whole columns: results never
    rest on the sketches. NULL and NaN aren't values; a column without values
    has no rows.
    """
    margin = 2 * rank_error() if margin is None else margin
    spark = df.sparkSession
    while True:
        whole = margin >= 1
        ranges = {} if whole else brackets(summaries, sorted(probs), margin)
        known = [c for c in cols if c in ranges]
        vals = _long_values(df, cols)
        if not whole:
            v = F.lit(-math.inf)
            for c in known:
                v = F.when(F.col("column_name") == c, _collapsed(F.col("v"), ranges[c])).otherwise(v)
            vals = vals.select("column_name", v.alias("v"))
        counts = vals.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt"))
        found = cut_lineage(P.quantiles_of_counts(counts, probs))
        if whole:
            break
        rows = spark.createDataFrame([(c, lo, hi) for c in known for lo, hi in ranges[c]],
                                     "b_column string, lo double, hi double")
        inside = found.join(F.broadcast(rows), (F.col("column_name") == F.col("b_column"))
                            & F.col("lo_v").between(F.col("lo"), F.col("hi")))
        inside = inside.drop("b_column", "lo", "hi").join(F.broadcast(rows), (F.col("column_name") == F.col("b_column"))
                            & F.col("hi_v").between(F.col("lo"), F.col("hi")))
        if inside.count() == found.count():
            break
        margin = min(1.0, max(margin, 0.001) * 8)
    return found.select("column_name", "prob", P.interpolated().alias("value"))


def stored_describe(df: DataFrame, summaries: DataFrame, cols: Sequence[str] = tuple(P.NUMERIC_COLUMNS)) -> DataFrame:
    """A15 from the summaries, with exact quartiles from one pass over ``df``."""
    q = stored_quantiles(df, summaries, cols).groupBy("column_name").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in zip(P.QUARTILES, ("p25", "p50", "p75"))])
    return moments(summaries).join(q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def stored_histogram(df: DataFrame, summaries: DataFrame, col: str = "booking_value", bins: int = 40) -> DataFrame:
    """A17 with its bounds from the summaries: one pass over ``df`` instead of two."""
    ends = summaries.where(F.col("column_name") == col).agg(F.min("min"), F.max("max")).first()
    lo, hi = (math.nan, math.nan) if ends[0] is None else ends
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return P.histogram(df, col, bins, bounds=(F.lit(float(lo)), F.lit(float(hi))))
