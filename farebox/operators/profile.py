"""Exploratory profile of a ride table: nulls, types, distinct keys, value
distributions, numeric summary, histogram and density curve.

Every profile is one or two passes of partial+final aggregates. Null counts
and column types aggregate wide and unpivot the single result row; value
distributions stack the few profiled columns and aggregate them in one
shuffle; the exact quartiles and ranks use a distributed prefix sum over
range partitions, so no column is ever gathered into a single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions import columns as C
from farebox.session import cut_lineage

# --- Fixed values: texts a pandas CSV read turns into missing values. ---
PANDAS_NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                   "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                   "n/a", "nan", "null"]
# --- end of fixed values ---

KEY_COLUMNS = ["booking_status", "vehicle_type", "payment_method"]
NUMERIC_COLUMNS = ["booking_value", "ride_distance", "driver_ratings", "customer_rating"]
REASON_COLUMNS = ["reason_customer", "driver_reason", "incomplete_reason"]


def na_normalise(c: str | Column) -> Column:
    """S8 helper: a text equal to one of the reader's NA texts -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(PANDAS_NA_TEXTS), F.lit(None).cast("string")).otherwise(c)


def eda_view(df: DataFrame) -> DataFrame:
    """NA texts of every string column become NULL (as a pandas read)."""
    string_cols = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[na_normalise(c).alias(c) if c in string_cols else F.col(c)
                       for c in df.columns])


def _stack(pairs: list[tuple[str, Column]], key: str, value: str) -> Column:
    """Unpivot generator: one (key, value) row per named column."""
    args = []
    for name, col in pairs:
        args += [F.lit(name), col]
    return F.stack(F.lit(len(pairs)), *args).alias(key, value)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, one pass, then unpivoted (column, null_count)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "null_count")


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count and row count."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    pairs = [(c, F.struct(F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                          F.col(c).alias("non_null"))) for c in df.columns]
    long = wide.select("_rows", _stack(pairs, "column_name", "_s"))
    return long.select("column_name", F.col("_s.dtype").alias("dtype"),
                       F.col("_s.non_null").alias("non_null"), F.col("_rows").alias("rows"))


def distinct_count(df: DataFrame, col: str = "booking_id", approx: bool = False,
                   rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values; HyperLogLog++ when ``approx``."""
    f = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(f.alias("distinct_count"))


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = [(c, F.col(c).cast("string")) for c in cols]
    return df.select(_stack(pairs, "column_name", "value"))


def value_distribution(df: DataFrame, cols: Sequence[str] = KEY_COLUMNS,
                       places: int = 2) -> DataFrame:
    """Count and share (rounded half up) per value, NULL included, for
    several columns in one aggregate; sorted by column, count desc."""
    counts = _long_values(df, cols).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("count"))
    # Per-column totals: one row per profiled column, broadcast by construction.
    totals = counts.groupBy("column_name").agg(F.sum("count").alias("_total"))
    counts = counts.join(F.broadcast(totals), "column_name")
    return (counts.withColumn("pct", C.pct_half_up(F.col("count"), F.col("_total"), places))
            .drop("_total")
            .orderBy("column_name", F.desc("count"), F.asc_nulls_first("value")))


def reason_counts(df: DataFrame, cols: Sequence[str] = REASON_COLUMNS) -> DataFrame:
    """Count per non-null value of each reason column."""
    return (_long_values(df, cols).where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("column_name", F.desc("count"), "value"))


def ordered_counts(df: DataFrame, col: str, places: int = 1) -> DataFrame:
    """Bars by frequency (desc) with the pie share to ``places``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    out = counts.withColumn("pct", C.pct_half_up(F.col("count"), total, places))
    return global_row_number(out, [F.desc("count"), F.asc("value")], "rank").orderBy("rank")


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total order, without a global
    window: rows are range-partitioned on the order, numbered inside their
    partition, and offset by the sizes of the partitions before (a few rows,
    broadcast). Partition ids are pinned by a reliable checkpoint."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return (ranged.withColumn("_in", inside).join(F.broadcast(before), "_pid")
            .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
            .drop("_pid", "_in", "_before"))


# --- numeric summary ------------------------------------------------------

QUARTILES = (0.25, 0.5, 0.75)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES,
                    partitions: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (as numpy/pandas).

    Distributed: values are reduced to (column, value, count), range
    partitioned, each partition's total is summed into a prefix (a few rows
    per partition), and the rows holding the wanted ranks are found with a
    running count inside each partition. No step holds a whole column.
    Result: (column, prob, value).
    """
    vals = _long_values_num(df, cols).where(F.col("v").isNotNull())
    counts = vals.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt"))
    return quantiles_of_counts(counts, probs, partitions).select(
        "column_name", "prob", interpolated().alias("value"))


def interpolated() -> Column:
    """The quantile between its two neighbours, by ``quantiles_of_counts``."""
    frac = F.col("pos") - F.floor("pos")
    return F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * frac


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float] = QUARTILES,
                        partitions: int | None = None) -> DataFrame:
    """The values at the two ranks around each quantile, from rows (column_name,
    v, cnt): column_name, prob, pos, lo_v, hi_v."""
    spark = counts.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(n_parts, "column_name", "v").withColumn(
        "pid", F.spark_partition_id())
    # Partition ids must be the same in both uses below: cut lineage once.
    ranged = cut_lineage(ranged)
    part_tot = ranged.groupBy("column_name", "pid").agg(F.sum("cnt").alias("ptot"))
    before_part = part_tot.withColumn(
        "pbefore", F.coalesce(F.sum("ptot").over(
            Window.partitionBy("column_name").orderBy("pid")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n_by_col = part_tot.groupBy("column_name").agg(F.sum("ptot").alias("n"))
    within = Window.partitionBy("pid", "column_name").orderBy("v").rowsBetween(
        Window.unboundedPreceding, -1)
    cum = (ranged.withColumn("inbefore", F.coalesce(F.sum("cnt").over(within), F.lit(0)))
           .join(before_part.select("column_name", "pid", "pbefore"), ["column_name", "pid"])
           .select("column_name", "v", "cnt", (F.col("pbefore") + F.col("inbefore")).alias("start")))
    # Targets: two ranks per (column, prob); a few rows, size fixed by the
    # number of columns and probabilities.
    prob_rows = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    targets = n_by_col.select("column_name", "n", prob_rows).withColumn(
        "pos", F.col("prob") * (F.col("n") - 1)).select(
        "column_name", "prob", "pos",
        F.floor("pos").cast("long").alias("lo_rank"), F.ceil("pos").cast("long").alias("hi_rank"))
    tl = targets.select("column_name", "prob", "pos", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("lo_rank").alias("rank")),
        F.struct(F.lit("hi").alias("side"), F.col("hi_rank").alias("rank")))).alias("t")) \
        .select("column_name", "prob", "pos", "t.side", "t.rank")
    c, t = cum.alias("c"), tl.alias("t")
    hit = c.join(F.broadcast(t), (F.col("c.column_name") == F.col("t.column_name"))
                 & (F.col("t.rank") >= F.col("c.start"))
                 & (F.col("t.rank") < F.col("c.start") + F.col("c.cnt"))) \
        .select(F.col("t.column_name").alias("column_name"), "prob", "pos", "side", "v")
    return hit.groupBy("column_name", "prob", "pos").agg(
        F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("lo_v"),
        F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("hi_v"))


def _long_values_num(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = [(c, F.col(c).cast("double")) for c in cols]
    return df.select(_stack(pairs, "column_name", "v"))


def numeric_describe(df: DataFrame, cols: Sequence[str] = NUMERIC_COLUMNS,
                     exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column.

    ``exact`` quartiles interpolate linearly (pandas ``describe``);
    otherwise ``percentile_approx`` with the given accuracy.
    """
    long = _long_values_num(df, cols).where(F.col("v").isNotNull())
    stats = long.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    if exact:
        q = exact_quantiles(df, cols)
        wide = q.groupBy("column_name").agg(*[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for p, name in zip(QUARTILES, ("p25", "p50", "p75"))])
    else:
        pa = F.percentile_approx("v", list(QUARTILES), accuracy)
        wide = long.groupBy("column_name").agg(pa.alias("_q")).select(
            "column_name", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
            F.col("_q")[2].alias("p75"))
    return stats.join(wide, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# Values whose kernels are computed at a time (a grid x values matrix).
KERNEL_VALUES = 4096


# --- histogram and density ------------------------------------------------

def _bounds(df: DataFrame, col: str) -> tuple[Column, Column]:
    """Scalar subqueries for min/max (numpy widens an empty range by 0.5)."""
    mm = df.where(F.col(col).isNotNull()).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo = mm.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5)
                   .otherwise(F.col("lo"))).scalar()
    hi = mm.select(F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5)
                   .otherwise(F.col("hi"))).scalar()
    return lo, hi


def histogram(df: DataFrame, col: str = "booking_value", bins: int = 40,
              bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Equal-width bins over [min, max], nulls dropped, the max in the
    last bin; empty bins included. (bin, lower, upper, count). ``bounds``, where
    they are known, save a pass."""
    lo, hi = bounds or _bounds(df, col)
    v = F.col(col).cast("double")
    idx = F.least(F.floor((v - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(idx.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    # The bins themselves: a dimension of exactly ``bins`` rows.
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / F.lit(float(bins))
    return (all_bins.join(F.broadcast(counts), "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lower"),
                    F.when(F.col("bin") == bins - 1, hi)
                    .otherwise(lo + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))


def kde_curve(df: DataFrame, col: str = "booking_value", grid: int = 200,
              bins: int = 40) -> DataFrame:
    """The curve drawn over a histogram of ``bins`` bars: a Gaussian
    density at ``grid`` points from min to max, bandwidth std * n^(-1/5) (Scott),
    and the same scaled to counts (density x n x bar width).

    (point, x, density, count). Exact, in one pass after the four statistics:
    each task adds its values' kernels up in numpy and emits ``grid`` partial
    sums, so no row is multiplied by the grid. Empty without two different
    values; NULL and NaN values are left out.
    """
    v = F.col(col).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    # Four numbers of one aggregate, read on the driver.
    st = base.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"),
                  F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not st["n"] or not st["sd"]:
        return df.sparkSession.createDataFrame(
            [], "point int, x double, density double, count double")
    n, lo, hi = float(st["n"]), st["lo"], st["hi"]
    bw = st["sd"] * n ** -0.2
    step = (hi - lo) / (grid - 1)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = (lo + step * np.arange(grid))[:, None]
        sums = np.zeros(grid)
        for pdf in batches:
            values = pdf["v"].to_numpy()
            for at in range(0, len(values), KERNEL_VALUES):
                z = (x - values[None, at:at + KERNEL_VALUES]) / bw
                sums += np.exp(-0.5 * z * z).sum(axis=1)
        yield pd.DataFrame({"point": np.arange(grid, dtype=np.int32), "s": sums})

    sums = base.mapInPandas(kernels, "point int, s double").groupBy("point").agg(F.sum("s").alias("s"))
    density = F.col("s") / F.lit(n * bw * math.sqrt(2 * math.pi))
    return sums.select("point", (F.lit(lo) + F.lit(step) * F.col("point")).alias("x"),
                       density.alias("density"),
                       (density * F.lit(n * (hi - lo) / bins)).alias("count")).orderBy("point")


def head(df: DataFrame, n: int = 3, order: Sequence[str] = ("_id",)) -> DataFrame:
    """First ``n`` rows under an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n)
