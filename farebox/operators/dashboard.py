"""Dashboard aggregates (KPIs, cancellations, vehicles, hourly traffic) and the
shares and stats the charts derive from them.

All four dashboard parts come from one scan (grouping sets); shares take
their totals from scalar-subquery aggregates, and the traffic stats aggregate
the grouped rows, never ride rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import columns as C
from farebox.functions import filters as FL


def _completed() -> Column:
    return F.col("booking_status") == F.lit(sch.STATUS_COMPLETED)


def success_rate(completed: Column, total: Column) -> Column:
    """completed / total * 100, rounded half up to 2 places; 0 with no rows."""
    pct = F.round(completed.cast("decimal(20,0)") * F.lit(100) / total.cast("decimal(20,0)"), 2)
    return F.when(total > 0, pct.cast("double")).otherwise(F.lit(0.0))


def kpi_summary(gold: DataFrame, vehicle: str | None = None, start: dt.datetime | None = None,
                end: dt.datetime | None = None, with_avg_rating: bool = False) -> DataFrame:
    """A1: total, completed, revenue (0 when none) and success rate, one row."""
    df = FL.dashboard_filter(gold, vehicle, start, end)
    aggs = [F.count(F.lit(1)).alias("total_bookings"),
            F.count_if(_completed()).alias("successful_bookings"),
            F.coalesce(F.sum("booking_value"), F.lit(0.0)).alias("total_revenue")]
    if with_avg_rating:
        aggs.append(C.round_half_up(F.avg("customer_rating"), 2).alias("avg_rating"))
    out = df.agg(*aggs)
    return out.withColumn("success_rate",
                          success_rate(F.col("successful_bookings"), F.col("total_bookings")))


def cancellation_counts(gold: DataFrame, vehicle: str | None = None,
                        start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A2: rides by reason, without 'Not Cancelled' (NULL reasons drop too)."""
    df = FL.dashboard_filter(gold, vehicle, start, end).where(FL.exclude_value())
    return df.groupBy(F.col("unified_cancellation_reason").alias("reason")) \
        .agg(F.count(F.lit(1)).alias("count"))


def vehicle_performance(gold: DataFrame, vehicle: str | None = None,
                        start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A3: rides and average customer rating (2 places, NULLs ignored)."""
    df = FL.dashboard_filter(gold, vehicle, start, end)
    return df.groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("total_rides"),
        C.round_half_up(F.avg("customer_rating"), 2).alias("avg_rating"))


def hourly_traffic(gold: DataFrame, vehicle: str | None = None,
                   start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A4: rides by hour, sorted by hour, NULL hour last; empty hours absent."""
    df = FL.dashboard_filter(gold, vehicle, start, end)
    return (df.groupBy(C.hour_of_day("ride_timestamp").alias("hour"))
            .agg(F.count(F.lit(1)).alias("ride_count"))
            .orderBy(F.asc_nulls_last("hour")))


def dashboard_summary(gold: DataFrame, vehicle: str | None = None,
                      start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A5: A1-A4 under one filter in a single scan.

    One grouping-sets aggregate; ``grouping_id`` tells a rolled-up column from
    a NULL group. Result is long: (part, key, total, completed, revenue,
    success_rate, avg_rating); ``split_summary`` gives the four frames.
    """
    df = FL.dashboard_filter(gold, vehicle, start, end).select(
        F.when(FL.exclude_value(), F.col("unified_cancellation_reason")).alias("reason"),
        F.col("vehicle_type"), C.hour_of_day("ride_timestamp").alias("hour"),
        F.col("booking_status"), F.col("booking_value"), F.col("customer_rating"))
    g = df.groupingSets([[], ["reason"], ["vehicle_type"], ["hour"]],
                        "reason", "vehicle_type", "hour").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(_completed()).alias("completed"),
        F.sum("booking_value").alias("revenue"),
        F.avg("customer_rating").alias("avg_rating_raw"))
    # gid bits (reason, vehicle_type, hour): 7 = grand total, 3 = by reason,
    # 5 = by vehicle, 6 = by hour.
    part = (F.when(F.col("gid") == 7, "kpi").when(F.col("gid") == 3, "reason")
            .when(F.col("gid") == 5, "vehicle").otherwise("hour"))
    key = (F.when(F.col("gid") == 3, F.col("reason"))
           .when(F.col("gid") == 5, F.col("vehicle_type"))
           .when(F.col("gid") == 6, F.col("hour").cast("string")))
    out = g.select(part.alias("part"), key.alias("key"), "total", "completed",
                   F.when(F.col("gid") == 7, F.coalesce(F.col("revenue"), F.lit(0.0))).alias("revenue"),
                   F.when(F.col("gid") == 7, success_rate(F.col("completed"), F.col("total")))
                    .alias("success_rate"),
                   F.when(F.col("gid") == 5, C.round_half_up(F.col("avg_rating_raw"), 2))
                    .alias("avg_rating"),
                   F.col("gid"), F.col("reason"))
    # Rows outside the cancellation filter form the NULL reason group: drop it.
    return out.where(~((F.col("gid") == 3) & F.col("reason").isNull())).drop("gid", "reason")


def split_summary(summary: DataFrame) -> dict[str, DataFrame]:
    """The four dashboard frames from the long A5 result."""
    s = summary
    return {
        "kpi": s.where(F.col("part") == "kpi").select(
            F.col("total").alias("total_bookings"), F.col("completed").alias("successful_bookings"),
            F.col("revenue").alias("total_revenue"), "success_rate"),
        "reason": s.where(F.col("part") == "reason").select(
            F.col("key").alias("reason"), F.col("total").alias("count")),
        "vehicle": s.where(F.col("part") == "vehicle").select(
            F.col("key").alias("vehicle_type"), F.col("total").alias("total_rides"), "avg_rating"),
        "hour": s.where(F.col("part") == "hour").select(
            F.col("key").cast("int").alias("hour"), F.col("total").alias("ride_count"))
            .orderBy(F.asc_nulls_last("hour")),
    }


def share_of_total(counts: DataFrame, count_col: str = "count", places: int = 1) -> DataFrame:
    """Count / sum(count) * 100, rounded half up. The total is a scalar
    subquery (a partial+final aggregate), so no task holds all groups."""
    total = counts.select(F.sum(count_col)).scalar()
    return counts.withColumn("pct", C.pct_half_up(F.col(count_col), total, places))


def share_of_max(counts: DataFrame, count_col: str = "count") -> DataFrame:
    """Count / max(count) * 100 (bar width); the max as a scalar subquery."""
    top = counts.select(F.max(count_col)).scalar()
    return counts.withColumn("pct_of_max", F.col(count_col).cast("double") * 100.0 / top)


def traffic_stats(hourly: DataFrame) -> DataFrame:
    """Peak and lowest hour (earliest hour on ties) and the mean count
    over present hours, rounded half up."""
    return hourly.agg(
        F.max(F.struct(F.col("ride_count"), -F.col("hour"))).alias("_pk"),
        F.min(F.struct(F.col("ride_count"), F.col("hour"))).alias("_lo"),
        F.floor(F.avg("ride_count") + 0.5).cast("long").alias("mean_count"),
    ).select(F.col("_pk.ride_count").alias("peak_count"), (-F.col("_pk.col2")).alias("peak_hour"),
             F.col("_lo.ride_count").alias("min_count"), F.col("_lo.hour").alias("min_hour"),
             "mean_count")
