"""The example questions of the ride assistant as DataFrame queries.

``STATEMENTS`` holds the example SQL (PostgreSQL dialect, table
``gold.dataset``); each has a DataFrame twin below. Row order of a LIMIT is
made total by a key tie-break, so results repeat.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import columns as C
from farebox.functions import filters as FL
from farebox.operators import lookup as L

# --- Fixed values: the assistant's example statements. ---
STATEMENTS = {
    "q_latest": "SELECT * FROM gold.dataset ORDER BY ride_timestamp DESC LIMIT 5;",
    "q_total_revenue": "SELECT SUM(booking_value) AS total_revenue FROM gold.dataset LIMIT 1;",
    "q_completed": "SELECT COUNT(*) FROM gold.dataset WHERE booking_status = 'Completed' LIMIT 1;",
    "q_rating_by_vehicle": "SELECT vehicle_type, AVG(customer_rating) AS avg_rating FROM gold.dataset GROUP BY vehicle_type LIMIT 10;",
    "q_top_reasons": "SELECT unified_cancellation_reason, COUNT(*) AS count FROM gold.dataset WHERE unified_cancellation_reason != 'Not Cancelled' GROUP BY unified_cancellation_reason ORDER BY count DESC LIMIT 3;",
    "q_revenue_by_payment": "SELECT payment_method, SUM(booking_value) AS revenue FROM gold.dataset WHERE payment_method != 'Not Specified' GROUP BY payment_method LIMIT 10;",
    "q_long_recent": "SELECT * FROM gold.dataset WHERE ride_distance > 10 AND ride_timestamp >= NOW() - INTERVAL '1 month' ORDER BY ride_timestamp DESC LIMIT 10;",
    "q_distance_by_vehicle": "SELECT vehicle_type, AVG(ride_distance) AS avg_distance FROM gold.dataset GROUP BY vehicle_type ORDER BY avg_distance DESC LIMIT 10;",
    "q_most_expensive": "SELECT booking_id, booking_value, vehicle_type, ride_timestamp FROM gold.dataset ORDER BY booking_value DESC LIMIT 5;",
    "q_bike_cancelled": "SELECT * FROM gold.dataset WHERE vehicle_type = 'Bike' AND booking_status = 'Cancelled by Customer' ORDER BY ride_timestamp DESC LIMIT 10;",
    "q_by_hour": "SELECT EXTRACT(HOUR FROM ride_timestamp) AS hour, COUNT(*) AS ride_count FROM gold.dataset GROUP BY hour ORDER BY hour LIMIT 24;",
    "q_upi_completed": "SELECT SUM(booking_value) FROM gold.dataset WHERE booking_status = 'Completed' AND payment_method = 'UPI' LIMIT 1;",
    "q_top_rated": "SELECT booking_id, driver_ratings, vehicle_type FROM gold.dataset WHERE driver_ratings IS NOT NULL ORDER BY driver_ratings DESC LIMIT 5;",
}
REFUSALS = {
    "Delete all incomplete rides": "SELECT 'ERROR: Only SELECT queries allowed' LIMIT 1;",
    "Drop the table": "SELECT 'ERROR: Only SELECT queries allowed' LIMIT 1;",
    "Hello how are you?": "SELECT 'ERROR: Only data queries allowed' LIMIT 1;",
}
# --- end of fixed values ---


def _newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*L.newest_first()).limit(n)


def latest(gold: DataFrame, n: int = 5) -> DataFrame:
    return _newest(gold, n)


def total_revenue(gold: DataFrame) -> DataFrame:
    return gold.agg(F.sum("booking_value").alias("total_revenue"))


def completed_count(gold: DataFrame) -> DataFrame:
    return gold.where(F.col("booking_status") == sch.STATUS_COMPLETED).agg(
        F.count(F.lit(1)).alias("count"))


def rating_by_vehicle(gold: DataFrame) -> DataFrame:
    return gold.groupBy("vehicle_type").agg(F.avg("customer_rating").alias("avg_rating"))


def top_reasons(gold: DataFrame, n: int = 3, status: str | None = None) -> DataFrame:
    df = gold if status is None else gold.where(F.col("booking_status") == status)
    counts = df.where(FL.exclude_value()).groupBy("unified_cancellation_reason").agg(
        F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "unified_cancellation_reason").limit(n)


def revenue_by_payment(gold: DataFrame) -> DataFrame:
    return (gold.where(FL.exclude_value("payment_method", sch.NOT_SPECIFIED))
            .groupBy("payment_method").agg(F.sum("booking_value").alias("revenue")))


def long_recent(gold: DataFrame, as_of: dt.datetime | Column | None = None,
                min_distance: float = 10, n: int = 10) -> DataFrame:
    """Rides over ``min_distance`` in the month before ``as_of`` (default:
    the newest ride time, so runs repeat)."""
    if as_of is None:
        as_of = gold.select(F.max("ride_timestamp")).scalar()
    start = (as_of if isinstance(as_of, Column) else FL.ntz_lit(as_of)) \
        - F.make_ym_interval(F.lit(0), F.lit(1))
    df = gold.where((F.col("ride_distance") > min_distance) & (F.col("ride_timestamp") >= start))
    return _newest(df, n)


def distance_by_vehicle(gold: DataFrame) -> DataFrame:
    return (gold.groupBy("vehicle_type").agg(F.avg("ride_distance").alias("avg_distance"))
            .orderBy(F.desc_nulls_first("avg_distance"), "vehicle_type").limit(10))


def most_expensive(gold: DataFrame, n: int = 5) -> DataFrame:
    return L.top_n(gold, "booking_value", n,
                   columns=["booking_id", "booking_value", "vehicle_type", "ride_timestamp"])


def bike_cancelled(gold: DataFrame, n: int = 10) -> DataFrame:
    return _newest(FL.ride_filter(gold, status=sch.STATUS_CUSTOMER_CANCEL, vehicle="Bike"), n)


def by_hour(gold: DataFrame) -> DataFrame:
    return (gold.groupBy(C.hour_of_day("ride_timestamp").alias("hour"))
            .agg(F.count(F.lit(1)).alias("ride_count"))
            .orderBy(F.asc_nulls_last("hour")).limit(24))


def upi_completed(gold: DataFrame) -> DataFrame:
    return (FL.ride_filter(gold, status=sch.STATUS_COMPLETED)
            .where(F.col("payment_method") == "UPI")
            .agg(F.sum("booking_value").alias("sum")))


def top_rated(gold: DataFrame, n: int = 5) -> DataFrame:
    return L.top_n(gold.where(FL.not_null("driver_ratings")), "driver_ratings", n,
                   columns=["booking_id", "driver_ratings", "vehicle_type"])


# UI example questions.

def latest_completed(gold: DataFrame, n: int = 10) -> DataFrame:
    return _newest(FL.ride_filter(gold, status=sch.STATUS_COMPLETED), n)


def avg_rating_of(gold: DataFrame, vehicle: str = "Go Mini") -> DataFrame:
    return FL.ride_filter(gold, vehicle=vehicle).agg(F.avg("customer_rating").alias("avg_rating"))


def count_by_payment(gold: DataFrame, method: str = "UPI") -> DataFrame:
    return gold.where(F.col("payment_method") == method).agg(F.count(F.lit(1)).alias("count"))
