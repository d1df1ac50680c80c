"""The segment report (the benchmark query) and filtered counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- Fixed values: the benchmark query's constants. ---
SEGMENT_STATUS = "Completed"
SEGMENT_VEHICLES = ("Uber XL", "Premier Sedan", "Go Sedan")
SEGMENT_MIN_VALUE = 300
SEGMENT_DISTANCE = (5, 50)
# --- end of fixed values ---


def segment_report(gold: DataFrame, status: str = SEGMENT_STATUS,
                   vehicles: Sequence[str] = SEGMENT_VEHICLES,
                   min_value: float = SEGMENT_MIN_VALUE,
                   distance: tuple[float, float] = SEGMENT_DISTANCE) -> DataFrame:
    """Filter, group by (vehicle, payment): rides, average value, total
    distance; sorted by total distance, largest first (NULL first).

    All four predicates are pushed to the Parquet scan; on the clustered
    layout (plans.layout) the status is a partition filter and the vehicle
    and value bounds skip row groups.
    """
    lo, hi = distance
    df = gold.where((F.col("booking_status") == F.lit(status))
                    & F.col("vehicle_type").isin(list(vehicles))
                    & (F.col("booking_value") > F.lit(min_value))
                    & F.col("ride_distance").between(lo, hi))
    return (df.groupBy("vehicle_type", "payment_method")
            .agg(F.count(F.lit(1)).alias("total_rides"),
                 F.avg("booking_value").alias("avg_value"),
                 F.sum("ride_distance").alias("total_distance"))
            .orderBy(F.desc_nulls_first("total_distance")))


def filtered_count(df: DataFrame) -> DataFrame:
    """A10: rows under the current filter, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total_count"))
