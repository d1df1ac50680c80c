"""Row predicates. Optional filters are added only when set, so an unset
filter leaves no ``OR`` in the plan and every set one reaches the Parquet scan
as a pushed filter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox import schemas as sch


def ntz_lit(value: dt.datetime | dt.date) -> Column:
    """A zone-less timestamp literal, the same whatever the session zone
    (a Python datetime literal would pass through the session zone)."""
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ")
    else:
        text = f"{value.isoformat()} 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def dashboard_filter(df: DataFrame, vehicle: str | None = None,
                     start: dt.datetime | None = None, end: dt.datetime | None = None,
                     ts_col: str = "ride_timestamp") -> DataFrame:
    """vehicle (NULL or empty = no filter), ts >= start, ts <= end."""
    if vehicle:
        df = df.where(F.col("vehicle_type") == F.lit(vehicle))
    if start is not None:
        df = df.where(F.col(ts_col) >= ntz_lit(start))
    if end is not None:
        df = df.where(F.col(ts_col) <= ntz_lit(end))
    return df


def ride_filter(df: DataFrame, status: str | None = None, vehicle: str | None = None,
                customer_id: str | None = None) -> DataFrame:
    """optional equality filters; only None disables (empty text matches
    nothing)."""
    for col, val in (("booking_status", status), ("vehicle_type", vehicle),
                     ("customer_id", customer_id)):
        if val is not None:
            df = df.where(F.col(col) == F.lit(val))
    return df


def valid_key(c: str | Column = "booking_id") -> Column:
    """key not NULL and not exactly ``null`` (case-sensitive, untrimmed)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != F.lit("null"))


def exclude_value(c: str | Column = "unified_cancellation_reason",
                  value: str = sch.NOT_CANCELLED) -> Column:
    """``c <> value``; NULLs are dropped as well (SQL three-valued logic)."""
    c = F.col(c) if isinstance(c, str) else c
    return c != F.lit(value)


def in_list(c: str | Column, values: Sequence) -> Column:
    """``c IN (...)``."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isin(list(values))


def between(c: str | Column, lo, hi) -> Column:
    """inclusive range."""
    c = F.col(c) if isinstance(c, str) else c
    return c.between(lo, hi)


def not_null(c: str | Column) -> Column:
    """F7."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull()


def recent_interval(c: str | Column, as_of: dt.datetime, months: int = 1) -> Column:
    """F8: ``c >= as_of - INTERVAL 'months' month`` (calendar months)."""
    c = F.col(c) if isinstance(c, str) else c
    return c >= (ntz_lit(as_of) - F.make_ym_interval(F.lit(0), F.lit(months)))


RATING_COLUMNS = ("driver_ratings", "customer_rating")


def rating_ok(c: str | Column) -> Column:
    """rating NULL or within [0, 5] (NaN fails, as in the source CHECK)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ((c >= 0) & (c <= 5) & ~F.isnan(c))
