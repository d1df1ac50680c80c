"""Filtered, paged and top-n lookups over gold.

A page is ``orderBy(...).offset(o).limit(n)``, which Spark plans as a
``TakeOrderedAndProject``: each task keeps only its best ``o + n`` rows, so
there is no global sort. Deep pages use the keyset variant, or the stored order of
``pages``.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions import columns as C
from farebox.functions import filters as FL
from farebox.session import broadcast_if_small

DEFAULT_PAGE_SIZE = 20


def check_page(page: int, size: int) -> None:
    if page < 1 or size < 1:
        raise ValueError("page and size must be at least 1")


def newest_first(ts: str = "ride_timestamp", key: str = "booking_id") -> list[Column]:
    """Newest first with NULL times first (PostgreSQL DESC); ties by key."""
    return [F.desc_nulls_first(ts), F.asc_nulls_last(key)]


def id_semi_join(df: DataFrame, ids: DataFrame, key: str = "booking_id") -> DataFrame:
    """Keep rows whose key is in ``ids`` (broadcast when small)."""
    return df.join(broadcast_if_small(ids.select(key)), key, "left_semi")


def page_rows(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    check_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def rides_page(gold: DataFrame, status: str | None = None, vehicle: str | None = None,
               customer_id: str | None = None, ids: DataFrame | None = None,
               page: int = 1, size: int = DEFAULT_PAGE_SIZE, api_names: bool = False) -> DataFrame:
    """O1: filter (F2, optional id list J1), newest first, one page, with the
    filtered total as a ``total_count`` column (a scalar subquery)."""
    df = FL.ride_filter(gold, status, vehicle, customer_id)
    if ids is not None:
        df = id_semi_join(df, ids)
    total = df.select(F.count(F.lit(1))).scalar()
    cols = [c for c in C.GOLD_API_NAMES]
    out = page_rows(df.select(*cols), newest_first(), page, size)
    if api_names:
        out = out.select(*C.project_rename(C.GOLD_API_NAMES))
    return out.withColumn("total_count", total)


def rides_after(gold: DataFrame, last_ts: dt.datetime | None, last_id: str | None,
                size: int = DEFAULT_PAGE_SIZE, **filters) -> DataFrame:
    """O1 keyset variant: the page after (last_ts, last_id) in newest-first
    order, for deep paging without an offset. NULL times come first."""
    df = FL.ride_filter(gold, **filters)
    if last_id is not None:
        ts, key = F.col("ride_timestamp"), F.col("booking_id")
        if last_ts is None:
            after = (ts.isNull() & (key > F.lit(last_id))) | ts.isNotNull()
        else:
            lt = FL.ntz_lit(last_ts)
            after = ts.isNotNull() & ((ts < lt) | ((ts == lt) & (key > F.lit(last_id))))
        df = df.where(after)
    return df.orderBy(*newest_first()).limit(size)


def runs_page(status_view: DataFrame, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """O2: pipeline runs newest first (by start time, then batch), paged,
    with the total run count."""
    total = status_view.select(F.count(F.lit(1))).scalar()
    order = [F.desc_nulls_first("start_time"), F.asc_nulls_last("batch_id")]
    return page_rows(status_view, order, page, size).withColumn("total_count", total)


def top_n(df: DataFrame, col: str, n: int, key: str = "booking_id",
          columns: list[str] | None = None) -> DataFrame:
    """O3: highest ``n`` by ``col`` (NULL first, as PostgreSQL DESC); ties by key."""
    out = df.orderBy(F.desc_nulls_first(col), F.asc_nulls_last(key)).limit(n)
    return out.select(*columns) if columns else out


def page_count(total: Column | int, size: int) -> Column:
    """Number of pages, ceil(total / size)."""
    if isinstance(total, int):
        return F.lit(math.ceil(total / size)).cast("long")
    return F.ceil(total / F.lit(size)).cast("long")
