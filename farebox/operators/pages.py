"""Deep pages of gold (O1): rows stored in the page order, with counts per range.

``lookup.rides_page`` keeps offset + n rows in each task, so a page far down costs
more and more. Here gold is stored in ranges of the newest-first order, with the
number of rows of each range, status and vehicle. A page finds its ranges by these
counts and reads only them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions import columns as C
from farebox.functions import filters as FL
from farebox.operators.lookup import DEFAULT_PAGE_SIZE, check_page, newest_first

RANGE = "_page_range"
#: Ranges of a stored table: take so many that one holds about 128 MB.
RANGES = 64


def write_paged(gold: DataFrame, path: str, ranges: int = RANGES) -> str:
    """Store gold in at most ``ranges`` ranges of the page order and count them.

    Range bounds are sampled, so ranges are of about one size; rows that tie in
    the whole order share a range. One shuffle, then one scan of three columns
    for the counts. Returns ``path``.
    """
    spark = gold.sparkSession
    dealt = gold.repartitionByRange(ranges, *newest_first()).withColumn(RANGE, F.spark_partition_id())
    dealt.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(RANGE).parquet(f"{path}/rows"))
    counts = _rows(spark, path).groupBy(RANGE, "booking_status", "vehicle_type").agg(F.count(F.lit(1)).alias("rows"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/rows")


def page_ranges(spark: SparkSession, path: str, status: str | None = None, vehicle: str | None = None,
                page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> tuple[list[int], int, int]:
    """(ranges that hold the page, filtered rows before them, filtered rows in
    all). One number per range comes to the driver."""
    check_page(page, size)
    counts = FL.ride_filter(spark.read.parquet(f"{path}/counts"), status, vehicle)
    per = counts.groupBy(RANGE).agg(F.sum("rows").alias("rows")).orderBy(RANGE).collect()
    first, seen, before, held = (page - 1) * size, 0, 0, []
    for r in per:
        if seen + r["rows"] <= first:
            before = seen + r["rows"]
        elif seen < first + size:
            held.append(r[RANGE])
        seen += r["rows"]
    return held, before, seen


def deep_page(spark: SparkSession, path: str, status: str | None = None, vehicle: str | None = None,
              page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """O1 from the stored order: the rows of ``rides_page`` for the same status
    and vehicle filters, and its ``total_count``, reading the ranges that hold
    the page. A task keeps at most one range's rows before the page, however
    deep it is. A page past the end is empty. Filters by customer or id list
    have no counts: use ``rides_page``, which their few rows suit."""
    held, before, total = page_ranges(spark, path, status, vehicle, page, size)
    rows = FL.ride_filter(_rows(spark, path).where(F.col(RANGE).isin(held)), status, vehicle)
    rows = rows.select(*C.GOLD_API_NAMES)
    skip = (page - 1) * size - before if held else 0
    out = rows.orderBy(*newest_first()).offset(skip).limit(size)
    return out.withColumn("total_count", F.lit(total).cast("long"))
