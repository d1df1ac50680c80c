"""Physical layout of gold for the segment report, and the plan report that
compares layouts.

The source speeds its benchmark query with a composite index on
(status, vehicle, value). Spark has no indexes; the same effect comes from
the layout: gold partitioned by status (partition pruning turns the status
predicate into a folder choice) and sorted within each partition by
(vehicle, value), so Parquet row-group min/max statistics let the scan skip
row groups outside the vehicle list and the value bound.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import report as R

CLUSTER_PARTITION = "booking_status"
CLUSTER_SORT = ("vehicle_type", "booking_value")
# Row-group size for the clustered files: small enough that min/max ranges
# of the sort columns stay narrow (rows per group = bytes / row width).
ROW_GROUP_BYTES = 8 * 1024 * 1024
# Rows of a page: the column index lets a scan skip pages within a row group.
PAGE_ROWS = 1000


def write_clustered(gold: DataFrame, path: str, files_per_status: int | None = None) -> str:
    """L1: gold partitioned by status, range-clustered and sorted by (vehicle,
    value) inside each status folder.

    ``repartitionByRange`` on (status, vehicle, value) gives each task one
    contiguous key range, so each output file covers a narrow slice of the
    sort key (good min/max statistics) and a hot status is spread over many
    tasks instead of one.
    """
    spark = gold.sparkSession
    n = files_per_status or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A salt (hash of the key) as the last range column lets the range
    # partitioner split even one hot (status, vehicle, value) over several
    # tasks; the sort inside each file stays on the clustering columns.
    salt = F.xxhash64("booking_id")
    clustered = (gold.repartitionByRange(n, F.col(CLUSTER_PARTITION),
                                         *[F.col(c) for c in CLUSTER_SORT], salt)
                 .sortWithinPartitions(CLUSTER_PARTITION, *CLUSTER_SORT))
    (clustered.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS)
     .partitionBy(CLUSTER_PARTITION).parquet(path))
    return path


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(gold: DataFrame, table: str, path: str, buckets: int | None = None,
                   key: str = "booking_id") -> str:
    """Gold bucketed (and sorted) by key, as an external table whose files
    live in the shared folder ``path``. Joins on the key with a side too big
    to broadcast (change sets, batch key sets) then shuffle only that side:
    the gold side is already hash-partitioned into the buckets."""
    spark = gold.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (gold.write.mode("overwrite").option("path", path)
     .bucketBy(n, key).sortBy(key).saveAsTable(table))
    return table


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    """L2 helper: the physical plan as text."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def _scans(plan) -> list:
    """The Parquet scans of an executed plan, through adaptive stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _scans(plan.plan())
    if name == "FileSourceScanExec":
        return [plan]
    kids = plan.children()
    return [s for i in range(kids.size()) for s in _scans(kids.apply(i))]


def scan_rows(df: DataFrame) -> tuple[int, int]:
    """Runs ``df`` and returns (rows, files) its scans really read, from the
    scan nodes' own metrics: after partition pruning and after the row groups
    and pages whose min/max statistics exclude the filters were skipped."""
    df.collect()
    read = [{k: s.metrics().apply(k).value() for k in ("numOutputRows", "numFiles")}
            for s in _scans(df._jdf.queryExecution().executedPlan())]
    return sum(r["numOutputRows"] for r in read), sum(r["numFiles"] for r in read)


def plan_report(layouts: dict[str, DataFrame]) -> DataFrame:
    """L2: the segment report over each stored layout: rows of the layout,
    rows aggregated and groups out, one row per layout. What the scans read of
    the files is measured by ``measured_scans``."""
    parts = []
    for name, df in layouts.items():
        parts += [df.agg(F.lit(name).alias("layout"), F.count(F.lit(1)).alias("rows_total"),
                         F.lit(0).cast("long").alias("rows_aggregated"), F.lit(0).cast("long").alias("groups_out")),
                  R.segment_report(df).agg(F.lit(name), F.lit(0).cast("long"), F.coalesce(F.sum("total_rides"), F.lit(0)),
                                           F.count(F.lit(1)))]
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    return both.groupBy("layout").agg(*[F.sum(c).alias(c) for c in ("rows_total", "rows_aggregated", "groups_out")])


def measured_scans(layouts: dict[str, DataFrame]) -> dict[str, dict[str, int]]:
    """The plan report with the rows and files that each layout's scan really
    read (for the bench: it reads Spark's scan metrics off the executed plan)."""
    out = {r["layout"]: r.asDict() for r in plan_report(layouts).collect()}
    for name, df in layouts.items():
        out[name]["rows_read"], out[name]["files_read"] = scan_rows(R.segment_report(df))
        del out[name]["layout"]
    return out
