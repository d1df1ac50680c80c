"""Structured Streaming jobs: CSV drop-folder ingestion, periodic vector sync
and live dashboard aggregates.

Each job keeps its progress in a checkpoint under the shared checkpoint
folder, so a restart (or a lost executor) replays from the last committed
micro-batch; ``foreachBatch`` sinks replace whole partitions (a batch, a bucket,
a batch's share) or keep a ledger of epochs, so a replayed micro-batch leaves the
same result.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farebox import schemas as sch
from farebox.operators import pipeline as PL
from farebox.operators import vectors as V
from farebox.session import cut_lineage, work_path
from farebox.sources import csv as CSV
from farebox.sources import layers as LY

log = logging.getLogger(__name__)



def batch_of(path: Column) -> Column:
    """The batch id of an uploaded file: folder, file stem and a hash of the
    whole path, so every file is a batch of its own and a replay of it gets the
    same id. Only characters that are safe in a folder name."""
    name = F.regexp_extract(path, r"([^/]*/?[^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), F.lit("-"),
                    F.substring(F.md5(path), 1, 12))


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    if interval:
        return writer.trigger(processingTime=interval)
    return writer


def stream_ingest(spark: SparkSession, drop_folder: str, pipeline: PL.Pipeline,
                  checkpoint: str | None = None, available_now: bool = False,
                  interval: str | None = None, files_per_trigger: int = 1) -> StreamingQuery:
    """Every arriving CSV becomes one batch through bronze, silver, gold.

    One file per micro-batch by default (more per trigger run one after the
    other, in path order). The batch id comes from the file's whole path
    (``batch_of``): files of one folder never replace each other, and a
    replayed micro-batch overwrites the same partitions (exactly-once effect).
    Each file goes through the batch scan, so quoted line breaks hold here too.
    Empty micro-batches (empty files) are skipped.
    """
    rows = CSV.csv_stream(spark, drop_folder, files_per_trigger)

    def run_batch(df: DataFrame, epoch_id: int) -> None:
        # The ids of distinct paths: on every row the pattern costs more than all else.
        files = df.select("_file").distinct().select("_file", batch_of(F.col("_file")).alias("b"))
        # At most files_per_trigger values: bounded.
        for r in sorted(files.collect()):
            pipeline.run(r["b"], CSV.literal_path(r["_file"]))

    w = rows.writeStream.foreachBatch(run_batch).option(
        "checkpointLocation", checkpoint or work_path(spark, "ingest-checkpoint"))
    return _trigger(w, available_now, interval).start()


class VectorIndex:
    """The vector collection (S6): points partitioned by a hash of their id
    into ``buckets`` folders, so that a change rewrites the buckets it touches
    (about points / buckets rows each) and nothing else."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base, self.buckets = spark, base, buckets

    def bucket(self, id_col: str = "id") -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int").alias("bucket")

    def current(self) -> DataFrame:
        if not LY.path_exists(self.spark, self.base):
            return self.spark.createDataFrame([], sch.VECTOR_SCHEMA).withColumn("bucket", F.lit(0))
        schema = sch.VECTOR_SCHEMA.jsonValue()
        schema["fields"] = [*schema["fields"], {"name": "bucket", "type": "integer", "nullable": True, "metadata": {}}]
        return self.spark.read.schema(sch.T.StructType.fromJson(schema)).parquet(self.base)

    def write(self, points: DataFrame) -> None:
        """The whole collection anew."""
        (points.select(*sch.VECTOR_SCHEMA.fieldNames(), self.bucket()).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.base))


def sync_once(spark: SparkSession, gold_path: str, index: VectorIndex, embedder=None,
              refresh_changed: bool = False) -> int:
    """V2-V4 once against the current gold snapshot and index: how many
    buckets were rewritten. An empty plan writes nothing; otherwise only
    buckets with a deleted, new or (``refresh_changed``) updated point are."""
    source, held = V.sync_source(spark.read.parquet(gold_path)), index.current()
    plan = cut_lineage(V.sync_plan(source, held, refresh_changed))
    orphans = plan.where("action = 'delete'").select("id")
    if not V.delete_guard(source, held, orphans).first()["apply_deletes"]:
        orphans = orphans.limit(0)
    wanted = plan.where("action != 'delete'").select("id", "booking_id", "reason")
    new = cut_lineage(V.embed_distinct(wanted, "reason", embedder).where(F.col("embedding").isNotNull()))
    changed = orphans.union(new.select("id")).distinct()
    touched = cut_lineage(changed.select(index.bucket()).distinct())
    n = touched.count()
    if n:
        # the semi-join on the partition column prunes the other buckets at run time
        rest = held.join(F.broadcast(touched), "bucket", "left_semi").join(changed, "id", "left_anti")
        rows = V.upsert(rest, new).select(*sch.VECTOR_SCHEMA.fieldNames(), index.bucket())
        LY.replace_partitions(cut_lineage(rows), touched, index.base, "bucket")
    return n


def stream_vector_sync(spark: SparkSession, gold_path: str, index: VectorIndex,
                       checkpoint: str | None = None, interval: str = "2 minutes",
                       available_now: bool = False, embedder=None,
                       refresh_changed: bool = False) -> StreamingQuery:
    """A sync on every tick of the clock (every 2 minutes by default), with
    or without new gold files, so rides removed from gold leave the index too.
    A failing sync is logged, the stream goes on, and the next tick retries.
    With ``available_now`` one tick runs."""
    def run() -> None:
        sync_once(spark, gold_path, index, embedder, refresh_changed)

    return _on_ticks(spark, run, checkpoint or work_path(spark, "sync-checkpoint"), interval, available_now)


def _on_ticks(spark: SparkSession, run, checkpoint: str, interval: str, available_now: bool) -> StreamingQuery:
    """``run`` once per trigger, whatever the folders it reads did; a failure
    is logged and the next tick tries again."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def tick(df: DataFrame, epoch_id: int) -> None:
        try:
            run()
        except Exception:  # noqa: BLE001 - the loop survives a failed tick
            log.exception("tick %s failed", epoch_id)

    w = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval if not available_now else None).start()


def utc_instant(ntz_col: str) -> Column:
    """A zone-less timestamp read as UTC, independent of the session zone."""
    c = F.col(ntz_col)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def window_start(ntz_col: str, seconds: int) -> Column:
    """Start of the fixed window a ride time falls in; NULL for a NULL time (a
    window aggregate would drop such rides)."""
    t = F.unix_seconds(utc_instant(ntz_col))
    return F.timestamp_seconds(t - F.pmod(t, F.lit(seconds)))


def dashboard_stream(spark: SparkSession, gold_path: str, seconds: int = 3600) -> DataFrame:
    """Live KPIs per (window of ``seconds``, vehicle) over new gold files.

    The dashboard counts every ride however late it arrives and with or
    without a ride time (a NULL window), so its totals equal A1 and there is no
    watermark: the state is one row per (hour, vehicle), bounded by time range
    x vehicle types. Gold files that a batch rerun rewrites are new files to
    this stream: over gold with reruns use ``stream_dashboard``, which takes a
    batch's old share back."""
    src = spark.readStream.schema(spark.read.parquet(gold_path).schema).parquet(gold_path)
    return src.groupBy(window_start("ride_timestamp", seconds).alias("window_start"),
                       "vehicle_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("booking_status") == sch.STATUS_COMPLETED).alias("completed"),
        F.sum("booking_value").alias("revenue"))


SHARE_SCHEMA = ("files long, window_start timestamp, vehicle_type string, total long, completed long, "
                "revenue double, share string")
#: The share of gold files that stand in no batch folder.
NO_BATCH = "-"


def _share_of(path: Column) -> Column:
    """The batch folder that a gold file stands in (batch ids are safe in a
    folder name)."""
    name = F.regexp_extract(path, f"/{LY.BATCH_COL}=([^/]*)/", 1)
    return F.when(name != "", name).otherwise(F.lit(NO_BATCH)).alias("share")


def refresh_dashboard(spark: SparkSession, gold_path: str, shares_path: str, seconds: int = 3600) -> int:
    """Bring the dashboard's shares up to date with gold: how many changed.

    A share is one batch's counts and revenue per (window of ``seconds``,
    vehicle), rides without a time included, kept as a partition of its own with
    a hash of the batch's files. A batch whose files are others than those (a new
    one, a rerun, a change set) is counted again and its share replaced; the
    share of a batch that is gone is removed. So an old share is always taken
    back whole, the work follows the batches that changed, and doing it again
    changes nothing. Listing reads names, not contents."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(gold_path).groupBy(_share_of(F.col("path")))
             .agg(F.expr("bit_xor(xxhash64(path, length, modificationTime))").alias("files")))
    known = spark.createDataFrame([], SHARE_SCHEMA)
    if LY.path_exists(spark, shares_path):
        known = spark.read.schema(known.schema).parquet(shares_path)
    # the folder of rides without a batch reads as NULL
    held = known.select(F.coalesce("share", F.lit(LY.NULL_PARTITION)).alias("share"), "files").distinct()
    differ = cut_lineage(files.alias("n").join(held.alias("k"), "share", "full_outer")
                         .where(~F.col("n.files").eqNullSafe(F.col("k.files")))
                         .select("share", F.col("n.files").alias("files")))
    n = differ.count()
    if n:
        gold = spark.read.parquet(gold_path)
        changed = [r["share"] for r in differ.where("files IS NOT NULL").select("share").collect()]   # names of changed batches
        if NO_BATCH not in changed and LY.BATCH_COL in gold.columns:      # only their folders are read
            batch = F.col(LY.BATCH_COL).cast("string")
            mine = batch.isin([c for c in changed if c != LY.NULL_PARTITION])
            gold = gold.where(mine | batch.isNull() if LY.NULL_PARTITION in changed else mine)
        rows = (gold.select("*", _share_of(F.col("_metadata.file_path")))
                .groupBy("share", window_start("ride_timestamp", seconds).alias("window_start"), "vehicle_type")
                .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("booking_status") == sch.STATUS_COMPLETED).alias("completed"),
                     F.sum("booking_value").alias("revenue"))
                .join(differ.where("files IS NOT NULL"), "share").select(*known.columns))
        LY.replace_partitions(cut_lineage(rows), differ.select("share"), shares_path, "share")
    return n


def dashboard_table(spark: SparkSession, shares_path: str, seconds: int = 3600) -> DataFrame:
    """The dashboard: the batches' shares summed per (window, vehicle)."""
    shares = spark.read.schema(spark.createDataFrame([], SHARE_SCHEMA).schema).parquet(shares_path)
    return shares.groupBy("window_start", "vehicle_type").agg(
        F.sum("total").alias("total"), F.sum("completed").alias("completed"), F.sum("revenue").alias("revenue")).select(
        "window_start", (F.col("window_start") + F.make_dt_interval(secs=F.lit(seconds))).alias("window_end"),
        "vehicle_type", "total", "completed", "revenue")


def stream_dashboard(spark: SparkSession, gold_path: str, shares_path: str, checkpoint: str | None = None,
                     available_now: bool = False, interval: str = "5 seconds", seconds: int = 3600) -> StreamingQuery:
    """T3 with a table: on every tick (every 5 seconds by default, as the
    dashboard polls) the shares of the batches that changed are replaced."""
    def run() -> None:
        refresh_dashboard(spark, gold_path, shares_path, seconds)

    return _on_ticks(spark, run, checkpoint or work_path(spark, "dashboard-checkpoint"), interval, available_now)


def stream_changes(spark: SparkSession, changes_path: str, gold_path: str,
                   schema, checkpoint: str | None = None, available_now: bool = False,
                   interval: str | None = None) -> StreamingQuery:
    """M4 as a stream: change files arriving in ``changes_path`` are applied
    to the batch-partitioned gold table one micro-batch at a time (sequence
    order within a micro-batch; across micro-batches, arrival order, as API
    calls arrive). Only the partitions a micro-batch touches are rewritten,
    and every epoch is applied exactly once (``apply_changes_once``; the ledger
    stands beside the checkpoint, whose epoch numbers it goes by)."""
    src = spark.readStream.schema(schema).parquet(changes_path)
    checkpoint = (checkpoint or work_path(spark, "changes-checkpoint")).rstrip("/")

    def run(df: DataFrame, epoch_id: int) -> None:
        if not df.isEmpty():
            LY.apply_changes_once(spark, gold_path, df, f"{checkpoint}-ledger", epoch_id)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def run_to_memory(df: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a streaming frame over all available input into a memory table and
    return that table (tests and one-shot refreshes)."""
    spark = df.sparkSession
    name = f"stream_{uuid.uuid4().hex[:10]}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint or work_path(spark, f"{name}-checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
