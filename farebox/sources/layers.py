"""Layer tables on shared storage: batch-scoped scans and idempotent
batch replacement."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH_COL = "_batch_id"


def layer_scan(spark: SparkSession, path: str, batch_id: str | None = None,
               batch_col: str = BATCH_COL) -> DataFrame:
    """One layer, optionally one batch; the batch test is a partition
    filter, so only that batch's folder is listed and read."""
    df = spark.read.parquet(path)
    if batch_id is not None:
        df = df.where(F.col(batch_col) == F.lit(batch_id))
    return df


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def _partition_dir(path: str, batch_col: str, batch_id: str) -> str:
    return f"{path.rstrip('/')}/{batch_col}={batch_id}"


def batch_names(spark: SparkSession, path: str, batch_col: str = BATCH_COL) -> list[str]:
    """The batches of a layer, from the names of its folders; no file is opened.
    The partition without a batch is none."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    names = [unquote(n.partition("=")[2]) for n in names if n.startswith(f"{batch_col}=")]
    return sorted(n for n in names if n != NULL_PARTITION)


def batch_replace(df: DataFrame, path: str, batch_id: str, batch_col: str = BATCH_COL) -> int:
    """Replace one batch of a layer, idempotently; returns rows written.

    Dynamic partition overwrite swaps only this batch's folder at commit, so a
    failed job keeps the old rows and the layer may be read by the same plan.
    An empty result must still clear the batch (the source deletes first), so
    the folder is removed when nothing was written.
    """
    spark = df.sparkSession
    obs = Observation(f"rows_{batch_col}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    (observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch_col).parquet(path))
    rows = int(obs.get.get("rows", 0) or 0)
    if rows == 0:
        fs, p = _fs_path(spark, _partition_dir(path, batch_col, batch_id))
        if fs.exists(p):
            fs.delete(p, True)
    return rows


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only table write (step events)."""
    df.write.mode("append").parquet(path)


NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def replace_partitions(rows: DataFrame, touched: DataFrame, path: str, col: str) -> None:
    """Replace the partitions ``touched`` (one column, NULL for the partition
    without a value) of a table by ``rows``, which hold all that is to be in
    them; both must not depend on the table any more. Each is swapped at commit
    (dynamic overwrite); one left without rows is removed."""
    spark = rows.sparkSession
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path))
    left = rows.select(F.col(col).alias("_left")).distinct()
    empty = touched.join(left, touched[col].eqNullSafe(F.col("_left")), "left_anti")
    for r in empty.toLocalIterator():
        remove_path(spark, _partition_dir(path, col, NULL_PARTITION if r[0] is None else r[0]))


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _changed_partitions(spark: SparkSession, gold_path: str, changes: DataFrame,
                        batch_col: str) -> tuple[DataFrame, DataFrame]:
    """(touched batches, all their rows after the changes)."""
    from farebox.operators import changes as CH
    from farebox.session import broadcast_if_small, cut_lineage
    gold = spark.read.parquet(gold_path)
    gold = gold.withColumn(batch_col, F.col(batch_col).cast("string"))
    keys = changes.select("booking_id").distinct()
    # The touched batches: one row per batch, kept so all uses agree.
    touched = gold.join(broadcast_if_small(keys), "booking_id", "left_semi") \
        .select(batch_col).distinct()
    if not changes.where(F.col("op") == "insert").isEmpty():   # new rides have no batch
        touched = touched.unionByName(spark.range(1).select(
            F.lit(None).cast("string").alias(batch_col))).distinct()
    touched = cut_lineage(touched)
    # A semi-join on the partition column prunes the other folders at run time.
    part = gold.where(F.col(batch_col).isNotNull()).join(
        broadcast_if_small(touched), batch_col, "left_semi").select(*gold.columns)
    if not touched.where(F.col(batch_col).isNull()).isEmpty():
        part = part.unionByName(gold.where(F.col(batch_col).isNull()))
    return touched, CH.apply_changes(part, changes)


def apply_changes_in_place(spark: SparkSession, gold_path: str, changes: DataFrame,
                           batch_col: str = BATCH_COL) -> DataFrame:
    """M4 on a batch-partitioned gold table, rewriting only the partitions
    that hold a changed key (plus the no-batch partition new rides go to):
    the work is proportional to the touched batches, not to all of gold.
    Returns the batch ids rewritten (one column; NULL is the no-batch partition).

    A change set is one call: given again it is applied again (an update that
    came before the first insert of its key then finds the row). Where a call
    may be repeated, use ``apply_changes_once``.
    """
    from farebox.session import cut_lineage
    touched, rows = _changed_partitions(spark, gold_path, changes, batch_col)
    replace_partitions(cut_lineage(rows), touched, gold_path, batch_col)
    return touched


def apply_changes_once(spark: SparkSession, gold_path: str, changes: DataFrame, ledger: str, epoch: int,
                       batch_col: str = BATCH_COL) -> bool:
    """M4 for a numbered change set that may be sent again: exactly once.

    The rewritten partitions are first written whole under
    ``ledger``/epoch=n; their commit decides the epoch's result, and gold isn't
    touched before it. Then they are swapped into gold, and the epoch is marked
    done. A repeat of a done epoch does nothing; one after a crash swaps the
    rows that were decided, whatever part of gold had been swapped; one after a
    crash before the commit starts from a gold that is as it was. The rows of a
    done epoch are removed, the mark stays. One writer at a time. False if the
    epoch was done before.
    """
    base = f"{ledger.rstrip('/')}/epoch={epoch:012d}"
    done, staged, names = f"{base}/done", f"{base}/rows", f"{base}/touched"
    if path_exists(spark, done):
        return False
    if not path_exists(spark, f"{staged}/_SUCCESS"):
        touched, rows = _changed_partitions(spark, gold_path, changes, batch_col)
        touched.write.mode("overwrite").parquet(names)
        rows.write.option("partitionOverwriteMode", "static").mode("overwrite").parquet(staged)
    replace_partitions(spark.read.parquet(staged), spark.read.parquet(names), gold_path, batch_col)
    fs, p = _fs_path(spark, done)
    fs.create(p, True).close()
    remove_path(spark, staged)
    remove_path(spark, names)
    return True
