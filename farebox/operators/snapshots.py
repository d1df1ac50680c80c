"""Stored snapshots compared by hash buckets (T4 over large tables).

A snapshot is written by bucket of its key, with one digest per bucket. Two
snapshots are compared by their digests first, and only the buckets whose digests
differ are read and joined: the work follows the changes, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators.changes import snapshot_diff

BUCKET = "_bucket"
#: Buckets of a snapshot: take so many that one holds a few hundred MB.
BUCKETS = 256
# Two sums of independent row hashes; they don't depend on the rows' order, and
# repeated rows don't cancel out.
_SEEDS = (1, 2)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _row_hash(cols: list[str], seed: int) -> Column:
    # A hash skips NULLs, so each column's presence is hashed with it.
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")


def write_snapshot(df: DataFrame, path: str, key: str | list[str], buckets: int = BUCKETS) -> str:
    """Store ``df`` by bucket of its key, then one digest row per bucket.

    Rows are dealt by ranges of (bucket, key hash), so tasks are even whatever
    the number of buckets. The digests come from the stored rows in one scan
    that sends one row per task and bucket. An empty table is a snapshot without
    buckets. Returns ``path``.
    """
    keys = _keys(key)
    cols = df.columns
    dealt = df.withColumn(BUCKET, bucket_of(keys, buckets)).repartitionByRange(BUCKET, F.xxhash64(*keys))
    write = dealt.write.mode("overwrite").option("partitionOverwriteMode", "static")
    write.partitionBy(BUCKET).parquet(f"{path}/rows")
    spark = df.sparkSession
    df.limit(0).withColumn(BUCKET, F.lit(0)).write.mode("overwrite").parquet(f"{path}/schema")
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    digests = _rows(spark, path).groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(null_key).alias("null_keys"),
        *[F.sum(_row_hash(cols, s)).alias(f"sum_{s}") for s in _SEEDS])
    (digests.withColumn("buckets", F.lit(buckets)).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/digests"))
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/rows")


def changed_buckets(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Buckets whose rows differ (column ``_bucket``): their digests differ, or
    one holds a NULL key, which equals no key."""
    b = spark.read.parquet(f"{before}/digests")
    a = spark.read.parquet(f"{after}/digests")
    sizes = [r[0] for r in b.select("buckets").unionByName(a.select("buckets")).distinct().collect()]
    if len(sizes) > 1:
        raise ValueError(f"snapshots of different numbers of buckets: {sorted(sizes)}")
    names = ["rows", *[f"sum_{s}" for s in _SEEDS]]
    j = b.select(BUCKET, "null_keys", *[F.col(n).alias(f"b_{n}") for n in names]).join(
        a.select(BUCKET, F.col("null_keys").alias("a_nulls"), *[F.col(n).alias(f"a_{n}") for n in names]),
        BUCKET, "full_outer")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"b_{n}").eqNullSafe(F.col(f"a_{n}"))
    nulls = (F.coalesce("null_keys", F.lit(0)) > 0) | (F.coalesce("a_nulls", F.lit(0)) > 0)
    return j.where(~same | nulls).select(BUCKET)


def diff_snapshots(spark: SparkSession, before: str, after: str, key: str | list[str]) -> DataFrame:
    """T4 of two stored snapshots: key columns + ``change``, as
    ``snapshot_diff``, reading only the buckets that differ.

    The numbers of those buckets (never more than a snapshot has) become a
    partition filter on both sides.
    """
    b, a = _rows(spark, before), _rows(spark, after)
    if b.columns != a.columns:
        raise ValueError("snapshots of different columns")
    ids = [r[0] for r in changed_buckets(spark, before, after).collect()]
    picked = F.col(BUCKET).isin(ids)
    return snapshot_diff(b.where(picked).drop(BUCKET), a.where(picked).drop(BUCKET), key)
