"""Session helpers: sizing, bounded checks, shared-folder paths, shipping."""

from farebox import session as S


def test_tune_for_input_sizes_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        n = S.tune_for_input(spark, 100 * 2**30)          # 100 GiB input
        assert n == int(100 * 2**30 * 3.0 // S.TARGET_PARTITION_BYTES) + 1
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(S.TARGET_PARTITION_BYTES)
        assert S.tune_for_input(spark, 10) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_fits_broadcast_measures_values_without_gathering_rows(spark):
    from pyspark.sql import functions as F
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("t"), F.array(F.col("id")).alias("a"))
    size = 1000 * (16 + 100 + 16 + 8 + 16)
    assert S.fits_broadcast(df, size) and not S.fits_broadcast(df, size - 1)
    assert S.fits_broadcast(df.limit(0), 0)


def test_work_paths_live_under_the_checkpoint_folder(spark):
    base = spark.sparkContext.getCheckpointDir()
    p = S.work_path(spark, "x")
    assert p.startswith(base.rstrip("/")) and p != S.work_path(spark, "x")


def test_ship_package_writes_the_zip_to_the_shared_folder(spark):
    import zipfile
    target = S.ship_package(spark)
    assert target.startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))
    local = target.replace("file:", "")
    names = zipfile.ZipFile(local).namelist()
    assert "farebox/catalog.py" in names and "farebox/operators/medallion.py" in names
