"""J2 by key filters: the rows of the plain insert, and which batches are read."""

import pytest
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import columns as C
from farebox.operators import key_filters as KF
from farebox.operators import medallion as M
from farebox.operators import pipeline as PL
from farebox.session import work_path
from farebox.sources import fixtures as X
from farebox.sources import layers as LY
from tests.test_stored import rows, spoil


@pytest.fixture(scope="module")
def layers(spark):
    """Silver rows, and gold of nine batches of their own keys with filters."""
    silver = X.ride_silver(spark, "/root/testdata/sf0.001").cache()
    gold = M.gold_from_silver(silver).withColumn("_batch_id", F.concat(F.lit("old-"), F.pmod(F.xxhash64("booking_id"), F.lit(9))))
    path, filters = work_path(spark, "filtered-gold"), work_path(spark, "key-filters")
    gold.select(*sch.GOLD_COLUMNS).write.partitionBy("_batch_id").parquet(path)
    KF.key_filters(spark.read.parquet(path)).write.partitionBy("_batch_id").parquet(filters)
    return silver, path, filters


def gold_at(spark, path):
    return spark.read.parquet(path).select(*sch.GOLD_COLUMNS)


def renamed(silver, tail):
    return silver.withColumn("booking_id", F.concat("booking_id", F.lit(tail))).withColumn("_batch_id", F.lit("new"))


def test_no_key_is_missed(spark, layers):
    _, path, filters = layers
    gold = gold_at(spark, path)
    hits = KF.possible(gold.select("booking_id"), KF.read_filters(spark, filters))
    assert gold.select("_batch_id", "booking_id").subtract(hits).isEmpty()
    n = gold.count()
    false = KF.possible(gold.select(F.concat("booking_id", F.lit("?")).alias("booking_id")), KF.read_filters(spark, filters)).count()
    assert false <= max(2, 9 * n * 1e-4)


@pytest.mark.parametrize("share", ["new", "old", "mixed"])
def test_rows_of_the_plain_insert(spark, layers, share):
    silver, path, filters = layers
    new = renamed(silver, "?")
    old = silver.withColumn("_batch_id", F.lit("new"))
    batch = {"new": new, "old": old, "mixed": new.where("_id % 3 = 0").unionByName(old.where("_id % 3 = 1"))}[share]
    got = KF.to_gold(batch, gold_at(spark, path), LY.batch_names(spark, path), KF.read_filters(spark, filters), "new")
    want = M.to_gold(batch, gold_at(spark, path), "new")
    assert rows(got) == rows(want)
    assert want.isEmpty() == (share == "old")


def test_other_batches_are_not_opened(spark, layers):
    silver, path, filters = layers
    copy, spoilt = work_path(spark, "filtered-gold"), 0
    gold_at(spark, path).write.partitionBy("_batch_id").parquet(copy)
    gold = gold_at(spark, copy)
    one = gold.where("_batch_id = 'old-4'").select("booking_id").limit(3)
    same = silver.join(F.broadcast(one.select(F.col("booking_id").alias("k"))), C.strip_quotes("booking_id") == F.col("k"), "left_semi")
    batch = renamed(silver, "?").unionByName(same.withColumn("_batch_id", F.lit("new")))
    read = KF.batches_to_read(M.to_gold(batch, None, "new").select("booking_id"), LY.batch_names(spark, copy), KF.read_filters(spark, filters), "new")
    assert "old-4" in read and len(read) <= 3
    want = rows(M.to_gold(batch, gold, "new"))
    for i in range(9):
        if f"old-{i}" not in read:
            spoilt += spoil(f"{copy}/_batch_id=old-{i}")
    assert spoilt >= 6
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gold.schema)
    held = spark.read.schema(schema).parquet(copy)
    assert rows(KF.to_gold(batch, held, LY.batch_names(spark, copy), KF.read_filters(spark, filters), "new")) == want


def test_a_batch_without_filters_is_read(spark, layers):
    _, path, filters = layers
    gold = gold_at(spark, path)
    some = KF.read_filters(spark, filters).where("_batch_id != 'old-2'")
    names = LY.batch_names(spark, path)
    assert names == [f"old-{i}" for i in range(9)]
    keys = gold.select(F.lit("no such key").alias("booking_id")).limit(1)
    assert KF.batches_to_read(keys, names, some) == ["old-2"]
    assert KF.batches_to_read(keys, names, KF.read_filters(spark, work_path(spark, "none"))) == names
    assert KF.batches_to_read(keys, names, some, "old-2") == []


def test_pages_null_keys_and_a_hot_key(spark):
    data = spark.range(9_000).select(F.when(F.col("id") < 3_000, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("booking_id"),
                                     F.lit("a").alias("_batch_id"))
    data = data.unionByName(spark.createDataFrame([(None, "a"), (None, "b")], "booking_id string, _batch_id string"))
    filters = KF.key_filters(data)
    assert rows(filters.groupBy("_batch_id").agg(F.max("pages"), F.count("*"))) == [("a", 16, 16), ("b", 1, 1)]
    got = KF.possible(data.select("booking_id").distinct(), filters)
    assert got.where("_batch_id = 'a'").count() == 6_001 and got.where("_batch_id = 'b'").isEmpty()
    assert KF.key_filters(data.limit(0)).isEmpty()


def test_pipeline_with_key_filters(spark):
    raw = X.ride_raw_text(spark, "/root/testdata/sf0.001").drop("_id", "_batch_id", "_ingested_at")
    raw = raw.select(*sch.CSV_COLUMNS)
    runs = [PL.Pipeline(spark, work_path(spark, "run"), key_filters=k) for k in (False, True)]
    for run in runs:
        for name, part in (("b0", raw.limit(300)), ("b1", raw.limit(500)), ("b1", raw.limit(400))):
            assert run.run(name, raw=part)
    plain, filtered = (rows(r.gold().drop("_batch_id").select("booking_id")) for r in runs)
    assert plain == filtered and plain
    names = {r[0] for r in KF.read_filters(spark, runs[1].filters_path).select("_batch_id").distinct().collect()}
    assert names == {"b0", "b1"}
