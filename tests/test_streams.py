"""Streams equal their batch results; a restart adds nothing."""

from farebox.operators import pipeline as PL
from farebox.session import work_path
from farebox.sources import fixtures as X
from farebox.streaming import streams as ST


def test_ingest_stream_equals_batch_and_restart_adds_nothing(spark, sf):
    base, batches = X.ride_csv_folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "stream-layers"))
    ckpt = work_path(spark, "stream-ckpt")
    ST.stream_ingest(spark, f"{base}/*", pipe, checkpoint=ckpt, available_now=True).awaitTermination()
    cols = [c for c in PL.sch.GOLD_COLUMNS if c != "_batch_id"]
    got = sorted(tuple(r) for r in pipe.gold().select(*cols).collect())
    batch = PL.Pipeline(spark, work_path(spark, "batch-layers"))
    for b in batches:
        batch.run(b, f"{base}/{b}")
    assert got == sorted(tuple(r) for r in batch.gold().select(*cols).collect())
    # Every file is a batch of its own (two or more per folder).
    assert pipe.status().count() == spark.read.format("binaryFile").option(
        "pathGlobFilter", "part-*").load(f"{base}/*").count() >= 2 * len(batches)
    events = pipe.events().count()
    ST.stream_ingest(spark, f"{base}/*", pipe, checkpoint=ckpt, available_now=True).awaitTermination()
    assert pipe.events().count() == events


def test_ingest_names_a_batch_once_a_file(spark, monkeypatch):
    """The batch id comes from the path, so it's made for files, not for rows."""
    from pyspark.sql import functions as F
    from farebox import schemas as sch
    from farebox.sources import csv as CSV
    folder = work_path(spark, "many-rows")
    rows = spark.range(400).select((F.col("id") % 2).alias("part"), *[F.col("id").cast("string").alias(c) for c in sch.CSV_COLUMNS])
    CSV.write_csv(rows, folder, partition_by="part")
    calls, of = spark.sparkContext.accumulator(0), ST.batch_of

    def counted(path):
        def one(p):
            calls.add(1)
            return p
        return of(F.udf(one, "string")(path))

    class Runs:
        seen = []

        def run(self, batch, path):
            self.seen.append((batch, path))

    monkeypatch.setattr(ST, "batch_of", counted)
    ST.stream_ingest(spark, f"{folder}/*", Runs(), available_now=True).awaitTermination()
    assert len(Runs.seen) == len(set(Runs.seen)) == 2 == calls.value
    assert all(b.startswith("part-") and p.endswith(".csv") for b, p in Runs.seen)


def test_dashboard_stream_totals_equal_batch(spark, sf):
    gold_path = work_path(spark, "dash-gold")
    g = X.ride_gold(spark, sf)
    g.write.parquet(gold_path)
    out = ST.run_to_memory(ST.dashboard_stream(spark, gold_path))
    assert out.groupBy().sum("total").first()[0] == g.count()


def shown(df):
    from pyspark.sql import functions as F
    return sorted(map(repr, df.withColumn("revenue", F.round("revenue", 4))
                      .select("window_start", "vehicle_type", "total", "completed", "revenue").collect()))


def fresh(g):
    from pyspark.sql import functions as F
    return g.groupBy(ST.window_start("ride_timestamp", 3600).alias("window_start"), "vehicle_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("booking_status") == "Completed").alias("completed"),
        F.sum("booking_value").alias("revenue"))


def test_dashboard_takes_old_shares_back(spark, sf):
    """New batches, a rerun with other rows, rides without a time, a batch
    that is gone: always what a fresh aggregate gives, and only what changed is
    counted again."""
    from pyspark.sql import functions as F
    from farebox.sources import layers as LY
    path, shares = work_path(spark, "dash-gold"), work_path(spark, "dash-shares")
    g = X.ride_gold(spark, sf)
    batch = {b: g.where(F.col("_batch_id") == b) for b in ("batch-0", "batch-1", "batch-2")}
    for b in ("batch-0", "batch-1"):
        LY.batch_replace(batch[b], path, b)
    assert ST.refresh_dashboard(spark, path, shares) == 2
    assert ST.refresh_dashboard(spark, path, shares) == 0
    no_time = batch["batch-1"].limit(7).withColumn("ride_timestamp", F.lit(None).cast("timestamp_ntz"))
    LY.batch_replace(no_time, path, "batch-1")                      # a rerun with fewer rows
    LY.batch_replace(batch["batch-2"], path, "batch-2")
    assert ST.refresh_dashboard(spark, path, shares) == 2
    now = spark.read.parquet(path)
    assert shown(ST.dashboard_table(spark, shares)) == shown(fresh(now))
    assert ST.dashboard_table(spark, shares).where("window_start IS NULL").groupBy().sum("total").first()[0] == 7
    LY.batch_replace(batch["batch-0"].limit(0), path, "batch-0")    # an empty rerun
    batch["batch-1"].withColumn("_batch_id", F.lit(None).cast("string")).write.mode("overwrite").partitionBy("_batch_id").parquet(path)
    ST.stream_dashboard(spark, path, shares, available_now=True).awaitTermination()
    assert shown(ST.dashboard_table(spark, shares)) == shown(fresh(spark.read.parquet(path)))
    assert ST.refresh_dashboard(spark, path, shares) == 0


def test_dashboard_over_gold_without_batch_folders(spark, sf):
    path, shares = work_path(spark, "dash-flat"), work_path(spark, "dash-flat-shares")
    g = X.ride_gold(spark, sf)
    g.write.parquet(path)
    ST.refresh_dashboard(spark, path, shares)
    g.limit(5).write.mode("append").parquet(path)
    assert ST.refresh_dashboard(spark, path, shares) == 1
    assert shown(ST.dashboard_table(spark, shares)) == shown(fresh(spark.read.parquet(path)))


def test_batch_ids_tell_files_apart(spark):
    from pyspark.sql import functions as F
    paths = ["file:/a/up/x.csv", "file:/a/up/y.csv", "file:/b/up/x.csv", "file:/a/my%20up/x.v2.CSV"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    ids = [r[0] for r in df.select(ST.batch_of(F.col("p"))).collect()]
    assert len(set(ids)) == 4 and all(i.replace("-", "").replace(".", "").isalnum() for i in ids)
    assert ids[0].startswith("up-x-") and ids[3].startswith("my-20up-x.v2-")


def test_vector_sync_stream_survives_a_failing_sync(spark, sf):
    from pyspark.sql import functions as F
    gold_path = work_path(spark, "sync-fail-gold")
    X.ride_gold(spark, sf).write.parquet(gold_path)
    _, idx = X.vector_sync_fixture(spark, sf)
    index = ST.VectorIndex(spark, work_path(spark, "sync-fail-index"))
    index.write(idx)
    ckpt = work_path(spark, "sync-fail-ckpt")

    def broken(col):                      # an embedder whose every call fails the job
        return F.raise_error(F.lit("model down")).cast("array<float>")

    q = ST.stream_vector_sync(spark, gold_path, index, checkpoint=ckpt, available_now=True, embedder=broken)
    q.awaitTermination()
    assert q.exception() is None          # the stream goes on
    assert index.current().count() == idx.count()  # readers see the last good one
    # The next tick retries, with no new gold file.
    ST.stream_vector_sync(spark, gold_path, index, checkpoint=ckpt, available_now=True).awaitTermination()
    want = {r[0] for r in ST.V.sync_source(X.ride_gold(spark, sf)).select("id").collect()}
    assert want <= {r[0] for r in index.current().select("id").collect()}


def test_change_stream_equals_batch_apply(spark, sf):
    from pyspark.sql import functions as F
    from farebox.operators import changes as CH
    from farebox.schemas import GOLD_SCHEMA
    g = X.ride_gold(spark, sf)
    cs = X.change_set(spark, sf)
    first, later = cs.where(F.col("seq") % 3 == 0), cs.where(F.col("seq") % 3 == 1)
    path = work_path(spark, "change-files")
    first.write.parquet(path)
    gold = work_path(spark, "gold-batches")
    g.write.partitionBy("_batch_id").parquet(gold)
    ckpt = work_path(spark, "change-ckpt")
    ST.stream_changes(spark, path, gold, cs.schema, checkpoint=ckpt, available_now=True).awaitTermination()
    later.write.mode("append").parquet(path)
    ST.stream_changes(spark, path, gold, cs.schema, checkpoint=ckpt, available_now=True).awaitTermination()
    want = sorted(map(tuple, CH.apply_changes(g, cs).select(*GOLD_SCHEMA.fieldNames()).collect()))
    got = sorted(map(tuple, spark.read.parquet(gold).select(*GOLD_SCHEMA.fieldNames()).collect()))
    assert got == want


def test_dashboard_follows_pipeline_reruns(spark, sf):
    base, batches = X.ride_csv_folder(spark, sf)
    shares = work_path(spark, "pipe-shares")
    pipe = PL.Pipeline(spark, work_path(spark, "pipe-layers"))
    pipe.after_gold = lambda b: ST.refresh_dashboard(spark, pipe.gold_path, shares)
    for b in [*batches, batches[0]]:                                # and a rerun
        assert pipe.run(b, f"{base}/{b}")
    assert shown(ST.dashboard_table(spark, shares)) == shown(fresh(pipe.gold()))


def _files(path):
    import os
    top = path.replace("file:", "")
    return {d: sorted(os.listdir(f"{top}/{d}")) for d in os.listdir(top) if "=" in d}


def test_vector_sync_rewrites_only_touched_buckets(spark, sf):
    from pyspark.sql import functions as F
    gold_path = work_path(spark, "bucket-gold")
    g = X.ride_gold(spark, sf)
    g.write.parquet(gold_path)
    index = ST.VectorIndex(spark, work_path(spark, "bucket-index"), buckets=16)
    assert ST.sync_once(spark, gold_path, index) > 0                # from nothing
    ids = index.current().orderBy("id").select("id").collect()
    assert {r[0] for r in ids} == {r[0] for r in ST.V.sync_source(g).select("id").collect()}
    before = _files(index.base)
    assert ST.sync_once(spark, gold_path, index) == 0               # an empty plan writes nothing
    assert _files(index.base) == before
    gone = ids[0][0]
    index_rows = index.current()
    extra = index_rows.where(F.col("id") == gone).withColumn("id", F.lit("00000000-0000-0000-0000-00000000000f"))
    both = index_rows.drop("bucket").unionByName(extra.drop("bucket")).collect()
    index.write(spark.createDataFrame(both, ST.sch.VECTOR_SCHEMA))
    before = _files(index.base)
    assert ST.sync_once(spark, gold_path, index) == 1               # one orphan, one bucket
    after = _files(index.base)
    assert sum(before.get(d) != after.get(d) for d in before) == 1
    assert index.current().count() == len(ids)
    # a changed reason stays unless asked for
    g.withColumn("unified_cancellation_reason", F.when(F.col("unified_cancellation_reason") == "Driver asked to cancel", F.lit("Other Issue"))
                 .otherwise(F.col("unified_cancellation_reason"))).write.mode("overwrite").parquet(gold_path)
    stale = index.current().where("reason = 'Driver asked to cancel'").count()
    assert stale and ST.sync_once(spark, gold_path, index) == 0
    assert ST.sync_once(spark, gold_path, index, refresh_changed=True) > 0
    now = index.current()
    assert now.where("reason = 'Driver asked to cancel'").count() == 0 and now.count() == len(ids)
    assert now.where("reason = 'Other Issue'").select("embedding").distinct().count() == 1      # embedded anew
    assert ST.sync_once(spark, gold_path, index, refresh_changed=True) == 0


def test_upsert_takes_one_point_of_an_id(spark):
    from farebox.operators import vectors as V
    index = spark.createDataFrame([("a", [1.0], "old", "1"), ("b", [2.0], "old", "2")], ST.sch.VECTOR_SCHEMA)
    points = spark.createDataFrame([("a", [3.0], "x", "1"), ("a", [4.0], "y", "1"), ("c", [5.0], "z", "3"), ("c", [5.0], "z", "3")], ST.sch.VECTOR_SCHEMA)
    got = sorted((r["id"], r["reason"], r["embedding"]) for r in V.upsert(index, points).collect())
    assert got == [("a", "y", [4.0]), ("b", "old", [2.0]), ("c", "z", [5.0])]


def _gold_and_changes(spark, path):
    from tests.test_invariants import CHANGES, _gold_rows
    _gold_rows(spark, "K1", "K2").write.partitionBy("_batch_id").parquet(path)
    up = ("Incomplete", "Other Issue", None, None)
    # the update of K9 comes before its first insert: applied again it would find the row
    return spark.createDataFrame([(1, "update", "K9", *up), (2, "insert", "K9", None, None, 5.0, 1.0),
                                  (3, "update", "K1", *up), (4, "delete", "K2", None, None, None, None)], CHANGES)


def _state(spark, path):
    return sorted((r["booking_id"], r["booking_status"], r["booking_value"]) for r in spark.read.parquet(path).collect())


def test_changes_are_applied_exactly_once(spark, monkeypatch):
    import pytest
    from farebox.sources import layers as LY
    plain = work_path(spark, "once-plain")
    changes = _gold_and_changes(spark, plain)
    LY.apply_changes_in_place(spark, plain, changes)
    want = _state(spark, plain)
    LY.apply_changes_in_place(spark, plain, changes)
    assert _state(spark, plain) != want                             # the case that needs a ledger
    whole = LY.replace_partitions
    write = LY._changed_partitions

    def crash_before_commit(*a):
        write(*a)
        raise RuntimeError("lost")

    def crash_before_swap(*a):
        raise RuntimeError("lost")

    def crash_after_swap(*a):
        whole(*a)
        raise RuntimeError("lost")

    for i, (name, crash) in enumerate((("_changed_partitions", crash_before_commit), ("replace_partitions", crash_before_swap),
                                       ("replace_partitions", crash_after_swap))):
        path, ledger = work_path(spark, f"once-{i}"), work_path(spark, f"ledger-{i}")
        changes = _gold_and_changes(spark, path)
        with monkeypatch.context() as m:
            m.setattr(LY, name, crash)
            with pytest.raises(RuntimeError):
                LY.apply_changes_once(spark, path, changes, ledger, 7)
        assert LY.apply_changes_once(spark, path, changes, ledger, 7) is True
        assert _state(spark, path) == want
        assert LY.apply_changes_once(spark, path, changes, ledger, 7) is False
        assert _state(spark, path) == want
