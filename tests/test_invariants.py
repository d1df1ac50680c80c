"""Pipeline, change-set and sync invariants."""

import pytest
from pyspark.sql import functions as F

from farebox.operators import changes as CH
from farebox.operators import dashboard as D
from farebox.operators import medallion as M
from farebox.operators import pipeline as PL
from farebox.operators import vectors as V
from farebox.session import work_path
from farebox.sources import fixtures as X
from farebox.sources import layers as LY


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def ran(spark, sf):
    base, batches = X.ride_csv_folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "test-layers"))
    for b in batches:
        assert pipe.run(b, f"{base}/{b}")
    return pipe, base, batches


def test_gold_keys_unique(spark, ran):
    pipe, _, _ = ran
    g = pipe.gold()
    assert g.count() == g.select("booking_id").distinct().count()


def test_rerun_of_a_batch_leaves_gold_unchanged(spark, ran):
    pipe, base, batches = ran
    before = rows(pipe.gold().select(*M.sch.GOLD_COLUMNS))
    assert pipe.run(batches[1], f"{base}/{batches[1]}")
    assert rows(pipe.gold().select(*M.sch.GOLD_COLUMNS)) == before


def test_status_view_records_every_step(spark, ran):
    pipe, _, batches = ran
    st = {r["batch_id"]: r for r in pipe.status().collect()}
    assert set(st) >= set(batches)
    assert all(st[b]["step"] == "Gold" and st[b]["status"] == "Success" for b in batches)


def test_failed_gold_step_keeps_old_rows_and_resumes(spark, sf):
    base, batches = X.ride_csv_folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "test-fail"))
    b = batches[0]
    assert pipe.run(b, f"{base}/{b}")
    before = rows(pipe.gold())
    # Break the silver batch: a rating out of range fails the gold step.
    silver = LY.layer_scan(spark, pipe.silver_path, b)
    bad = silver.withColumn("customer_rating", F.lit(9.0))
    LY.batch_replace(bad.checkpoint(), pipe.silver_path, b)
    assert not pipe.run(b, start="Gold")
    st = pipe.status().where(F.col("batch_id") == b).first()
    assert (st["step"], st["status"]) == ("Gold", "Failed")
    assert rows(pipe.gold()) == before
    assert CH.resumable_runs(pipe.status()).where(F.col("batch_id") == b).count() == 1
    # Fix the silver batch and resume from the failed step.
    assert pipe.to_silver(b) > 0
    assert pipe.resume(b)
    assert pipe.status().where(F.col("batch_id") == b).first()["status"] == "Success"


def test_empty_result_clears_the_batch(spark, sf):
    path = work_path(spark, "test-empty")
    df = X.ride_bronze(spark, sf).where(F.col("_batch_id") == "batch-0")
    assert LY.batch_replace(df, path, "batch-0") > 0
    assert LY.batch_replace(df.limit(0), path, "batch-0") == 0
    assert not LY.path_exists(spark, f"{path}/_batch_id=batch-0")


def test_short_csv_row_fails_the_scan(spark, tmp_path):
    from farebox.sources import csv as CSV
    p = tmp_path / "bad.csv"
    p.write_text("h1,h2\n" + ",".join(["a"] * 17) + "\n" + ",".join(["b"] * 5) + "\n")
    with pytest.raises(Exception):
        CSV.csv_scan(spark, str(p)).collect()
    ok = tmp_path / "extra.csv"
    ok.write_text("h\n" + ",".join(["a"] * 19) + "\n")
    assert CSV.csv_scan(spark, str(ok)).count() == 1


CHANGES = ("seq long, op string, booking_id string, booking_status string, "
           "unified_cancellation_reason string, booking_value double, ride_distance double")


def _gold_rows(spark, *keys):
    from farebox.schemas import GOLD_COLUMNS, GOLD_SCHEMA
    base = dict.fromkeys(GOLD_COLUMNS)
    base.update(_batch_id="b", booking_status="Completed",
                unified_cancellation_reason="Not Cancelled", booking_value=10.0, ride_distance=2.0)
    return spark.createDataFrame([tuple({**base, "booking_id": k}[c] for c in GOLD_COLUMNS)
                                  for k in keys], GOLD_SCHEMA)


def test_changes_of_one_key_apply_in_sequence(spark):
    gold = _gold_rows(spark, *[f"K{i}" for i in range(1, 10)])
    up = ("Incomplete", "Other Issue", None, None)
    ch = spark.createDataFrame([
        (1, "delete", "K1", None, None, None, None), (2, "insert", "K1", None, None, 99.0, 3.0),
        (3, "insert", "K20", None, None, 7.0, 2.0), (4, "update", "K20", *up),
        (5, "update", "K2", *up), (6, "update", "K2", "Cancelled by Driver", None, None, None),
        (7, "update", "K3", *up), (8, "delete", "K3", None, None, None, None),
        (9, "insert", "K4", None, None, 1.0, 1.0),                      # the key exists: skipped
        (10, "update", "K5", *up), (11, "delete", "K5", None, None, None, None),
        (12, "insert", "K5", None, None, 5.0, 0.0),                     # the update came before
        (13, "insert", "K21", None, None, 1.0, 1.0), (14, "delete", "K21", None, None, None, None),
        (15, "update", "K22", *up), (16, "insert", "K22", None, None, 4.0, 1.0),
        (17, "insert", "K22", None, None, 8.0, 1.0),                    # a second insert: skipped
        (18, "delete", "K6", None, None, None, None), (18, "insert", "K6", None, None, 6.0, 1.0),
        (19, "update", "K30", *up), (20, "noise", "K7", *up), (21, None, "K8", *up)], CHANGES)
    want = {"K1": ("Completed", "Not Cancelled", 99.0), "K20": ("Incomplete", "Other Issue", 7.0),
            "K2": ("Cancelled by Driver", None, 10.0), "K4": ("Completed", "Not Cancelled", 10.0),
            "K5": ("Completed", "Not Cancelled", 5.0), "K22": ("Completed", "Not Cancelled", 4.0),
            "K6": ("Completed", "Not Cancelled", 6.0), "K7": ("Completed", "Not Cancelled", 10.0),
            "K8": ("Completed", "Not Cancelled", 10.0), "K9": ("Completed", "Not Cancelled", 10.0)}

    def shown(df):
        rows_ = df.select("booking_id", "booking_status", "unified_cancellation_reason",
                          "booking_value").collect()
        assert len(rows_) == len({r[0] for r in rows_})
        return {r[0]: tuple(r[1:]) for r in rows_}

    once = CH.apply_changes(gold, ch)
    assert shown(once) == want
    # A replay changes nothing, but that K22's early update now finds a row.
    again = CH.apply_changes(once, ch.where("seq IS NULL OR seq <> 15"))
    assert shown(again) == want
    assert shown(CH.apply_changes(gold, ch.limit(0))) == shown(gold)


def test_status_updates_deletes_and_matches(spark):
    gold = _gold_rows(spark, "K1")
    up = spark.createDataFrame([("K1", "Cancelled by Driver", None)], "booking_id string, "
                               "booking_status string, unified_cancellation_reason string")
    out = CH.update_status(gold, up).select("booking_id", "booking_status", "unified_cancellation_reason")
    assert rows(out) == [("K1", "Cancelled by Driver", None)]
    dele = spark.createDataFrame([(3, "delete", "K1")], "seq long, op string, booking_id string")
    assert CH.delete_rides(gold, dele).count() == 0
    m = CH.matched_keys(gold, spark.createDataFrame([("K1",), ("K9",)], "booking_id string"))
    assert rows(m) == [("K1", True), ("K9", False)]


def test_new_ride_keys_are_unique(spark, monkeypatch):
    new = spark.range(400).select(
        F.lit(None).cast("timestamp_ntz").alias("ride_timestamp"), F.lit("c").alias("customer_id"),
        F.lit("Bike").alias("vehicle_type"), F.lit(5.0).alias("booking_value"),
        F.lit(1.0).alias("ride_distance"), F.lit(4.0).alias("driver_ratings"),
        F.lit(4.0).alias("customer_rating"), F.lit("Cash").alias("payment_method"),
        F.lit("same").alias("seed"))
    with pytest.raises(CH.QualityError, match="duplicate key"):
        CH.add_rides(new, key_seed="seed")
    # Short keys clash at once; redrawing the clashing ones makes them unique.
    short = lambda seed=None, prefix="BOK-": F.substring(F.uuid(), 1, 4)
    monkeypatch.setattr(CH.C, "generate_key", short)
    gold = spark.range(2000).select(F.lower(F.lpad(F.hex("id"), 4, "0")).alias("booking_id"))
    keys = [r[0] for r in CH.add_rides(new, gold=gold).select("booking_id").collect()]
    assert len(keys) == len(set(keys)) == 400
    assert not set(keys) & {r[0] for r in gold.collect()}


def test_sync_twice_has_an_empty_plan(spark, sf):
    src, idx = X.vector_sync_fixture(spark, sf)
    new = V.apply_sync(src, idx)
    assert V.sync_plan(src, new).count() == 0


def test_delete_guard_blocks_full_wipe(spark, sf):
    src, idx = X.vector_sync_fixture(spark, sf)
    other = src.withColumn("id", F.concat(F.lit("x"), F.col("id")))  # nothing matches
    g = V.delete_guard(other, idx).first()
    assert g["delete_count"] == g["index_count"] and not g["apply_deletes"]
    empty = V.delete_guard(src.limit(0), idx).first()
    assert empty["apply_deletes"]            # an empty source deletes everything


def test_shares_and_hours_add_up(spark, sf):
    g = X.ride_gold(spark, sf)
    shares = D.share_of_total(D.cancellation_counts(g)).agg(F.sum("pct")).first()[0]
    assert abs(shares - 100) < 0.1 * 12
    hours = D.hourly_traffic(g).agg(F.sum("ride_count")).first()[0]
    assert hours == g.count()
    parts = D.split_summary(D.dashboard_summary(g))
    assert rows(parts["vehicle"]) == rows(D.vehicle_performance(g))
    assert rows(parts["hour"]) == rows(D.hourly_traffic(g))


def test_hot_key_dedup_and_changes(spark, sf):
    """One key holding a third of all rows: first row wins and last change
    wins stay exact, and the plan pre-aggregates before the shuffle."""
    from farebox.plans.layout import explain_text
    silver = X.ride_silver(spark, sf)
    hot = silver.withColumn("booking_id", F.when(F.col("_id") % 3 == 0, F.lit('"HOT"'))
                            .otherwise(F.col("booking_id")))
    gold = M.gold_from_silver(hot)
    plan = explain_text(gold)
    assert "partial_min" in plan
    first = hot.where(F.col("booking_id") == '"HOT"').orderBy("_batch_id", "_id").first()
    row = gold.where(F.col("booking_id") == "HOT").collect()
    assert len(row) == 1 and row[0]["_batch_id"] == first["_batch_id"]
    assert row[0]["ride_timestamp"] == first["ride_timestamp"]
    assert gold.count() == gold.select("booking_id").distinct().count()
    changes = hot.select(F.col("_id").alias("seq"), F.lit("update").alias("op"),
                         F.lit("HOT").alias("booking_id"), F.col("booking_status"),
                         F.concat(F.lit("r"), F.col("_id").cast("string"))
                         .alias("unified_cancellation_reason"))
    last = CH.net_changes(changes).collect()
    assert len(last) == 1 and last[0]["_u"]["seq"] == hot.agg(F.max("_id")).first()[0]


def test_clean_first_picks_reason_by_trimmed_status(spark, sf):
    b = X.ride_bronze(spark, sf)
    padded = F.col("booking_status").startswith("  Cancelled by Customer")
    raw = M.to_silver(b).join(b.where(padded).select("_id"), "_id")
    clean = M.to_silver(b, clean_first=True).join(b.where(padded).select("_id"), "_id")
    assert raw.count() > 0
    assert raw.where(F.col("unified_cancellation_reason") != "Not Cancelled").count() == 0
    assert clean.where(F.col("unified_cancellation_reason") == "Not Cancelled").count() == 0


def test_load_order_follows_files_and_positions(spark, tmp_path):
    """Several files in one batch, each in several splits: _id follows file
    path order, then position in the file (split packing is by size)."""
    from farebox.sources import csv as CSV
    header = ",".join(f"c{i}" for i in range(17))
    expected = []
    for name, n in (("a.csv", 40), ("b.csv", 5), ("c.csv", 300)):     # largest last by name
        lines = [header]
        for i in range(n):
            key = f"{name[0]}{i:04d}"
            lines.append(",".join(["2024-01-01", "10:00:00", key] + ["x"] * 14))
            expected.append(key)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")       # many splits per file
    try:
        raw = CSV.csv_scan(spark, str(tmp_path), with_file=True)
        assert raw.select("_file", "_block").distinct().count() > 3
        got = [r["booking_id"] for r in M.to_bronze(raw, "b1").orderBy("_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expected


def test_resume_of_unknown_or_finished_batch(spark, ran):
    pipe, _, batches = ran
    assert pipe.resume(batches[0]) is False          # succeeded: nothing to resume
    with pytest.raises(LookupError):
        pipe.resume("no-such-batch")


def test_files_of_any_size_are_read(spark, tmp_path):
    from farebox.sources import csv as CSV
    p = tmp_path / "big.csv"
    p.write_text("h\n" + "\n".join(",".join(["a"] * 17) for _ in range(50)) + "\n")
    assert CSV.csv_scan(spark, str(p)).count() == 50                 # no silent skip


def test_apply_changes_in_place_rewrites_only_touched_batches(spark, sf):
    import os
    g = X.ride_gold(spark, sf)
    path = work_path(spark, "inplace-gold")
    g.write.partitionBy("_batch_id").parquet(path)
    cs = X.change_set(spark, sf).where(F.col("op") != "insert")
    only_b1 = cs.join(g.where(F.col("_batch_id") == "batch-1").select("booking_id"), "booking_id",
                      "left_semi")
    local = path.replace("file:", "")
    before = {d: os.listdir(f"{local}/{d}") for d in os.listdir(local) if d.startswith("_batch_id=")}
    touched = LY.apply_changes_in_place(spark, path, only_b1)
    assert [r[0] for r in touched.collect()] == ["batch-1"]
    after = {d: os.listdir(f"{local}/{d}") for d in os.listdir(local) if d.startswith("_batch_id=")}
    assert after["_batch_id=batch-0"] == before["_batch_id=batch-0"]      # untouched files
    assert after["_batch_id=batch-1"] != before["_batch_id=batch-1"]
    want = CH.apply_changes(g, only_b1)
    got = spark.read.parquet(path).select(*g.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*g.columns).collect()))


def test_apply_changes_in_place_with_inserts(spark, sf):
    g = X.ride_gold(spark, sf)
    path = work_path(spark, "inplace-gold-ins")
    g.write.partitionBy("_batch_id").parquet(path)
    cs = X.change_set(spark, sf)
    LY.apply_changes_in_place(spark, path, cs)
    want = CH.apply_changes(g, cs).select(*g.columns)
    got = spark.read.parquet(path).select(*g.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
