"""Stored forms: snapshots by bucket, deep pages, sketches, compacted events."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import labels as LB
from farebox.operators import changes as CH
from farebox.operators import lookup as L
from farebox.operators import pages as PG
from farebox.operators import pipeline as PL
from farebox.operators import sketches as SK
from farebox.operators import snapshots as SN
from farebox.session import work_path
from farebox.sources import compaction as CO
from farebox.sources import fixtures as X


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def spoil(folder):
    """Overwrite every data file under ``folder``: reading one then fails."""
    found = glob.glob(folder.replace("file:", "") + "/*.parquet")
    for f in found:
        with open(f, "wb") as out:
            out.write(b"not parquet")
        crc = f.rsplit("/", 1)[0] + "/." + f.rsplit("/", 1)[1] + ".crc"
        for c in glob.glob(crc):
            with open(c, "wb") as out:
                out.write(b"")
    return len(found)


# --- snapshots -------------------------------------------------------------------

def snapshot(spark, data, buckets=16):
    df = spark.createDataFrame(data, "k string, a int, b string")
    return df, SN.write_snapshot(df, work_path(spark, "snap"), "k", buckets)


def test_snapshots_differ_as_the_full_outer_join(spark):
    rnd = random.Random(3)
    old = [(f"k{i}", i, f"t{i % 7}") for i in range(300)]
    new = [r for r in old if rnd.random() > 0.02]
    new = [(k, a + 1, b) if rnd.random() < 0.02 else (k, a, b) for k, a, b in new] + [("n1", None, ""), ("n2", 1, None)]
    b, pb = snapshot(spark, old)
    a, pa = snapshot(spark, new)
    want = rows(CH.snapshot_diff(b, a, "k"))
    assert want and rows(SN.diff_snapshots(spark, pb, pa, "k")) == want


def test_only_differing_buckets_are_read(spark):
    old = [(f"k{i}", i, "t") for i in range(300)]
    _, pb = snapshot(spark, old)
    _, pa = snapshot(spark, [("k7", -1, "t") if r[0] == "k7" else r for r in old])
    changed = [r[0] for r in SN.changed_buckets(spark, pb, pa).collect()]
    assert len(changed) == 1
    spoilt = sum(spoil(f"{p}/rows/{SN.BUCKET}={i}") for p in (pb, pa) for i in range(16) if i not in changed)
    assert spoilt >= 30
    assert rows(SN.diff_snapshots(spark, pb, pa, "k")) == [("k7", "changed")]


@pytest.mark.parametrize("old, new", [
    ([("x", None, "1")], [("x", 1, None)]),          # a value that moves to another column
    ([("x", 1, "")], [("x", 1, None)]),              # empty text and NULL
    ([("x", 1, "a"), ("y", 1, "b")], [("x", 1, "b"), ("y", 1, "a")]),
    ([], [("x", 1, "a")]),
    ([("x", 1, "a")], []),
    ([], []),
    ([(None, 1, "a")], [(None, 1, "a")]),            # a NULL key equals no key
])
def test_small_snapshots(spark, old, new):
    b, pb = snapshot(spark, old, 4)
    a, pa = snapshot(spark, new, 4)
    assert rows(SN.diff_snapshots(spark, pb, pa, "k")) == rows(CH.snapshot_diff(b, a, "k"))


def test_repeated_rows_count_in_the_digest(spark):
    _, pb = snapshot(spark, [("x", 1, "a")] * 2, 4)
    _, pa = snapshot(spark, [("x", 1, "a")] * 4, 4)
    assert SN.changed_buckets(spark, pb, pa).count() == 1


def test_snapshots_of_other_shapes_are_refused(spark):
    _, p4 = snapshot(spark, [("x", 1, "a")], 4)
    _, p8 = snapshot(spark, [("x", 1, "a")], 8)
    with pytest.raises(ValueError):
        SN.diff_snapshots(spark, p4, p8, "k")


# --- deep pages -------------------------------------------------------------------

def test_every_page_equals_the_offset_page(spark, sf):
    g = X.ride_gold(spark, sf).cache()
    path = PG.write_paged(g, work_path(spark, "paged"), 7)
    size = 97
    for status, vehicle in ((None, None), ("Completed", None), ("Completed", "Bike"), ("none", None)):
        total = PG.page_ranges(spark, path, status, vehicle)[2]
        for page in sorted({1, 2, total // size // 2 + 1, total // size + 1, total // size + 3}):
            want = L.rides_page(g, status, vehicle, page=page, size=size).collect()
            assert PG.deep_page(spark, path, status, vehicle, page, size).collect() == want, (status, vehicle, page)
    g.unpersist()


def test_a_page_reads_only_its_ranges(spark, sf):
    g = X.ride_gold(spark, sf)
    path = PG.write_paged(g, work_path(spark, "paged"), 8)
    page = g.count() // 20
    want = PG.deep_page(spark, path, page=page, size=20).collect()
    held, _, _ = PG.page_ranges(spark, path, page=page, size=20)
    assert len(held) <= 2
    assert sum(spoil(f"{path}/rows/{PG.RANGE}={i}") for i in range(8) if i not in held) >= 5
    assert PG.deep_page(spark, path, page=page, size=20).collect() == want and len(want) == 20


def test_pages_of_ties_null_times_and_empty_tables(spark, sf):
    g = X.ride_gold(spark, sf)
    null_times = g.withColumn("ride_timestamp", F.when(F.crc32("booking_id") % 3 != 0, F.lit(dt.datetime(2024, 1, 1))))
    path = PG.write_paged(null_times, work_path(spark, "paged"), 5)
    for page in (1, 3, 9):
        assert PG.deep_page(spark, path, page=page, size=50).collect() == L.rides_page(null_times, page=page, size=50).collect()
    empty = PG.write_paged(g.limit(0), work_path(spark, "paged"), 5)
    assert PG.deep_page(spark, empty).collect() == []
    with pytest.raises(ValueError):
        PG.deep_page(spark, path, page=0)


# --- sketches ---------------------------------------------------------------------

def test_union_of_batch_sketches(spark):
    df = spark.range(60000).select(F.concat(F.lit("k"), (F.col("id") % 20000)).alias("k"),
                                   F.concat(F.lit("b"), F.col("id") % 4).alias("_batch_id"))
    path = work_path(spark, "sketch")
    for b in ("b0", "b1", "b2", "b3", "b1"):         # b1 again: replaced, not added
        SK.store_sketch(df, path, b, "k")
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    est = SK.distinct_estimate(stored).first()[0]
    assert abs(est - 20000) <= 3 * SK.relative_error() * 20000
    SK.store_sketch(df.where("k < 'k1'"), path, "b0", "k")      # a rerun with other rows
    kept = df.where("_batch_id <> 'b0' OR k < 'k1'").select("k").distinct().count()
    est = SK.distinct_estimate(spark.read.parquet(path)).first()[0]
    assert abs(est - kept) <= 3 * SK.relative_error() * kept


def test_sketch_counts_empty_texts_and_no_nulls(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("x", "b"), (None, "c")], "k string, _batch_id string")
    s = SK.batch_sketches(df, "k")
    got = dict(s.select("_batch_id", F.hll_sketch_estimate("sketch")).collect())
    assert got == {"b": 2, "c": 0}
    assert SK.distinct_estimate(s.limit(0)).first()[0] == 0


# --- step events --------------------------------------------------------------------

def test_compaction_keeps_the_view_and_bounds_the_files(spark, sf):
    path = work_path(spark, "events")
    ev = X.step_events(spark, sf)
    ev.repartition(30).write.parquet(path)
    read = lambda: spark.read.schema(sch.STEP_EVENT_SCHEMA).parquet(path)
    want = rows(CH.step_status(read()))
    assert CO.compact(spark, path, sch.STEP_EVENT_SCHEMA, max_files=30) == 0
    assert CO.compact(spark, path, sch.STEP_EVENT_SCHEMA, max_files=29) == 30
    assert len(CO.small_files(spark, path)) == 1
    assert read().count() == ev.count() and rows(CH.step_status(read())) == want


def test_events_left_twice_by_a_crash_leave_the_view_the_same(spark, sf):
    ev = X.step_events(spark, sf)
    assert rows(CH.step_status(ev.unionByName(ev))) == rows(CH.step_status(ev))


def test_a_run_writes_four_times_and_compacts(spark, sf):
    base, batches = X.ride_csv_folder(spark, sf)
    pipe = PL.Pipeline(spark, work_path(spark, "layers"))
    assert pipe.compact_events() == 0                # no table yet
    assert pipe.run(batches[0], f"{base}/{batches[0]}")
    assert len(CO.small_files(spark, pipe.events_path)) == 4
    events = [(r["step"], r["status"]) for r in pipe.events().orderBy("seq").collect()]
    assert events == [(s, e) for s in pipe.STEPS for e in ("Processing", "Success")]
    before = rows(pipe.status())
    assert pipe.compact_events(max_files=3) == 4
    assert rows(pipe.status()) == before


# --- labels -------------------------------------------------------------------------

def test_short_reasons_and_run_labels(spark):
    c = spark.createDataFrame([("Wrong Address", 2), ("made up", 1), (None, 3)], "reason string, count int")
    got = {r["reason"]: r["reason_label"] for r in LB.short_reasons(c).collect()}
    assert got == {"Wrong Address": LB.REASON_SHORT_LABELS["Wrong Address"], "made up": "made up", None: None}
    s = spark.createDataFrame([("Failed",), ("other",)], "status string")
    assert {r[0]: r[1] for r in LB.label_runs(s).collect()} == {"Failed": LB.RUN_STATUS_LABELS["Failed"], "other": "other"}
