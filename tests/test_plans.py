"""Physical plan shapes: pushdown, pruning, broadcast, top-k, no Python."""

from pyspark.sql import functions as F

from farebox.operators import dashboard as D
from farebox.operators import lookup as L
from farebox.operators import report as R
from farebox.plans import layout as LO
from farebox.session import work_path
from farebox.sources import fixtures as X


def stored_gold(spark, sf):
    path = work_path(spark, "plan-gold")
    X.ride_gold(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_segment_report_pushes_filters_and_prunes_columns(spark, sf):
    plan = LO.explain_text(R.segment_report(stored_gold(spark, sf)))
    assert "PushedFilters" in plan and "booking_status" in plan and "GreaterThan(booking_value,300" in plan
    read = [l for l in plan.splitlines() if "ReadSchema" in l][0]
    assert "customer_id" not in read and "ride_timestamp" not in read
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_clustered_layout_prunes_status_partitions(spark, sf):
    path = LO.write_clustered(X.ride_gold(spark, sf), work_path(spark, "plan-clustered"))
    plan = LO.explain_text(R.segment_report(LO.read_clustered(spark, path)))
    assert "PartitionFilters: [isnotnull(booking_status" in plan and "Completed" in plan
    gold = stored_gold(spark, sf)
    rep = LO.measured_scans({"plain": gold, "clustered": LO.read_clustered(spark, path)})
    # Measured by the scan: less than the rows of the status partition alone.
    completed = gold.where(F.col("booking_status") == "Completed").count()
    assert rep["clustered"]["rows_read"] < completed <= rep["plain"]["rows_total"]
    assert rep["clustered"]["rows_aggregated"] == rep["plain"]["rows_aggregated"] > 0


def test_page_is_a_top_k_not_a_sort(spark, sf):
    plan = LO.explain_text(L.rides_page(stored_gold(spark, sf), status="Completed", page=2))
    assert "TakeOrderedAndProject" in plan


def test_id_list_is_broadcast_to_the_semi_join(spark, sf):
    g = stored_gold(spark, sf)
    ids = g.where(F.col("booking_value") > 400).select("booking_id")
    plan = LO.explain_text(L.id_semi_join(g, ids))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_dashboard_summary_is_one_scan(spark, sf):
    plan = LO.explain_text(D.dashboard_summary(stored_gold(spark, sf)))
    scans = [l for l in plan.splitlines() if l.startswith("(") and "Scan parquet" in l]
    assert len(scans) == 1 and "Expand" in plan


def test_gold_dedup_is_a_partial_aggregate(spark, sf):
    plan = LO.explain_text(X.ride_gold(spark, sf))
    assert "partial_min" in plan and "Window" not in plan


def test_keyset_pages_equal_offset_pages(spark, sf):
    g = stored_gold(spark, sf)
    cols = ["booking_id", "ride_timestamp"]
    p1 = L.rides_page(g, status="Completed", page=1, size=7).select(*cols).collect()
    p2 = L.rides_page(g, status="Completed", page=2, size=7).select(*cols).collect()
    last = p1[-1]
    k2 = L.rides_after(g, last["ride_timestamp"], last["booking_id"], size=7,
                       status="Completed").select(*cols).collect()
    assert [tuple(r) for r in k2] == [tuple(r) for r in p2]
    plan = LO.explain_text(L.rides_after(g, last["ride_timestamp"], last["booking_id"], size=7))
    assert "TakeOrderedAndProject" in plan


def test_label_lookup_matches_the_join(spark, sf):
    from farebox.functions import labels as LB
    g = X.ride_gold(spark, sf)
    joined = LB.label_rides(g).select("booking_id", "vehicle_label")
    inline = g.select("booking_id", LB.label_expr("vehicle", F.col("vehicle_type")).alias("vehicle_label"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, inline.collect()))


def test_bucketed_gold_joins_shuffle_only_the_change_side(spark, sf):
    from farebox.operators import changes as CH
    plain = stored_gold(spark, sf)
    table = LO.write_bucketed(plain, "gold_bucketed_test", work_path(spark, "gold-bucketed"), buckets=8)
    bg = spark.table(table)
    ups = plain.where(F.col("vehicle_type") == "Bike").select(
        "booking_id", F.lit("Cancelled by Driver").alias("booking_status"),
        F.lit("Other Issue").alias("unified_cancellation_reason"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # take the shuffled path
    try:
        out = CH.update_status(bg, ups, small=False)
        plan = LO.explain_text(out)
        assert out.where(F.col("booking_status") == "Cancelled by Driver").count() >= ups.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [l for l in plan.splitlines() if l.startswith("(") and "Exchange" in l]
    assert "SortMergeJoin" in plan and len(exchanges) == 1   # only the change side moves


def test_incremental_gold_probes_gold_without_shuffling_it(spark, sf):
    from farebox.operators import medallion as M
    g = stored_gold(spark, sf)
    silver = X.ride_silver(spark, sf).where(F.col("_batch_id") == "batch-2")
    plan = LO.explain_text(M.to_gold(silver, g, "batch-2"))
    gold_scans = [b for b in plan.split("\n\n") if "Scan parquet" in b and "_batch_id" in b
                  and "Not(EqualTo(_batch_id,batch-2))" in b]
    assert gold_scans                                      # other batches only, pushed down
    assert "ReadSchema: struct<booking_id:string,_batch_id:string>" in plan
    assert plan.count("BroadcastHashJoin") >= 2 and "LeftSemi" in plan and "LeftAnti" in plan


def test_api_names_page(spark, sf):
    from farebox.functions import columns as C
    page = L.rides_page(stored_gold(spark, sf), vehicle="Bike", page=1, size=5, api_names=True)
    assert page.columns == list(C.GOLD_API_NAMES.values()) + ["total_count"]
    assert page.count() == 5


def test_no_registered_query_plans_a_cross_join(spark, sf):
    from farebox import catalog
    bad = [name for name, fn in catalog.QUERIES.items()
           if any(k in LO.explain_text(fn(spark, sf), "simple")
                  for k in ("CartesianProduct", "BroadcastNestedLoopJoin"))]
    assert bad == []


def test_no_rows_are_gathered_in_one_task_before_a_limit(spark, sf):
    """No size check or change set sends rows through a single task."""
    from farebox import catalog
    names = ["id_semi_join", "matched_keys", "update_status", "delete_rides", "apply_changes",
             "snapshot_diff", "insert_if_absent", "to_gold"]
    for name in names:
        plan = LO.explain_text(catalog.QUERIES[name](spark, sf), "simple")
        assert "SinglePartition" not in plan, name
