"""Benchmark: headline queries over stored gold at $BENCH_SF_DIR.

Gold is built once from ``events`` (bronze -> silver -> gold) and written
as Parquet twice: plain, and in the clustered layout (L1). The queries then
read those tables, as a deployment reads its gold layer. Each query runs
once to warm up, then is timed fully materialised (``noop`` sink); the
median of $BENCH_REPEATS (3) runs is reported.

Prints one JSON line: {"metric", "value", "unit", "queries", "build", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from farebox.operators import adhoc as Q  # noqa: E402
from farebox.operators import changes as CH  # noqa: E402
from farebox.operators import dashboard as D  # noqa: E402
from farebox.operators import lookup as L  # noqa: E402
from farebox.operators import medallion as M  # noqa: E402
from farebox.operators import pipeline as PL  # noqa: E402
from farebox.operators import profile as P  # noqa: E402
from farebox.operators import report as R  # noqa: E402
from farebox.operators import vectors as V  # noqa: E402
from farebox.plans import layout as LO  # noqa: E402
from farebox.session import build_session, tune_for_input  # noqa: E402
from farebox.sources import fixtures as X  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")}
    if os.environ.get("BENCH_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = os.environ["BENCH_CHECKPOINT_DIR"]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="farebox-bench",
                          extra=extra)
    input_bytes = sum(os.path.getsize(os.path.join(sf_dir, f)) for f in os.listdir(sf_dir)
                      if f.endswith(".parquet"))
    tune_for_input(spark, input_bytes)
    base = spark.sparkContext.getCheckpointDir()  # the shared folder (set when unset)
    root = f"{base.rstrip('/')}/bench-{int(time.time() * 1000)}"

    # Session start-up (JVM, first job) is not part of any figure below.
    X.ride_bronze(spark, sf_dir).write.format("noop").mode("overwrite").save()

    build: dict[str, float] = {}
    t = time.perf_counter()
    X.ride_gold(spark, sf_dir).write.mode("overwrite").parquet(f"{root}/gold")
    build["build_gold"] = time.perf_counter() - t
    gold = spark.read.parquet(f"{root}/gold")
    t = time.perf_counter()
    LO.write_clustered(gold, f"{root}/gold_clustered")
    build["build_clustered"] = time.perf_counter() - t
    clustered = spark.read.parquet(f"{root}/gold_clustered")
    # Ingestion as the source runs it: each batch's CSV through bronze,
    # silver and gold with batch replacement and step events.
    folder, batches = X.ride_csv_folder(spark, sf_dir, f"{root}/drop")
    pipe = PL.Pipeline(spark, f"{root}/layers")
    t = time.perf_counter()
    if not all(pipe.run_folder(folder, batches).values()):
        raise RuntimeError("a batch failed")
    build["pipeline_csv_to_gold"] = time.perf_counter() - t
    # Skew: the same dedup with a third of all rows under one key.
    silver = X.ride_silver(spark, sf_dir)
    hot = silver.withColumn("booking_id", F.when(F.col("_id") % 3 == 0, F.lit("HOT"))
                            .otherwise(F.col("booking_id")))
    for name, src in (("dedup", silver), ("dedup_hot_key_third", hot)):
        M.gold_from_silver(src).write.format("noop").mode("overwrite").save()   # warm
        t = time.perf_counter()
        M.gold_from_silver(src).write.format("noop").mode("overwrite").save()
        build[name] = time.perf_counter() - t

    conversations = X.table(spark, sf_dir, "conversations")
    statements = spark.sql(X.STATEMENT_LOG_SQL, conversations=conversations, gold=gold)
    events = X.step_events(spark, sf_dir)
    emb_index = X.embedding_index(spark, sf_dir)
    emb_queries = X.embedding_queries(spark, sf_dir)
    digits = X.key_digits()
    changes = (gold.where(digits % 101 == 0).select(digits.alias("seq"), F.lit("delete").alias("op"),
                                                   "booking_id")
               .unionByName(gold.where(digits % 97 == 0).select(
                   digits.alias("seq"), F.lit("update").alias("op"), "booking_id",
                   F.lit("Cancelled by Driver").alias("booking_status"),
                   F.lit("Other Issue").alias("unified_cancellation_reason")), allowMissingColumns=True))

    queries = {
        "segment_report": lambda: R.segment_report(gold),
        "segment_report_clustered": lambda: R.segment_report(clustered),
        "kpi_summary": lambda: D.kpi_summary(gold),
        "dashboard_summary": lambda: D.dashboard_summary(gold),
        "cancellation_counts": lambda: D.share_of_total(D.cancellation_counts(gold)),
        "vehicle_performance": lambda: D.vehicle_performance(gold),
        "hourly_traffic": lambda: D.traffic_stats(D.hourly_traffic(gold)),
        "rides_page": lambda: L.rides_page(gold, status="Completed", page=3, size=20),
        "top_n": lambda: L.top_n(gold, "booking_value", 5),
        "value_distribution": lambda: P.value_distribution(gold),
        "numeric_describe": lambda: P.numeric_describe(gold, ["booking_value", "ride_distance",
                                                              "driver_ratings", "customer_rating"]),
        "histogram": lambda: P.histogram(gold, "booking_value", 40),
        "guard_sql": lambda: Q.guard_sql(statements),
        "step_status": lambda: CH.step_status(events),
        "apply_changes": lambda: CH.apply_changes(gold, changes),
        "cosine_topk": lambda: V.cosine_topk(emb_index, emb_queries, 5),
    }

    def run(make) -> float:
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for make in queries.values():   # warm-up
        run(make)
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    # Median of the timed runs per query (one run is noisy at this size).
    timings = {name: round(sorted(run(make) for _ in range(repeats))[repeats // 2], 4)
               for name, make in queries.items()}
    # Rows the segment report's scans read on both layouts, from scan metrics
    # (the figures the source's captured plans give).
    layouts = LO.measured_scans({"plain": gold, "clustered": clustered})
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "build": {k: round(v, 4) for k, v in build.items()},
        "segment_report_layouts": layouts,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
