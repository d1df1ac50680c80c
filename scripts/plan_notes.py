"""Print the key physical-plan lines of the headline queries (sf0.1 by
default): scans with pushed/partition filters, exchanges, joins, aggregates.

    python scripts/plan_notes.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from farebox.operators import changes as CH  # noqa: E402
from farebox.operators import dashboard as D  # noqa: E402
from farebox.operators import lookup as L  # noqa: E402
from farebox.operators import medallion as M  # noqa: E402
from farebox.operators import profile as P  # noqa: E402
from farebox.operators import report as R  # noqa: E402
from farebox.operators import vectors as V  # noqa: E402
from farebox.plans import layout as LO  # noqa: E402
from farebox.session import build_session, work_path  # noqa: E402
from farebox.sources import fixtures as X  # noqa: E402

KEEP = re.compile(r"^\(\d+\) (Scan|Exchange|BroadcastExchange|HashAggregate|SortAggregate|ObjectHashAggregate|"
                  r"BroadcastHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|Window|TakeOrderedAndProject|"
                  r"Expand|MapInPandas|Generate|Sort )|PushedFilters|PartitionFilters|ReadSchema|"
                  r"Functions \[|Keys \[|Partitioning|Join type")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    path = work_path(spark, "plans-gold")
    X.ride_gold(spark, sf).write.parquet(path)
    gold = spark.read.parquet(path)
    clustered = spark.read.parquet(LO.write_clustered(gold, work_path(spark, "plans-clustered")))
    silver = X.ride_silver(spark, sf)
    changes = X.change_set(spark, sf)
    cases = {
        "segment_report (plain)": R.segment_report(gold),
        "segment_report (clustered)": R.segment_report(clustered),
        "dashboard_summary": D.dashboard_summary(gold),
        "rides_page": L.rides_page(gold, status="Completed", page=3),
        "gold dedup (all batches)": M.gold_from_silver(silver),
        "to_gold (one batch vs gold)": M.to_gold(silver.where(F.col("_batch_id") == "batch-2"), gold, "batch-2"),
        "apply_changes": CH.apply_changes(gold, changes),
        "step_status": CH.step_status(X.step_events(spark, sf)),
        "numeric_describe (exact)": P.numeric_describe(gold),
        "cosine_topk": V.cosine_topk(X.embedding_index(spark, sf), X.embedding_queries(spark, sf)),
    }
    for name, df in cases.items():
        print(f"### {name}")
        for line in LO.explain_text(df).splitlines():
            if KEEP.search(line):
                print("   ", line[:200])
        print()


if __name__ == "__main__":
    main()
