"""The medallion run (G1-G4): CSV -> bronze -> silver -> gold as three Spark
jobs, each recorded as step events, resumable at the failed step.

Each step replaces only its batch's partition (dynamic overwrite), so a rerun
or a resume is idempotent and a failed job leaves the old rows in place.
"""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import filters as FL
from farebox.operators import changes as CH
from farebox.operators import key_filters as KF
from farebox.operators import medallion as M
from farebox.sources import compaction as CO
from farebox.sources import csv as CSV
from farebox.sources import layers as LY

log = logging.getLogger(__name__)


def rating_guarded(df: DataFrame) -> DataFrame:
    """F9 inside the write: a rating outside [0, 5] fails the job (so the
    commit never happens and the old batch stays)."""
    out = df
    for c in FL.RATING_COLUMNS:
        out = out.withColumn(c, F.when(~FL.rating_ok(c), F.raise_error(
            F.concat(F.lit(f"check constraint violated: {c} = "), F.col(c).cast("string"))))
            .otherwise(F.col(c)))
    return out


@dataclass
class Pipeline:
    spark: SparkSession
    root: str
    # Called with the batch id after its gold step succeeded (e.g. to refresh
    # the dashboard's per-batch contributions); its failure is logged only.
    after_gold: Callable[[str], None] | None = None
    # Keep key filters beside gold, so that a batch reads only the keys of the
    # batches that may hold one of its own.
    key_filters: bool = False

    @property
    def bronze_path(self) -> str:
        return f"{self.root}/bronze"

    @property
    def silver_path(self) -> str:
        return f"{self.root}/silver"

    @property
    def gold_path(self) -> str:
        return f"{self.root}/gold"

    @property
    def filters_path(self) -> str:
        return f"{self.root}/gold_key_filters"

    @property
    def events_path(self) -> str:
        return f"{self.root}/step_events"

    # -- status events --------------------------------------------------------

    def record(self, batch_id: str, step: str, status: str, rows: int | None = None,
               error: str | None = None, then: str | None = None) -> None:
        """M5: a step event, stamped with the driver's UTC clock as the source
        stamps its status rows, and with ``then`` the start of the next step in
        the same write: two metadata rows at most."""
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        seq = time.time_ns()
        events = [(seq, batch_id, step, status, now, rows, error)]
        if then is not None:
            events.append((seq + 1, batch_id, then, "Processing", now, None, None))
        ev = self.spark.createDataFrame(events, sch.STEP_EVENT_SCHEMA).coalesce(1)
        LY.append_rows(ev, self.events_path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(sch.STEP_EVENT_SCHEMA).parquet(self.events_path)

    def status(self) -> DataFrame:
        return CH.step_status(self.events())

    def compact_events(self, max_files: int = CO.MAX_SMALL_FILES) -> int:
        """M5: the small event files as one, once there are more than
        ``max_files``. The status view takes first times and latest events, so
        a repeated event leaves it the same. A failure is logged only: the next
        run tries again."""
        try:
            return CO.compact(self.spark, self.events_path, sch.STEP_EVENT_SCHEMA, max_files)
        except Exception:  # noqa: BLE001 - the batch itself succeeded
            log.exception("step events not compacted")
            return 0

    # -- steps ------------------------------------------------------------------

    def to_bronze(self, batch_id: str, csv_path: str | None = None,
                  raw: DataFrame | None = None) -> int:
        """G1: CSV (a path, or rows already read) -> typed bronze rows."""
        raw = raw if raw is not None else CSV.csv_scan(self.spark, csv_path, with_file=True)
        return LY.batch_replace(M.to_bronze(raw, batch_id), self.bronze_path, batch_id)

    def to_silver(self, batch_id: str) -> int:
        """Bronze batch -> silver batch."""
        b = LY.layer_scan(self.spark, self.bronze_path, batch_id)
        return LY.batch_replace(M.to_silver(b), self.silver_path, batch_id)

    def to_gold(self, batch_id: str) -> int:
        """Silver batch -> gold, first row wins within the batch and
        against gold rows of other batches."""
        s = LY.layer_scan(self.spark, self.silver_path, batch_id)
        gold = (LY.layer_scan(self.spark, self.gold_path)
                if LY.path_exists(self.spark, self.gold_path) else None)
        if not self.key_filters:
            return LY.batch_replace(rating_guarded(M.to_gold(s, gold, batch_id)), self.gold_path, batch_id)
        g = rating_guarded(KF.to_gold(s, gold, LY.batch_names(self.spark, self.gold_path),
                                     KF.read_filters(self.spark, self.filters_path), batch_id))
        # without filters the batch is always read, also if the run ends in between
        KF.drop_filters(self.spark, self.filters_path, batch_id)
        rows = LY.batch_replace(g, self.gold_path, batch_id)
        if rows:
            KF.store_filters(LY.layer_scan(self.spark, self.gold_path, batch_id), self.filters_path, batch_id)
        return rows

    STEPS = ("Bronze", "Silver", "Gold")

    def run(self, batch_id: str, csv_path: str | None = None, start: str = "Bronze",
            raw: DataFrame | None = None) -> bool:
        """The steps from ``start`` on, each only after the previous one
        succeeded; every failure is recorded and stops the run."""
        steps = self.STEPS[self.STEPS.index(start):]
        self.record(batch_id, start, "Processing")
        for step, then in zip(steps, (*steps[1:], None)):
            try:
                if step == "Bronze":
                    rows = self.to_bronze(batch_id, csv_path, raw)
                elif step == "Silver":
                    rows = self.to_silver(batch_id)
                else:
                    rows = self.to_gold(batch_id)
            except Exception as e:  # noqa: BLE001 - any failure fails the step
                self.record(batch_id, step, "Failed", 0, str(e))
                return False
            self.record(batch_id, step, "Success", rows, then=then)
        self.compact_events()
        if self.after_gold is not None:
            try:
                self.after_gold(batch_id)
            except Exception:  # noqa: BLE001 - the batch itself succeeded
                log.exception("after-gold hook failed for batch %s", batch_id)
        return True

    def run_folder(self, folder: str, batches: list[str]) -> dict[str, bool]:
        """G4 over several uploads: each batch folder under ``folder`` in name
        order (the load order first-row-wins depends on); a failed batch is
        recorded and the next one still runs. Returns success per batch."""
        return {b: self.run(b, f"{folder.rstrip('/')}/{b}") for b in sorted(batches)}

    def resume(self, batch_id: str) -> bool:
        """M6: rerun a batch whose latest status is Failed at Silver or Gold;
        any other known batch is left as is (False); an unknown one raises."""
        st = self.status().where(F.col("batch_id") == batch_id)
        todo = CH.resumable_runs(st).first()
        if todo is None:
            if st.isEmpty():
                raise LookupError(f"pipeline not found: {batch_id}")
            return False
        return self.run(batch_id, start=todo["resume_step"])

    def gold(self) -> DataFrame:
        return LY.layer_scan(self.spark, self.gold_path)
