"""Row changes as bulk change sets, pipeline status events and snapshot diffs.

Changes are applied to gold in one job: the change set (reduced to one row per
key) is broadcast when its measured size is small, so the large gold side is
rewritten in place without a shuffle; otherwise both sides are shuffled on the
key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import columns as C
from farebox.operators.medallion import QualityError, check_ratings
from farebox.session import broadcast_if_small, cut_lineage, fits_broadcast


def _maybe_broadcast(df: DataFrame, small: bool | None = None) -> DataFrame:
    """Broadcast ``df`` when it is known (``small``) or measured to be small."""
    if small is None:
        return broadcast_if_small(df)
    return F.broadcast(df) if small else df


# --- single-kind changes --------------------------------------------------

# Redraws of random keys before giving up: each redraw leaves a clash with
# a chance of about (rows / 2^40), so a second one is already rare.
KEY_REDRAWS = 20


def clashing_keys(rows: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Keys that ``rows`` holds more than once or that ``gold`` already has."""
    twice = rows.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > 1).select("booking_id")
    if gold is None:
        return twice
    taken = gold.select("booking_id").join(
        broadcast_if_small(rows.select("booking_id").distinct()), "booking_id", "left_semi")
    return twice.unionByName(taken).distinct()


def add_rides(new: DataFrame, key_seed: str | None = None, now: Column | None = None,
              check: bool = True, gold: DataFrame | None = None) -> DataFrame:
    """M1: gold rows for new rides: generated key, status Completed, reason
    Not Cancelled, time defaults to now, revenue per km by P11, no batch.

    ``key_seed`` names a column hashed into the key (repeatable); without it
    keys are random. Keys are unique among the new rows and against ``gold``
    (where given): random keys that clash are drawn again, seeded ones, which
    cannot change, raise QualityError. ``check=False`` skips ratings and keys.
    """
    now = now if now is not None else F.localtimestamp()
    seed = F.col(key_seed) if key_seed else None
    out = new.select(
        C.generate_key(seed).alias("booking_id"),
        F.lit(None).cast("string").alias("_batch_id"),
        F.coalesce(F.col("ride_timestamp").cast("timestamp_ntz"), now.cast("timestamp_ntz"))
         .alias("ride_timestamp"),
        F.lit(sch.STATUS_COMPLETED).alias("booking_status"),
        F.col("customer_id"), F.col("vehicle_type"),
        F.lit(sch.NOT_CANCELLED).alias("unified_cancellation_reason"),
        F.col("booking_value").cast("double").alias("booking_value"),
        F.col("ride_distance").cast("double").alias("ride_distance"),
        C.safe_ratio(F.col("booking_value").cast("double"), F.col("ride_distance").cast("double"))
         .alias("revenue_per_km"),
        F.col("driver_ratings").cast("double").alias("driver_ratings"),
        F.col("customer_rating").cast("double").alias("customer_rating"),
        F.col("payment_method").cast("string").alias("payment_method"))
    if not check:
        return out
    check_ratings(out)
    # Random keys must not change between the check and the use.
    if seed is None:
        out = cut_lineage(out)
    for _ in range(KEY_REDRAWS):
        clash = clashing_keys(out, gold)
        if clash.isEmpty():
            return out
        if seed is not None:
            break
        marked = out.join(clash.withColumn("_clash", F.lit(True)), "booking_id", "left")
        out = cut_lineage(marked.withColumn(
            "booking_id", F.when(F.col("_clash"), C.generate_key()).otherwise(F.col("booking_id")))
            .select(*out.columns))
    raise QualityError("duplicate key value violates unique constraint on booking_id")


def update_status(gold: DataFrame, updates: DataFrame, small: bool | None = None) -> DataFrame:
    """M2: set status and reason (reason may become NULL) of matching keys;
    nothing else is recomputed. ``updates``: (booking_id, booking_status,
    unified_cancellation_reason), one row per key."""
    u = updates.select("booking_id", F.col("booking_status").alias("_new_status"),
                       F.col("unified_cancellation_reason").alias("_new_reason"),
                       F.lit(True).alias("_hit"))
    j = gold.join(_maybe_broadcast(u, small), "booking_id", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(*[
        F.when(hit, F.col("_new_status")).otherwise(F.col(c)).alias(c) if c == "booking_status"
        else F.when(hit, F.col("_new_reason")).otherwise(F.col(c)).alias(c)
        if c == "unified_cancellation_reason" else F.col(c)
        for c in gold.columns])


def matched_keys(gold: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether each change key matched a gold row: (booking_id, matched)."""
    k = keys.select("booking_id").distinct()
    hits = gold.select("booking_id").join(_maybe_broadcast(k), "booking_id", "left_semi") \
        .distinct().withColumn("matched", F.lit(True))
    return k.join(hits, "booking_id", "left").select(
        "booking_id", F.coalesce(F.col("matched"), F.lit(False)).alias("matched"))


def delete_rides(gold: DataFrame, keys: DataFrame, small: bool | None = None) -> DataFrame:
    """M3: drop rows whose key is listed."""
    return gold.join(_maybe_broadcast(keys.select("booking_id"), small), "booking_id", "left_anti")


# --- mixed change set -------------------------------------------------------

CHANGE_FIELD_TYPES = {
    "booking_status": "string", "unified_cancellation_reason": "string",
    "ride_timestamp": "timestamp_ntz", "customer_id": "string", "vehicle_type": "string",
    "booking_value": "double", "ride_distance": "double", "driver_ratings": "double",
    "customer_rating": "double", "payment_method": "string"}
CHANGE_FIELDS = list(CHANGE_FIELD_TYPES)


def net_changes(changes: DataFrame) -> DataFrame:
    """What a key's changes amount to in sequence order, one row per key:

    * ``_d``: whether any delete occurs;
    * ``_i``: the first insert after the last delete (any insert without one;
      later inserts find the key taken and are skipped);
    * ``_u``: the last update. It applies to a row made by ``_i`` only when it
      comes after it.

    Equal ``seq`` of one key run as delete, insert, update; a NULL ``seq`` comes
    first. Plain aggregates with map-side combine, so a hot key stays cheap; the
    join that brings a key's last delete to its rows is split by AQE if skewed.
    """
    fields = [F.col(c).cast(t).alias(c) if c in changes.columns else F.lit(None).cast(t).alias(c)
              for c, t in CHANGE_FIELD_TYPES.items()]
    c = changes.where(F.col("op").isin("insert", "update", "delete")).select(
        "booking_id", "op",
        F.coalesce(F.col("seq").cast("long"), F.lit(-2**63).cast("long")).alias("seq"), *fields)
    last_delete = c.where(F.col("op") == "delete").groupBy("booking_id").agg(
        F.max("seq").alias("_last"))
    c = c.join(_maybe_broadcast(last_delete), "booking_id", "left")
    open_insert = (F.col("op") == "insert") & (F.col("_last").isNull()
                                               | (F.col("seq") >= F.col("_last")))
    inserted = [F.col(f) for f in CHANGE_FIELDS if f not in ("booking_status",
                                                             "unified_cancellation_reason")]
    return c.groupBy("booking_id").agg(
        F.max(F.col("_last").isNotNull()).alias("_d"),
        F.min(F.when(open_insert, F.struct(F.col("seq"), *inserted))).alias("_i"),
        F.max(F.when(F.col("op") == "update", F.struct(
            "seq", "booking_status", "unified_cancellation_reason"))).alias("_u"))


def apply_changes(gold: DataFrame, changes: DataFrame) -> DataFrame:
    """M4: insert / update / delete rows in sequence order. Inserts take the
    M1 defaults but keep the change's key; an insert under a key that exists at
    that point is skipped, an update or delete of a missing key does nothing."""
    small = fits_broadcast(changes)
    net = net_changes(changes)
    # Deletes and updates of existing rows in one left join over gold.
    mods = net.select("booking_id", F.col("_d").alias("_gone"), F.col("_u").alias("_new"))
    j = gold.join(_maybe_broadcast(mods, small), "booking_id", "left") \
        .where(~F.coalesce(F.col("_gone"), F.lit(False)))
    hit = F.col("_new").isNotNull()
    changed = ("booking_status", "unified_cancellation_reason")
    kept = j.select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
                      if c in changed else F.col(c) for c in gold.columns])
    ins = net.where(F.col("_i").isNotNull())
    later = F.col("_u").isNotNull() & (F.col("_u.seq") >= F.col("_i.seq"))
    i = {c: F.col(f"_i.{c}") for c in CHANGE_FIELDS if c not in changed}
    new = ins.select(
        "booking_id", F.col("_d").alias("_gone"), F.lit(None).cast("string").alias("_batch_id"),
        i["ride_timestamp"].alias("ride_timestamp"),
        F.when(later, F.col("_u.booking_status")).otherwise(F.lit(sch.STATUS_COMPLETED))
         .alias("booking_status"),
        i["customer_id"].alias("customer_id"), i["vehicle_type"].alias("vehicle_type"),
        F.when(later, F.col("_u.unified_cancellation_reason")).otherwise(F.lit(sch.NOT_CANCELLED))
         .alias("unified_cancellation_reason"),
        i["booking_value"].alias("booking_value"), i["ride_distance"].alias("ride_distance"),
        C.safe_ratio(i["booking_value"], i["ride_distance"]).alias("revenue_per_km"),
        i["driver_ratings"].alias("driver_ratings"), i["customer_rating"].alias("customer_rating"),
        i["payment_method"].alias("payment_method"))
    # Without a delete before it, an insert under a key in gold is skipped.
    taken = gold.select("booking_id").join(_maybe_broadcast(
        ins.where(~F.col("_d")).select("booking_id"), small), "booking_id", "left_semi")
    new = new.join(_maybe_broadcast(taken, small), "booking_id", "left_anti")
    return kept.unionByName(new.select(*gold.columns))


# --- pipeline status ----------------------------------------------------------

def _latest(cond: Column | None, *fields: str) -> Column:
    order = [F.col("event_time"), F.col("seq")]
    s = F.struct(*order, *[F.col(f) for f in fields])
    return F.max(F.when(cond, s) if cond is not None else s)


END_STATES = ("Success", "Failed")


def step_status(events: DataFrame) -> DataFrame:
    """M5: one status row per batch from its step events: start time never
    changes, step / status / error are the latest event's, rows and end time
    the latest finished (Success or Failed) event's."""
    done = F.col("status").isin(*END_STATES)
    g = events.groupBy("batch_id").agg(
        F.min("event_time").alias("start_time"),
        _latest(None, "step", "status", "error").alias("_l"),
        _latest(done, "rows").alias("_d"))
    return g.select("batch_id", F.col("_l.step").alias("step"), F.col("_l.status").alias("status"),
                    "start_time", F.col("_d.event_time").alias("end_time"),
                    F.col("_d.rows").alias("rows_imported"),
                    F.col("_l.error").alias("error_message"))


def latest_status(events: DataFrame) -> DataFrame:
    """The latest (step, status) of every batch, all batches at once."""
    g = events.groupBy("batch_id").agg(_latest(None, "step", "status").alias("_l"))
    return g.select("batch_id", F.col("_l.step").alias("step"), F.col("_l.status").alias("status"))


def resumable_runs(status_view: DataFrame) -> DataFrame:
    """M6: batches to rerun and the step to run: latest status Failed at
    Silver or Gold (Bronze cannot resume: its file is gone)."""
    return status_view.where(C.can_resume("status", "step")).select(
        "batch_id", F.col("step").alias("resume_step"))


def with_run_flags(status_view: DataFrame, now: Column | None = None) -> DataFrame:
    """P19 + P20 on the status view: duration text and can_resume."""
    return status_view.withColumn("duration", C.duration_text("start_time", "end_time", now)) \
        .withColumn("can_resume", C.can_resume("status", "step"))


# --- snapshot diff --------------------------------------------------------------

def snapshot_diff(before: DataFrame, after: DataFrame, key: str | list[str]) -> DataFrame:
    """T4: rows inserted, deleted or changed between two snapshots.

    A full outer join on the key; a row is changed when any column differs
    under null-safe equality. Result: key columns + ``change``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*cols).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.struct(*cols).alias("_a"), F.lit(True).alias("_in_a"))
    j = b.join(a, keys, "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}"))
    change = (F.when(F.col("_in_b").isNull(), "inserted")
              .when(F.col("_in_a").isNull(), "deleted")
              .when(~same, "changed"))
    return j.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


__all__ = ["QualityError"]
