"""Bronze -> silver -> gold steps of the ride pipeline.

Each layer is one projection (a single whole-stage-codegen span over the
scan). The shuffles are the first-row-wins key dedup of gold, done as a
partial+final aggregate so a hot key is pre-reduced on the map side, and, for
bronze's exact load order, a one-row-per-split aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.functions import columns as C
from farebox.functions import filters as FL
from farebox.session import broadcast_if_small, cut_lineage, fits_broadcast


class QualityError(RuntimeError):
    """A batch broke a rule that fails the whole batch (source CHECK)."""


# --- bronze -------------------------------------------------------------

def parse_text_columns() -> list[Column]:
    """P1-P4 over the 17 CSV text columns -> typed bronze columns."""
    out = [C.parse_date("ride_date").alias("ride_date")]
    for c in sch.CSV_COLUMNS[1:]:
        if c in sch.FLAG_COLUMNS:
            out.append(C.parse_flag(c).alias(c))
        elif c in sch.NUMBER_COLUMNS:
            out.append(C.parse_number(c).alias(c))
        else:
            out.append(F.col(c))
    return out


# Bits for the position inside one file (16 TiB), below the file's rank.
FILE_POSITION_BITS = 44


def with_load_order(raw: DataFrame) -> DataFrame:
    """Adds ``_id``: each row's place in load order (files by path, then
    position in the file), from the ``_file`` / ``_block`` columns of the scan.

    Spark packs file splits into partitions by size, so partition order is not
    file order. The position is the split's start byte plus the row's index
    within its split: strictly increasing through a file, since a row takes at
    least one byte. Split starts and file ranks are one row per split / file,
    broadcast when small. Deterministic under task retries. A scan that put
    records together gives each one's line in its split as ``_row``.
    """
    from farebox.operators.profile import global_row_number
    if "_row" in raw.columns:
        files = cut_lineage(raw.select("_file").distinct())
        ranks = broadcast_if_small(global_row_number(files, [F.asc("_file")], "_rank"))
        order = F.shiftleft(F.col("_rank").cast("long"), FILE_POSITION_BITS) + F.col("_block") + F.col("_row")
        return raw.join(ranks, "_file").withColumn("_id", order).drop("_row", "_rank")
    d = raw.withColumn("_mono", F.monotonically_increasing_id())
    # One row per split, computed once (one pass over the batch) and kept in
    # the shared checkpoint folder; the size check and the join reuse it.
    splits = cut_lineage(d.groupBy("_file", "_block").agg(F.min("_mono").alias("_first")))
    files = splits.select("_file").distinct()
    # Rank the distinct paths by a distributed row number (range partitions).
    ranks = global_row_number(files, [F.asc("_file")], "_rank")
    splits, ranks = broadcast_if_small(splits), broadcast_if_small(ranks)
    pos = F.col("_block") + (F.col("_mono") - F.col("_first"))
    order = F.shiftleft(F.col("_rank").cast("long"), FILE_POSITION_BITS) + pos
    # Left joins plus a guard: a row whose split was not seen by the first
    # read (input changed in between) fails the job instead of vanishing.
    order = F.when(F.col("_first").isNull() | F.col("_rank").isNull(),
                   F.raise_error(F.lit("input files changed while loading the batch"))
                   .cast("long")).otherwise(order)
    return (d.join(splits, ["_file", "_block"], "left").join(ranks, "_file", "left")
            .withColumn("_id", order).drop("_mono", "_first", "_rank"))


def to_bronze(raw: DataFrame, batch_id: str | Column, load_order: Column | None = None,
              ingested_at: Column | None = None) -> DataFrame:
    """G1: typed bronze rows of one batch of CSV text.

    ``_id`` fixes the load order for first-row-wins: with the scan's ``_file``
    and ``_block`` columns it is the exact file order (``with_load_order``);
    otherwise the row's position in the scan (one file per batch).
    """
    if load_order is None:
        if "_file" in raw.columns and "_block" in raw.columns:
            raw = with_load_order(raw)
            load_order = F.col("_id")
        else:
            load_order = F.monotonically_increasing_id()
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    ts = ingested_at if ingested_at is not None else F.localtimestamp()
    return raw.select(load_order.cast("long").alias("_id"), bid.alias("_batch_id"),
                      ts.cast("timestamp_ntz").alias("_ingested_at"),
                      *parse_text_columns())


# --- silver -------------------------------------------------------------

def silver_columns(clean_first: bool = False) -> list[Column]:
    """The silver projection. The source picks the reason by the *untrimmed*
    status, so a padded 'Cancelled ...' row keeps 'Not Cancelled';
    ``clean_first`` picks it by the trimmed status instead."""
    status = F.trim(F.col("booking_status")) if clean_first else F.col("booking_status")
    return [
        F.col("_id"), F.col("_batch_id"),
        C.combine_timestamp("ride_date", "ride_time").alias("ride_timestamp"),
        C.trim_spaces("booking_id").alias("booking_id"),
        C.trim_spaces("booking_status").alias("booking_status"),
        C.trim_spaces("customer_id").alias("customer_id"),
        C.trim_spaces("vehicle_type").alias("vehicle_type"),
        C.unify_reason(status, "reason_customer", "driver_reason",
                       "incomplete_reason").alias("unified_cancellation_reason"),
        C.fill_zero("booking_value").alias("booking_value"),
        C.fill_zero("ride_distance").alias("ride_distance"),
        F.col("driver_ratings"), F.col("customer_rating"),
        C.default_payment("payment_method").alias("payment_method"),
    ]


def to_silver(bronze: DataFrame, clean_first: bool = False) -> DataFrame:
    """F3 key filter + P5-P9 cleaning, one projection."""
    return bronze.where(FL.valid_key("booking_id")).select(*silver_columns(clean_first))


# --- gold ---------------------------------------------------------------

def gold_columns() -> list[Column]:
    return [
        C.strip_quotes("booking_id").alias("booking_id"),
        F.col("_batch_id"), F.col("ride_timestamp"),
        C.strip_quotes("booking_status").alias("booking_status"),
        C.strip_quotes("customer_id").alias("customer_id"),
        C.strip_quotes("vehicle_type").alias("vehicle_type"),
        F.col("unified_cancellation_reason"),
        F.col("booking_value"), F.col("ride_distance"),
        C.safe_ratio("booking_value", "ride_distance").alias("revenue_per_km"),
        F.col("driver_ratings"), F.col("customer_rating"),
        C.strip_quotes("payment_method").alias("payment_method"),
    ]


def first_wins(df: DataFrame, key: str | list[str], order: list[str],
               keep: list[str] | None = None) -> DataFrame:
    """One row per key, the one first in ``order``.

    A ``min`` over a struct led by the order columns is an ordinary aggregate,
    so each map task keeps one row per key before the shuffle: a key holding a
    third of all rows sends one row per task, not a third of the table to one
    window partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    keep = keep or [c for c in df.columns if c not in keys]
    rest = [c for c in keep if c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in keep])


def check_ratings(df: DataFrame) -> None:
    """fail the batch when any rating is outside [0, 5]."""
    bad = df.where(~(FL.rating_ok("driver_ratings") & FL.rating_ok("customer_rating")))
    if not bad.isEmpty():
        raise QualityError("new row for relation \"dataset\" violates check constraint "
                           "on driver_ratings/customer_rating")


def quality_report(df: DataFrame) -> DataFrame:
    """F9 as a report: rows checked and rows breaking each rating rule."""
    return df.agg(F.count(F.lit(1)).alias("rows_checked"),
                  F.count_if(~FL.rating_ok("driver_ratings")).alias("bad_driver_ratings"),
                  F.count_if(~FL.rating_ok("customer_rating")).alias("bad_customer_rating"))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F9 option: (rows passing, rows quarantined) instead of failing."""
    ok = FL.rating_ok("driver_ratings") & FL.rating_ok("customer_rating")
    return df.where(ok), df.where(~ok)


def gold_from_silver(silver: DataFrame) -> DataFrame:
    """G3 over all batches at once: batches load in name order, so the first
    row by (_batch_id, _id) wins the key."""
    cleaned = silver.select(F.col("_id"), *gold_columns())
    return first_wins(cleaned, "booking_id", ["_batch_id", "_id"], keep=sch.GOLD_COLUMNS[1:]) \
        .select(*sch.GOLD_COLUMNS)


def to_gold(silver_batch: DataFrame, gold: DataFrame | None, batch_id: str) -> DataFrame:
    """G3 for one batch: clean, first row wins within the batch, then insert
    only keys absent from the gold rows of *other* batches (this batch's rows
    are replaced, as the source deletes them first).

    Gold is probed with the batch's distinct keys: broadcast when they are
    small, so the large gold side is filtered in place and never shuffled.
    """
    cleaned = silver_batch.select(F.col("_id"), *gold_columns())
    batch = first_wins(cleaned, "booking_id", ["_id"], keep=sch.GOLD_COLUMNS[1:])
    if gold is None:
        return batch.select(*sch.GOLD_COLUMNS)
    others = gold.where(F.col("_batch_id") != F.lit(batch_id)).select("booking_id")
    keys = batch.select("booking_id")
    # The batch has no more keys than rows: measure the key column of the rows
    # (a scan of one column) rather than the aggregated key set.
    if fits_broadcast(silver_batch.select("booking_id")):
        taken = others.join(F.broadcast(keys), "booking_id", "left_semi")
        return batch.join(F.broadcast(taken), "booking_id", "left_anti").select(*sch.GOLD_COLUMNS)
    taken = others.join(keys, "booking_id", "left_semi")
    return batch.join(taken, "booking_id", "left_anti").select(*sch.GOLD_COLUMNS)
