"""Key filters of gold's batches (J2 without reading the keys of all gold).

Beside gold every batch keeps Bloom filters of its keys, as rows of 4 KB bitmaps:
a page for about a thousand keys, the page of a key told by its hash. A new batch
probes the pages that its keys may be in, and only batches whose filter may hold
one of them have their keys read. That read is the exact check, so the filters
only ever save work: a batch without filters is always read.

Built and probed with Spark's own bitmap functions; a hot key sets the same few
bits in every task, and a task sends one bitmap per page, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.operators import medallion as M
from farebox.session import broadcast_if_small
from farebox.sources import layers as LY

#: Bits of a page: what one bitmap of ``bitmap_construct_agg`` holds.
PAGE_BITS = 32_768
#: Bits for a key, and how many of them it sets: about six false positives in a
#: million probes.
BITS_PER_KEY, HASHES = 32, 8
FILTER_SCHEMA = "pages long, page long, bits binary, _batch_id string"


def _page(key: Column, pages: Column) -> Column:
    return F.pmod(F.xxhash64(key), pages)


def _positions(key: Column) -> list[Column]:
    """The bits of a key in its page."""
    first = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(PAGE_BITS))
    step = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(PAGE_BITS // 2)) * 2 + 1
    return [F.pmod(first + step * i, F.lit(PAGE_BITS)) for i in range(HASHES)]


def _has(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def key_filters(rows: DataFrame, key_col: str = "booking_id", batch_col: str = LY.BATCH_COL) -> DataFrame:
    """One row per batch and page of keys. NULL keys are in no filter; a batch
    without keys has one empty page, so it is known and never read."""
    per_page = PAGE_BITS // BITS_PER_KEY
    size = rows.groupBy(batch_col).agg(F.count(key_col).alias("n"))
    # a power of two: the numbers of pages in use are few, whatever the number of batches
    wide = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / per_page)))
    size = size.select(batch_col, F.pow(F.lit(2.0), wide).cast("long").alias("pages"))
    key = F.col(key_col)
    bit = (rows.where(key.isNotNull()).join(broadcast_if_small(size), batch_col)
           .select(batch_col, "pages", _page(key, F.col("pages")).alias("page"), F.explode(F.array(*_positions(key))).alias("at")))
    pages = bit.groupBy(batch_col, "pages", "page").agg(F.bitmap_construct_agg("at").alias("bits"))
    empty = size.join(pages.select(batch_col).distinct(), batch_col, "left_anti") \
        .select(batch_col, F.lit(1).cast("long").alias("pages"), F.lit(0).cast("long").alias("page"),
                F.lit(bytes(PAGE_BITS // 8)).alias("bits"))
    return pages.unionByName(empty).select("pages", "page", "bits", batch_col)


def store_filters(rows: DataFrame, path: str, batch_id: str) -> None:
    """Replace the filters of one batch, whose gold rows are given."""
    LY.batch_replace(key_filters(rows.where(F.col(LY.BATCH_COL) == F.lit(batch_id))), path, batch_id)


def drop_filters(spark: SparkSession, path: str, batch_id: str) -> None:
    """The batch has no filters from now on, so its keys are read: to be called
    before its gold rows change, and ``store_filters`` after."""
    LY.remove_path(spark, f"{path.rstrip('/')}/{LY.BATCH_COL}={batch_id}")


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    if not LY.path_exists(spark, path):
        return spark.createDataFrame([], FILTER_SCHEMA)
    return spark.read.schema(FILTER_SCHEMA).parquet(path)


def possible(keys: DataFrame, filters: DataFrame, key_col: str = "booking_id",
             batch_col: str = LY.BATCH_COL) -> DataFrame:
    """(batch, key) of every key that a batch's filter may hold; each key is
    probed in one page of a batch."""
    # one row per power of two in use
    wide = [r["pages"] for r in filters.select("pages").distinct().collect()]
    if not wide:
        return keys.select(F.lit(None).cast("string").alias(batch_col), key_col).limit(0)
    key = F.col(key_col)
    probes = keys.where(key.isNotNull()).select(key_col, F.explode(F.array(*[F.lit(w).cast("long") for w in sorted(wide)])).alias("pages"))
    probes = broadcast_if_small(probes.withColumn("page", _page(key, F.col("pages"))))
    hit = F.lit(True)
    for at in _positions(key):
        hit = hit & _has(F.col("bits"), at)
    return filters.join(probes, ["pages", "page"]).where(hit).select(batch_col, key_col)


def batches_to_read(keys: DataFrame, batches: list[str], filters: DataFrame, batch_id: str | None = None,
                    key_col: str = "booking_id", batch_col: str = LY.BATCH_COL) -> list[str]:
    """Those of gold's ``batches`` (but ``batch_id``) whose keys have to be read:
    they may hold one of ``keys``, or they have no filters."""
    if batch_id is not None:
        filters = filters.where(F.col(batch_col) != F.lit(batch_id))
    known = {r[0] for r in filters.select(batch_col).distinct().collect()}       # names of partitions
    maybe = {r[0] for r in possible(keys, filters, key_col, batch_col).select(batch_col).distinct().collect()}
    return [b for b in batches if b != batch_id and (b in maybe or b not in known)]


def to_gold(silver_batch: DataFrame, gold: DataFrame | None, batches: list[str], filters: DataFrame,
            batch_id: str) -> DataFrame:
    """G3 for one batch as ``medallion.to_gold``, with the same rows, reading the
    keys of those of gold's ``batches`` that ``batches_to_read`` names. Gold is
    partitioned by batch, so the others' files aren't opened."""
    batch = M.to_gold(silver_batch, None, batch_id)
    if gold is None:
        return batch
    keys = broadcast_if_small(batch.select("booking_id"))
    names = batches_to_read(keys, batches, filters, batch_id)
    if not names:
        return batch
    held = gold.where(F.col(LY.BATCH_COL).isin(names)).select("booking_id")
    taken = broadcast_if_small(held.join(keys, "booking_id", "left_semi"))
    return batch.join(taken, "booking_id", "left_anti").select(*sch.GOLD_COLUMNS)
