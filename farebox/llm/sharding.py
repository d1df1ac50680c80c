"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by a hash of their text (then by id), so equal texts are
neighbours. A size-weighted hash sample of the keys gives quantile boundaries;
they cut the key space into many more ranges than shards. Exact row and byte
counts of the ranges follow from one aggregation; a range that is overfull
because one text is copied very often is subdivided by a hash of the id. Running
totals inside the ranges, plus the totals of the ranges before, place every
record on one exact line of bytes (or rows), which is cut into equal shards.

Laws: ``bytes`` (byte sums nearly equal; a text's copies stay in one shard
unless they weigh more than ``whole`` of a shard), ``rows`` (row counts at most
one apart) and ``key`` (a jump-free consistent placement: id and shard count
decide, and one more shard only takes rows into itself).

Nulls: a NULL text weighs ``overhead`` bytes and has the crc of the empty text;
NULL ids sort first. Repeated rows each get their own slot; an empty table gives
an empty result. Output columns are fixed; others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.session import cut_lineage

LAWS = ("bytes", "rows", "key")


def records(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    """What sharding needs of a document: id, size, text crc and order keys."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.xxhash64(F.col(id_col), F.lit(10)).alias("_salt"))


def splitters(rows: DataFrame, ranges: int, per_range: int, total: int, accuracy: int) -> list[int]:
    """Quantiles of the order key over a size-weighted sample: a row is drawn
    with a chance in proportion to its size, about ``ranges * per_range`` in all."""
    chance = F.col("size") * F.lit(ranges * per_range / max(total, 1))
    sample = rows.filter(C.unit_hash("_salt", 11) < chance)
    at = [i / ranges for i in range(1, ranges)]
    got = sample.agg(F.percentile_approx("_key", at, accuracy).alias("q")).first()["q"]
    return sorted(set(got or []))


def ranged(rows: DataFrame, bounds: list[int], ranges: int, total: int) -> DataFrame:
    """``rows`` with ``_range`` and ``_sub``: the range of the key, and the part
    of it a row falls in where one key alone is overfull."""
    n = len(bounds)
    array = F.lit(bounds).cast("array<long>") if n else F.array().cast("array<long>")
    placed = rows.withColumn("_range", C.pick_bucket(F.col("_key"), array, n) if n else F.lit(0))
    target = max(total // ranges, 1)
    # keys that weigh more than a range: at most `ranges` of them by their size
    hot = (rows.groupBy("_key").agg(F.sum("size").alias("_bytes"))
           .filter(F.col("_bytes") > target)
           .select("_key", F.ceil(F.col("_bytes") / target).cast("int").alias("_parts")))
    return (placed.join(F.broadcast(hot), "_key", "left")
            .withColumn("_sub", F.when(F.col("_parts").isNull(), F.lit(-1))
                        .otherwise(F.pmod("_salt", F.col("_parts")).cast("int"))))


def on_one_line(placed: DataFrame) -> DataFrame:
    """Every row's exact global rank and bytes before it (``_rank``, ``_before``).

    Order: range, light keys before hot ones' parts, key, salt. Only the totals
    of the ranges meet in one task: at most two rows per range.
    """
    line = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = (placed.groupBy("_range", "_sub")
              .agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_bytes"))
              .select("_range", "_sub", F.coalesce(F.sum("_rows").over(line), zero).alias("_r0"),
                      F.coalesce(F.sum("_bytes").over(line), zero).alias("_b0")))
    inside = Window.partitionBy("_range", "_sub").orderBy("_key", "_salt", "doc_id", "text_crc32", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
            .withColumn("_before", F.coalesce(F.sum("size").over(before), zero))
            .join(F.broadcast(starts), ["_range", "_sub"])   # one row per range part
            .withColumn("_rank", F.col("_rank") + F.col("_r0"))
            .withColumn("_before", F.col("_before") + F.col("_b0")))


def consistent(key: Column, shards: int) -> Column:
    """Highest-random-weight placement: the shard whose hash with the key is
    largest. One more shard can only take the rows it wins."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                          lambda s: F.struct(F.xxhash64(key, s).alias("w"), (-s).alias("s")))
    return (-F.array_max(weights)["s"]).cast("int")


def shard(docs: DataFrame, shards: int = 24, law: str = "bytes", id_col: str = "doc_id",
          text_col: str = "text", overhead: int = 8, ranges: int | None = None,
          per_range: int = 64, whole: float = 0.01, accuracy: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard)
    and grown_shard (``key`` only) of every document."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    spark = docs.sparkSession
    rows = cut_lineage(records(docs, id_col, text_col, overhead))   # texts are read once
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or max(8 * shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = on_one_line(ranged(rows, splitters(rows, ranges, per_range, total, accuracy), ranges, total))
    none = F.lit(None).cast("int")
    if law == "rows":
        cut, grown = F.floor(F.col("_rank") * shards / F.lit(max(n_rows, 1))), none
        # shard s takes ranks from ceil(s * n / shards): counts at most one apart
    elif law == "bytes":
        # copies of one text stay together where they are a small part of a shard
        same = Window.partitionBy("_range", "_sub", "_key")
        group, start = F.sum("size").over(same), F.min("_before").over(same)
        whole_group = (F.col("_sub") < 0) & (group <= F.lit(whole * total / shards))
        at = F.when(whole_group, start + group / 2).otherwise(F.col("_before") + F.col("size") / 2)
        cut, grown = F.least(F.floor(at * shards / F.lit(max(total, 1))), F.lit(shards - 1)), none
    else:
        cut, grown = consistent(F.col("doc_id"), shards), consistent(F.col("doc_id"), shards + 1)
    out = line.withColumn("shard", cut.cast("int")).withColumn("grown_shard", grown)
    # slots: rows of the same shard in the range part before this one, from the
    # counts per (part, shard); then the rank inside
    part = Window.partitionBy("_range", "_sub", "shard").orderBy("_key", "_salt", "doc_id", "text_crc32", "size")
    out = out.withColumn("_in", F.row_number().over(part).cast("long") - 1)
    counts = out.groupBy("shard", "_range", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", "_sub", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    return (out.join(offsets, ["shard", "_range", "_sub"])
            .select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
                    (F.col("_in") + F.col("_off")).alias("slot"), "grown_shard"))
