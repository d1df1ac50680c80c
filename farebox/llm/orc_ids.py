"""Token ids in ORC: stripes with integer run-length encoding, row indexes, and
Bloom filters on document ids.

``write`` range-partitions documents by id, encodes each task's sorted rows as a
stream and writes one ORC file per range; files, stripes and rows ascend by id.
``read`` gives documents with their place in the whole id stream; stripes are
read in parallel, and a filter on ids skips stripes and row groups by their
minimum, maximum and Bloom filter. A document's start is its place in its file,
known from the stream, plus the totals of the files before, of which there is
one number per file.

Nulls: a NULL text is empty (its end id only); NULL ids come first. Rows with
equal ids keep the order of their text hashes. An empty table writes a folder
that reads as empty. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm import encoding

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
          text_col: str = "text", files: int | None = None, options: dict[str, str] | None = None) -> None:
    """Encodes and writes all documents in ascending id order."""
    spark = docs.sparkSession
    C.ready(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, of in encoding.encode_column(batch.column("text"), tokenizer):
                at = of + np.arange(len(of))              # one more id per document
                out = np.empty(at[-1], np.int32)
                last = at[1:] - 1
                body = np.ones(len(out), bool)
                body[last] = False
                out[body] = ids.astype(np.int32)
                out[last] = end_id
                n = np.diff(at)
                yield pa.record_batch([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)),
                    pa.array(start + at[:-1]), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                start += int(at[-1])

    (rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .mapInArrow(run, SCHEMA)
     .write.options(**(OPTIONS | (options or {}))).orc(path))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; with
    ``doc_ids`` only those, found through the files' indexes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))       # one row per file
              .select("part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before")))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``: of the ids as little-endian unsigned
    32-bit integers."""
    C.ready(rows.sparkSession)

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        import zlib
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        of = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], pa.int64())

    return rows.withColumn("ids_crc32", crc("ids")).drop("ids")
