"""Small files of an append-only table rewritten as few (M5's step events).

The rows are appended again in few files, and the small files that they came from
are removed after that commit. A crash in between leaves rows twice, never lost:
this suits tables whose readers don't mind repeated rows. The views over step
events are such readers (first times, latest events).
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from farebox.session import TARGET_PARTITION_BYTES
from farebox.sources.layers import _fs_path

#: Small files that a table may hold before it is compacted.
MAX_SMALL_FILES = 64


def small_files(spark: SparkSession, path: str, target: int = TARGET_PARTITION_BYTES) -> list[tuple[str, int]]:
    """(path, bytes) of the table's data files under half the target size."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    found = [(f.getPath(), f.getLen()) for f in fs.listStatus(p) if f.isFile()]
    return [(x.toString(), n) for x, n in found if x.getName().endswith(".parquet") and n < target // 2]


def compact(spark: SparkSession, path: str, schema: T.StructType, max_files: int = MAX_SMALL_FILES,
            target: int = TARGET_PARTITION_BYTES) -> int:
    """Rewrite the small files once there are more than ``max_files`` of them;
    the number of files removed.

    Files appended meanwhile aren't touched. Two at once can repeat rows, but
    lose none: each removes only files whose rows it has committed.
    """
    old = small_files(spark, path, target)
    if len(old) <= max_files:
        return 0
    parts = max(1, math.ceil(sum(n for _, n in old) / target))
    rows = spark.read.schema(schema).parquet(*[x for x, _ in old])
    rows.coalesce(parts).write.mode("append").parquet(path)
    for x, _ in old:
        fs, p = _fs_path(spark, x)
        fs.delete(p, False)
    return len(old)
