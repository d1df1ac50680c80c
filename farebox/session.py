"""Session construction and cluster-safe helpers shared by every operator."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every job relies on. Shuffle partitions is sized per run by the
# caller (about 128 MB per partition at the target scale; 8 for local tests).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Lineage cuts write reliable checkpoints; remove them once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "farebox", extra: dict | None = None,
                  ui: bool = False) -> SparkSession:
    """A session with the engine's defaults; the web UI is off unless asked
    for (local runs and tests)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = str(ui).lower()
    conf["spark.ui.showConsoleProgress"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Target bytes per task, for input splits and for shuffle partitions.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def tune_for_input(spark: SparkSession, input_bytes: int, expansion: float = 3.0,
                   target: int = TARGET_PARTITION_BYTES) -> int:
    """Size shuffles so each partition fits in executor memory at the target
    scale: input splits of ``target`` bytes, and ``input x expansion``
    (Parquet decompresses) over ``target`` shuffle partitions, at least one
    per core; AQE then coalesces small ones and splits skewed ones. Returns
    the shuffle partition count."""
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(input_bytes * expansion // target) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target))
    return parts


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins; a folder of our own is set only
    when none is configured and the master is local (tests). Elsewhere it raises:
    a machine-local folder is not seen by the other machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured and not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not configured:
        configured = os.path.join("/tmp", "farebox-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for derived tables.

    Written tables (CSV drops, layer tables, vector indexes) live next to the
    checkpoints so that every executor sees them; never a machine-local folder.
    """
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/farebox-work/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> str:
    """Zip this package (in memory) into the shared checkpoint folder and add
    it to every executor's Python path (cluster runs; local mode already sees
    it). No machine-local temporary folder is used."""
    import io
    import zipfile
    here = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(here)))
    target = work_path(spark, "pyfiles") + "/farebox.zip"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target)
    return target


_SHARED: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """``ship_package`` once per application, for functions that Python workers
    import from this package."""
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        ship_package(spark)
        _SHARED.add(app)


# Largest side, in bytes of its values, that is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the values of ``df`` take at most ``max_bytes``.

    One partial aggregate over all of ``df``: each task sends a single number,
    so no rows are gathered. Used before every broadcast whose size is not
    fixed by construction; beyond it the join is shuffled on its key.
    """
    row = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            row = row + F.when(c.isNotNull(), F.size(c)).otherwise(0) * 8 + 16
        else:
            row = row + 16
    total = df.agg(F.sum(row.cast("long"))).first()[0]
    return (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows it."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
