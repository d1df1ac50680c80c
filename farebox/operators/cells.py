"""Approximate cosine search over a large index: an index in cells.

Unit vectors are clustered around centres fitted on a bounded sample; every
point is stored in the partition of its nearest centre. A query reads the cells
of its nearest centres only and scores their points exactly, so scores are
exact and only which points are seen is approximate. How many cells a query
reads is measured when the index is built: the fewest for which a sample of its
own points finds the wanted share of its exact neighbours (``recall``).

The driver holds the sample, the centres and the tuning queries' neighbours,
all of fixed size; assignment, storing and scoring run over partitions. Rows
with a NULL id or vector are not stored. A cell that is much larger than others
is written by several tasks, as the range partitioning splits it by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.operators import vectors as V
from farebox.operators.profile import global_row_number
from farebox.session import cut_lineage, share_package

MOST_CELLS = 4096
SAMPLE_ROWS = 20_000
TUNE_QUERIES = 200


@dataclass
class CellIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray         # (cells, dims), unit length
    probes: int                 # cells that a query reads

    def points(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The cells of each vector, nearest centre first."""
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")


def _centres(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, from the first rows; an empty cell keeps its centre."""
    centre = x[:cells].copy()
    for _ in range(rounds):
        of = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.divide(sums, norm, out=centre, where=norm > 0)
    return centre


def build(index: DataFrame, path: str, cells: int | None = None, recall: float = 0.97, k: int = 5,
          seed: int = 5) -> CellIndex:
    """Cluster, store and tune an index of (id, embedding, ...). ``cells``: the
    square root of the points by default, ``MOST_CELLS`` at most."""
    spark = index.sparkSession
    share_package(spark)
    points = index.where(F.col("id").isNotNull() & F.col("embedding").isNotNull())
    n = points.count()
    cells = max(1, min(MOST_CELLS, cells or round(n ** 0.5), n))
    drawn = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("id", "embedding").limit(SAMPLE_ROWS).collect()
    if not drawn:
        raise ValueError("an index without points has no cells")
    sample = V._unit_rows([r["embedding"] for r in drawn])
    out = CellIndex(spark, path, _centres(sample, cells), 1)
    sent = spark.sparkContext.broadcast(out.centres)

    @F.pandas_udf("int")
    def cell(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in vectors:
            yield pd.Series((V._unit_rows(v) @ sent.value.T).argmax(1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (points.withColumn("cell", cell("embedding")).repartitionByRange(parts, "cell", F.xxhash64("id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("cell").parquet(path))
    # the exact neighbours of a few of its own points, and how far down their centres' order they are
    asked = drawn[:TUNE_QUERIES]
    queries = spark.createDataFrame([(i, [float(x) for x in r["embedding"]]) for i, r in enumerate(asked)], "query_id long, query array<double>")
    hits = cut_lineage(V.cosine_topk(out.points(), queries, k + 1).select("query_id", "id"))
    found = hits.join(out.points().select("id", "cell"), "id").collect()          # at most TUNE_QUERIES x (k + 1)
    place = out.nearest(V._unit_rows([r["embedding"] for r in asked])).argsort(1)
    depth = np.sort([place[r["query_id"], r["cell"]] for r in found if r["id"] != asked[r["query_id"]]["id"]])
    if len(depth):
        out.probes = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1
    return out


def search(cells: CellIndex, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_col: str = "query",
           block: int = V.QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k best points of each query's cells,
    ties by id. Queries go in blocks of at most ``block``; a block reads the
    partitions of its cells only, and a point is scored for the queries that
    read its cell."""
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_col).alias("q")).where(F.col("q").isNotNull())
    numbered = cut_lineage(global_row_number(q, [F.asc("qid")], "n").withColumn("block", F.expr(f"(n - 1) div {int(block)}")))
    last = numbered.agg(F.max("block")).first()[0]
    out = None
    for b in range((-1 if last is None else last) + 1):
        rows = numbered.where(F.col("block") == b).collect()             # at most ``block`` rows
        part = _block(cells, np.array([r["qid"] for r in rows], np.int64), V._unit_rows([r["q"] for r in rows]), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return cells.spark.createDataFrame([], V.TOPK_SCHEMA + ", rank long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _block(cells: CellIndex, qids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    probed = cells.nearest(vectors)[:, :cells.probes]
    reads = np.zeros((len(vectors), len(cells.centres)), bool)
    np.put_along_axis(reads, probed, True, axis=1)
    share_package(cells.spark)
    sent = cells.spark.sparkContext.broadcast((qids, vectors, reads))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, vectors, reads = sent.value
        q, ids, scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        for pdf in batches:
            for c, group in pdf.groupby("cell"):
                mine = np.flatnonzero(reads[:, c])
                for at in range(0, len(group), V.SCORE_ROWS):
                    part = group.iloc[at:at + V.SCORE_ROWS]
                    s = vectors[mine] @ V._unit_rows(part["embedding"]).T
                    n = s.shape[1]
                    kth = np.partition(s, n - k, axis=1)[:, n - k:n - k + 1] if n > k else np.full((len(mine), 1), -np.inf)
                    qi, col = np.nonzero(s >= kth)
                    q = np.concatenate((q, mine[qi]))
                    ids = np.concatenate((ids, part["id"].to_numpy(object)[col]))
                    scores = np.concatenate((scores, s[qi, col]))
                    best = V._top_rows(q, ids, scores, k)
                    q, ids, scores = q[best], ids[best], scores[best]
        if len(q):
            yield pd.DataFrame({"query_id": qids[q], "id": ids, "score": scores})

    wanted = [int(c) for c in np.unique(probed)]
    return (cells.points().where(F.col("cell").isin(wanted)).select("id", "embedding", "cell")
            .mapInPandas(partial, V.TOPK_SCHEMA))


def rows_read(cells: CellIndex, queries: DataFrame, query_col: str = "query") -> float:
    """The share of the points that a query scores, on average over ``queries``
    (bounded: a report)."""
    sizes = np.zeros(len(cells.centres))
    for r in cells.points().groupBy("cell").count().collect():          # one row per cell
        sizes[r["cell"]] = r["count"]
    vectors = V._unit_rows([r[0] for r in queries.where(F.col(query_col).isNotNull()).select(query_col).collect()])
    return float(sizes[cells.nearest(vectors)[:, :cells.probes]].sum(1).mean() / sizes.sum())


def recall_report(cells: CellIndex, index: DataFrame, queries: DataFrame, k: int = 5, wanted: float = 0.9) -> DataFrame:
    """One row: queries, exact neighbours, and whether the index finds at least
    the share ``wanted`` of them."""
    exact = V.cosine_topk(index, queries, k).select("query_id", "id")
    near = search(cells, queries, k).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
        (F.count("hit") >= wanted * F.count(F.lit(1))).alias("recall_reached"))
