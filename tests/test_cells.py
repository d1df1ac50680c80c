"""The index in cells against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.operators import cells as CL
from farebox.operators import vectors as V
from farebox.session import work_path
from farebox.sources import fixtures as X


def recall(spark, index, cells, queries, k=5):
    exact = {(r["query_id"], r["id"]) for r in V.cosine_topk(index, queries, k).collect()}
    got = CL.search(cells, queries, k).collect()
    assert len(got) == len(exact)
    return len(exact & {(r["query_id"], r["id"]) for r in got}) / len(exact)


def test_recall_and_rows_read(spark):
    """Clustered points: nearly all neighbours from a small part of the rows."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 24))
    x = centre[rng.integers(0, 40, 4000)] + rng.normal(scale=0.35, size=(4000, 24))
    index = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    cells = CL.build(index, work_path(spark, "cells"))
    queries = index.where(F.col("id").cast("int") % 50 == 0).select(F.col("id").cast("long").alias("query_id"), F.col("embedding").alias("query"))
    assert recall(spark, index, cells, queries) >= 0.9
    assert CL.rows_read(cells, queries) < 0.25
    plan = CL._block(cells, np.array([0]), V._unit_rows([x[0]]), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    several = CL.search(cells, queries, 5, block=7)
    rounded = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    assert rounded(several) == rounded(CL.search(cells, queries, 5))


def test_recall_on_the_given_vectors(spark, sf):
    index, queries = X.embedding_index(spark, sf), X.embedding_queries(spark, sf)
    cells = CL.build(index, work_path(spark, "cells-given"))
    assert recall(spark, index, cells, queries) >= 0.9


def test_odd_points_and_queries(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), (None, [1.0, 1.0]), ("c", None), ("d", [1.0, 0.1]), ("e", [1.0, 0.0])]
    index = spark.createDataFrame(rows, "id string, embedding array<float>")
    cells = CL.build(index, work_path(spark, "cells-odd"), cells=1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query array<float>")
    assert [(r["query_id"], r["id"], r["rank"]) for r in CL.search(cells, queries, 3).orderBy("rank").collect()] == [(1, "a", 1), (1, "e", 2), (1, "d", 3)]
    assert CL.search(cells, queries.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        CL.build(index.limit(0), work_path(spark, "cells-none"))
