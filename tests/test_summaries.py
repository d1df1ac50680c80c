"""Summaries stored per batch: moments, exact quantiles in brackets, histogram."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farebox.operators import profile as P
from farebox.operators import summaries as SU
from farebox.session import work_path

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)


def table(spark, n=4000, seed=5):
    rnd = np.random.default_rng(seed)
    a = rnd.lognormal(3, 1, n).round(2)
    pdf = pd.DataFrame({"_batch_id": [f"b{i % 3}" for i in range(n)], "a": a,
                        "t": rnd.integers(0, 4, n).astype(float)})           # a third of all values tie
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("a", F.when(F.col("a") < 200, F.col("a")))     # some NULLs


def got(df):
    return {(r["column_name"], r["prob"]): r["value"] for r in df.collect()}


def want(pdf, cols=("a", "t")):
    vals = {"a": pdf["a"][pdf["a"] < 200], "t": pdf["t"]}
    return {(c, p): np.quantile(vals[c], p) for c in cols for p in PROBS}


@pytest.mark.parametrize("size, margin", [(4096, None), (16, None), (64, 0.001)])
def test_quantiles_are_exact_whatever_the_sketch(spark, size, margin):
    """Also where the sketch is coarse and brackets are missed: they are widened."""
    pdf, df = table(spark)
    s = SU.batch_summaries(df, ["a", "t"], size=size)
    q = got(SU.stored_quantiles(df, s, ["a", "t"], PROBS, margin))
    w = want(pdf)
    assert set(q) == set(w)
    assert all(abs(q[k] - w[k]) < 1e-9 for k in w)


def test_summaries_of_other_rows_don_t_change_the_result(spark):
    pdf, df = table(spark)
    old = SU.batch_summaries(df.withColumn("a", F.col("a") + 500), ["a", "t"])
    q = got(SU.stored_quantiles(df, old, ["a", "t"], PROBS))
    w = want(pdf)
    assert all(abs(q[k] - w[k]) < 1e-9 for k in w)


def test_only_bracketed_values_are_ranked(spark):
    _, df = table(spark)
    ranges = SU.brackets(SU.batch_summaries(df, ["a"]), [0.5], 2 * SU.rank_error())["a"]
    assert len(ranges) == 1
    lo, hi = ranges[0]
    kept = df.select(SU._collapsed(F.col("a"), ranges).alias("v")).where("v IS NOT NULL").distinct().count()
    assert kept <= df.where(F.col("a").between(lo, hi)).select("a").distinct().count() + 2
    assert kept < df.select("a").distinct().count() / 10


def test_describe_and_histogram_from_stored_batches(spark):
    _, df = table(spark)
    path = work_path(spark, "summaries")
    for b in ("b0", "b1", "b2", "b1"):                       # b1 again: replaced, not added
        SU.store_summary(df, path, b, ["a", "t"])
    s = spark.read.parquet(path)
    a = SU.stored_describe(df, s, ["a", "t"]).toPandas().set_index("column_name").sort_index()
    b = P.numeric_describe(df, ["a", "t"]).toPandas().set_index("column_name").sort_index()
    assert np.allclose(a[b.columns].to_numpy(float), b.to_numpy(float), rtol=1e-10)
    assert SU.stored_histogram(df, s, "a", 12).collect() == P.histogram(df, "a", 12).collect()


def test_columns_without_values_single_values_and_nan(spark):
    df = spark.createDataFrame([("b", None, 2.0, float("nan")), ("b", None, None, 1.0)],
                               "_batch_id string, none double, one double, nan double")
    s = SU.batch_summaries(df, ["none", "one", "nan"])
    rows = {r["column_name"]: r for r in SU.stored_describe(df, s, ["none", "one", "nan"]).collect()}
    assert set(rows) == {"one", "nan"}
    assert rows["one"]["std"] is None and rows["one"]["p25"] == rows["one"]["p75"] == 2.0
    assert rows["nan"]["count"] == 1 and rows["nan"]["max"] == 1.0
    assert SU.stored_quantiles(df.limit(0), s.limit(0), ["one"]).count() == 0
