"""Brute-force checks of the distributed algorithms on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from farebox.operators import profile as P
from farebox.operators import vectors as V
from farebox.sources import fixtures as X


def test_cosine_topk_equals_brute_force(spark, sf):
    idx = X.embedding_index(spark, sf).repartition(7)
    q = X.embedding_queries(spark, sf)
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9))
           for r in V.cosine_topk(idx, q, 5).collect()}
    rows = idx.select("id", "embedding").collect()
    ids = np.array([r["id"] for r in rows])
    m = np.array([np.asarray(r["embedding"], dtype=np.float64) for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for r in q.collect():
        v = np.asarray(r["query"], dtype=np.float64)
        s = m @ (v / np.linalg.norm(v))
        order = np.lexsort((ids, -s))[:5]
        for rank, i in enumerate(order, 1):
            gid, gscore = got[(r["query_id"], rank)]
            assert gid == ids[i] and abs(gscore - s[i]) < 1e-9


def test_embedding_is_unit_length_and_deterministic(spark):
    df = spark.createDataFrame([("Driver asked to cancel",), ("AC is not working",), ("",)], "t string")
    vecs = [r[0] for r in df.select(V.hashed_embedding("t")).collect()]
    assert all(len(v) == V.DEFAULT_DIMS for v in vecs)
    assert abs(np.linalg.norm(vecs[0]) - 1) < 1e-6 and not any(vecs[2])
    again = [r[0] for r in df.select(V.hashed_embedding("t")).collect()]
    assert vecs == again


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in vals], "v double").repartition(5)
    got = {r["prob"]: r["value"] for r in P.exact_quantiles(df, ["v"], (0.1, 0.25, 0.5, 0.9)).collect()}
    for p, v in got.items():
        assert abs(v - np.percentile(vals, p * 100)) < 1e-12


def test_histogram_counts_every_value(spark):
    df = spark.range(1000).select((F.col("id") * 0.37).alias("v"))
    h = P.histogram(df, "v", 40).collect()
    assert len(h) == 40 and sum(r["count"] for r in h) == 1000
    counts, _ = np.histogram(np.arange(1000) * 0.37, bins=40)
    assert [r["count"] for r in h] == counts.tolist()


def test_kde_matches_direct_sum(spark):
    vals = np.array([1.0, 2.0, 2.5, 4.0, 10.0])
    df = spark.createDataFrame([(float(x),) for x in vals], "v double")
    out = P.kde_curve(df, "v", grid=20).collect()
    bw = vals.std(ddof=1) * len(vals) ** -0.2
    for r in out:
        want = np.exp(-0.5 * ((r["x"] - vals) / bw) ** 2).sum() / (len(vals) * bw * np.sqrt(2 * np.pi))
        assert abs(r["density"] - want) < 1e-12
        assert abs(r["count"] - want * len(vals) * (10.0 - 1.0) / 40) < 1e-12
    assert (out[0]["x"], out[-1]["x"]) == (1.0, 10.0)
    assert P.kde_curve(df.where("v = 1"), "v").count() == 0


def test_topk_takes_queries_in_blocks(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (300, 4)).astype(float)                # many ties and zero vectors
    index = spark.createDataFrame([(f"p{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)],
                                  "id string, embedding array<double>").repartition(5)
    q = rng.integers(-2, 3, (23, 4)).astype(float)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)],
                                    "query_id long, query array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"])
           for r in V.cosine_topk(index, queries, 4, block=5).collect()}
    assert len(got) == 23 * 4

    def unit(a):
        n = np.linalg.norm(a, axis=1, keepdims=True)
        return np.divide(a, n, out=np.zeros_like(a), where=n > 0)

    scores = unit(q) @ unit(m).T
    for i in range(23):
        best = sorted(-np.round(scores[i], 12))[:4]
        assert np.allclose([-got[i, k][1] for k in range(1, 5)], best)
    assert V.cosine_topk(index, queries.limit(0), 4).count() == 0


def test_blank_search_text_gives_the_plain_page(spark, sf):
    from farebox.operators import lookup as L
    from farebox.sources import fixtures as X
    g = X.ride_gold(spark, sf)
    _, index = X.vector_sync_fixture(spark, sf)
    for text in ("   ", "", None):
        page = V.semantic_rides(g, index, text, size=7).collect()
        assert page == L.rides_page(g, size=7).collect() and page[0]["total_count"] == g.count()


def _toy_model_factory():
    """A stand-in model: letter counts; fails on texts containing 'boom'.
    Built in a closure so it is pickled by value to the Python workers."""
    def load():
        def embed(texts):
            out = []
            for t in texts:
                if "boom" in t:
                    raise ValueError("model error")
                v = np.zeros(26, dtype=np.float32)
                for ch in t.lower():
                    if "a" <= ch <= "z":
                        v[ord(ch) - 97] += 1
                out.append(v)
            return out
        return embed
    return load


def test_pandas_embedder_skips_failed_texts(spark):
    embed = V.pandas_embedder(_toy_model_factory(), dims=26)
    df = spark.createDataFrame([("abc",), ("boom",), ("zz",)], "t string")
    got = {r["t"]: r["e"] for r in df.select("t", embed("t").alias("e")).collect()}
    assert got["boom"] is None
    assert got["abc"][:3] == [1.0, 1.0, 1.0] and got["zz"][25] == 2.0


def test_apply_sync_with_a_model_embedder(spark, sf):
    src, idx = X.vector_sync_fixture(spark, sf)
    embed = V.pandas_embedder(_toy_model_factory(), dims=26)
    new = V.apply_sync(src, idx.limit(0), embedder=lambda c: embed(c), persist=False)
    assert new.count() == src.count()
    assert new.where(F.size("embedding") != 26).count() == 0


def test_approximate_options_stay_close(spark, sf):
    g = X.ride_gold(spark, sf)
    exact = {r["column_name"]: r for r in P.numeric_describe(g).collect()}
    approx = {r["column_name"]: r for r in P.numeric_describe(g, exact=False).collect()}
    for col, r in exact.items():
        span = (r["max"] - r["min"]) or 1.0
        for q in ("p25", "p50", "p75"):
            assert abs(approx[col][q] - r[q]) <= 0.02 * span
    d = P.distinct_count(g).first()[0]
    a = P.distinct_count(g, approx=True).first()[0]
    assert abs(a - d) <= 0.05 * d
