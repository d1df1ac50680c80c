"""Embedding, vector-index sync and cosine top-k search.

* The built-in embedder is pure column expressions (token hashing into a
  fixed number of signed buckets, L2-normalised), so it runs in the JVM; a
  real model plugs in as an iterator ``pandas_udf`` that loads it once per
  worker. Texts are embedded once per *distinct* text, then joined back.
* Sync is two anti-joins (orphans, missing) and one guard aggregate.
* Exact top-k: the queries are taken in blocks of a fixed size, each
  broadcast; each index partition scores its rows against a block in numpy and
  emits only its own top-k per query, so no query x index pair ever leaves the
  task; a final ranking picks the global top-k from these candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox import schemas as sch
from farebox.functions import columns as C
from farebox.functions import filters as FL
from farebox.session import broadcast_if_small, cut_lineage, share_package

DEFAULT_DIMS = 384
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Queries of one block (broadcast), and index rows scored against it at a time:
# a score matrix of at most 32 MB.
QUERY_BLOCK = 4096
SCORE_ROWS = 1024


# --- V1: embedding -------------------------------------------------------------

def tokens(text: Column | str) -> Column:
    """Lower-case alphanumeric tokens."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda x: F.length(x) > 0)


def hashed_embedding(text: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """V1 built-in embedder: each token adds +-1 to bucket md5(token) mod
    ``dims`` (sign from another md5 digit); the vector is L2-normalised.
    Deterministic and JVM-side; an all-empty text gives a zero vector."""
    toks = tokens(text)
    marks = F.transform(toks, lambda t: let(F.md5(t), lambda h: F.struct(
        (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims).cast("int").alias("b"),
        F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0))
         .otherwise(F.lit(-1.0)).alias("s"))))

    def buckets(ms: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(
            ms, F.lit(0.0), lambda acc, m: acc + F.when(m["b"] == i, m["s"]).otherwise(F.lit(0.0))))

    def normalise(raw: Column) -> Column:
        return let(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x)),
                   lambda norm: F.transform(raw, lambda x: F.when(norm > 0, x / norm)
                                            .otherwise(F.lit(0.0)).cast("float")))

    return let(marks, lambda ms: let(buckets(ms), normalise))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a lambda variable
    bound through a one-element array); expressions inside higher-order
    lambdas are otherwise re-evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def pandas_embedder(load_model: Callable[[], Callable[[list[str]], np.ndarray]],
                    dims: int = DEFAULT_DIMS):
    """V1 pluggable embedder: an iterator ``pandas_udf`` that calls
    ``load_model()`` once per Python worker, then embeds Arrow batches. A
    failed text yields NULL (skipped until the next sync, as the source does)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for s in batches:
            out = []
            try:
                vecs = model(s.fillna("").tolist())
                out = [np.asarray(v, dtype=np.float32) for v in vecs]
            except Exception:  # noqa: BLE001 - per-text retry below
                for text in s.fillna("").tolist():
                    try:
                        out.append(np.asarray(model([text])[0], dtype=np.float32))
                    except Exception:  # noqa: BLE001
                        out.append(None)
            # A vector of the wrong size counts as a failed embedding.
            yield pd.Series([v if v is not None and v.shape == (dims,) else None for v in out])
    return embed


def embed_distinct(df: DataFrame, text_col: str, embedder: Callable[[Column], Column] | None = None,
                   out_col: str = "embedding") -> DataFrame:
    """Embed each distinct text once and join the vectors back (broadcast only
    when their measured size is small)."""
    embedder = embedder or hashed_embedding
    # The distinct texts (a partial aggregate over one column) and their vectors
    # once, kept in the shared checkpoint folder for the size check and the join.
    texts = df.select(text_col).distinct()
    vecs = broadcast_if_small(cut_lineage(
        texts.select(text_col, embedder(F.col(text_col)).alias(out_col))))
    return df.join(vecs, df[text_col].eqNullSafe(vecs[text_col]), "left").drop(vecs[text_col])


# --- V2-V4, S6, S7, J3, J4: index sync ----------------------------------------------

def sync_source(gold: DataFrame) -> DataFrame:
    """Source points: gold rows with a cancellation reason, id by P12."""
    return gold.where(FL.exclude_value()).select(
        C.hash_uuid("booking_id").alias("id"), "booking_id",
        F.col("unified_cancellation_reason").alias("reason"))


def index_ids(index: DataFrame) -> DataFrame:
    """Ids of the index; ids that are not UUIDs are skipped."""
    return index.select("id").where(F.col("id").rlike(UUID_PATTERN))


def orphan_ids(index: DataFrame, source: DataFrame) -> DataFrame:
    """Indexed ids with no source row."""
    return index_ids(index).join(source.select("id"), "id", "left_anti")


def missing_ids(source: DataFrame, index: DataFrame) -> DataFrame:
    """Source rows whose id is not indexed."""
    return source.join(index_ids(index), "id", "left_anti")


def sync_plan(source: DataFrame, index: DataFrame, refresh_changed: bool = False) -> DataFrame:
    """V2: (id, booking_id, reason, action) with action delete / insert.
    A changed reason under an indexed id is not re-embedded (kept stale) unless
    ``refresh_changed``: then it is an update."""
    dels = orphan_ids(index, source).select(
        "id", F.lit(None).cast("string").alias("booking_id"),
        F.lit(None).cast("string").alias("reason"), F.lit("delete").alias("action"))
    ins = missing_ids(source, index).select("id", "booking_id", "reason",
                                            F.lit("insert").alias("action"))
    plan = dels.unionByName(ins)
    if refresh_changed:
        held = index.select("id", F.col("reason").alias("_held"))
        changed = source.join(held, "id").where(~F.col("reason").eqNullSafe(F.col("_held")))
        plan = plan.unionByName(changed.select("id", "booking_id", "reason", F.lit("update").alias("action")).distinct())
    return plan


def delete_guard(source: DataFrame, index: DataFrame,
                 orphans: DataFrame | None = None) -> DataFrame:
    """V3: one row: index size, deletes planned (``orphans``, where already
    known), source size, and whether the deletes apply. Deletes that would empty a non-empty index while the source
    is not empty are skipped (inserts still run)."""
    orphans = orphans if orphans is not None else orphan_ids(index, source)
    tagged = (index_ids(index).select(F.lit("i").alias("t"))
              .unionByName(orphans.select(F.lit("d").alias("t")))
              .unionByName(source.select(F.lit("s").alias("t"))))
    row = tagged.agg(F.count_if(F.col("t") == "i").alias("index_count"),
                     F.count_if(F.col("t") == "d").alias("delete_count"),
                     F.count_if(F.col("t") == "s").alias("source_count"))
    blocked = (F.col("delete_count") > 0) & (F.col("delete_count") == F.col("index_count")) \
        & (F.col("source_count") > 0)
    return row.withColumn("apply_deletes", (F.col("delete_count") > 0) & ~blocked)


def upsert(index: DataFrame, points: DataFrame) -> DataFrame:
    """Points replace index rows of the same id, others are added. Of
    points that repeat an id the one with the largest (booking_id, reason,
    embedding) stays."""
    cols = sch.VECTOR_SCHEMA.fieldNames()
    rest = ["booking_id", "reason", "embedding"]
    pts = points.groupBy("id").agg(F.max(F.struct(*rest)).alias("p")).select("id", *[F.col(f"p.{c}").alias(c) for c in rest])
    return index.select(*cols).join(pts.select("id"), "id", "left_anti").unionByName(pts.select(*cols))


def apply_sync(source: DataFrame, index: DataFrame,
               embedder: Callable[[Column], Column] | None = None,
               persist: bool = True) -> DataFrame:
    """V4: deletes (unless guarded), then embed the missing points (a NULL
    vector skips the point until the next sync) and upsert them. Returns
    the new index, written to the shared checkpoint folder unless
    ``persist`` is off (as a vector store keeps its points)."""
    # Each anti-join runs once: the guard and the result share its rows.
    orphans = cut_lineage(orphan_ids(index, source))
    missing = cut_lineage(missing_ids(source, index))
    kept = index
    if delete_guard(source, index, orphans).first()["apply_deletes"]:
        kept = index.join(broadcast_if_small(orphans), "id", "left_anti")
    new = embed_distinct(missing, "reason", embedder)
    new = new.where(F.col("embedding").isNotNull())
    out = upsert(kept, new)
    return cut_lineage(out) if persist else out


# --- V5, V6: search ----------------------------------------------------------------

TOPK_SCHEMA = "query_id long, id string, score double"


def _unit_rows(vectors) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _top_rows(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (score, then id) of every query in ``q``."""
    order = np.lexsort((ids, -scores, q))
    first = np.concatenate(([0], np.nonzero(np.diff(q[order]))[0] + 1)) if len(order) else []
    starts = np.zeros(len(order), dtype=np.int64)
    starts[first] = first
    place = np.arange(len(order)) - np.maximum.accumulate(starts)
    return order[place < k]


def _block_topk(index: DataFrame, rows: list, k: int) -> DataFrame:
    """Each index partition's k best rows for every query of one block."""
    spark = index.sparkSession
    share_package(spark)
    bq = spark.sparkContext.broadcast((
        np.array([r["qid"] for r in rows], dtype=np.int64), _unit_rows([r["q"] for r in rows])))

    def partial_topk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qm = bq.value
        q, ids, scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        for pdf in batches:
            for at in range(0, len(pdf), SCORE_ROWS):
                part = pdf.iloc[at:at + SCORE_ROWS]
                s = qm @ _unit_rows(part["embedding"]).T          # queries x rows
                # Rows at or above a query's k-th best of this piece are its
                # candidates (ties included, so the order stays exact).
                n = s.shape[1]
                kth = (np.partition(s, n - k, axis=1)[:, n - k:n - k + 1] if n > k
                       else np.full((len(qids), 1), -np.inf))
                qi, col = np.nonzero(s >= kth)
                q = np.concatenate((q, qi))
                ids = np.concatenate((ids, part["id"].to_numpy(object)[col]))
                scores = np.concatenate((scores, s[qi, col]))
                best = _top_rows(q, ids, scores, k)
                q, ids, scores = q[best], ids[best], scores[best]
        if len(q):
            yield pd.DataFrame({"query_id": qids[q], "id": ids, "score": scores})

    return index.select("id", "embedding").where(
        F.col("id").isNotNull() & F.col("embedding").isNotNull()) \
        .mapInPandas(partial_topk, TOPK_SCHEMA)


def cosine_topk(index: DataFrame, queries: DataFrame, k: int = 5,
                query_id: str = "query_id", query_col: str = "query",
                block: int = QUERY_BLOCK) -> DataFrame:
    """V5: exact k nearest index points by cosine for every query; ties by id.

    (query_id, id, score, rank). Any number of queries, taken in blocks of at
    most ``block``: a block is broadcast and the index scanned for it, and each
    index partition returns at most k candidates per query; the global top-k is
    taken from those candidates only. Rows with a NULL id or vector are left out.
    """
    from farebox.operators.profile import global_row_number
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_col).alias("q")) \
        .where(F.col("q").isNotNull())
    numbered = cut_lineage(global_row_number(q, [F.asc("qid")], "n")
                           .withColumn("block", F.expr(f"(n - 1) div {int(block)}")))
    last = numbered.agg(F.max("block")).first()[0]
    if last is None:
        return index.sparkSession.createDataFrame([], TOPK_SCHEMA + ", rank long")
    cands = None
    for b in range(last + 1):
        rows = numbered.where(F.col("block") == b).collect()     # at most ``block`` rows
        part = _block_topk(index, rows, k)
        cands = part if cands is None else cands.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return cands.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def search_text(index: DataFrame, text: str, k: int = 5,
                embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """V5 for one text query, embedded by the same embedder."""
    embedder = embedder or hashed_embedding
    spark = index.sparkSession
    q = spark.range(1).select(F.lit(0).cast("long").alias("query_id"),
                              embedder(F.lit(text)).alias("query"))
    return cosine_topk(index, q, k)


def semantic_rides(gold: DataFrame, index: DataFrame, text: str, k: int = 5,
                   page: int = 1, size: int = 20, embedder=None, **filters) -> DataFrame:
    """V6: the top-k points of the whole index first, then their rides
    under the filters, newest first (not by score); may give fewer than k
    rows, and no hit gives an empty page. A blank text is no search: the plain
    page."""
    from farebox.operators import lookup as L
    if not (text or "").strip():
        return L.rides_page(gold, page=page, size=size, **filters)
    hits = search_text(index, text, k, embedder).join(
        index.select("id", "booking_id"), "id").select("booking_id")
    # At most k rows, used by the page and by its total: search the index
    # once and keep the hits in the shared checkpoint folder.
    hits = cut_lineage(hits)
    return L.rides_page(gold, ids=hits, page=page, size=size, **filters)
