"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer numpy network with temperature-calibrated probabilities.

Every token has a fixed sparse ternary index vector (drawn by hash); a token's
context vector is the sum of its neighbours' index vectors over the *whole*
corpus, added up by Spark as integers (so the result does not depend on task
order). The vocabulary is hashed to a fixed number of rows, so the vectors have
a fixed size. A document is the mean of its tokens' unit context vectors plus
how concentrated and repetitive its tokens are.

Nulls: a NULL or empty text has no tokens, pools to zeros and gets a score all
the same. A NULL id is never learned from. With no labelled rows, or labels of
one kind only, every score is 0.5 resp. that kind's smoothed share. Repeated
rows each get their score; other columns pass through unless they have an
output's name, which then replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C


@dataclass(frozen=True)
class Config:
    rows: int = 8192            # hashed vocabulary
    dims: int = 64
    nonzero: int = 4            # entries of an index vector
    window: int = 2
    hidden: int = 24
    sample: int = 10_000        # bound on labelled ids that the network is fitted on; twice as many rows
    sample_bytes: int = 1 << 28 # bound on their text
    epochs: int = 120
    seed: int = 7
    block: int = 128            # vocabulary rows per shuffled record


def index_vectors(cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each row's sparse ternary index vector."""
    rng = np.random.default_rng(cfg.seed)
    pos = np.argsort(rng.random((cfg.rows, cfg.dims)), axis=1)[:, :cfg.nonzero]
    return pos.astype(np.int64), rng.choice([-1, 1], (cfg.rows, cfg.nonzero)).astype(np.float64)


def _rows_of(tokens: C.Tokens, cfg: Config) -> np.ndarray:
    return (tokens.hashes() % np.uint64(cfg.rows)).astype(np.int64)


def context_vectors(docs: DataFrame, text_col: str, cfg: Config) -> np.ndarray:
    """Context vectors of all hashed words over all texts, shape (rows, dims).

    Each task adds up its own texts and sends ``rows / block`` records; the
    records of a block are summed as a stream, never gathered, in two levels: first
    those of every ``width``-th task, then their sums.
    """
    C.ready(docs.sparkSession)
    tasks = C.merged_tasks(docs, text_col)
    width = math.isqrt(tasks)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("quality")
        pos, sign = index_vectors(cfg)
        total = np.zeros(cfg.rows * cfg.dims)
        for batch in batches:
            col = batch.column(0)
            for lo, hi in C.slices(col):
                tokens = C.Tokens(*C.utf8(col.slice(lo, hi - lo)), C.CLASSES)
                if len(tokens.start) < 2:
                    continue
                row, doc = _rows_of(tokens, cfg), tokens.doc()
                for d in range(1, cfg.window + 1):
                    near = np.flatnonzero(doc[d:] == doc[:-d])
                    a, b = row[near], row[near + d]
                    for to, of in ((a, b), (b, a)):
                        total += np.bincount(((to * cfg.dims)[:, None] + pos[of]).ravel(),
                                             sign[of].ravel(), cfg.rows * cfg.dims)
        task = TaskContext.get()
        yield from _blocks(total.astype(np.int64), cfg, task.partitionId() % width if task else 0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("quality")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(value.as_buffer(), np.int64)
                sums[block] = sums[block] + v if block in sums else v.copy()
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()),
                                   pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                  names=["block", "sums"])

    schema = "block int, sums binary"
    blocks = cfg.rows // cfg.block
    parts = (docs.select(text_col).coalesce(tasks).mapInArrow(partial, "block int, sums binary, part int")
             .repartition(min(tasks, blocks * width), "block", "part").mapInArrow(merge, schema)
             .repartition(blocks, "block").mapInArrow(merge, schema))
    total = np.zeros((cfg.rows // cfg.block, cfg.block * cfg.dims), np.int64)
    for r in parts.collect():               # a fixed number of rows: the model
        total[r["block"]] += np.frombuffer(r["sums"], np.int64)
    vectors = total.reshape(cfg.rows, cfg.dims).astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def _blocks(total: np.ndarray, cfg: Config, part: int) -> Iterator[pa.RecordBatch]:
    by = total.reshape(-1, cfg.block * cfg.dims)
    used = np.flatnonzero(by.any(axis=1))
    yield pa.record_batch([pa.array(used, pa.int32()),
                           pa.array([by[i].tobytes() for i in used], pa.binary()),
                           pa.array([part] * len(used), pa.int32())],
                          names=["block", "sums", "part"])


def n_features(cfg: Config) -> int:
    return cfg.dims + 8


def features(col: pa.Array, vectors: np.ndarray, cfg: Config) -> np.ndarray:
    """Pooled features of each text of ``col``, over its whole length."""
    out = np.zeros((len(col), n_features(cfg)), np.float32)
    for lo, hi in C.slices(col, C.SLICE_BYTES // 2):
        tokens = C.Tokens(*C.utf8(col.slice(lo, hi - lo)), C.CLASSES)
        n = np.diff(tokens.of)
        if not len(tokens.start):
            continue
        row, doc = _rows_of(tokens, cfg), tokens.doc()
        per = np.maximum(n, 1)[:, None].astype(np.float32)
        start, piece_doc = C.cut(tokens.of, 16)
        sums = C.piece_sums(vectors, row, start, 16)
        pooled = C.segment_sum(sums, np.searchsorted(piece_doc, np.arange(len(n) + 1))) / per
        # how concentrated the tokens are: the chance that two are the same
        both = np.sort(doc * cfg.rows + row)
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        times = np.diff(np.append(first, len(both)))
        same_two = np.bincount(both[first] // cfg.rows, times.astype(float) ** 2, len(n)) / np.maximum(n, 1) ** 2
        again, last = np.zeros(len(row), bool), np.zeros(len(row), bool)
        for d in range(1, 9):
            same = (row[d:] == row[:-d]) & (doc[d:] == doc[:-d])
            again[d:] |= same
            if d == 1:
                last[1:] = same
        upper = (tokens.data[tokens.start] >= 0x41) & (tokens.data[tokens.start] <= 0x5A)
        size = (tokens.end - tokens.start).astype(np.float32)
        extra = np.stack([again, last, tokens.cls == C.MARK, upper, size], axis=1).astype(np.float32)
        f = out[lo:hi]
        f[:, :cfg.dims] = pooled
        f[:, cfg.dims:cfg.dims + 5] = C.segment_sum(extra, tokens.of) / per
        f[:, cfg.dims + 5] = np.linalg.norm(pooled, axis=1)
        f[:, cfg.dims + 6] = np.sqrt(same_two)
        f[:, cfg.dims + 7] = np.log1p(n)
    return out


@dataclass
class Model:
    """Vectors, feature scaling, the two layers and the temperature."""

    cfg: Config
    vectors: np.ndarray
    constant: float | None = None
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.std @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30).astype(float)))


def fit_network(x: np.ndarray, y: np.ndarray, model: Model, weight: np.ndarray | None = None) -> Model:
    """Two tanh/logistic layers by Adam; the temperature is the one that gives
    the least log loss on a fifth of the sample kept out of training. ``weight``:
    for how many labelled rows each row stands (1 by default)."""
    cfg = model.cfg
    weight = np.ones(len(y)) if weight is None else weight
    if len(set(y.tolist())) < 2:
        model.constant = float(((weight * y).sum() + 1) / (weight.sum() + 2))
        return model
    rng = np.random.default_rng(cfg.seed)
    order = rng.permutation(len(y))
    keep = order[: max(2, len(y) // 5)] if len(y) >= 20 else order
    fit = order[len(keep):] if len(y) >= 20 else order
    model.mean, model.std = x[fit].mean(0), x[fit].std(0) + 1e-3
    weight = weight / weight[fit].mean()
    z = (x - model.mean) / model.std
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], cfg.hidden)), np.zeros(cfg.hidden),
         rng.normal(0, 1 / np.sqrt(cfg.hidden), cfg.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    size = 128
    epochs = max(cfg.epochs * 2000 // max(len(fit), 1), 30) if len(fit) > 2000 else cfg.epochs
    for _ in range(epochs):
        mixed = rng.permutation(fit)
        for at in range(0, len(mixed), size):
            i = mixed[at:at + size]
            a = np.tanh(z[i] @ w[0] + w[1])
            g = weight[i] * (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - y[i]) / len(i)
            da = np.outer(g, w[2]) * (1 - a * a)
            grads = [z[i].T @ da + 1e-4 * w[0], da.sum(0), a.T @ g + 1e-4 * w[2], g.sum(keepdims=True)]
            step += 1
            for p, gr, mm, vv in zip(w, grads, m, v, strict=True):
                mm += 0.1 * (gr - mm)
                vv += 0.001 * (gr * gr - vv)
                p -= 0.003 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.999 ** step)) + 1e-8)
    model.layers = [p.astype(np.float32) for p in w]
    logit = np.clip(model.logits(x[keep]).astype(float), -60, 60)
    tried = np.geomspace(0.25, 8, 61)
    loss = [np.mean(weight[keep] * (np.logaddexp(0, logit / t) - y[keep] * logit / t)) for t in tried]
    model.temperature = float(tried[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", cfg: Config = Config()) -> Model:
    """Word vectors over all of ``docs``; the network on at most about
    ``cfg.sample`` of the labelled rows that ``learn`` (over ``_id``) allows, each
    weighted by the inverse of its label's share in the sample."""
    model = Model(cfg, context_vectors(docs, text_col, cfg))
    chosen = C.bounded_labels(labels, id_col, label_col, learn, cfg.sample, cfg.seed)
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(chosen), "_id"))
    texts = C.bounded_rows(texts, "_id", "_text", 2 * cfg.sample, cfg.sample_bytes, cfg.seed)
    vectors = model.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("quality")
        for batch in batches:
            x = features(batch.column("_text"), vectors, cfg)
            yield pa.record_batch([batch.column("_id").cast(pa.int64()), batch.column("_y"), batch.column("_share"),
                                   pa.array([r.tobytes() for r in x], pa.binary())],
                                  names=["_id", "_y", "_share", "x"])

    # one row per learned document: bounded by cfg.sample
    rows = texts.select(F.col("_id").cast("long"), "_y", "_share", "_text").mapInArrow(
        run, "_id long, _y int, _share double, x binary").collect()
    rows.sort(key=lambda r: (r["_id"], r["x"]))
    if not rows:
        model.constant = 0.5
        return model
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1)
    return fit_network(x, np.array([r["_y"] for r in rows], float), model, 1 / np.array([r["_share"] for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (score >= 0.5)."""
    C.ready(docs.sparkSession)
    cfg = model.cfg

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        C.begin("quality")
        return pa.array(model.probability(features(text, model.vectors, cfg)), pa.float64())

    return (docs.withColumn("score", probability(F.col(text_col)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
