"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: lower-case words, and the first
bytes of longer words, so that inflected forms meet. The machine gives a term a
weight and a factor vector; the dot products of factor vectors are learned
pairwise interactions, so a pair such as an insult and a group's name can count
for more (or less) than its parts, which additive weights can't express.
Training is proximal Adagrad with an L1 pull on the weights, which leaves the
noise of the many harmless terms of long texts at exactly zero.

Nulls: a NULL or empty text has no terms and gets the score of the bias alone.
A NULL id is never learned from; without labelled rows, or with labels of one
kind, the score is 0.5 resp. that kind's smoothed share. Repeated rows each get
their score; other columns pass through unless they have an output's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C


@dataclass(frozen=True)
class Config:
    terms: int = 1 << 17        # hashed terms
    factors: int = 4
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)  # bytes; the term of a longer word's beginning
    sample: int = 10_000        # bound on labelled ids that the machine is fitted on; twice as many rows
    sample_bytes: int = 1 << 26 # bound on their text, so on the term sets that the driver reads
    epochs: int = 8
    rate: float = 0.1
    least_docs: int = 2         # sampled documents that hold a term, for it to count
    most_weight: float = 8.0    # of a row of the rarer label
    l1: float = 2e-4
    l2: float = 1e-4
    seed: int = 8


#: Marks split words.
_WORDS = np.where(C.CLASSES == C.WORD, C.WORD, C.SPACE).astype(np.uint8)


def term_sets(col: pa.Array, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text and their offsets, over whole texts."""
    found, counts = [], np.zeros(len(col), np.int64)
    for lo, hi in C.slices(col):
        tokens = C.Tokens(*C.utf8(pc.utf8_lower(col.slice(lo, hi - lo))), _WORDS)
        doc = tokens.doc()
        size = tokens.end - tokens.start
        keys = [(tokens.hashes(), doc)]
        for p in cfg.prefixes:
            longer = np.flatnonzero(size > p)
            keys.append((C.mix(tokens.hashes(p)[longer] + np.uint64(p)), doc[longer]))
        term = np.concatenate([k for k, _ in keys]) % np.uint64(cfg.terms)
        of = np.concatenate([d for _, d in keys])
        both = np.unique(of * cfg.terms + term.astype(np.int64))
        found.append((both % cfg.terms).astype(np.int32))
        counts[lo:hi] = np.bincount(both // cfg.terms, minlength=hi - lo)
    return (np.concatenate(found) if found else np.zeros(0, np.int32),
            np.concatenate([[0], np.cumsum(counts)]))


@dataclass
class Model:
    cfg: Config
    constant: float | None = None
    bias: float = 0.0
    w: np.ndarray | None = None
    v: np.ndarray | None = None

    def forward(self, idx: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, factor sums and the pairwise scale of each text. The pairwise
        part is divided by the number of terms, so long texts are comparable."""
        v = self.v[idx]
        total = C.segment_sum(v, of)
        scale = 1 / np.maximum(np.diff(of), 1)
        pairs = 0.5 * ((total ** 2).sum(1) - C.segment_sum((v * v).sum(1), of)) * scale
        return self.bias + C.segment_sum(self.w[idx], of) + pairs, total, scale

    def probability(self, idx: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(of) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.forward(idx, of)[0].astype(float), -30, 30)))


def fit_machine(idx: np.ndarray, of: np.ndarray, y: np.ndarray, cfg: Config, stands_for: np.ndarray | None = None) -> Model:
    """Proximal Adagrad over mini-batches of the sampled documents; terms in
    fewer than ``least_docs`` sampled documents are left out, as they can't
    generalise. ``stands_for``: for how many labelled rows each row stands (1 by
    default), so that a balanced draw doesn't move the scores."""
    model = Model(cfg)
    stands_for = np.ones(len(y)) if stands_for is None else stands_for
    rate = float((stands_for * y).sum() / max(stands_for.sum(), 1e-9))     # of the label among all labelled rows
    if len(set(y.tolist())) < 2:
        model.constant = float(((stands_for * y).sum() + 1) / (stands_for.sum() + 2))
        return model
    rng = np.random.default_rng(cfg.seed)
    often = np.bincount(idx, minlength=cfg.terms) >= cfg.least_docs
    keep = often[idx]
    of = np.concatenate([[0], np.cumsum(C.segment_sum(keep.astype(np.int64), of))])
    idx = idx[keep]
    model.w = np.zeros(cfg.terms, np.float32)
    model.v = np.where(often[:, None], rng.normal(0, 0.05, (cfg.terms, cfg.factors)), 0).astype(np.float32)
    gw, gv = np.full(cfg.terms, 1e-3, np.float32), np.full((cfg.terms, cfg.factors), 1e-2, np.float32)
    model.bias, gb = float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), 1.0
    weight = np.where(y == 1, min(cfg.most_weight, 0.5 / max(rate, 1e-3)), 0.5 / max(1 - rate, 1e-3))
    weight = weight * stands_for / stands_for.mean()
    size = max(8, min(64, len(y) // 20))
    for _ in range(cfg.epochs):
        mixed = rng.permutation(len(y))
        for at in range(0, len(mixed), size):
            docs = mixed[at:at + size]
            n = of[docs + 1] - of[docs]
            sub = np.concatenate([[0], np.cumsum(n)])
            ids = idx[np.arange(sub[-1]) + np.repeat(of[docs] - sub[:-1], n)]
            logit, total, scale = model.forward(ids, sub)
            g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            row = np.repeat(np.arange(len(docs)), n)
            used, inv = np.unique(ids, return_inverse=True)
            dw = np.bincount(inv, g[row], len(used)).astype(np.float32)
            per = (total[row] - model.v[ids]) * (g * scale)[row][:, None]
            dv = np.stack([np.bincount(inv, per[:, k], len(used)) for k in range(cfg.factors)], 1).astype(np.float32)
            dv += cfg.l2 * model.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            step = cfg.rate / np.sqrt(gw[used])
            moved = model.w[used] - step * dw
            model.w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * cfg.l1, 0)
            model.v[used] -= cfg.rate * dv / np.sqrt(gv[used])
            gb += g.sum() ** 2
            model.bias -= cfg.rate * float(g.sum()) / np.sqrt(gb)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", cfg: Config = Config()) -> Model:
    """Fits on at most about ``cfg.sample`` of the labelled rows that ``learn``
    (over ``_id``) allows; each is one term set, weighted by the
    inverse of its label's share in the sample."""
    C.ready(docs.sparkSession)
    chosen = C.bounded_labels(labels, id_col, label_col, learn, cfg.sample, cfg.seed)
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(chosen), "_id"))
    texts = C.bounded_rows(texts, "_id", "_text", 2 * cfg.sample, cfg.sample_bytes, cfg.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, of = term_sets(batch.column("_text"), cfg)
            yield pa.record_batch([batch.column("_id").cast(pa.int64()), batch.column("_y"), batch.column("_share"),
                                   pa.array([idx[a:b].tobytes() for a, b in zip(of, of[1:], strict=False)], pa.binary())],
                                  names=["_id", "_y", "_share", "x"])

    rows = texts.select(F.col("_id").cast("long"), "_y", "_share", "_text").mapInArrow(
        run, "_id long, _y int, _share double, x binary").collect()   # bounded by cfg.sample
    rows.sort(key=lambda r: (r["_id"], r["x"]))
    if not rows:
        return Model(cfg, constant=0.5)
    idx = np.frombuffer(b"".join(r["x"] for r in rows), np.int32)
    of = np.concatenate([[0], np.cumsum([len(r["x"]) // 4 for r in rows])])
    return fit_machine(idx, of, np.array([r["_y"] for r in rows], float), cfg, 1 / np.array([r["_share"] for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more toxic) and ``predicted`` (score >= 0.5)."""
    C.ready(docs.sparkSession)
    cfg = model.cfg

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        return pa.array(model.probability(*term_sets(text, cfg)), pa.float64())

    return (docs.withColumn("score", probability(F.col(text_col)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
