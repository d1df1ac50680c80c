"""Hard negatives by anchor-clustered shared lists with certified termination.

Anchors are clustered by direction. For a cluster the candidates are sorted once
by an upper bound of their score with any member of length 1: with a candidate
at an angle t from the cluster's centre and members within r of it, the bound is
the candidate's length times cos(max(0, t - r)). Every member walks this shared
list from its top and stops where its length times the bound of all that follow
is below what it already has: then nothing after can enter its answer. Scores are
exact integer products, so answers are exact.

The first search finds an anchor's positives, the second the best candidates
between two scores for each of them. Either search runs first over a hash sample
(``probe`` of the candidates): the score and id of a sampled list's last row are a
limit that the whole answer can't fall below, so the run over all candidates
starts with it and a task sends a few rows for each answer, however many tasks
there are.

At scale: candidates stay where they are read; anchors travel, in blocks of
``anchors`` rows at most, one pass over the candidates for each block (a stated
query set against all rows, in blocks). What a task holds is bounded by a batch of
candidates and a block of answers; hot labels or vectors change nothing, as no row
is dealt by them. Answers are cut per task before they are shuffled.

Nulls: rows with a NULL id, label or vector, or with a NULL or non-finite component
take no part, nor do those with a component beyond 2**20 (their products would
leave 64 bits). Vectors of unequal length are compared as if the shorter ended in
zeros. Equal scores go by the smaller id. A repeated row is a row of its own among
the candidates; a row is never its own positive, nor is one that repeats its id.
Anchors that repeat id, label and vector are answered once. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm import embeddings as E
from farebox.llm.neardup import Keeper


@dataclass(frozen=True)
class Config:
    scale: int = 256            # a component x counts as floor(scale * x)
    positives: int = 5          # of an anchor
    negatives: int = 10         # of a positive
    least: int = 30             # percent of the positive's score a negative has
    most: int = 90              # at least and at most
    clusters: int = 32          # of a block of anchors
    anchors: int = 8192         # in a block
    step: int = 2048            # candidates that a member walks at a time
    probe: float = 1 / 16       # of the candidates, for the first limits
    seed: int = 12


FARTHEST = 1 << 20
NOWHERE = -np.iinfo(np.int64).max             # below every score; its negative is a number too
#: Added to cosines of bounds: more than the rounding of angles takes away.
ROUNDING = 1e-7


def quantised(vectors: DataFrame, label: Column, id_col: str, vector_col: str, cfg: Config) -> DataFrame:
    """vec_id, label and q (integer components) of the rows that take part."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"))
    far = F.exists("v", lambda c: F.abs(c) > FARTHEST)
    return (rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & E.usable("v") & ~far)
            .select("vec_id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * cfg.scale).cast("long")).alias("q")))


class Clusters:
    """Anchors by direction: spherical k-means from distant rows."""

    def __init__(self, x: np.ndarray, n: int, rounds: int = 5) -> None:
        self.length = np.sqrt(np.einsum("ij,ij->i", x, x))
        u = E.units(x)
        centre = u[:1]
        while len(centre) < min(n, len(u)):
            centre = np.concatenate([centre, u[[int((u @ centre.T).max(1).argmin())]]])
        for _ in range(rounds):
            of = (u @ centre.T).argmax(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, of, u)
            centre = np.where(np.abs(sums).sum(1, keepdims=True) > 0, E.units(sums), centre)
        self.of = (u @ centre.T).argmax(1)
        self.centre = centre
        near = np.clip(np.einsum("ij,ij->i", u, centre[self.of]), -1, 1)
        self.radius = np.array([np.arccos(near[self.of == c]).max(initial=0.0) for c in range(len(centre))])
        zero = self.length == 0                            # no direction: every score is 0
        self.radius[np.unique(self.of[zero])] = math.pi


class Answers:
    """The best rows of each of a block's questions: score, id and row label.

    ``floor`` and ``floor_id`` are the last row that an answer can hold."""

    def __init__(self, k: int, floor: np.ndarray, floor_id: np.ndarray) -> None:
        n = len(floor)
        self.k, self.floor, self.floor_id = k, floor, floor_id
        self.score = np.full((n, k), NOWHERE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def last(self) -> np.ndarray:
        """The least score that could still enter each answer."""
        return np.maximum(self.score[:, -1], self.floor)

    def put(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        on = (score > self.floor[q]) | ((score == self.floor[q]) & (ids <= self.floor_id[q]))
        on &= score >= self.score[q, -1]
        if on.any():
            s = np.concatenate([self.score[q], score[on]])
            i = np.concatenate([self.id[q], ids[on]])
            by = np.lexsort((i, -s))[:self.k]
            self.score[q], self.id[q] = s[by], i[by]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, j = np.nonzero(self.score > NOWHERE)
        return q, self.score[q, j], self.id[q, j]


@dataclass
class Block:
    """Anchors and their questions: a question asks for the ``k`` best rows of
    its anchor that have the anchor's label (``same``) or another one, with a
    score of ``low`` to ``high``."""

    id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    clusters: Clusters
    anchor: np.ndarray           # of each question
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    floor_id: np.ndarray
    same: bool
    k: int

    def walk(self, answers: Answers, ids: np.ndarray, label: np.ndarray, q: np.ndarray, step: int) -> int:
        """Every anchor walks its cluster's list of these candidates; how many
        products that took."""
        x = q.astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        angle = np.arccos(np.clip(E.units(x) @ self.clusters.centre.T, -1, 1))
        exact = length.max(initial=0) * self.clusters.length.max(initial=0) < 2 ** 52   # products fit a double
        done = 0
        for c in np.unique(self.clusters.of):
            mine = np.flatnonzero(self.clusters.of == c)
            bound = length * (np.cos(np.clip(angle[:, c] - self.clusters.radius[c], 0, math.pi)) + ROUNDING)
            order = np.argsort(-bound, kind="stable")
            asks = np.flatnonzero(np.isin(self.anchor, mine))
            for lo in range(0, len(order), step):
                reach = self.clusters.length[self.anchor[asks]] * bound[order[lo]]
                asks = asks[(reach >= answers.last()[asks]) & (reach >= self.low[asks])]
                if not len(asks):
                    break
                at = order[lo:lo + step]
                live = np.unique(self.anchor[asks])
                if exact:
                    score = (x[at] @ self.q[live].astype(np.float64).T).astype(np.int64)
                else:
                    score = q[at] @ self.q[live].T
                done += score.size
                column = np.searchsorted(live, self.anchor[asks])
                # what can enter an answer, of all questions at once
                s = score[:, column]
                fits = (s >= np.maximum(answers.last()[asks], self.low[asks])) & (s <= self.high[asks])
                fits &= (label[at][:, None] == self.label[self.anchor[asks]]) == self.same
                if self.same:
                    fits &= ids[at][:, None] != self.id[self.anchor[asks]]
                for j in np.flatnonzero(fits.any(0)):
                    on = np.flatnonzero(fits[:, j])
                    answers.put(asks[j], s[on, j], ids[at[on]])
        return done


def search(candidates: DataFrame, block: Block, dim: int, cfg: Config) -> DataFrame:
    """question, score and vec_id: each task's part of the answers."""
    sent = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        answers = Answers(block.k, block.floor, block.floor_id)
        for batch in batches:
            for lo in range(0, len(batch), 8192):
                part = batch.slice(lo, 8192)
                q = E.matrix(part.column("q"), dim).astype(np.int64)
                block.walk(answers, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), q, cfg.step)
        q, score, ids = answers.rows()
        yield pa.record_batch([pa.array(q), pa.array(score), pa.array(ids)], names=["question", "score", "vec_id"])

    return candidates.mapInArrow(run, "question long, score long, vec_id long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each question with their rank."""
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def answer(candidates: DataFrame, block: Block, dim: int, cfg: Config) -> tuple[np.ndarray, ...]:
    """question, rank, score and vec_id of the whole answers, ordered (a block's
    answers are bounded by its questions)."""
    few = candidates.filter(C.unit_hash("vec_id", cfg.seed) < cfg.probe)
    limits = best(search(few, block, dim, cfg), block.k).filter(F.col("rank") == block.k).toPandas()
    at = limits["question"].to_numpy(np.int64)
    block.floor, block.floor_id = block.floor.copy(), block.floor_id.copy()
    block.floor[at] = limits["score"].to_numpy(np.int64)
    block.floor_id[at] = limits["vec_id"].to_numpy(np.int64)
    got = best(search(candidates, block, dim, cfg), block.k).toPandas().sort_values(["question", "rank"])
    return tuple(got[c].to_numpy(np.int64) for c in ("question", "rank", "score", "vec_id"))


SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, cfg: Config = Config(),
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` an expression over the
    table (default: its label column)."""
    spark = vectors.sparkSession
    C.ready(spark)
    keep = Keeper(spark, "hard-negatives")
    rows = keep(quantised(vectors, F.col(label_col) if label is None else label, id_col, vector_col, cfg), "rows")
    dim = rows.agg(F.max(F.size("q"))).first()[0] or 0
    asked = keep(rows.filter(is_anchor).distinct(), "anchors")
    # blocks of anchors by rank ranges of a hash: bounded whatever their number
    blocks = max(1, math.ceil(asked.count() / (cfg.anchors / 2)))
    asked = keep(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks))), "blocks")
    parts = []
    for b in range(blocks):
        part = asked.filter(F.col("block") == b).orderBy("vec_id", "label", "q").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        q = E.matrix(part.column("q"), dim).astype(np.int64)
        ids, of = (part.column(c).to_numpy() for c in ("vec_id", "label"))
        clusters = Clusters(q.astype(np.float64), cfg.clusters)
        n = len(ids)
        none, least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, NOWHERE), np.full(n, np.iinfo(np.int64).max)
        positives = Block(ids, of, q, clusters, np.arange(n), least, most, least, none, True, cfg.positives)
        asks, _, score, found = answer(rows, positives, dim, cfg)
        if not len(asks):
            continue
        # 100 * negative between least and most percent of the positive, in whole numbers
        low, high = -((-cfg.least * score) // 100), (cfg.most * score) // 100
        floor = np.full(len(asks), NOWHERE)
        negatives = Block(ids, of, q, clusters, asks, low, high, floor, np.full(len(asks), np.iinfo(np.int64).max), False, cfg.negatives)
        question, rank, value, other = answer(rows, negatives, dim, cfg)
        parts.append(keep(spark.createDataFrame(pa.table({
            "anchor_id": ids[asks[question]], "positive_id": found[question], "rank": rank.astype(np.int32), "negative_id": other,
            "positive_score": score[question], "negative_score": value}).to_pandas(), SCHEMA), f"answers{b}"))
    out = spark.createDataFrame([], SCHEMA)
    for part in parts:
        out = out.union(part)
    return out
