"""Embedding near-duplicates by a pivot-permutation index.

Pivots are mutually distant vectors of a bounded sample. A vector is described by
its ``nearest`` pivots in order. The inverted lists hold vectors by sets of
``shared`` pivots, so two vectors meet in a list exactly if they share that many
of their nearest pivots; how many lists they share tells the shared-pivot count.
Vectors that meet and whose sign sketches don't rule out the wanted cosine are
compared in double precision.

Groups of near copies are never expanded into pairs. Vectors of one cell (the
same first pivots in the same order) around the cell's mean form a ball of half
the linking angle: by the triangle inequality all in it are linked, which needs a
count only. Lists hold balls, each once. Two balls are wholly linked or wholly
apart if their radii say so; of the others the members are compared as blocks of
rows, a matrix product for two blocks, of which only counts by member come back.
So every count is exact for all pairs of balls that meet.

At scale: aggregates are combined before they are shuffled (a hot vector, cell or
list costs a row a task), the number of pivots grows with the square root of the
number of different vectors, and each step is a table in the shared folder. The
driver and the broadcast hold the pivots only, ``most_pivots`` at most.

Recall: two vectors at a cosine of 0.9 share three of nine pivots in about 98 % of
cases and nearly always from 0.95 on; no pair below the threshold is linked.

Nulls: a vector that is NULL, empty or zero or holds a NULL or non-finite
component is linked with nothing and is its own component. Vectors of unequal
length are compared as if the shorter ended in zeros. A NULL id takes part in
links; its component is the smallest id reached (NULL if none) and it is kept.
Repeated rows are vectors of their own, each with a result row. An empty table
gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm import embeddings as E
from farebox.llm.neardup import Keeper, components

#: Angles (radians) by which a certified bound is kept away from the threshold.
MARGIN = 1e-7


@dataclass(frozen=True)
class Config:
    cosine: float = 0.9         # link at this cosine or more
    nearest: int = 9            # pivots that describe a vector
    shared: int = 3             # of them in common for a candidate
    first: int = 2              # ordered pivots that make a cell
    least_pivots: int = 64
    most_pivots: int = 32_768   # the pivots go to every task
    spread: float = 0.7         # largest cosine between two pivots
    bits: int = 128             # of a sign sketch
    miss: float = 5.0           # standard deviations of differing bits that are allowed
    block: int = 256            # members of a ball compared at a time
    salts: int = 32             # ways in which the rows of a cell meet its centre
    seed: int = 11

    def pivots(self, vectors: int) -> int:
        return int(min(self.most_pivots, max(self.least_pivots, 2 * math.sqrt(vectors))))


def choose_pivots(x: np.ndarray, n: int, spread: float) -> np.ndarray:
    """Up to ``n`` rows of ``x``, in order, none closer than ``spread`` to an
    earlier one."""
    out = np.zeros((min(n, len(x)), x.shape[1]))
    got = 0
    for row in x:
        if got < len(out) and (not got or (out[:got] @ row).max() < spread):
            out[got] = row
            got += 1
    return out[:got]


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each row, nearest first (ties: the smaller)."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ pivots.T
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(s), 1))
        by = np.lexsort((near, -np.take_along_axis(s, near, 1)), axis=1)
        out[lo:lo + 1024] = np.take_along_axis(near, by, 1)
    return out


def set_keys(near: np.ndarray, size: int) -> np.ndarray:
    """A number for each set of ``size`` of a row's pivots: (rows, sets)."""
    asc = np.sort(near, axis=1)
    key = np.zeros((len(near), math.comb(near.shape[1], size)), np.int64)
    for at in zip(*itertools.combinations(range(near.shape[1]), size), strict=True):
        key = (key << (63 // size)) | asc[:, list(at)]
    return key


def sketches(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Signs along ``bits`` fixed directions, as integers: (rows, bits / 64)."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits))
    return np.packbits(x @ planes > 0, axis=1).view("<i8")


def most_bits(cfg: Config) -> int:
    """Differing bits that a pair at the threshold stays under but for ``miss``
    standard deviations."""
    p = math.acos(cfg.cosine) / math.pi
    return math.ceil(cfg.bits * p + cfg.miss * math.sqrt(cfg.bits * p * (1 - p)))


def cluster(vectors: DataFrame, cfg: Config = Config(), id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    C.ready(spark)
    keep = Keeper(spark, "vector-dedup")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    source = source.withColumn("v", F.when(E.usable("v"), F.col("v").cast("array<double>")))
    source = source.withColumn("v", F.when(F.exists("v", lambda x: x != 0), F.col("v")))
    dim = source.agg(F.max(F.size("v"))).first()[0] or 0
    rows = source.select("vec_id", "v", F.md5(F.to_json(F.struct("v")).cast("binary")).alias("text"))

    # equal vectors are one class, numbered in the written table
    classes = keep(rows.filter("v IS NOT NULL").groupBy("text").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size = cfg.pivots(n)
    sample = np.array([r["v"] + [0.0] * (dim - len(r["v"])) for r in
                       classes.orderBy(F.xxhash64("text", F.lit(cfg.seed)), "cid").select("v").limit(2 * size).collect()])
    pivots = choose_pivots(E.units(sample), size, cfg.spread)
    k = min(cfg.nearest, len(pivots))
    shared, first = min(cfg.shared, k), min(cfg.first, k)
    sent = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = E.units(E.matrix(batch.column("v"), dim))
            near = nearest(u, sent.value, k)
            cell = np.zeros(len(u), np.int64)
            for j in range(first):
                cell = cell * np.int64(len(sent.value) + 1) + near[:, j]
            yield pa.record_batch([batch.column("cid"), batch.column("least"), batch.column("times"),
                                   E.lists(u), E.lists(near), pa.array(cell)],
                                  names=["cid", "least", "times", "u", "near", "cell"])

    described = keep(classes.select("cid", "least", "times", "v").mapInArrow(
        describe, "cid long, least long, times long, u array<double>, near array<long>, cell long"), "described")
    members = keep(_balls(described, cfg, dim), "members")
    weighed = (members.groupBy("ball").agg(F.sum("times").alias("weight"), F.max("angle").alias("radius"),
                                           F.count(F.lit(1)).alias("members"), F.min("least").alias("least"),
                                           F.first("centre").alias("centre")))
    balls = keep(weighed, "balls")
    pairs = keep(_candidates(members, balls, cfg, shared), "pairs")
    judged = keep(_judge(pairs, balls, cfg, dim), "judged")

    whole = judged.filter("linked").select("a", "b")
    both = whole.union(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("ball", "other")
    counts = (both.join(balls.select(F.col("ball").alias("other"), "weight"), "other")
              .groupBy("ball").agg(F.sum("weight").alias("more")))
    blocks = keep(_compare_blocks(judged.filter("NOT linked"), members, balls, cfg, dim), "blocks")
    singly = blocks.filter("links > 0 AND cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("single"))
    links = whole.union(blocks.filter("cid IS NULL").select("a", "b").distinct())
    labels = components(keep(links, "links"), keep)
    owner = labels.join(balls.select(F.col("ball").alias("id"), "least"), "id").groupBy("label").agg(F.min("least").alias("component"))
    of_ball = (balls.select("ball", "weight", "least")
               .join(labels.select(F.col("id").alias("ball"), "label"), "ball", "left").join(owner, "label", "left")
               .join(counts, "ball", "left")
               .select("ball", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
                       F.when(F.col("label").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component")))
    found = (members.select("cid", "ball").join(of_ball, "ball").join(singly, "cid", "left")
             .join(classes.select("cid", "text"), "cid")
             .select("text", (F.col("links") + F.coalesce("single", F.lit(0))).alias("n_links"), "component"))
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("text")).alias("text")).join(found, "text", "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _balls(described: DataFrame, cfg: Config, dim: int) -> DataFrame:
    """``described`` with each class's ball (its number is a member's), the
    ball's centre and the angle to it. The centre is the mean of a cell, then of
    those within the linking angle of it; who is not within half that angle of
    the second mean is a ball of its own."""
    spark = described.sparkSession
    theta = math.acos(cfg.cosine)

    def means(df: DataFrame) -> DataFrame:
        return df.groupBy("cell").agg(Summarizer.mean(array_to_vector("u")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell", vector_to_array("m").alias("centre"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, c = (E.matrix(batch.column(x), dim) for x in ("u", "centre"))
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", u, E.units(c)), -1, 1))
            yield pa.record_batch([batch.column("cid"), pa.array(angle), E.lists(E.units(c))], names=["cid", "angle", "centre"])

    def to_centre(df: DataFrame, centres: DataFrame) -> DataFrame:
        # a hot cell is met by ``salts`` copies of its centre
        spread = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
        return (df.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(cfg.salts)).cast("int")).join(spread, ["cell", "salt"])
                .select("cid", "u", "centre").mapInArrow(angles, "cid long, angle double, centre array<double>"))

    crowded = described.select("cid", "cell", "u")
    near = to_centre(crowded, means(crowded)).filter(F.col("angle") <= theta).select("cid")
    second = to_centre(crowded, means(crowded.join(near, "cid", "left_semi"))).filter(F.col("angle") <= theta / 2 - MARGIN)
    inside = Keeper(spark, "vector-dedup")(second, "inside")
    named = (described.select("cid", "cell").join(inside.select("cid"), "cid").groupBy("cell")
             .agg(F.min("cid").alias("ball"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell", "ball"))
    return (described.join(inside, "cid", "left").join(named, "cell", "left")
            .withColumn("in", F.col("angle").isNotNull() & F.col("ball").isNotNull())
            .select("cid", "least", "times", "u", "near",
                    F.when(F.col("in"), F.col("ball")).otherwise(F.col("cid")).alias("ball"),
                    F.when(F.col("in"), F.col("angle")).otherwise(0.0).alias("angle"),
                    F.when(F.col("in"), F.col("centre")).otherwise(F.col("u")).alias("centre")))


def _candidates(members: DataFrame, balls: DataFrame, cfg: Config, shared: int) -> DataFrame:
    """Pairs of balls (a < b) that meet in a list and whose sketches allow a link."""
    words = [f"s{j}" for j in range(cfg.bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                near = np.asarray(part.column("near").flatten()).reshape(len(part), -1)
                key = set_keys(near, shared)
                u = np.asarray(part.column("u").flatten()).reshape(len(part), -1)
                sketch = np.repeat(sketches(u, cfg.bits, cfg.seed), key.shape[1], axis=0)
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(part.column("ball").to_numpy(), key.shape[1])),
                                       *[pa.array(np.ascontiguousarray(c)) for c in sketch.T]], names=["key", "ball", *words])

    schema = "key long, ball long, " + ", ".join(f"{w} long" for w in words)
    sized = members.select("ball", "near", "u").join(balls.select("ball", F.col("members").alias("m")), "ball")
    alone = sized.filter("m = 1").drop("m").mapInArrow(run, schema)
    many = (sized.filter("m > 1").drop("m").mapInArrow(run, schema).groupBy("key", "ball").agg(F.lit(1).alias("one"))
            .select("key", "ball", *[F.lit(None).cast("long").alias(w) for w in words]))
    lists = alone.union(many)
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    return (lists.alias("x").join(lists.alias("y"), "key").filter(F.col("x.ball") < F.col("y.ball"))
            .filter(F.coalesce(differ <= most_bits(cfg), F.lit(True)))
            .select(F.col("x.ball").alias("a"), F.col("y.ball").alias("b")).distinct())


def _judge(pairs: DataFrame, balls: DataFrame, cfg: Config, dim: int) -> DataFrame:
    """a, b and linked of the pairs that are wholly linked (true) or may be in
    part (false)."""
    theta = math.acos(cfg.cosine)
    side = lambda x: balls.select(F.col("ball").alias(x), F.col("centre").alias("c" + x), F.col("radius").alias("r" + x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (E.matrix(batch.column(c), dim) for c in ("ca", "cb"))
            reach = batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
            cosine = np.einsum("ij,ij->i", x, y)
            angle = np.arccos(np.clip(cosine, -1, 1))
            points = reach == 0
            linked = np.where(points, cosine >= cfg.cosine, angle + reach <= theta - MARGIN)
            open_ = ~points & ~linked & (angle - reach <= theta + MARGIN)
            take = pa.array(np.flatnonzero(linked | open_))
            yield pa.record_batch([batch.column("a").take(take), batch.column("b").take(take),
                                   pa.array(linked).take(take)], names=["a", "b", "linked"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", "ra", "rb")
    return both.mapInArrow(run, "a long, b long, linked boolean")


def _compare_blocks(pairs: DataFrame, members: DataFrame, balls: DataFrame, cfg: Config, dim: int) -> DataFrame:
    """For balls linked in part: cid and links (rows linked in the other ball) of
    each member, and a row without cid for every two blocks with a link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    inside = members.select("ball", "cid", "times", "u").join(balls.select("ball", "members"), "ball").join(ids, "ball")
    # a ball's blocks: as many as its members need, filled by a hash
    blocks = (inside.withColumn("block", F.pmod(F.xxhash64("cid"), F.ceil(F.col("members") / cfg.block)))
              .groupBy("ball", "block").agg(F.collect_list(F.struct("cid", "times", "u")).alias("rows")))
    side = lambda x: blocks.select(F.col("ball").alias(x), F.col("rows.cid").alias("i" + x),
                                   F.col("rows.times").alias("t" + x), F.flatten("rows.u").alias("u" + x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[np.ndarray] = []
            for r in range(len(batch)):
                a, b, ia, ib, ta, tb, ua, ub = (batch.column(c)[r] for c in ("a", "b", "ia", "ib", "ta", "tb", "ua", "ub"))
                ia, ib, ta, tb = (np.asarray(c.values, np.int64) for c in (ia, ib, ta, tb))
                linked = np.asarray(ua.values).reshape(-1, dim) @ np.asarray(ub.values).reshape(-1, dim).T >= cfg.cosine
                if linked.any():
                    got += [np.stack([ia, linked @ tb]), np.stack([ib, ta @ linked]), np.array([[-1 - r], [0]])]
            out = np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.int64)
            edge = out[0] < 0
            at = pa.array(np.where(edge, -1 - out[0], 0), mask=~edge)
            yield pa.record_batch([pa.array(out[0], mask=edge), pa.array(out[1]), batch.column("a").take(at), batch.column("b").take(at)],
                                  names=["cid", "links", "a", "b"])

    return (pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
            .mapInArrow(run, "cid long, links long, a long, b long"))
