"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of hashed word shingles. Equal word sequences are one class,
whose smallest id stands for it, so copies are never paired. Representatives
that agree on a band of their signature meet in a bucket; a bucket compares its
members with its smallest id instead of with each other. A compared pair's
signatures are read batch by batch, and the pair is dropped as soon as the
posterior chance of a similarity at the threshold falls below the miss
probability; survivors are verified exactly on the full shingle sets. Links form
components. Members of a bucket that are still in different components are then
compared too, if their rare shingles and packed signatures allow a link: on their
shingle sets within the bucket's join, which makes no rows but links and leaves
one of them for each two components. So a link is lost only where every band
misses it, or the pruning does: at the defaults a pair at similarity 0.8 is missed
with a chance under 4e-6, plus 1e-7 by pruning.

At scale: band rows are aggregated before they are shuffled, hot buckets are
joined with a row per bucket (a join Spark can split), components are found by
min-label rounds with pointer jumping, and every round's result is a written
table in the shared folder, by as many tasks as its input takes. Nothing is
collected but counts.

A row is known by its id and a hash of its text, so rows that share an id but not
their text are documents of their own: each is linked by its own text.

Nulls: a NULL or empty text, or one without words, has no shingles and is linked
with nothing; a NULL id gets the component of its text (NULL if no id is reached)
and is kept. Repeated rows are listed each. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.session import work_path
from farebox.sources.layers import remove_path


@dataclass(frozen=True)
class Config:
    words: int = 5              # words per shingle
    percent: int = 80           # link at 100 * intersection >= percent * union
    bands: int = 42
    rows: int = 6               # signature values per band
    batch: int = 28             # signature values compared between prunings
    miss: float = 1e-7          # posterior chance at which a pair is dropped
    broadcast_ids: int = 1_000_000  # ids sent to every task at most (8 bytes each)
    rare: int = 8               # a shingle of at most so many documents is rare
    strays: int = 1_024         # strays of a bucket that meet its members in one task
    seed: int = 6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


# --- signatures -------------------------------------------------------------

def sets(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bounded range of texts: distinct shingles (ascending within a
    text, 48 bits), their offsets, and a 64-bit hash of each word sequence."""
    for lo, hi in C.slices(col):
        data, offsets = C.utf8(col.slice(lo, hi - lo))
        tokens = C.Tokens(C.LOWER[data], offsets, C.PLAIN)
        h = tokens.hashes()
        s, of = C.shingles(h, tokens.of, k)
        doc = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(of))
        key = np.sort((doc << np.uint64(48)) | (s >> np.uint64(16)))   # ranges have fewer than 2^16 texts
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        key = key[fresh]
        counts = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=hi - lo)
        of2 = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(tokens.of[:-1], np.diff(tokens.of)).astype(np.uint64)
        seq = C.mix(C.segment_sum(C.mix(h + C.mix(place + np.uint64(1))), tokens.of) + np.diff(tokens.of).astype(np.uint64))
        yield lo, hi, key & np.uint64((1 << 48) - 1), of2, seq


def signatures(shingle: np.ndarray, of: np.ndarray, cfg: Config) -> np.ndarray:
    """16 bits of each minimum: (texts, hashes); texts without shingles get 0."""
    rng = np.random.default_rng(cfg.seed)
    flip = rng.integers(0, 1 << 32, cfg.hashes, dtype=np.uint64).astype(np.uint32)
    times = (rng.integers(0, 1 << 31, cfg.hashes, dtype=np.uint64) * 2 + 1).astype(np.uint32)
    x = C.mix(shingle).astype(np.uint32)
    out = np.zeros((len(of) - 1, cfg.hashes), np.uint16)
    full = np.flatnonzero(np.diff(of) > 0)
    if len(full):
        v = np.empty_like(x)
        for j in range(cfg.hashes):
            np.bitwise_xor(x, flip[j], out=v)
            np.multiply(v, times[j], out=v)
            out[full, j] = np.minimum.reduceat(v, of[full]).astype(np.uint16)
    return out


#: Columns of the packed signature: four bits of each value, 16 values a column.
PACKED = [f"p{i}" for i in range(16)]


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each of up to 256 signature values, as 16 integers a row."""
    nibble = np.zeros((len(sig), 256), np.uint8)
    nibble[:, :sig.shape[1]] = sig >> 12
    return (nibble[:, ::2] | (nibble[:, 1::2] << 4)).view("<i8")


def agreeing(x: str, y: str) -> Column:
    """How many of the 256 packed values of two rows agree (a zero nibble of
    their xor), counted on whole integers."""
    total = F.lit(0)
    for c in PACKED:
        d = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        some = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        total = total + (16 - F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111))))
    return total


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))


def texts_of(docs: DataFrame, ids: DataFrame, n_ids: int, reps: DataFrame, cfg: Config) -> DataFrame:
    """doc_id (a class's number) and text of the classes ``ids``, from the row
    that stands for each."""
    wanted = reps.join(ids.select(F.col("doc_id").alias("rep")), "rep").select(
        F.col("rep").alias("class"), F.col("of.doc_id").alias("id"), F.col("of.text_hash").alias("hash"))
    few = F.broadcast(wanted) if n_ids <= cfg.broadcast_ids else wanted
    # rows that repeat id and text are one
    return (docs.join(few, docs["doc_id"].eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
            .groupBy(F.col("class").alias("doc_id")).agg(F.max("text").alias("text")))


def sign(docs: DataFrame, id_col: str, text_col: str, cfg: Config) -> DataFrame:
    """doc_id and text_hash of each row, the hash of its word sequence, n_shingles
    and signature."""
    C.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("near_duplicates")
        for batch in batches:
            col = batch.column("text")
            for lo, hi, shingle, of, seq in sets(col, cfg.words):
                sig = signatures(shingle, of, cfg)
                yield pa.record_batch([
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(seq.view(np.int64)),
                    pa.array(np.diff(of).astype(np.int64)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                    *[pa.array(c) for c in np.ascontiguousarray(packed(sig).T)]],
                    names=["doc_id", "text_hash", "seq", "n_shingles", "sig", *PACKED])

    return (keyed_texts(docs, id_col, text_col)
            .mapInArrow(run, "doc_id long, text_hash long, seq long, n_shingles long, sig binary, " + ", ".join(f"{p} long" for p in PACKED)))


# --- verification -----------------------------------------------------------

def least_matches(n: int, t: float, miss: float) -> int:
    """The fewest of ``n`` values that must agree: below it, the posterior chance
    (uniform prior) that they agree with a probability of ``t`` is under ``miss``."""
    chance = 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if chance >= miss:
            return m
    return n


def fewest(cfg: Config) -> list[tuple[int, int]]:
    """(values read, fewest matches to go on) after each batch."""
    return [(n, least_matches(n, cfg.percent / 100, cfg.miss))
            for n in [*range(cfg.batch, cfg.hashes, cfg.batch), cfg.hashes]]


def likely(pairs: DataFrame, sigs: DataFrame, cfg: Config, size: int) -> DataFrame:
    """The pairs (a, b) that their set sizes and signatures leave possible.
    ``size``: bytes of the signatures compared, about."""
    C.ready(pairs.sparkSession)
    side = lambda x: sigs.select(F.col("rep").alias(x), F.col("n_shingles").alias("n" + x), F.col("sig").alias("s" + x))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    both = both.filter((100 * F.least("na", "nb") >= cfg.percent * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("near_duplicates")
        steps = fewest(cfg)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, cfg.hashes) for c in ("sa", "sb"))
                alive, matches, before = np.arange(len(part)), np.zeros(len(part), np.int64), 0
                for n, least in steps:
                    matches = matches + (x[alive, before:n] == y[alive, before:n]).sum(1)
                    stay = matches >= least
                    alive, matches, before = alive[stay], matches[stay], n
                yield part.select(["a", "b"]).take(pa.array(alive))

    return sized(both.select("a", "b", "sa", "sb"), size).mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, cfg: Config, size: int) -> DataFrame:
    """The pairs whose full shingle sets link. ``texts``: of the classes in pairs;
    ``size``: bytes of all pairs' texts, about."""
    C.ready(pairs.sparkSession)
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias("t" + x))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("near_duplicates")
        for batch in batches:
            linked = np.zeros(len(batch), bool)
            for lo, hi in C.slices(batch.column("ta"), C.SLICE_BYTES // 2):
                got = []
                for c in ("ta", "tb"):
                    parts = [(x0, s, of) for x0, _, s, of, _ in sets(batch.column(c).slice(lo, hi - lo), cfg.words)]
                    got.append(np.concatenate([(np.repeat(np.arange(len(of) - 1, dtype=np.uint64) + np.uint64(x0), np.diff(of)) << np.uint64(48)) | s
                                               for x0, s, of in parts]))
                pair = lambda v: np.bincount((v >> np.uint64(48)).astype(np.int64), minlength=hi - lo)  # noqa: B023, E731
                every = np.sort(np.concatenate(got))
                common = pair(every[1:][every[1:] == every[:-1]])
                union = pair(every) - common
                linked[lo:hi] = (100 * common >= cfg.percent * union) & (common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return sized(both.select("a", "b", "ta", "tb"), size).mapInArrow(run, "a long, b long")


def shingle_rows(texts: DataFrame, cfg: Config) -> DataFrame:
    """(rep, shingle) of the classes of ``texts``."""
    C.ready(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("near_duplicates")
        for batch in batches:
            rep = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, shingle, of, _ in sets(batch.column("text"), cfg.words):
                yield pa.record_batch([pa.array(np.repeat(rep[lo:hi], np.diff(of))), pa.array(shingle.astype(np.int64))],
                                      names=["rep", "shingle"])

    return texts.mapInArrow(run, "rep long, shingle long")


# --- components -------------------------------------------------------------

def components(links: DataFrame, keep) -> DataFrame:
    """id and label (smallest id reachable) of every id in ``links`` (a, b)."""
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    size = 32 * both.count()
    labels = keep(sized(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), size), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m")))
        lower = keep(sized(labels.join(near, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("old")), size), "labels")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = keep(sized(lower.join(jump, "label").select("id", F.least("label", "up").alias("label"), "old"), size), "labels")
        if new.filter("label != old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


# --- the operator -----------------------------------------------------------

def cluster(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of
    every document; then its text_hash, and stays: whether its id and text are
    the first of its component, which leaves one text of each."""
    spark = docs.sparkSession
    keep = Keeper(spark)
    texts = keyed_texts(docs, id_col, text_col)
    signed = keep(sign(docs, id_col, text_col, cfg), "signed")
    n, words = signed.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    # bytes, about: of all signatures, of all band rows, of a text (or a set in memory)
    sig_bytes, band_bytes, text_bytes = n * (2 * cfg.hashes + 256), n * cfg.bands * 32, 8 * (words or 0) // max(n, 1) + 64
    # a class: equal word sequences (64-bit hash, set size and signature agree)
    same = ["seq", "n_shingles"]
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")       # ids before NULL
    # a class has a number, fixed in the written table, and a row that stands for it
    reps = keep(sized(signed.filter(F.col("n_shingles") > 0).groupBy(*same, F.md5("sig").alias("sm"))
                      .agg(F.min(row).alias("of"), *[F.first(c).alias(c) for c in ("sig", *PACKED)]), sig_bytes)
                .withColumn("rep", F.monotonically_increasing_id()), "classes")
    sigs = reps.select("rep", "n_shingles", "sig", *PACKED)
    reps = reps.select(*same, "sm", "of", "rep")
    width = 2 * cfg.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(cfg.bands - 1)),
                        lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))
    banded = sigs.select("rep", F.posexplode(bands).alias("band", "bucket"))
    met = keep(sized(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("head"))
                     .filter(F.col("size") > 1), band_bytes), "buckets")
    members = keep(sized(banded.join(met, "bucket"), band_bytes), "members")
    stars = members.filter("rep != head").select(F.col("head").alias("a"), F.col("rep").alias("b"), "bucket")

    def verified(pairs: DataFrame) -> DataFrame:
        left = keep(likely(pairs, sigs, cfg, sig_bytes + pairs.count() * 4 * cfg.hashes), "likely")
        n_left = left.count()
        ids = keep(sized(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 32 * n_left), "ids")
        return keep(confirm(left, texts_of(texts, ids, ids.count(), reps, cfg), cfg, 2 * n_left * text_bytes), "links")

    def labelled(rows: DataFrame, labels: DataFrame, col: str, name: str) -> DataFrame:
        return (rows.join(labels.select(F.col("id").alias(col), F.col("label").alias(name)), col, "left")
                .withColumn(name, F.coalesce(name, col)))

    # every member with the smallest head it meets
    first = keep(sized(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), band_bytes), "pairs")
    links = verified(first)
    labels = components(links, keep)
    # the other heads it meets, where not yet in one component
    others = labelled(labelled(stars.groupBy("a", "b").agg(F.lit(1)).select("a", "b"), labels, "a", "la"), labels, "b", "lb")
    second = keep(sized(others.filter("la != lb").select("a", "b").join(first, ["a", "b"], "left_anti"), band_bytes), "pairs")
    found = verified(second)
    if not found.isEmpty():
        links = links.union(found)
        labels = components(links, keep)
    # members of one bucket still apart: those outside its main component with all others
    marked = keep(sized(labelled(members.filter("size > 2"), labels, "rep", "label"), band_bytes), "marked")
    main = (marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
            .filter("parts > 1").select("bucket", F.col("main.label").alias("main")))
    apart = keep(sized(marked.join(main, "bucket"), band_bytes), "apart")
    n_apart = apart.count()
    if n_apart:
        # Pairs that share a rare shingle are listed by it, a few for each. In any
        # other pair the rare shingles of u are outside v, and a link needs
        # (100 + p) * rare(u) <= 100 * |u| - p * |v|, and the same for v.
        ids = keep(sized(apart.select(F.col("rep").alias("doc_id")).distinct(), 16 * n_apart), "ids")
        n_ids = ids.count()
        rows = keep(shingle_rows(sized(texts_of(texts, ids, n_ids, reps, cfg), n_ids * text_bytes), cfg), "shingles")
        n_rows = rows.count()
        counted = keep(sized(rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle"), 32 * n_rows), "counted")
        is_rare = F.col("n") <= cfg.rare
        parts = counted.groupBy("rep").agg(F.count_if(is_rare).alias("alone"), F.collect_list(F.when(~is_rare, F.col("shingle"))).alias("common"))
        shared = counted.filter(is_rare & (F.col("n") > 1)).select("shingle", "rep")
        shared = (shared.select("shingle", F.col("rep").alias("a")).join(shared.select("shingle", F.col("rep").alias("b")), "shingle")
                  .filter("a < b").select("a", "b"))
        p, t = cfg.percent, cfg.percent / 100
        # a pair is compared in the first bucket that it shares
        spare = apart.join(sigs.withColumn("bands", bands).drop("sig"), "rep").join(parts, "rep").select(
            "bucket", "rep", "label", "main", "head", F.col("n_shingles").alias("n"), *PACKED, "common",
            F.slice("bands", F.lit(1), F.col("band")).alias("before"),
            (100 * F.col("n_shingles") - (100 + p) * F.col("alone")).alias("room"))
        spare = keep(sized(spare.filter(F.col("room") * 100 >= p * p * F.col("n")), n_apart * (text_bytes + 16 * cfg.bands + 256)), "spare")
        # and their packed signatures must agree as often as pruning asks for
        agree = least_matches(cfg.hashes, t + (1 - t) / 16, cfg.miss) + 256 - cfg.hashes
        # a bucket's strays go to its members in groups of about cfg.strays, a group to a key
        many = (spare.filter("label != main").groupBy("bucket").agg(F.count(F.lit(1)).alias("strays"))
                .select("bucket", F.ceil(F.col("strays") / cfg.strays).cast("int").alias("groups")))
        u = spare.filter("label != main").join(many, "bucket").withColumn("group", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int"))
        v = spare.filter("rep != head").join(many, "bucket").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        u, v = u.alias("u"), v.alias("v")
        # and then the sets themselves: the rest of a pair not listed by a rare
        # shingle holds all that it shares, so the join makes links only, and of
        # those between two components one is enough
        sharing = F.size(F.array_intersect("u.common", "v.common"))
        direct = (u.join(v, ["bucket", "group"])
                  .filter((F.col("u.label") != F.col("v.label")) & (F.col("u.room") >= p * F.col("v.n")) & (F.col("v.room") >= p * F.col("u.n"))
                          & ((F.col("u.rep") < F.col("v.rep")) | (F.col("v.label") == F.col("v.main"))) & (agreeing("u", "v") >= agree)
                          & ~F.arrays_overlap("u.before", "v.before") & ((100 + p) * sharing >= p * (F.col("u.n") + F.col("v.n"))))
                  .groupBy(F.least("u.label", "v.label").alias("la"), F.greatest("u.label", "v.label").alias("lb"))
                  .agg(F.min(F.struct(F.col("u.rep").alias("a"), F.col("v.rep").alias("b"))).alias("one")).select("one.a", "one.b"))
        direct = keep(sized(direct, 64 * n_apart), "links")
        third = labelled(labelled(shared, labels, "a", "la"), labels, "b", "lb").filter("la != lb").select("a", "b").distinct()
        third = keep(sized(third.join(first.union(second), ["a", "b"], "left_anti"), 16 * cfg.rare * n_rows), "pairs")
        found = direct.union(verified(third))
        if not found.isEmpty():
            labels = components(links.union(found), keep)
    named = keep(sized(reps.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
                       .select(*same, "sm", "of", F.coalesce("label", "rep").alias("label")), sig_bytes), "named")
    firsts = keep(sized(named.groupBy("label").agg(F.min("of").alias("first")), sig_bytes), "firsts")
    keep.clear("signed", "named", "firsts")
    named = named.join(firsts, "label").select(*same, "sm", "first")
    rows = signed.select("doc_id", "text_hash", *same, F.md5("sig").alias("sm"))
    worded = F.col("n_shingles") > 0
    return (sized(rows.join(named, [*same, "sm"], "left"), n * 128)
            .withColumn("component_id", F.when(worded, F.col("first.doc_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash",
                    (~worded | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))).alias("stays")))


#: Bytes that a task of a step takes in, about.
TASK_BYTES = 16 << 20


def sized(step: DataFrame, size: int) -> DataFrame:
    """``step``, whose last tasks are as many as ``size`` bytes of input take, some
    per core at least: a round on few rows isn't dealt to all shuffle partitions.
    Goes before a Python step, which otherwise starts anew for each of them."""
    return step.coalesce(max(4 * step.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


class Keeper:
    """Writes a step's rows as Parquet into the shared folder and reads them back."""

    def __init__(self, spark: SparkSession, name: str = "near-dup") -> None:
        self.spark, self.base, self.written = spark, work_path(spark, name), []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{len(self.written) + 1:03d}-{name}"
        df.write.parquet(path)
        self.written.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *last: str) -> None:
        """Remove what was written, but the last table of each of these names:
        those that the result is still read from."""
        kept = {name: path for name, path in self.written if name in last}
        for _, path in self.written:
            if path not in kept.values():
                remove_path(self.spark, path)
