"""Helpers shared by the corpus operators: column expressions for the fixed
folds, bounded hash samples, and vectorised tokenisation of Arrow text.

Texts reach Python as Arrow batches. ``slices`` cuts a batch into pieces of a
bounded number of bytes, so a task's memory does not follow the batch size, and
``runs`` finds and hashes the tokens of a whole piece in a few numpy passes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.session import cut_lineage, ship_package

SLICE_BYTES = 1 << 19
#: Most bytes of an Arrow batch to a Python worker: bounds what a task holds of
#: long texts on either side, whatever the number of rows.
BATCH_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)          # odd multiplier of the rolling hash
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_SHIPPED: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per
    application (the zip goes through the shared checkpoint folder), and keep
    Arrow batches small."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) != str(BATCH_BYTES):
        spark.conf.set(size, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        ship_package(spark)
        _SHIPPED.add(app)


# --- what a Python worker keeps -----------------------------------------------

#: Called to let go of what an operator keeps from task to task, by operator.
KEPT: dict[str, Callable[[], None]] = {}
_WORKER_OF = [""]


def begin(operator: str) -> None:
    """To be called as a task of ``operator`` begins, or at each of its batches. A
    Python worker serves all operators of an application in turn: what others keep
    is let go, and free memory goes back to the system."""
    if _WORKER_OF[0] == operator:
        return
    first, _WORKER_OF[0] = not _WORKER_OF[0], operator
    for name, clear in KEPT.items():
        if name != operator:
            clear()
    if not first:
        trim()


def trim() -> None:
    """Free memory of Python, Arrow and the C library goes back to the system."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Free memory of Arrow and the C library goes back to the system; cheap enough
    to be called at each batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


# --- folds and samples ------------------------------------------------------

def id_crc(col: str | Column) -> Column:
    """crc32 of an id written as text (NULL for a NULL id)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary"))


def in_fold(col: str | Column, mod: int, remainder: int) -> Column:
    """Whether an id's crc falls on ``remainder``; false for a NULL id."""
    return F.coalesce(id_crc(col) % mod == remainder, F.lit(False))


def unit_hash(col: str | Column, seed: int) -> Column:
    """A value in [0, 1) fixed by the column's value and ``seed``."""
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(seed)), 33) / F.lit(float(1 << 31))


def bounded_labels(labels: DataFrame, id_col: str, label_col: str, learn: Column,
                   cap: int, seed: int) -> DataFrame:
    """About ``cap`` labelled ids at most, chosen by a hash of the id: up to
    about half of them of either label, so that a rare one is not drowned.
    ``_share`` is the share of a row's label that is drawn: weighted by its
    inverse, the sample stands for all labelled rows.

    One row per id (the largest label if an id repeats); rows with a NULL id or
    label are left out. The size is bounded by ``cap`` (documented by each
    caller), so the result may be broadcast.
    """
    clean = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
             .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
             .filter(learn).groupBy("_id").agg(F.max("_y").alias("_y")))
    counts = {r["_y"]: r["count"] for r in clean.groupBy("_y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, cap / 2 / n))).otherwise(share)
    return clean.withColumn("_share", share).filter(unit_hash("_id", seed) < F.col("_share"))


def bounded_rows(rows: DataFrame, id_col: str, text_col: str, most: int, most_bytes: int, seed: int) -> DataFrame:
    """Of a sample drawn by id, about ``most`` rows and ``most_bytes`` of text at most.

    An id (or NULL) may hold any share of the corpus, so each gives an even part of
    ``most``, drawn by a hash of its texts; ids with fewer rows keep them all. Rows
    alike in all columns come once. The ids are a bounded sample, so their sizes
    may be broadcast.
    """
    ids = cut_lineage(rows.groupBy(F.col(id_col).alias("_of")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).alias("_size")))
    n = ids.count()
    share = F.least(F.lit(1.0), F.lit(max(1.0, most / max(n, 1))) / F.col("_n"))
    size = ids.agg(F.sum(F.col("_size") * share)).first()[0] or 0
    ids = ids.select("_of", (share * min(1.0, most_bytes / max(size, 1))).alias("_kept"))
    drawn = rows.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("_of")))
    return drawn.filter(unit_hash(F.xxhash64(id_col, text_col), seed) < F.col("_kept")).drop("_of", "_kept").distinct()


def merged_tasks(docs: DataFrame, text_col: str, task_bytes: int = 1 << 30) -> int:
    """In how many tasks a model of a fixed size is added up over all texts: some
    per core, as each sends it whole, and so many that none reads much over
    ``task_bytes`` of text."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))


# --- Arrow text -------------------------------------------------------------

def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of an Arrow string array; NULL is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, arr.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``arr`` of about ``limit`` bytes of text and at most 32,768
    rows each (a longer text is a range of its own)."""
    _, off = utf8(arr)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1), lo + (1 << 15))
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of the rolling-hash multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            for name, p in (("up", _P), ("down", _PINV)):
                a = np.full(size, p, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()

def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the rolling hash: ``len(data) + 1`` values."""
    up, _ = _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[1:], out=out[1:])
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it stands."""
    sums = prefix_sums(data) if sums is None else sums
    _, down = _POWERS.upto(len(data) + 1)
    return mix((sums[end] - sums[start]) * down[start])


SPACE, WORD, MARK = 0, 1, 2
#: Byte classes: ASCII white space, letters/digits/non-ASCII, other marks.
CLASSES = np.full(256, MARK, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = WORD
#: The same with marks as part of words: words are what stands between spaces.
PLAIN = np.where(CLASSES == SPACE, SPACE, WORD).astype(np.uint8)
#: ASCII lower case by table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Tokens:
    """Tokens of several texts: ``start``/``end`` byte positions, and ``of`` the
    token offsets of each text (``len(texts) + 1``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> None:
        cls = classes[data]
        edge = np.empty(len(data), bool)
        if len(data):
            edge[0] = True
            np.not_equal(cls[1:], cls[:-1], out=edge[1:])
            edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(data))
        keep = cls[start] != SPACE
        self.start, self.end = start[keep], end[keep]
        self.cls = cls[self.start]
        self.of = np.searchsorted(self.start, offsets)
        self.data = data
        self._sum = None

    def hashes(self, upto: int | None = None) -> np.ndarray:
        """A 64-bit hash of each token, or of its first ``upto`` bytes."""
        if self._sum is None:
            self._sum = prefix_sums(self.data)
        end = self.end if upto is None else np.minimum(self.end, self.start + upto)
        return span_hashes(self.data, self.start, end, self._sum)

    def doc(self) -> np.ndarray:
        """The text each token is in."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def shingles(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` tokens in a row and their offsets by text; a text of
    1 to k-1 tokens has one shingle of them all, one without tokens has none."""
    n = len(h)
    count = np.diff(of)
    salt = mix(np.arange(1, k + 2, dtype=np.uint64) * _P) | np.uint64(1)
    if n < k:
        rolled = np.zeros(n, np.uint64)
    else:
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled[:n - k + 1] += h[j:n - k + 1 + j] * salt[j]
    for d in np.flatnonzero((count > 0) & (count < k)):
        a, b = of[d], of[d + 1]
        rolled[a] = np.sum(np.append(h[a:b] * salt[:b - a], salt[k:k + 1] * np.uint64(b - a)), dtype=np.uint64)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    off = np.zeros(len(of), np.int64)
    np.cumsum(made, out=off[1:])
    idx = np.arange(off[-1]) + np.repeat(of[:-1] - off[:-1], made)
    return mix(rolled[idx]), off


def segment_sum(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Row sums of ``values`` between consecutive offsets (0 for empty ranges)."""
    out = np.zeros((len(of) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(of) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, of[full], axis=0)
    return out


def cut(of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of ``size`` words of all texts, and their texts."""
    n = np.diff(of)
    parts = -(-n // size)
    doc = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    return of[:-1][doc] + k * size, doc


def piece_sums(table: np.ndarray, term: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Sums of table rows over pieces of at most ``size`` words, a word of every
    piece at a time."""
    end = np.append(start[1:], len(term))
    out = np.zeros((len(start), table.shape[1]), np.float32)
    for j in range(size):
        on = start + j
        if j and (on >= end).any():
            live = np.flatnonzero(on < end)
            out[live] += table[term[on[live]]]
        else:
            out += table[term[on]]
    return out


def pick_bucket(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` ascending ``bounds`` are <= ``value``: a binary
    search as a fold, so a lookup takes log2(n) steps."""
    steps = max(1, int(n).bit_length())

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        right = open_ & (F.get(bounds, mid) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).cast("int").alias("lo"),
                        F.when(open_ & ~right, mid).otherwise(acc["hi"]).cast("int").alias("hi"))

    first = F.struct(F.lit(0).cast("int").alias("lo"), F.lit(n).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["lo"]
