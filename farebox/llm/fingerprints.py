"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraph pieces: lines, long ones cut after words that
a hash picks, so an edit changes only the pieces it touches. Each piece's 64-bit
digest (with its occurrence number, as pieces repeat) is added to three cells of
a small table: a count, the xor of the digests and the xor of their checks.
Subtracting two tables leaves the pieces that differ; cells that hold one piece
give its digest, which is peeled off the other two, and so on. Where peeling
gets stuck, both texts are sketched again in a larger table. What is recovered
gives the exact likeness of the two sets: shared pieces over all pieces.

Versions of a document are joined by a range split of the ids whose boundaries
are ids themselves: a boundary document also goes, as a look-ahead, to the range
before it, so every task reads its documents in order with a successor for each
and texts are shuffled once.

Nulls: a NULL text is empty; two empty texts have likeness 1. A NULL id comes
first; the last document's successor is the smallest id. Equal ids are ordered by
text hash. Of one document the successor is itself; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C

CELLS = 24                       # cells of a fingerprint, in three thirds
CUT = 8                          # a line is cut after one in so many words
_SEEDS = (np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece digests of all texts, their offsets, and a digest of each text."""
    data, offsets = C.utf8(pa.array(texts, pa.large_string()))
    tokens = C.Tokens(data, offsets, C.PLAIN)
    word, doc, n = tokens.hashes(), tokens.doc(), len(texts)
    sums = C.prefix_sums(data)
    whole = C.span_hashes(data, offsets[:-1], offsets[1:], sums) if len(data) else np.zeros(n, np.uint64)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), whole
    lines = np.cumsum(data == 0x0A)
    line = lines[tokens.start]
    first = np.ones(len(word), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]) | (word[:-1] % np.uint64(CUT) == 0)
    at = np.flatnonzero(first)
    place = np.arange(len(word)) - np.repeat(at, np.diff(np.append(at, len(word))))
    digest = C.mix(np.add.reduceat(C.mix(word + C.mix(place.astype(np.uint64) + np.uint64(1))), at))
    of_doc = doc[at]
    order = np.lexsort((digest, of_doc))
    d, o = digest[order], of_doc[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d))))
    return C.mix(d + nth.astype(np.uint64) * _SEEDS[3]), np.searchsorted(o, np.arange(n + 1)), whole


class Sketches:
    """Tables of ``m`` cells for several sets: (sets, m) arrays."""

    def __init__(self, keys: np.ndarray, of: np.ndarray, m: int) -> None:
        n = len(of) - 1
        self.m = m
        self.count = np.zeros(n * m, np.int64)
        self.key = np.zeros(n * m, np.uint64)
        self.check = np.zeros(n * m, np.uint64)
        self.change(np.repeat(np.arange(n), np.diff(of)), keys, 1)

    @staticmethod
    def checks(keys: np.ndarray) -> np.ndarray:
        return C.mix(keys ^ _SEEDS[3]) >> np.uint64(32)

    def change(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check, third = self.checks(keys), self.m // 3
        for s in range(3):
            cell = row * self.m + s * third + (C.mix(keys + _SEEDS[s]) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, keys)
            np.bitwise_xor.at(self.check, cell, check)

    def minus(self, other: Sketches, rows: np.ndarray, others: np.ndarray) -> Sketches:
        out = Sketches(np.zeros(0, np.uint64), np.zeros(len(rows) + 1, np.int64), self.m)
        for name, op in (("count", np.subtract), ("key", np.bitwise_xor), ("check", np.bitwise_xor)):
            a, b = (getattr(x, name).reshape(-1, self.m)[i] for x, i in ((self, rows), (other, others)))
            setattr(out, name, op(a, b).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (row, digest, sign) and which rows were recovered whole."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.count)
        while True:
            look = look[np.abs(self.count[look]) == 1]
            look = look[self.checks(self.key[look]) == self.check[look]]
            if not len(look):
                break
            row, keys = look // self.m, self.key[look]
            _, one = np.unique(C.mix(keys) + row.astype(np.uint64) * _SEEDS[0], return_index=True)
            row, keys, sign = row[one], keys[one], self.count[look[one]]
            found.append((row, keys, sign))
            self.change(row, keys, -sign)
            touched = np.zeros(len(self.count) // self.m, bool)
            touched[row] = True
            look = np.flatnonzero(np.repeat(touched, self.m) & (self.count != 0))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(-1, self.m).any(1)
        row, keys, sign = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return row, keys, sign, done


def subset(keys: np.ndarray, of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = of[rows + 1] - of[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    return keys[np.arange(new[-1]) + np.repeat(of[rows] - new[:-1], size)], new


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
             sa: Sketches, sb: Sketches, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Shared over all pieces for rows ``ra`` of a and ``rb`` of b, from what
    peeling recovers; stuck pairs are tried again with four times the cells."""
    na, nb = np.diff(a[1])[ra], np.diff(b[1])[rb]
    out = np.zeros(len(ra))
    left, m = np.arange(len(ra)), sa.m
    ta, tb, xa, xb = sa, sb, ra, rb
    while len(left):
        row, _, sign, done = ta.minus(tb, xa, xb).peel()
        mine = np.bincount(row, sign > 0, len(left))
        theirs = np.bincount(row, sign < 0, len(left))
        ok = done & (mine - theirs == (na - nb)[left])
        union = na[left] + theirs
        out[left[ok]] = np.where(union > 0, (na[left] - mine) / np.maximum(union, 1), 1.0)[ok]
        left, m = left[~ok], m * 4
        if len(left):
            ta, tb = Sketches(*subset(*a, ra[left]), m), Sketches(*subset(*b, rb[left]), m)
            xa = xb = np.arange(len(left))
    return np.clip(out, 0, 1)


def written(s: Sketches, sizes: np.ndarray, whole: np.ndarray) -> list[str]:
    """Fingerprints as text: text digest, piece count and cells, in base 64."""
    rows = np.concatenate([
        whole.astype("<u8")[:, None].view(np.uint8), sizes.astype("<u4")[:, None].view(np.uint8),
        s.count.reshape(-1, s.m).astype("<i4").view(np.uint8), s.key.reshape(-1, s.m).astype("<u8").view(np.uint8),
        s.check.reshape(-1, s.m).astype("<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def compare(run: list[tuple[object, str]]) -> pa.RecordBatch:
    """Results of all but the last of consecutive documents."""
    texts = [t for _, t in run]
    n = len(texts) - 1
    cut = [len(t) // 4 for t in texts[:n]]
    edited = [t[:len(t) - k] + u[:k] for t, u, k in zip(texts, texts[1:], cut, strict=False)]
    own, of, whole = pieces(texts)
    ekeys, eof, ewhole = pieces(edited)
    s, e = Sketches(own, of, CELLS), Sketches(ekeys, eof, CELLS)
    i = np.arange(n)
    near_edited = likeness((own, of), (ekeys, eof), s, e, i, i)
    near_next = likeness((own, of), (own, of), s, s, i, i + 1)
    return pa.record_batch([
        pa.array([k for k, _ in run[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(written(s, np.diff(of), whole)[:n], pa.string()), pa.array(written(e, np.diff(eof), ewhole), pa.string()),
        pa.array(near_edited), pa.array(near_next)],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                ranges: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited version (its last quarter
    replaced by the beginning of its successor), and their likeness."""
    spark = docs.sparkSession
    C.ready(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least, splits = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()
    bounds = sorted({b for b in (splits or []) if b != least})
    n = len(bounds)
    array = F.lit(bounds).cast("array<long>") if n else F.array().cast("array<long>")
    at = C.pick_bucket(F.col("doc_id"), array, n) if n else F.lit(0)
    place = lambda b, ahead: F.struct(b.cast("int").alias("range"), F.lit(ahead).alias("ahead"))
    none = F.lit(None).cast("struct<range:int,ahead:boolean>")
    marked = (rows.withColumn("_at", at)
              .withColumn("_to", F.explode(F.array_compact(F.array(
                  place(F.col("_at"), False),
                  F.when(F.get(array, F.col("_at") - 1) == F.col("doc_id"), place(F.col("_at") - 1, True)).otherwise(none) if n else none,
                  F.when((F.col("doc_id") == F.lit(least)) if least is not None else F.lit(True), place(F.lit(n), True)).otherwise(none)))))
              .select(F.col("_to.range").alias("range"), F.col("_to.ahead").alias("ahead"), "doc_id", "text",
                      F.xxhash64("text").alias("tie")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, size = None, [], 0
        for batch in batches:
            for lo, hi in C.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                for r, ahead, key, text in zip(*(part.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text")), strict=True):
                    if r != now:
                        now, waiting, size = r, [], 0
                    if ahead:
                        if waiting:
                            yield compare([*waiting, (key, text)])
                        waiting, size = [], 0
                        continue
                    waiting.append((key, text))
                    size += len(text)
                    if size > C.SLICE_BYTES and len(waiting) > 1:
                        yield compare(waiting)
                        waiting = waiting[-1:]
                        size = len(text)

    return (marked.repartition(tasks, "range").sortWithinPartitions("range", "ahead", "doc_id", "tie")
            .select("range", "ahead", "doc_id", "text").mapInArrow(run, SCHEMA))
