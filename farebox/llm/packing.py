"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments, and loss-bearing tokens.
The open sequence takes, of the examples waiting, the fitting one whose demand
vector has the largest dot product with the room that is left, each dimension
weighted by the mean demand on it. Longer examples are first cut at the limits;
where nothing fits and the room is worth it, a waiting example is cut.

Every task packs its own rows as a stream with a bounded number of examples
waiting, so no shuffle is needed and memory does not follow the input. Sequence
ids hold the task's number and a running count, the same when a task is run
again.

Loss-bearing tokens are the last ``loss`` ones of an example (prompt first, answer
last) or, where no number is given, those whose bytes hold a letter, a digit or a
part of a non-ASCII character, and the end id; white space and punctuation are
read, not learned. By default a sequence has 64 segments and 1,016 loss-bearing
tokens at most: dense texts are mixed with others, and where there are no others a
sequence has 8 tokens of padding (0.8 %).

Nulls: a NULL or empty text has only its end id, a NULL id is carried along.
Repeated rows are packed each; an empty table gives no pieces. Only the id and
text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm import encoding
from farebox.llm.alignment import byte_entries

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long, ids binary")


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1016
    least_cut: int = 8          # room below this is left as padding
    waiting: int = 2048         # examples a task keeps waiting at most, about


#: Text encoded at a time, and an eighth of the ids given out at a time: what a
#: task holds beside the waiting examples and the table of units.
PIECE_BYTES = 1 << 17
_BEARING: dict[str, np.ndarray] = {}
_LEARNED = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def bearing(tokenizer: str) -> np.ndarray:
    """Whether each id of a byte-level vocabulary bears loss; entries that aren't
    byte-level do."""
    if tokenizer not in _BEARING:
        entries = byte_entries(encoding.encoder(tokenizer).tokenizer).of
        _BEARING[tokenizer] = np.array([not e or _LEARNED.search(e) is not None for e in entries])
    return _BEARING[tokenizer]


def running(n: int, loss: int | np.ndarray) -> np.ndarray:
    """Loss-bearing tokens before each of an example's ``n`` tokens, and of all:
    the last ``loss`` ones, or those that a mask names."""
    mask = loss if isinstance(loss, np.ndarray) else np.arange(n) >= n - loss
    return np.append(0, np.cumsum(mask)).astype(np.int32)


def longest(before: np.ndarray, start: int, tokens: int, loss: int) -> int:
    """The longest piece from ``start`` with so many tokens at most, ``loss`` of them loss-bearing."""
    most = min(len(before) - 1 - start, tokens)
    return int(np.searchsorted(before[start:start + most + 1], before[start] + loss, "right")) - 1


@dataclass
class Example:
    key: object
    ids: np.ndarray
    before: np.ndarray          # loss-bearing tokens before each token

    def loss(self, start: int, length: int) -> int:
        return int(self.before[start + length] - self.before[start])


class Pool:
    """Examples (or what is left of them) waiting for a sequence."""

    def __init__(self, limits: Limits, held: dict[int, Example]) -> None:
        self.limits, self.held, self.sequence = limits, held, 0
        self.ref = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)

    def add(self, ref: np.ndarray, start: np.ndarray, size: np.ndarray, loss: np.ndarray) -> None:
        self.ref = np.append(self.ref, ref)
        self.start = np.append(self.start, start)
        self.size = np.append(self.size, size)
        self.loss = np.append(self.loss, loss)

    def fill(self, down_to: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Packs until at most ``down_to`` examples wait; yields (example, start,
        length, sequence, offset)."""
        lim = self.limits
        cap = np.array([lim.tokens, lim.segments, lim.loss], float)
        alive = np.ones(len(self.ref), bool)
        left = len(self.ref)
        demand = np.stack([self.size, np.ones(left, np.int64), self.loss], 1) / cap
        weight = demand.mean(0) if left else np.ones(3)
        while left > down_to:
            room, at = cap.copy(), 0
            while left:
                fits = alive & (demand * cap <= room + 1e-9).all(1)
                if fits.any():
                    worth = demand @ (weight * room / cap)
                    i = int(np.where(fits, worth, -1).argmax())
                    start, length = int(self.start[i]), int(self.size[i])
                else:
                    if room[0] < lim.least_cut or room[1] < 1 or room[2] < 1:
                        break
                    i = int(np.where(alive, self.size, -1).argmax())
                    start = int(self.start[i])
                    length = longest(self.held[int(self.ref[i])].before, start, int(room[0]), int(room[2]))
                taken = self.held[int(self.ref[i])].loss(start, length)
                yield int(self.ref[i]), start, length, self.sequence, at
                at += length
                room -= (length, 1, taken)
                self.start[i] += length
                self.size[i] -= length
                self.loss[i] -= taken
                if self.size[i] == 0:
                    alive[i], left = False, left - 1
                else:
                    demand[i] = np.array([self.size[i], 1, self.loss[i]]) / cap
                if room[0] <= 0:
                    break
            self.sequence += 1
        for name in ("ref", "start", "size", "loss"):
            setattr(self, name, getattr(self, name)[alive])


def pack_ids(examples: Iterator[tuple[object, np.ndarray, int | np.ndarray]], limits: Limits, first: int) -> Iterator[tuple]:
    """Pieces (id, start, length, n, sequence, offset, loss, ids) of a stream of
    (id, token ids, how many last tokens bear loss or a mask of those that do);
    ``first`` is added to sequence numbers."""
    held: dict[int, Example] = {}
    pool, count = Pool(limits, held), 0

    def piece(ref: int, start: int, length: int, seq: int, at: int) -> tuple:
        e = held[ref]
        return e.key, start, length, len(e.ids), first + seq, at, e.loss(start, length), e.ids[start:start + length].tobytes()

    new: list[tuple[int, int, int, int]] = []
    for key, ids, loss in examples:
        n, start = len(ids), 0
        one = held[count] = Example(key, ids, running(n, loss))
        while n - start > (most := longest(one.before, start, limits.tokens, limits.loss)) or n - start == limits.tokens:
            yield piece(count, start, most, pool.sequence, 0)     # a sequence of its own
            pool.sequence += 1
            start += most
            if start == n:
                break
        if start < n:
            new.append((count, start, n - start, one.loss(start, n - start)))
        else:
            del held[count]
        count += 1
        if len(new) >= limits.waiting:
            pool.add(*np.array(new, np.int64).T)
            new = []
            for p in pool.fill(limits.waiting // 2):
                yield piece(*p)
            for k in set(held) - set(pool.ref.tolist()):
                del held[k]
    if new:
        pool.add(*np.array(new, np.int64).T)
    for p in pool.fill(0):
        yield piece(*p)


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """Pieces of all documents with their token ids (little-endian unsigned
    32-bit), sequence and offset. ``loss_col`` counts an example's loss-bearing
    last tokens; where it is NULL, and without it, ``bearing`` names them."""
    C.ready(docs.sparkSession)
    loss = F.lit(None).cast("long") if loss_col is None else F.col(loss_col).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), loss.alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("encoding")
        bears = bearing(tokenizer)

        def examples() -> Iterator[tuple[object, np.ndarray, int | np.ndarray]]:
            for batch in batches:
                keys, losses = batch.column("id").to_pylist(), batch.column("loss").to_pylist()
                C.give_back()
                for lo, hi, ids, of in encoding.encode_column(batch.column("text"), tokenizer, PIECE_BYTES):
                    for i in range(lo, hi):
                        one = np.append(ids[of[i - lo]:of[i - lo + 1]], np.uint32(end_id)).astype(np.uint32)
                        if losses[i] is None:
                            mask = bears[one]
                            mask[-1] = True
                            yield keys[i], one, mask
                        else:
                            yield keys[i], one, max(0, min(len(one), losses[i]))

        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 32
        out: list[tuple] = []
        size = 0
        for p in pack_ids(examples(), limits, first):
            out.append(p)
            size += len(p[-1])
            if size > 8 * PIECE_BYTES:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    return rows.mapInArrow(run, SCHEMA)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*pieces, strict=True)) if pieces else [()] * 8
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
