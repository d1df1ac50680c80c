"""Alignment of two tokenizers' ids over whole texts, by whitespace-token anchors.

Each text is tokenised fully by a byte-level BPE vocabulary (A, of a space and the
text) and by a piece vocabulary (B, which puts that space in front itself). Byte
offsets where both have a token that starts with a space are shared ends of what
stands before them: these anchors split a text into windows of token ids. A
window's groups depend on its id tuples only, so a worker aligns each pair of
tuples once (all new ones of a slice together) and looks it up afterwards, by a hash and then by the ids themselves;
the table of windows has a fixed size and starts anew when it is full.

A group ends where both an A and a B token end, so its last A and last B token are
a link. Links are counted by id pair over all texts: each text keeps its different
pairs with their numbers, tasks add them up, and the summed table goes to every
task. Its size is bounded by the vocabularies, whatever the number of texts: the
bytes of one of two linked tokens end with those of the other, and the numbers of
such pairs of entries (``most_pairs``) is fixed by the two files, some 500,000 here.

At scale: one pass over the texts, a written table of sums by text in the shared
folder, one aggregate of pairs combined before the shuffle, and a pass over that
table. No text is kept or moved; texts are taken in slices of bounded bytes.

Nulls: a text that is NULL or empty, or whose tokens don't give back its bytes in
either vocabulary, has no tokens: zeros, and an empty digest. A NULL id is a row
like any other; repeated rows are listed each, and count each. An empty table gives
an empty result. Strings of special tokens are plain text. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm.encoding import Encoder
from farebox.llm.neardup import Keeper

_SPACE = 0x20
_MARK = "▁"                                      # stands for a space in B's entries
_WORKER: dict[tuple[str, str], Aligner] = {}


class Entries:
    """The bytes of each id of a vocabulary."""

    def __init__(self, of: list[bytes]) -> None:
        self.size = np.fromiter(map(len, of), np.int64, len(of))
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(of), np.uint8)
        self.spaced = np.array([b[:1] == b" " for b in of])
        self.of = of

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.pool[np.repeat(self.start[ids] - before, size) + np.arange(int(size.sum()))]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    ones for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_entries(tokenizer) -> Entries:
    alphabet = byte_alphabet()
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        if all(c in alphabet for c in token):
            out[i] = bytes(alphabet[c] for c in token)
    return Entries(out)


def piece_entries(model) -> Entries:
    return Entries([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_MARK, " ").encode()
                    for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))])


def most_pairs(a: Entries, b: Entries) -> int:
    """How many pairs of entries can be linked: one ends with the other."""
    def tails(x: Entries, y: Entries, own: int) -> int:
        there = Counter(y.of)
        return sum(there[e[i:]] for e in x.of for i in range(own, len(e)))
    return tails(a, b, 0) + tails(b, a, 1)


class Pieces(Encoder):
    """Ids of the piece vocabulary for a space and a text, unit by unit: texts are
    cut where no entry holds the two characters that meet, so that no merge can
    cross."""

    def __init__(self, path: str, slots: int = 1 << 21) -> None:
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self.slots = slots
        meet = np.zeros((128, 128), bool)
        inner = False                                 # an entry with a space after another character
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                p = self.model.id_to_piece(i).replace(_MARK, " ")
                inner |= " " in p.lstrip(" ")
                for x, y in zip(p, p[1:], strict=False):
                    if x < "\x80" and y < "\x80":
                        meet[ord(x), ord(y)] = True
        #: units need a line break as a character that meets no other
        self.cuttable = not inner and not meet[0x0A].any() and not meet[:, 0x0A].any()
        self.apart = np.zeros((256, 256), bool)
        if self.cuttable:
            self.apart[:128, :128] = ~meet
            self.apart[:, _SPACE] = True
            self.apart[_SPACE, _SPACE] = ~meet[_SPACE, _SPACE]
        self.lead = len(self.model.encode("\n"))
        self.reset()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as they are: the space that the model puts in front goes to
        a line break, which stands apart from what follows."""
        if not self.cuttable:                         # whole texts: their own first space is the model's
            got = self.model.encode([t[1:] for t in texts], num_threads=1)
        else:
            got = [ids[self.lead:] for ids in self.model.encode(["\n" + t for t in texts], num_threads=1)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum())), size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuttable or self.entries > self.slots // 2 or self.used > 8 * self.slots:
            self.reset()
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(data) > 1:
            edge[1:-1] |= self.apart[data[:-1], data[1:]]
        start = np.flatnonzero(edge[:-1])
        of = np.searchsorted(start, offsets)
        end = np.append(start[1:], len(data))
        h = C.span_hashes(data, start, end)
        _, first = np.unique(h, return_index=True)
        new = first[self.find(h[first]) < 0]
        if len(new) > self.slots // 4:                # more units than the table takes
            start, end = offsets[:-1], offsets[1:]
            ids, size = self._texts(data, start, end)
            return ids, np.concatenate([[0], np.cumsum(size)])
        if len(new):
            self.add(h[new], *self._texts(data, start[new], end[new]))
        entry = self.find(h)
        size = self.sizes(entry)
        done = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.start[entry] - done[:-1], size) + np.arange(done[-1])], done[of]

    def _texts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self.whole([raw[a:b].decode("utf-8") for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of several ranges in a row."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Windows(Encoder):
    """The table of aligned windows: a window's ids (of A, then of B) by a hash,
    and with them its groups as text and its links as numbers."""

    def __init__(self, a: Entries, b: Entries, slots: int = 1 << 20) -> None:
        self.a, self.b, self.slots = a, b, slots
        self.decimals = Entries([b"%d" % i for i in range(max(len(a.of), len(b.of)))])
        self.reset()

    def reset(self) -> None:
        super().reset()
        self.texts: list[bytes] = []
        self.links = np.zeros(0, np.int64)
        self.link_of = np.zeros(1, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of several windows in a row (``na`` and ``nb`` ids each): the groups
        as text, all links and how many each window has."""
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)            # windows end together, so groups stay within
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        links = a[last_a].astype(np.int64) * len(self.b.of) + b[last_b]
        # a group's A ids stand before its B ids; what follows an id tells where its group ends
        before = lambda last: np.concatenate([[0], last[:-1] + 1])
        size_a, size_b = last_a + 1 - before(last_a), last_b + 1 - before(last_b)
        token = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + np.repeat(before(last_b), size_a), np.arange(len(b)) + np.repeat(last_a + 1, size_b)
        token[at_a], token[at_b] = a, b
        mark = np.full(len(token), ord(","), np.uint8)
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        size = self.decimals.size[token] + 1
        stop = np.cumsum(size)
        out = np.empty(int(stop[-1]), np.uint8)
        out[ranges(stop - size, size - 1)] = self.decimals.joined(token)
        out[stop - 1] = mark
        raw, cut = out.tobytes(), np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(na + nb)])].tolist()
        texts = [raw[x:y - 1] for x, y in zip(cut, cut[1:], strict=False)]
        windows = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(na)]))
        return texts, links, np.diff(windows)

    def look_up(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """Entries of the windows between consecutive token offsets ``at_a``, ``at_b``."""
        if self.entries > self.slots // 2 or self.used > 16 * self.slots:
            self.reset()
        na, nb = np.diff(at_a), np.diff(at_b)
        h = C.mix(C.span_hashes(a, at_a[:-1], at_a[1:]) + (C.span_hashes(b, at_b[:-1], at_b[1:]) << np.uint64(1)) + na.astype(np.uint64))
        # the ids of all windows in a row, A's before B's
        size = na + nb
        done = np.concatenate([[0], np.cumsum(size)])
        key = np.empty(int(done[-1]), np.uint32)
        key[np.arange(len(a)) + np.repeat(done[:-1] - at_a[:-1], na)] = a
        key[np.arange(len(b)) + np.repeat(done[:-1] + na - at_b[:-1], nb)] = b
        while True:
            _, first = np.unique(h, return_index=True)
            new = first[self.find(h[first]) < 0]
            if self.entries + len(new) > self.slots * 3 // 4:
                while len(new) > self.slots // 4:         # a very long text: its windows must fit
                    self.slots *= 2
                self.reset()
                continue
            if len(new):
                texts, links, counts = self.align(a[ranges(at_a[new], na[new])], b[ranges(at_b[new], nb[new])], na[new], nb[new])
                self.texts += texts
                self.add(h[new], key[ranges(done[new], size[new])], size[new])
                self.links = np.concatenate([self.links, links])
                self.link_of = np.concatenate([self.link_of, self.link_of[-1] + np.cumsum(counts)])
            entry = self.find(h)
            same = self.sizes(entry) == size
            held = self.pool[ranges(self.start[entry[same]], size[same])]
            other = np.flatnonzero(~same)
            wrong = held != key[np.repeat(same, size)]
            if wrong.any():
                other = np.union1d(other, np.flatnonzero(same)[np.unique(np.searchsorted(np.cumsum(size[same]), np.flatnonzero(wrong), "right"))])
            if not len(other):
                return entry
            h[other] = C.mix(h[other] + np.uint64(1))      # equal hashes of unequal ids: another place


class Aligner:
    """A worker's encoders and table of windows for two vocabulary files."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.encode_a, self.encode_b = Encoder(path_a), Pieces(path_b)
        self.a, self.b = byte_entries(self.encode_a.tokenizer), piece_entries(self.encode_b.model)
        self.windows = Windows(self.a, self.b)

    def texts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], list[np.ndarray]]:
        """(rows, n_a, n_b, n_groups) of the texts that both vocabularies give
        back, their groups as text, and the links of each as numbers."""
        rows = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(col), 0), False)))
        text = pc.binary_join_element_wise(pa.scalar(" ", col.type), col.take(pa.array(rows)), pa.scalar("", col.type))
        data, of = C.utf8(text)
        a, of_a = self.encode_a.encode(data, of)
        b, of_b = self.encode_b.encode(data, of)
        good = same_bytes(self.a, a, of_a, data, of) & same_bytes(self.b, b, of_b, data, of)
        if not good.all():
            (a, of_a), (b, of_b), (data, of) = (only(x, o, good) for x, o in ((a, of_a), (b, of_b), (data, of)))
            rows = rows[good]
        if not len(rows):
            return np.zeros((4, 0), np.int64), [], []
        # anchors: where a token of either that starts with a space begins, and where texts begin
        start_a, start_b = (np.cumsum(e.size[i]) - e.size[i] for e, i in ((self.a, a), (self.b, b)))
        both = np.intersect1d(start_a[self.a.spaced[a]], start_b[self.b.spaced[b]], assume_unique=True)
        anchor = np.union1d(both, of[:-1])
        at_a, at_b = (np.append(np.searchsorted(s, anchor), len(s)) for s in (start_a, start_b))
        entry = self.windows.look_up(a, b, at_a, at_b)
        first = np.searchsorted(anchor, of)
        lo, n = self.windows.link_of[entry], np.diff(self.windows.link_of)[entry]
        links = self.windows.links[ranges(lo, n)]
        link_of = np.concatenate([[0], np.cumsum(n)])[first]
        held, listed = self.windows.texts, entry.tolist()
        joined = [b";".join([held[e] for e in listed[x:y]]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        counts = np.stack([rows, np.diff(of_a), np.diff(of_b), np.diff(link_of)])
        return counts, joined, [links[x:y] for x, y in zip(link_of[:-1].tolist(), link_of[1:].tolist(), strict=True)]


def only(x: np.ndarray, of: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``good`` of a row of ranges."""
    size = np.diff(of)
    return x[np.repeat(good, size)], np.concatenate([[0], np.cumsum(size[good])])


def same_bytes(entries: Entries, ids: np.ndarray, of_ids: np.ndarray, data: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the entries of each text's ids are its bytes."""
    size = np.concatenate([[0], np.cumsum(entries.size[ids])])
    good = np.diff(size[of_ids]) == np.diff(of)
    (ids, _), (data, cut) = only(ids, of_ids, good), only(data, of, good)
    wrong = np.concatenate([[0], np.cumsum(entries.joined(ids) != data)])
    good[good] = np.diff(wrong[cut]) == 0
    return good


_SUMS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary")


def sums(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts and digest by text, and its different links (``codes``, ascending)
    with the ``times`` of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _WORKER.get((path_a, path_b)) or _WORKER.setdefault((path_a, path_b), Aligner(path_a, path_b))
        wide = code_type(aligner.a, aligner.b)
        for batch in batches:
            ids, col = batch.column("doc_id"), batch.column("text")
            for lo, hi in C.slices(col):
                counts, joined, links = aligner.texts(col.slice(lo, hi - lo))
                out = np.zeros((3, hi - lo), np.int64)
                out[:, counts[0]] = counts[1:]
                sha, codes, times = [""] * (hi - lo), [b""] * (hi - lo), [b""] * (hi - lo)
                for row, text, link in zip(counts[0].tolist(), joined, links, strict=True):
                    sha[row] = hashlib.sha256(text).hexdigest()
                    own, n = np.unique(link, return_counts=True)
                    codes[row], times[row] = own.astype(wide).tobytes(), n.astype("<u4").tobytes()
                yield pa.record_batch([ids.slice(lo, hi - lo), *[pa.array(c) for c in (*out, out[2])], pa.array(sha),
                                       pa.array(codes, pa.binary()), pa.array(times, pa.binary())],
                                      names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return docs.mapInArrow(run, _SUMS)


def code_type(a: Entries, b: Entries) -> str:
    return "<u4" if len(a.of) * len(b.of) <= 1 << 32 else "<u8"


def unpack(batch: pa.RecordBatch, wide: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of all rows of a batch, and their offsets by row."""
    codes = batch.column("codes").to_pylist()
    size = np.fromiter(map(len, codes), np.int64, len(codes)) // int(wide[-1])
    return (np.frombuffer(b"".join(codes), wide).astype(np.int64),
            np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum(size)]))


def pair_counts(table: DataFrame, wide: str) -> DataFrame:
    """code and n, over all texts; a task holds the pairs it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                code, times, _ = unpack(batch.slice(lo, 1024), wide)
                own, of = np.unique(np.concatenate([own, code]), return_inverse=True)
                total = np.bincount(of, np.concatenate([total, times]), len(own)).astype(np.int64)
        yield pa.record_batch([pa.array(own), pa.array(total)], names=["code", "n"])

    return table.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256
    of every document. ``path_a``: a byte-level BPE file of the tokenizers
    library, ``path_b``: a piece model of the sentencepiece library."""
    spark = docs.sparkSession
    C.ready(spark)
    keep = Keeper(spark, "alignment")
    here = Aligner(path_a, path_b)
    wide, width = code_type(here.a, here.b), len(here.b.of)
    table = keep(sums(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path_a, path_b), "sums")
    counts = keep(pair_counts(table, wide), "pairs")
    top = counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("top"))
    known = (counts.join(top, F.col("code") % width == F.col("b")).select("code", "n", (F.col("n") == F.col("top")).alias("best"))
             .orderBy("code").toArrow())
    sent = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            own, times, of = unpack(batch, wide)
            at = np.searchsorted(code, own)
            both = [np.diff(np.concatenate([[0], np.cumsum(times * v[at])])[of]) for v in (best, n)]
            yield pa.record_batch([*batch.columns[:5], *map(pa.array, both), batch.column("groups_sha256")],
                                  names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return table.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                 "count_sum long, groups_sha256 string")
