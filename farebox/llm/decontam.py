"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of words; a passage is the TF-IDF vector of its
hashed terms. Document frequencies are counted over the passages of the whole
corpus. A single-pass randomised SVD follows: every task multiplies its passages
with a random test matrix and back (``A' (A G)``), Spark adds the products up,
and the driver takes the corpus's leading directions from the sum, a matrix of a
fixed size; the first few, which all texts share, are taken out. Benchmark items take part with a weight, so that their directions
lead too; what is left of a text in these directions is its latent vector.

Search: overlapping windows of all documents are projected and compared with all
items by cosine (the length of the window's own TF-IDF vector counts, not only
that of its projection). A long item is cut into passages with a vector each, as
a window holds only a part of it. A fixed number of passages shares a set of
directions, so that the latent share of a passage does not fall as the items
grow in number. Where a text repeats some words in a row of an item (its seeds),
it is a candidate whatever its cosine, so exact copies are all found, however
many and however long the items are. A candidate is verified on
words: the longest common subsequence of the item with the text around the
window, and the answer (the item's own answer, or else its last sentence), which
must be there too when the subsequence alone doesn't settle it. A shorter
subsequence settles it if it is a paraphrase's: at least eight words, over half of
the item by the words' IDF weight, and spread over both halves of the item, which
neither frequent words met by chance nor a passage that the item shares in part
come to. So paraphrases that drop, add or replace words are found, chance likeness
is not.

Items are a query set: the driver reads them in blocks of ``block`` items, and
they go to the tasks in groups of about ``parts`` sets of directions, with a pass
over the documents for each group, whatever their number.

Nulls: NULL or empty texts and items match nothing; NULL ids are carried along.
Repeated rows are reported each. Without items or documents the result is empty.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C

SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer double"
_WORDS = np.where(C.CLASSES == C.WORD, C.WORD, C.SPACE).astype(np.uint8)


@dataclass(frozen=True)
class Config:
    terms: int = 1 << 14        # hashed terms
    passage: int = 48           # words of a passage in the counts and the SVD
    half: int = 16              # words of half a search window
    corpus_rank: int = 16       # directions taken from the corpus
    common: int = 8             # of them, leading ones that all texts share and that are taken out
    extra: int = 8              # further columns of the test matrix
    rank: int = 64              # latent dimensions, with those of the items
    vectors: int = 200          # item passages that share these dimensions at most
    item_passage: int = 64      # words of an item's passage at most
    run: int = 8                # words in a row that make a candidate
    weight: float = 16.0        # energy of the items to that of the corpus
    cosine: float = 0.13        # least cosine of a candidate
    lcs: float = 0.62           # common subsequence that settles it
    lcs_answer: float = 0.55    # ... that does if the answer is there too
    answer: float = 0.8
    paraphrase: float = 0.5     # common subsequence of a paraphrase, in words
    paraphrase_idf: float = 0.55    # ... in the words' IDF weight
    each_half: float = 0.4      # ... in the IDF weight of each half of the item
    least_words: int = 8        # ... and in number
    block: int = 5_000          # items read at once
    parts: int = 8              # sets of directions compared in one pass
    rows: int = 256             # terms per shuffled record
    seed: int = 9


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several lower-cased texts and their offsets."""
    data, offsets = C.utf8(pc.utf8_lower(col))
    tokens = C.Tokens(data, offsets, _WORDS)
    return tokens.hashes(), tokens.of


def _summed(docs: DataFrame, text_col: str, per_task, width: int, cfg: Config) -> tuple[np.ndarray, int]:
    """The sum over all tasks of a (terms, width) float matrix and of a count.

    Records of a row block are added up as a stream, in two levels: first those of
    every ``part``-th task, then their sums.
    """
    C.ready(docs.sparkSession)
    schema = "block int, n long, sums binary"
    tasks = C.merged_tasks(docs, text_col)
    level, blocks = math.isqrt(tasks), cfg.terms // cfg.rows

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("decontamination")
        total, n = np.zeros((cfg.terms, width), np.float32 if width > 1 else np.float64), 0
        for batch in batches:
            col = batch.column(0)
            for lo, hi in C.slices(col):
                h, of = words_of(col.slice(lo, hi - lo))
                if len(h):
                    n += per_task(total, h, of)
        by = total.astype(np.float64 if width == 1 else np.float32).reshape(cfg.terms // cfg.rows, -1)
        used = np.flatnonzero(by.any(axis=1))
        task = TaskContext.get()
        part = task.partitionId() % level if task else 0
        yield pa.record_batch([pa.array(np.append(used, -1), pa.int32()), pa.array([0] * len(used) + [n], pa.int64()),
                               pa.array([by[i].tobytes() for i in used] + [b""], pa.binary()),
                               pa.array([part] * (len(used) + 1), pa.int32())], names=["block", "n", "sums", "part"])

    def merge(batches: Iterator[pa.RecordBatch], kind: type = np.float64) -> Iterator[pa.RecordBatch]:
        C.begin("decontamination")
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for block, n, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "sums")), strict=True):
                v = np.frombuffer(raw, kind).astype(np.float64)
                sums[block] = sums[block] + v if block in sums else v
                counts[block] = counts.get(block, 0) + n
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(list(counts.values()), pa.int64()),
                               pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "n", "sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merge(batches, np.float64 if width == 1 else np.float32)

    rows = (docs.select(text_col).coalesce(tasks).mapInArrow(partial, schema + ", part int")
            .repartition(min(tasks, blocks * level), "block", "part").mapInArrow(first, schema)
            .repartition(blocks, "block").mapInArrow(merge, schema).collect())   # the model's size
    out, n = np.zeros((blocks, cfg.rows * width)), 0
    for r in rows:
        if r["block"] < 0:
            n += r["n"]
        else:
            out[r["block"]] += np.frombuffer(r["sums"], np.float64)
    return out.reshape(cfg.terms, width), n


def document_frequency(docs: DataFrame, text_col: str, cfg: Config) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each hashed term is, and how many there are."""
    def count(total: np.ndarray, h: np.ndarray, of: np.ndarray) -> int:
        start, _ = C.cut(of, cfg.passage)
        p = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
        both = np.sort(p * cfg.terms + (h % np.uint64(cfg.terms)).astype(np.int64))
        new = np.append(True, both[1:] != both[:-1])
        total[:, 0] += np.bincount(both[new] % cfg.terms, minlength=cfg.terms)
        return len(start)

    df, n = _summed(docs, text_col, count, 1, cfg)
    return df[:, 0], n


def test_matrix(cfg: Config) -> np.ndarray:
    return np.random.default_rng(cfg.seed).normal(size=(cfg.terms, cfg.corpus_rank + cfg.extra)).astype(np.float32)


def sketch(total: np.ndarray, h: np.ndarray, of: np.ndarray, idf: np.ndarray, g: np.ndarray, cfg: Config) -> None:
    """Adds A' (A G) of some texts' passages to ``total`` (``g``: G times idf).
    A word adds its idf to its passage's vector, whose scale is one over the root
    of the summed squares of its words."""
    start, _ = C.cut(of, cfg.passage)
    term = (h % np.uint64(cfg.terms)).astype(np.int64)
    scale = np.add.reduceat(idf[term] ** 2, start)
    y = C.piece_sums(g, term, start, cfg.passage) / scale[:, None].astype(np.float32)
    p = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    order = np.argsort(term.astype(np.uint16 if cfg.terms <= 1 << 16 else np.int64), kind="stable")
    t = term[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    total[t[first]] += np.add.reduceat(y[p[order]], first, axis=0) * idf[t[first]][:, None]


def corpus_factor(y: np.ndarray, g: np.ndarray, rank: int) -> np.ndarray:
    """E with E E' close to A'A, from its product with G (Nystrom form)."""
    y, g = y.astype(np.float64), g.astype(np.float64)
    y = y + 1e-7 * max(np.linalg.norm(y), 1e-12) * g
    b = g.T @ y
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    keep = values > values.max() * 1e-9
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, :rank] * s[:rank]


def directions(factor: np.ndarray, items: np.ndarray, cfg: Config) -> np.ndarray:
    """Leading left singular vectors of the corpus factor and the weighted items
    side by side, by a randomised range finder with two power steps. The leading
    corpus directions, in which all texts are alike, are taken out before."""
    top = factor[:, :cfg.common] / np.maximum(np.linalg.norm(factor[:, :cfg.common], axis=0), 1e-12)
    items = items - top @ (top.T @ items)
    factor = factor[:, cfg.common:]
    share = np.sqrt(cfg.weight) * np.linalg.norm(factor) / max(np.linalg.norm(items), 1e-12) if factor.any() else 1.0
    parts = (factor, items * share)
    rng = np.random.default_rng(cfg.seed)
    wide = sum(p.shape[1] for p in parts)
    q = sum(p @ w for p, w in zip(parts, np.split(rng.normal(size=(wide, min(wide, cfg.rank + cfg.extra))), [factor.shape[1]]), strict=True))
    for _ in range(2):
        q, _ = np.linalg.qr(q)
        q = sum(p @ (p.T @ q) for p in parts)
    q, _ = np.linalg.qr(q)
    u, _, _ = np.linalg.svd(np.concatenate([q.T @ p for p in parts], axis=1), full_matrices=False)
    return (q @ u[:, :cfg.rank]).astype(np.float32)


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of ``b`` per step, bits
    of one integer standing for the words of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def common_weight(a: list[int], b: list[int], weight: np.ndarray) -> float:
    """Largest weight of a common subsequence, ``weight`` being that of the words
    of ``a``, as a share of all of it; a word of ``a`` per step."""
    words, best = np.array(b, np.uint64), np.zeros(len(b) + 1)
    for x, w in zip(a, weight.astype(float), strict=True):
        step = best.copy()
        step[1:] = np.where(words == np.uint64(x), np.maximum(best[1:], best[:-1] + w), best[1:])
        best = np.maximum.accumulate(step)
    return float(best[-1] / max(weight.sum(), 1e-12))


def paraphrased(item: list[int], lcs: float, around: list[int], idf: np.ndarray, cfg: Config) -> bool:
    """Whether a common subsequence of ``lcs`` is that of a paraphrase."""
    n, mid = len(item), len(item) // 2
    if lcs < cfg.paraphrase or round(lcs * n) < cfg.least_words:
        return False
    weight = idf[(np.array(item, np.uint64) % np.uint64(cfg.terms)).astype(np.int64)]
    return (all(common_weight(item[part], around, weight[part]) >= cfg.each_half for part in (slice(0, mid), slice(mid, n)))
            and common_weight(item, around, weight) >= cfg.paraphrase_idf)


@dataclass
class Item:
    id: int
    words: list[int]
    answer: list[int]


def read_items(rows: list) -> list[Item]:
    """Items with words; the answer is the last sentence of at least three words,
    or the last five words, where none is given."""
    items = []
    for r in rows:
        text, answer = r["text"] or "", r["answer"]
        if not answer:
            said = [s for s in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if len(s.split()) >= 3]
            answer = said[-1] if said else " ".join(text.split()[-5:])
        h, of = words_of(pa.array([text, answer]))
        if of[1]:
            items.append(Item(r["id"], h[:of[1]].tolist(), h[of[1]:].tolist()))
    return items


@dataclass
class Part:
    """Latent vectors of terms and of some passages; ``table`` rows are idf times
    direction. The passages are of consecutive items from ``item`` on, whose
    first ones are at ``first``."""

    table: np.ndarray
    latent: np.ndarray
    item: int
    first: np.ndarray


@dataclass
class Seeds:
    """Hashes of ``n`` words in a row, ascending, and their items; ``maybe``: the
    low bits of the hashes."""

    n: int
    hashes: np.ndarray
    items: np.ndarray
    maybe: np.ndarray

    def hits(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in some texts where a seed starts, and the seeds' items."""
        s, off = C.shingles(h, of, self.n)
        on = np.flatnonzero(self.maybe[(s & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.hashes, s[on], side) for side in ("left", "right"))
        on, lo, n = on[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        d = np.searchsorted(off, on, "right") - 1
        which = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.repeat(of[d] + on - off[d], n), self.items[which]


@dataclass
class Index:
    cfg: Config
    idf: np.ndarray
    items: list[Item]
    parts: list[Part]
    seeds: list[Seeds]


def item_passages(item: Item, cfg: Config) -> list[list[int]]:
    """The item's words cut into equal passages of at most ``item_passage``."""
    n = len(item.words)
    cuts = np.linspace(0, n, -(-n // cfg.item_passage) + 1).astype(int).tolist()
    return [item.words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def groups(items: list[Item], cfg: Config) -> Iterator[list[Item]]:
    """The items by passes over the documents: a pass is full with ``parts`` times
    ``vectors`` passages."""
    some, n = [], 0
    for i in items:
        if n >= cfg.parts * cfg.vectors:
            yield some
            some, n = [], 0
        some.append(i)
        n += -(-len(i.words) // cfg.item_passage)
    if some:
        yield some


def build_seeds(items: list[Item], cfg: Config) -> list[Seeds]:
    """The runs of words of each item that the fewest items share; an item of
    less than ``run`` words is a run."""
    size = np.array([len(i.words) for i in items])
    out = []
    for n in np.unique(np.minimum(size, cfg.run)).tolist():
        some = np.flatnonzero(np.minimum(size, cfg.run) == n)
        words = np.array([w for k in some for w in items[k].words], np.uint64)
        s, of = C.shingles(words, np.append(0, np.cumsum(size[some])), n)
        owner = np.repeat(some, np.diff(of))
        order = np.lexsort((owner, s))
        s, owner = s[order], owner[order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1]))
        s, owner = s[fresh], owner[fresh]
        _, which, times = np.unique(s, return_inverse=True, return_counts=True)
        least = np.full(len(items), len(items))
        np.minimum.at(least, owner, times[which])
        keep = times[which] == least[owner]
        maybe = np.zeros(1 << 20, bool)
        maybe[(s[keep] & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        out.append(Seeds(n, s[keep], owner[keep], maybe))
    return out


def build_index(items: list[Item], idf: np.ndarray, factor: np.ndarray, cfg: Config) -> Index:
    passages = [(k, words) for k, i in enumerate(items) for words in item_passages(i, cfg)]
    parts = []
    for chosen in np.array_split(np.arange(len(passages)), -(-len(passages) // cfg.vectors)):
        tf = np.zeros((cfg.terms, len(chosen)))
        for j, p in enumerate(chosen):
            np.add.at(tf[:, j], np.array([w % cfg.terms for w in passages[p][1]], np.int64), 1)
        a = tf * idf[:, None]
        a /= np.linalg.norm(a, axis=0)
        v = directions(factor, a, cfg)
        z = v.T @ a
        of = np.array([passages[p][0] for p in chosen])
        parts.append(Part((v * idf[:, None]).astype(np.float32), (z / np.maximum(np.linalg.norm(z, axis=0), 1e-9)).astype(np.float32),
                          int(of[0]), np.flatnonzero(np.append(True, of[1:] != of[:-1]))))
    return Index(cfg, idf.astype(np.float32), items, parts, build_seeds(items, cfg))


def search(h: np.ndarray, of: np.ndarray, index: Index) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, lcs, answer) of the verified matches in some texts."""
    cfg = index.cfg
    if not len(h):
        return []
    term = (h % np.uint64(cfg.terms)).astype(np.int64)
    start, doc = C.cut(of, cfg.half)
    square = np.add.reduceat(index.idf[term] ** 2, start)
    on = np.flatnonzero(doc[1:] == doc[:-1])          # a window is a piece and the next of its text
    square[on] += square[on + 1]
    end = np.append(start[1:], len(h))
    end[on] = end[on + 1]
    at, of_item = (np.concatenate(x) for x in zip(*(s.hits(h, of) for s in index.seeds), strict=True))
    seeded = np.unique((np.searchsorted(start, at, "right") - 1) * len(index.items) + of_item)
    window, of_item = seeded // len(index.items), seeded % len(index.items)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for part in index.parts:
        z = C.piece_sums(part.table, term, start, cfg.half)
        z[on] += z[on + 1]
        cos = (z / np.sqrt(square)[:, None]) @ part.latent
        own = (of_item >= part.item) & (of_item < part.item + len(part.first))
        likely = cos.max(axis=1) >= cfg.cosine
        likely[window[own]] = True
        near = np.flatnonzero(likely)
        if not len(near):
            continue
        # near windows once more, a repeated word counting as the root of its number
        size = end[near] - start[near]
        of2 = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(start[near] - of2, size)
        both, tf = np.unique(np.repeat(np.arange(len(near)), size) * cfg.terms + term[at], return_counts=True)
        first = np.searchsorted(both // cfg.terms, np.arange(len(near)))
        damped = np.add.reduceat(part.table[both % cfg.terms] * np.sqrt(tf)[:, None].astype(np.float32), first, axis=0)
        cos = np.maximum.reduceat((damped / np.sqrt(square[near])[:, None]) @ part.latent, part.first, axis=1)
        take = cos >= cfg.cosine
        take[np.searchsorted(near, window[own]), of_item[own] - part.item] = True
        for w, k in zip(*np.nonzero(take), strict=True):
            d, key = int(doc[near[w]]), part.item + int(k)
            item, old = index.items[key], found.get((d, key), (0.0, 0.0, 0.0))
            if old[1] == 1.0:
                continue
            a, b, side = int(start[near[w]]), int(end[near[w]]), len(item.words)
            around = h[max(int(of[d]), a - side):min(int(of[d + 1]), b + side)].tolist()
            lcs = common_length(item.words, around) / side
            if lcs < min(cfg.lcs_answer, cfg.paraphrase):
                continue
            answer = common_length(item.answer, around) / len(item.answer) if item.answer else 0.0
            if (lcs >= cfg.lcs or (lcs >= cfg.lcs_answer and answer >= cfg.answer)
                    or paraphrased(item.words, lcs, around, index.idf, cfg)):
                found[d, key] = max(old, (min(1.0, float(cos[w, k])), lcs, answer), key=lambda x: x[1:])
    return [(d, index.items[k].id, *v) for (d, k), v in sorted(found.items())]


def matches(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config(), id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of every document and benchmark
    item that it holds."""
    spark = docs.sparkSession
    C.ready(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"),
                             (F.lit(None).cast("string") if answer_col is None else F.col(answer_col)).alias("answer"))
    total = items.count()
    df, n = document_frequency(docs, text_col, cfg)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    blocks = max(1, -(-total // cfg.block))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    g = test_matrix(cfg)
    scaled = (g * idf[:, None]).astype(np.float32)

    def add(into: np.ndarray, h: np.ndarray, of: np.ndarray) -> int:
        sketch(into, h, of, idf, scaled, cfg)
        return 0

    factor = corpus_factor(_summed(docs, text_col, add, g.shape[1], cfg)[0], g, cfg.corpus_rank) if total else None
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()      # about cfg.block items
        known = read_items(sorted(part, key=lambda r: (r["id"] is None, r["id"] or 0, r["text"] or "")))
        for some in groups(known, cfg):
            index = build_index(some, idf, factor, cfg)

            def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
                C.begin("decontamination")
                for batch in batches:
                    col, got = batch.column("text"), []
                    ids = batch.column("id").to_pylist()
                    for lo, hi in C.slices(col, C.SLICE_BYTES // 2):
                        got += [(ids[lo + d], *rest) for d, *rest in search(*words_of(col.slice(lo, hi - lo)), index)]
                    cols = list(zip(*got, strict=True)) if got else [()] * 5
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)],
                                          names=["doc_id", "item_id", "cosine", "lcs", "answer"])

            one = rows.mapInArrow(run, SCHEMA)
            out = one if out is None else out.union(one)
    return spark.createDataFrame([], SCHEMA) if out is None else out
