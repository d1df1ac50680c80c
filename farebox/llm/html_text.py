"""Main text of web pages: a recurrent block labeller.

A page is the sequence of its leaf blocks (``html_blocks``). Each block is a
vector of its tag path (learned vectors of hashed path words), its words
(learned vectors of hashed words) and a few counts; a bidirectional LSTM in
numpy reads the whole sequence both ways and labels every block as main text or
not, so a block is judged by all of the page.

Nobody labels these pages by hand. The network learns from a bounded sample:
pages whose own markup says what is what (``article`` or ``main`` against
menus, footers and the like), and pages composed from the sample's texts in many
layouts, with main text in differently named containers, and menus, sidebars,
notices, adverts, forms and reader comments around and inside it, whose labels
are known by construction. Nothing decides by container at prediction.

Nulls: a NULL, empty or text-free page has the empty text. Repeated rows are
extracted each. With an empty table the network learns from composed pages of a
few fixed words. Other columns pass through unless they have an output's name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm.html_blocks import Block, blocks

#: Path words that mark main text, and other parts of a page (fixed values).
MAIN = "article main content post entry story text body".split()
OTHER = ("nav menu navbar breadcrumb breadcrumbs header masthead footer aside sidebar widget related recommended ad ads "
         "advert advertisement banner promo sponsored cookie consent notice alert newsletter subscribe signup share social "
         "comments comment reply replies discussion login search form copyright disclaimer tags pagination popup modal").split()


@dataclass(frozen=True)
class Config:
    path_rows: int = 2048       # hashed path words
    path_dims: int = 20
    word_rows: int = 4096       # hashed words
    word_dims: int = 8
    hidden: int = 20
    pages: int = 300            # bound on sampled page ids; twice as many pages
    sample_bytes: int = 1 << 26 # bound on their html
    composed: int = 700         # pages composed for training
    epochs: int = 6
    batch: int = 24
    rate: float = 0.01
    seed: int = 4

    @property
    def inputs(self) -> int:
        return self.path_dims + self.word_dims + 6


_HASHED: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _HASHED.get(word)
    if h is None:
        if len(_HASHED) > 500_000:
            _HASHED.clear()
        h = _HASHED[word] = zlib.crc32(word.encode())
    return h


class Batch:
    """Blocks of several pages: flat word lists, counts and page lengths."""

    def __init__(self, pages: list[list[Block]], cfg: Config) -> None:
        flat = [b for p in pages for b in p]
        # the innermost path words count again: (word, depth from the leaf)
        paths = [[_hash(w) % cfg.path_rows for w in b.path] + [_hash("leaf " + w) % cfg.path_rows for w in b.path[-3:]] for b in flat]
        words = [[_hash(w) % cfg.word_rows for w in b.text.split(" ")] for b in flat]
        self.path, self.path_of = _flat(paths)
        self.word, self.word_of = _flat(words)
        n = np.diff(self.word_of)
        self.length = np.array([len(p) for p in pages], np.int64)
        place = np.concatenate([np.arange(k) / max(k, 1) for k in self.length]) if len(flat) else np.zeros(0)
        self.counts = np.stack([
            np.log1p(n) / 4, np.array([b.links for b in flat]), np.array([b.text[-1:] in ".!?" for b in flat], float),
            place, np.minimum(n, 3) / 3, np.ones(len(flat))], 1).astype(np.float32) if len(flat) else np.zeros((0, 6), np.float32)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    of = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.array([i for x in lists for i in x], np.int64), of


class Labeller:
    """The tables, both LSTM directions and the output layer."""

    def __init__(self, cfg: Config) -> None:
        rng, f32 = np.random.default_rng(cfg.seed), np.float32
        h = cfg.hidden
        self.cfg = cfg
        self.p = {"path": rng.normal(0, 0.3, (cfg.path_rows, cfg.path_dims)).astype(f32),
                  "word": rng.normal(0, 0.1, (cfg.word_rows, cfg.word_dims)).astype(f32),
                  "out": rng.normal(0, 0.3, 2 * h).astype(f32), "skip": np.zeros(cfg.inputs, f32), "bias": np.zeros(1, f32)}
        for d in "fb":
            self.p["in" + d] = rng.normal(0, 1 / np.sqrt(cfg.inputs), (cfg.inputs, 4 * h)).astype(f32)
            self.p["rec" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(f32)
            self.p["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(f32)

    def inputs(self, b: Batch) -> np.ndarray:
        path = C.segment_sum(self.p["path"][b.path], b.path_of) / np.sqrt(np.maximum(np.diff(b.path_of), 1))[:, None]
        word = C.segment_sum(self.p["word"][b.word], b.word_of) / np.maximum(np.diff(b.word_of), 1)[:, None]
        return np.concatenate([path, word, b.counts], 1).astype(np.float32)

    @staticmethod
    def grid(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages) positions of blocks in the flat order, and which exist."""
        t = np.arange(max(int(length.max(initial=0)), 1))[:, None]
        start = np.cumsum(length) - length
        real = t < length
        return np.where(real, start + t, 0), real

    def states(self, x: np.ndarray, real: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """LSTM states (steps, pages, hidden); absent steps leave the state alone."""
        h = self.cfg.hidden
        gates_in = x @ self.p["in" + d] + self.p["b" + d]
        s = np.zeros((x.shape[1], h), np.float32)
        c = np.zeros_like(s)
        out = np.zeros((*x.shape[:2], h), np.float32)
        for t in (range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)):
            a = gates_in[t] + s @ self.p["rec" + d]
            g = 1 / (1 + np.exp(-np.clip(a[:, :3 * h], -20, 20)))
            i, f, o, z = g[:, :h], g[:, h:2 * h], g[:, 2 * h:], np.tanh(a[:, 3 * h:])
            on = real[t][:, None]
            c2 = np.where(on, f * c + i * z, c)
            tc = np.tanh(c2)
            s2 = np.where(on, o * tc, s)
            if keep is not None:
                keep.append((t, s, c, i, f, o, z, tc))
            s, c = s2, c2
            out[t] = s
        return out

    def probabilities(self, b: Batch) -> np.ndarray:
        """Chance of main text of every block, in flat order."""
        if not len(b.counts):
            return np.zeros(0)
        flat = self.inputs(b)
        at, real = self.grid(b.length)
        x = flat[at]
        h = self.cfg.hidden
        z = self.states(x, real, "f") @ self.p["out"][:h] + self.states(x, real, "b") @ self.p["out"][h:] + x @ self.p["skip"] + self.p["bias"]
        out = np.zeros(len(flat))
        out[at[real]] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[real]
        return out

    def gradients(self, b: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over blocks with a label (y >= 0)."""
        p, h = self.p, self.cfg.hidden
        flat = self.inputs(b)
        at, real = self.grid(b.length)
        x = flat[at]
        kept: dict[str, list] = {"f": [], "b": []}
        s = {d: self.states(x, real, d, kept[d]) for d in "fb"}
        z = s["f"] @ p["out"][:h] + s["b"] @ p["out"][h:] + x @ p["skip"] + p["bias"]
        told = real & (y[at] >= 0)
        dz = np.where(told, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at], 0) / max(told.sum(), 1)
        dz = dz.astype(np.float32)
        g = {"bias": dz.sum(keepdims=True)[0], "skip": np.einsum("tp,tpi->i", dz, x),
             "out": np.concatenate([np.einsum("tp,tph->h", dz, s[d]) for d in "fb"])}
        dx = dz[..., None] * p["skip"]
        for k, d in enumerate("fb"):
            rec = p["rec" + d]
            g["rec" + d] = np.zeros_like(rec)
            da_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, s0, c0, i, f, o, zz, tc in reversed(kept[d]):
                on = real[t][:, None]
                dh = ds + dz[t][:, None] * p["out"][k * h:(k + 1) * h]
                dct = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dct * zz * i * (1 - i), dct * c0 * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - zz * zz)], 1)
                da = np.where(on, da, 0)
                da_all[t] = da
                g["rec" + d] += s0.T @ da
                ds = np.where(on, da @ rec.T, dh)
                dc = np.where(on, dct * f, dc)
            g["in" + d] = np.einsum("tpi,tpg->ig", x, da_all)
            g["b" + d] = da_all.sum((0, 1))
            dx += da_all @ p["in" + d].T
        dflat = np.zeros_like(flat)
        dflat[at[real]] = dx[real]
        cfg = self.cfg
        n, m = np.diff(b.path_of), np.diff(b.word_of)
        g["path"], g["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
        np.add.at(g["path"], b.path, np.repeat(dflat[:, :cfg.path_dims] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0))
        np.add.at(g["word"], b.word, np.repeat(dflat[:, cfg.path_dims:cfg.path_dims + cfg.word_dims] / np.maximum(m, 1)[:, None], m, axis=0))
        return g

    def train(self, pages: list[tuple[list[Block], list[int]]]) -> None:
        """Adam over mini-batches of pages, by backpropagation through time."""
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(cfg.epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), cfg.batch):
                some = [pages[i] for i in order[at:at + cfg.batch]]
                y = np.array([k for _, ys in some for k in ys], np.int64)
                step += 1
                for k, gr in self.gradients(Batch([p for p, _ in some], cfg), y).items():
                    gr = np.clip(gr, -1, 1)
                    m[k] += 0.1 * (gr - m[k])
                    v[k] += 0.01 * (gr * gr - v[k])
                    self.p[k] -= (cfg.rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)


# --- what it learns from ----------------------------------------------------

def told(page: list[Block]) -> list[int]:
    """1 or 0 where a page's own elements say so, -1 elsewhere."""
    out = []
    for b in page:
        words = set(b.path)
        out.append(0 if words & {"nav", "footer", "aside", "form", "menu", "button", "label", "option"} or words & {"ad", "ads", "comments", "sidebar"}
                   else 1 if words & {"article", "main"} else -1)
    return out


def compose(texts: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page of the given texts in a random layout, with its labels."""
    page: list[Block] = []
    labels: list[int] = []
    outer = ["html", "body"] + (["div"] + [str(rng.choice(["wrapper", "page", "container", "site", "layout"]))] if rng.random() < 0.5 else [])
    pick = lambda: str(texts[rng.integers(len(texts))])

    def short() -> str:
        words = pick().split(" ")
        k = int(rng.integers(1, 6))
        at = int(rng.integers(0, max(1, len(words) - k)))
        return " ".join(words[at:at + k])

    def add(path: list[str], text: str, label: int, links: float = 0.0) -> None:
        page.append(Block(tuple(path), text, links))
        labels.append(label)

    def other(inside: list[str]) -> None:
        word = str(rng.choice(OTHER))
        holder = [word] if word in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6 else [str(rng.choice(["div", "section", "ul", "aside", "p"])), word]
        if rng.random() < 0.3:
            holder.append(str(rng.choice(["box", "area", "list", "block", "inner", "top", "bottom", "left", "right", "section", "text", "content"])))
        path = inside + holder
        prose = word in ("comments", "comment", "reply", "replies", "discussion", "ad", "ads", "advert", "notice", "cookie", "consent", "sponsored", "promo", "disclaimer", "footer", "copyright")
        for _ in range(int(rng.integers(1, 7))):
            if prose:
                add(path + ([["p"], ["div"], ["li"], ["article", "comment", "p"], []][rng.integers(5)] if word[:3] in ("com", "rep", "dis") else [["p"], []][rng.integers(2)]),
                    pick() if rng.random() < 0.8 else short(), 0, float(rng.random() < 0.1))
            else:
                add(path + [["ul", "li"], ["li"], ["p"], ["div"], []][rng.integers(5)], short() if rng.random() < 0.85 else pick(), 0, float(rng.random() < 0.6))

    for _ in range(int(rng.integers(1, 5))):
        other(outer)
    holder = [["article"], ["main"], ["main", "article"], ["div", str(rng.choice(MAIN))], ["section", str(rng.choice(MAIN))],
              ["div", "id", str(rng.choice(MAIN)), "div"], ["div"]][rng.integers(7)]
    inside = outer + holder
    if rng.random() < 0.8:
        add(inside + [["h1"], ["header", "h1"], ["h2"]][rng.integers(3)] if "article" in holder else inside + ["h1"], short() if rng.random() < 0.5 else pick(), 1)
    for _ in range(int(rng.integers(1, 14))):
        kind = [["p"], ["p"], ["p"], ["p"], ["h2"], ["ul", "li"], ["blockquote", "p"], ["pre"], ["table", "tr", "td"], ["div"], ["figure", "figcaption"], []][rng.integers(12)]
        add(inside + kind, short() if kind in (["h2"], ["table", "tr", "td"]) or rng.random() < 0.08 else pick(), 1, float(rng.random() < 0.05))
        if rng.random() < 0.07:
            other(inside)
    if rng.random() < 0.3:
        other(inside)
    for _ in range(int(rng.integers(1, 5))):
        other(outer)
    return page, labels


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", cfg: Config = Config()) -> Labeller:
    """Learns from at most about ``cfg.pages`` pages, chosen by a hash of the id,
    and ``cfg.composed`` pages composed from their texts."""
    total = pages.count()
    rank = F.when(F.col(id_col).isNull(), C.unit_hash(html_col, cfg.seed)).otherwise(C.unit_hash(id_col, cfg.seed))
    sample = (pages.filter(F.col(html_col).isNotNull()).filter(rank < min(1.0, cfg.pages / max(total, 1)))
              .select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")))
    sample = C.bounded_rows(sample, "id", "html", 2 * cfg.pages, cfg.sample_bytes, cfg.seed)
    rows = sorted(sample.collect(), key=lambda r: (r["id"] or "", r["html"]))     # bounded by cfg.pages and cfg.sample_bytes
    real = [p for r in rows if (p := blocks(r["html"]))]
    texts = [b.text for p in real for b in p] or ["It was a plain day.", "Read on", "Two words here, and more of them."]
    rng = np.random.default_rng(cfg.seed)
    net = Labeller(cfg)
    net.train([(p, told(p)) for p in real] + [compose(texts, rng) for _ in range(cfg.composed)])
    return net


def extract(pages: DataFrame, net: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``: the blocks labelled as main text, in page order,
    joined by line breaks."""
    C.ready(pages.sparkSession)
    cfg = net.cfg

    @F.arrow_udf("string")
    def main_text(col: pa.Array) -> pa.Array:
        out: list[str] = []
        for lo, hi in C.slices(col):
            for part in _alike([blocks(t) for t in col.slice(lo, hi - lo).to_pylist()], out):
                pages_in, put = part
                p = net.probabilities(Batch(pages_in, cfg))
                at = 0
                for k, page in zip(put, pages_in, strict=True):
                    out[k] = "\n".join(b.text for b, q in zip(page, p[at:at + len(page)], strict=True) if q >= 0.5)
                    at += len(page)
        return pa.array(out, pa.string())

    return pages.withColumn("text", main_text(F.col(html_col)))


def _alike(pages: list[list[Block]], out: list[str]) -> Iterator[tuple[list[list[Block]], list[int]]]:
    """Pages in groups of like length, so little of a batch is padding; reserves
    their places in ``out``."""
    first = len(out)
    out += [""] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    order = [i for i in order if pages[i]]
    for at in range(0, len(order), 128):
        some = order[at:at + 128]
        yield [pages[i] for i in some], [first + i for i in some]
