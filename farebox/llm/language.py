"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes; one update-gated layer reads each window
forwards, one backwards, and a softmax over both states labels every byte
position. A document's probability of a language is the mean over its letter
bytes. The network is trained in numpy by backpropagation through time on a
bounded sample of windows. Windows of many documents go through the network
together, so a very long document is just more rows of the batch.

Nulls: a NULL text, or one without letters, is ``und`` with score 0. Rows with
a NULL language or id are not learned from. If nothing can be learned, every
text is ``und``. Repeated rows each get their label; other columns pass through
unless they have an output's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm import common as C

UNKNOWN = "und"


@dataclass(frozen=True)
class Config:
    window: int = 96            # bytes read together
    hidden: int = 16            # state size per direction
    docs_per_language: int = 600  # bound on documents per language that are learned from
    sample_bytes: int = 1 << 24 # bound on their text
    windows_per_doc: int = 4    # windows drawn from each, anywhere in the text
    batch: int = 192
    epochs: int = 7
    rate: float = 0.01
    seed: int = 1


_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def _sequences(x: np.ndarray, back: bool) -> range:
    return range(len(x) - 1, -1, -1) if back else range(len(x))


class Network:
    """Input rows by byte, recurrent weights and output layer of both directions.
    ``x`` is always (positions, windows)."""

    def __init__(self, labels: list[str], cfg: Config, rng: np.random.Generator) -> None:
        h, f32 = cfg.hidden, np.float32
        self.labels, self.hidden = labels, h
        self.p = {"out": rng.normal(0, 0.2, (2 * h, len(labels))).astype(f32),
                  "bias": np.zeros(len(labels), f32)}
        for d in "fb":
            self.p["in" + d] = rng.normal(0, 0.3, (256, 2 * h)).astype(f32)
            self.p["rec" + d] = rng.normal(0, 0.6 / np.sqrt(h), (h, 2 * h)).astype(f32)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """State after each position: h += z * (c - h), with the gate z and the
        candidate c from the byte and the state before."""
        h, rec, table = self.hidden, self.p["rec" + d], self.p["in" + d]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in _sequences(x, d == "b"):
            a = table[x[t]]
            a += state @ rec
            np.tanh(a, out=a)
            z = a[:, :h] * 0.5
            z += 0.5
            if keep is not None:
                keep.append((t, state, z, a[:, h:].copy()))
            c = a[:, h:]
            c -= state
            c *= z
            state = state + c
            out[t] = state
        return out

    def logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = self.hidden
        return f @ self.p["out"][:h] + b @ self.p["out"][h:] + self.p["bias"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: (positions, windows, labels)."""
        z = self.logits(self.states(x, "f"), self.states(x, "b"))
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean log loss over the masked positions and its gradients, through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        s = {d: self.states(x, d, kept[d]) for d in "fb"}
        z = self.logits(s["f"], s["b"])
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        n = max(float(mask.sum()), 1.0)
        hit = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
        loss = float(-(np.log(hit + 1e-9) * mask).sum() / n)
        dz = p
        np.put_along_axis(dz, np.broadcast_to(y[None, :, None], (*x.shape, 1)), (hit - 1)[..., None], 2)
        dz *= (mask / n)[..., None].astype(np.float32)
        h, g = self.hidden, {"bias": dz.sum((0, 1))}
        flat = dz.reshape(-1, dz.shape[2])
        g["out"] = np.concatenate([s[d].reshape(-1, h).T @ flat for d in "fb"])
        for i, d in enumerate("fb"):
            ds = dz @ self.p["out"][i * h:(i + 1) * h].T
            rec = self.p["rec" + d]
            g["rec" + d], g["in" + d] = np.zeros_like(rec), np.zeros((256, 2 * h), np.float32)
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, before, gate, cand in reversed(kept[d]):
                dh = ds[t] + carry
                da = np.empty((len(dh), 2 * h), np.float32)
                da[:, :h] = dh * (cand - before) * 2 * gate * (1 - gate)
                da[:, h:] = dh * gate * (1 - cand * cand)
                carry = dh * (1 - gate) + da @ rec.T
                g["rec" + d] += before.T @ da
                np.add.at(g["in" + d], x[t], da)
        return loss, g

    def train(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, cfg: Config) -> None:
        """Adam over shuffled mini-batches of windows (rows of ``x``)."""
        rng = np.random.default_rng(cfg.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(cfg.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), cfg.batch):
                i = order[at:at + cfg.batch]
                mask = ((np.arange(x.shape[1])[:, None] < size[i]) * _LETTER[x[i].T]).astype(np.float32)
                _, g = self.gradients(x[i].T, mask, y[i])
                step += 1
                for k, w in self.p.items():
                    gr = np.clip(g[k], -1, 1)
                    m[k] += 0.1 * (gr - m[k])
                    v[k] += 0.01 * (gr * gr - v[k])
                    w -= cfg.rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text cut into equal windows of at most ``width`` bytes: the byte
    matrix (0 after a window's end), the window lengths and their texts."""
    n = np.diff(offsets)
    parts = -(-n // width)
    doc = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = offsets[:-1][doc] + k * n[doc] // np.maximum(parts[doc], 1)
    hi = offsets[:-1][doc] + (k + 1) * n[doc] // np.maximum(parts[doc], 1)
    at = lo[:, None] + np.arange(width)
    x = np.where(at < hi[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((0, width))
    return x.astype(np.uint8), hi - lo, doc


def classify(col: pa.Array, net: Network, cfg: Config, together: int = 1024) -> np.ndarray:
    """Mean label probabilities of each text over its letter bytes."""
    out = np.zeros((len(col), len(net.labels)))
    for lo, hi in C.slices(col):
        data, offsets = C.utf8(col.slice(lo, hi - lo))
        x, size, doc = windows(data, offsets, cfg.window)
        total = np.zeros((hi - lo, len(net.labels)))
        weight = np.zeros(hi - lo)
        for at in range(0, len(x), together):
            part = np.ascontiguousarray(x[at:at + together].T)
            mask = _LETTER[part] * (np.arange(cfg.window)[:, None] < size[at:at + together])
            p = np.einsum("twl,tw->wl", net.probabilities(part), mask.astype(np.float32))
            np.add.at(total, doc[at:at + together], p)
            np.add.at(weight, doc[at:at + together], mask.sum(0))
        out[lo:hi] = total / np.maximum(weight, 1)[:, None]
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", cfg: Config = Config()) -> Network | None:
    """Trains on windows of at most about ``docs_per_language`` documents of
    each language among the rows that ``learn`` (over ``_id``) allows."""
    C.ready(docs.sparkSession)
    known = (docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
             .filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull()).filter(learn))
    counts = known.groupBy("_lang").count().collect()      # one row per language
    if not counts:
        return None
    labels = sorted(r["_lang"] for r in counts)
    shares = docs.sparkSession.createDataFrame(
        [(r["_lang"], min(1.0, cfg.docs_per_language / r["count"])) for r in counts], "_lang string, _share double")
    chosen = (known.join(F.broadcast(shares), "_lang")
              .filter((C.unit_hash("_id", cfg.seed) < F.col("_share")) & F.col("_text").rlike(r"\p{L}")))
    chosen = C.bounded_rows(chosen.select("_id", "_lang", "_text"), "_id", "_text",
                            2 * cfg.docs_per_language * len(labels), cfg.sample_bytes * len(labels), cfg.seed)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("language")
        for batch in batches:
            for lo, hi in C.slices(batch.column("_text")):
                part = batch.slice(lo, hi - lo)
                data, offsets = C.utf8(part.column("_text"))
                x, size, doc = windows(data, offsets, cfg.window)
                ids = part.column("_id").to_numpy(zero_copy_only=False)
                rank = C.mix(ids[doc].astype(np.uint64) * np.uint64(1 << 20) + np.arange(len(doc), dtype=np.uint64) - np.searchsorted(doc, doc).astype(np.uint64))
                order = np.lexsort((rank, doc))
                place = np.arange(len(order)) - np.searchsorted(doc, doc)
                take = order[place < cfg.windows_per_doc]
                yield pa.record_batch([pa.array(ids[doc[take]], pa.int64()), part.column("_lang").take(pa.array(doc[take])),
                                       pa.array(rank[take].view(np.int64), pa.int64()), pa.array(size[take].astype(np.int32)),
                                       pa.array([w.tobytes() for w in x[take]], pa.binary())],
                                      names=["id", "lang", "rank", "size", "x"])

    rows = chosen.select(F.col("_id").cast("long"), "_lang", "_text").mapInArrow(
        draw, "id long, lang string, rank long, size int, x binary").collect()   # bounded sample of windows
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], r["rank"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(len(rows), cfg.window)
    at = {v: i for i, v in enumerate(labels)}
    net = Network(labels, cfg, np.random.default_rng(cfg.seed))
    net.train(x, np.array([r["size"] for r in rows]), np.array([at[r["lang"]] for r in rows]), cfg)
    return net


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", cfg: Config = Config()) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, that label's mean probability."""
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))

    C.ready(docs.sparkSession)

    @F.arrow_udf("struct<lang:string, score:double>")
    def label(text: pa.Array) -> pa.Array:
        C.begin("language")
        p = classify(text, net, cfg)
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array([net.labels[i] for i in best], pa.string()),
             pa.array(np.clip(p[np.arange(len(p)), best], 0, 1), pa.float64())], names=["lang", "score"])

    readable = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("_label", label(F.col(text_col))).withColumn("_readable", readable)
    return (found.withColumn("lang_pred", F.when(F.col("_readable"), F.col("_label.lang")).otherwise(UNKNOWN))
            .withColumn("score", F.when(F.col("_readable"), F.col("_label.score")).otherwise(0.0))
            .drop("_label", "_readable"))
