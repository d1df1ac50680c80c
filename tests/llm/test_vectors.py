"""Vector near-duplicates, hard negatives and tokenizer alignment against brute
force, the registered queries included, and on odd rows."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.llm import alignment, hard_negatives, queries, vector_dedup

SF = "/root/testdata/sf0.001"


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).fetchall()


def near(rng, base, cosine):
    """A row at this cosine from each row of ``base``."""
    e = rng.normal(size=base.shape)
    e -= (e * base).sum(1, keepdims=True) * base
    return cosine * base + math.sqrt(1 - cosine ** 2) * e / np.linalg.norm(e, axis=1, keepdims=True)


def brute_links(x):
    """n_links and component of each row (NaN rows link with nothing)."""
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    u = np.where(good[:, None], x, 0) / np.where(good, norm, 1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(1))
        if (new == label).all():
            return link.sum(1), label
        label = new


# --- vector near-duplicates ---------------------------------------------------

def planted(seed=0, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(600, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    hot = near(rng, np.repeat(base[:1], 250, 0), 0.99)          # one large group of near copies
    loose = near(rng, np.repeat(base[1:2], 60, 0), 0.953)       # a group around the threshold
    pairs = [near(rng, base[2 + 50 * i:52 + 50 * i], c) for i, c in enumerate((0.9005, 0.93, 0.97, 0.8995))]
    x = np.concatenate([base, hot, loose, *pairs, base[10:40], 3 * base[40:50]])
    return x[rng.permutation(len(x))]


def test_vector_dedup_brute_force(spark):
    x = planted()
    links, label = brute_links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_dedup.cluster(df, vector_dedup.Config(block=16)).toPandas().sort_values("vec_id")
    assert list(got.vec_id) == list(range(len(x)))
    assert (got.n_links.to_numpy() <= links).all()              # no link below the threshold
    assert got.n_links.sum() >= 0.97 * links.sum()
    groups = Counter(label)
    far = np.array([groups[c] > 20 for c in label])
    assert (got.n_links.to_numpy()[far] >= links[far] - 1).all()
    same = got.component_id.to_numpy() == label
    assert same.mean() > 0.97
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_vector_dedup_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.concatenate([base, near(rng, base[:1000], 0.9001)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_dedup.cluster(df).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy()[2000:] > 0).mean() >= 0.95


def test_vector_dedup_query(spark):
    x = np.array([r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()])
    links, label = brute_links(x.astype(np.float64))
    got = queries.QUERIES["op11_vector_dedup"](spark, SF).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == label).all()


def test_vector_dedup_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x", 0), (2, None, "x", 1), (3, [0.0, 0.0], "x", 2), (4, [], "x", 3), (5, [1.0, None], "x", 4),
            (6, [nan, 1.0], "x", 5), (7, [inf, 1.0], "x", 6), (None, [2.0, 0.01], "x", 7), (8, [1.0], "x", 8),
            (9, [1e200, 1e198], "x", 9), (1, [1.0, 0.0], "x", 10), (1, [0.0, 1.0], "x", 11), (10, [0.0, -2.0], "x", 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, text string, cid long")
    got = vector_dedup.cluster(df).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert of[None] == [(4, 1, True)] and of[8] == [(4, 1, False)] and of[9] == [(4, 1, False)]
    assert sorted(of[1]) == [(0, 1, True), (4, 1, True), (4, 1, True)]
    for i in (2, 3, 4, 5, 6, 7, 10):
        assert of[i] == [(0, i, True)]
    none = vector_dedup.cluster(df.limit(0))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.count() == 0
    assert {(r.vec_id, r.n_links) for r in vector_dedup.cluster(df.filter("vec_id IN (2, 3)")).collect()} == {(2, 0), (3, 0)}


# --- hard negatives -----------------------------------------------------------

def brute_negatives(rows, anchor, cfg=hard_negatives.Config()):
    """rows: (id, label, integer vector)."""
    out = []
    key = lambda t: (-t[0], t[1])
    for i, label, q in sorted({(i, la, tuple(q)) for i, la, q in rows if anchor(i)}):
        scored = [(sum(a * b for a, b in zip(q, r[2], strict=False)), r[0], r[1]) for r in rows]
        for p in sorted([s for s in scored if s[2] == label and s[1] != i], key=key)[:cfg.positives]:
            fit = sorted([s for s in scored if s[2] != label and cfg.least * p[0] <= 100 * s[0] <= cfg.most * p[0]], key=key)
            out += [(i, p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(fit[:cfg.negatives])]
    return sorted(out)


def floored(df, label="label"):
    return [(r.vec_id, r.la, [math.floor(256 * x) for x in r.embedding])
            for r in df.selectExpr("vec_id", f"{label} AS la", "embedding").collect()]


def test_hard_negatives_query(spark):
    got = sorted(map(tuple, queries.QUERIES["op12_hard_negatives"](spark, SF).collect()))
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = floored(df, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    assert got == brute_negatives(rows, lambda i: i % 100 == 0)
    assert got == sorted(oracle(queries.OP12_SQL, embeddings=df.toPandas()))
    assert len(got) > 100


@pytest.mark.parametrize("cfg", [hard_negatives.Config(), hard_negatives.Config(clusters=3, anchors=20, step=16, probe=0.3)])
def test_hard_negatives_clustered(spark, cfg):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    x = centre[rng.integers(0, 6, 900)] + rng.normal(scale=0.2, size=(900, 8))
    x[100:400] = x[100]                                        # a third of the rows are equal
    df = spark.createDataFrame([(i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.mine(df.repartition(7), F.col("vec_id") % 20 == 0, cfg=cfg).collect()))
    assert got == brute_negatives(floored(df), lambda i: i % 20 == 0)


def test_hard_negatives_certified_end():
    """On clustered rows a walk ends long before its list does."""
    rng = np.random.default_rng(6)
    centre = 4 * rng.normal(size=(20, 16))
    x = np.floor(256 * (centre[np.arange(8000) % 20] + rng.normal(scale=0.05, size=(8000, 16)))).astype(np.int64)
    anchors = x[:200:20]
    n = len(anchors)
    none, least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, hard_negatives.NOWHERE), np.full(n, np.iinfo(np.int64).max)
    block = hard_negatives.Block(np.arange(0, 200, 20), np.zeros(n, np.int64), anchors, hard_negatives.Clusters(anchors.astype(float), 4),
                                 np.arange(n), least, most, least, none, True, 5)
    answers = hard_negatives.Answers(5, least, none)
    done = block.walk(answers, np.arange(8000), np.zeros(8000, np.int64), x, 256)
    assert done < 0.25 * n * 8000
    for a in range(n):
        s = anchors[a] @ x.T
        s[20 * a] = hard_negatives.NOWHERE
        assert list(answers.score[a]) == sorted(s.tolist(), reverse=True)[:5]


def test_hard_negatives_odd_rows(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0], "x"), (0, 1, [1.0, 0.0], "x"), (1, 1, [2.0, 0.0], "x"), (2, 1, None, "x"), (3, None, [1.0, 1.0], "x"),
            (4, 2, [1.0, None], "x"), (5, 2, [nan, 1.0], "x"), (None, 2, [1.0, 1.0], "x"), (6, 2, [1.5], "x"), (7, 2, [1.0, 9.0], "x"),
            (7, 2, [1.0, 9.0], "x"), (8, 2, [1e30, 1.0], "x"), (9, 2, [], "x"), (10, 1, [0.0, 0.0], "x"), (11, 2, [-1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, question string")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute_negatives([(i, la, [math.floor(256 * c) for c in v]) for i, la, v, _ in rows
                                   if None not in (i, la, v) and all(c is not None and abs(c) < 1e6 for c in v)], lambda i: i % 5 == 0)
    assert [r[:4] for r in got if r[0] == 0] == [(0, 1, 1, 6), (0, 1, 2, 7), (0, 1, 3, 7), (0, 10, 1, 9)]
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


# --- alignment ----------------------------------------------------------------

PATHS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def brute_alignment(rows):
    """The contract with one encode call per text and no windows or tables."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    alphabet, out, pairs = alignment.byte_alphabet(), [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [{e: n + 1 for n, e in enumerate(np.cumsum([len(t) for t in x]).tolist())} for x in (bytes_a, bytes_b)]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0][end], ends[1][end]
                    groups.append((ids_a[i:x], ids_b[j:y]))
                    i, j = x, y
        links = [(g[0][-1], g[1][-1]) for g in groups]
        pairs.update(links)
        out.append((doc_id, groups, links))
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    result = []
    for doc_id, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        result.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                       sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links),
                       hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(result, key=str)


def test_alignment_query(spark):
    got = sorted(map(tuple, queries.QUERIES["op13_alignment"](spark, SF).collect()), key=str)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute_alignment(rows)


def test_alignment_odd_rows(spark):
    rows = [(1, ""), (2, None), (None, "no id here"), (3, "twice the same"), (3, "twice the same"), (4, "a ▁ mark of its own"),
            (5, "  many   spaces \n\n and\ttabs\r\n "), (6, "日本語のテキスト、漢字 と かな"), (7, "emoji 👩‍👩‍👧 and ﬁ ligature é é"),
            (8, "<|endoftext|> </s> <s><0x0A> [INST]"), (9, "x" * 20_000), (10, "wörter " * 30_000), (11, "\x00\x01 control"),
            (12, "don't we'll I'VE 12345 3.14159 a,b;c.d e"), (13, " "), (14, "a▁b c"), (15, "C++::f(x)->y[0]!=\"z\"; // ok"),
            (16, "word\nword\n\nword \n word")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, codes string")
    got = sorted(map(tuple, alignment.align(df, *PATHS).collect()), key=str)
    assert got == brute_alignment(rows)
    assert alignment.align(df.limit(0), *PATHS).count() == 0


def test_alignment_small_tables(spark):
    """Tables of windows and units that fill up and start anew give the same."""
    import pyarrow as pa
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").filter("text != ''").limit(40).collect()
    col = pa.array([r.text for r in rows])
    whole, small = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS)
    small.windows.slots, small.encode_b.slots = 1 << 10, 1 << 9
    small.windows.reset()
    small.encode_b.reset()
    want, got = [], []
    for lo in range(0, len(col), 2):
        part = col.slice(lo, 2)
        for aligner, into in ((whole, want), (small, got)):
            counts, joined, links = aligner.texts(part)
            into.append((counts.tolist(), joined, [x.tolist() for x in links]))
    assert got == want


def test_alignment_pairs_are_bounded():
    here = alignment.Aligner(*PATHS)
    assert alignment.most_pairs(here.a, here.b) < 1_000_000
