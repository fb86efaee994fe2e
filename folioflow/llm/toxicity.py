"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, a text the mean of its words, and a
linear softmax over two classes reads it. As all of it is linear before the softmax, a word's share
of the logit is a number that workers remember.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: Bound of the training sample: labelled rows of each class, those with the smallest id hash.
SAMPLE_ROWS = 1200
#: Longer texts, in bytes, are not in the sample; it is what one driver holds. All texts are scored.
SAMPLE_TEXT_BYTES = 200_000
BUCKETS = 1 << 18
DIM = 2
NGRAMS = (3, 4, 5)
ROUNDS = 40
RATE = 0.8
#: Rounds until the full rate.
WARM = 6
#: Pull of a bucket's vector towards zero; most n-grams tell nothing and end there.
SHRINK = 0.07
#: Buckets in fewer than one sample text in LEAST_SHARE are left out, LEAST_TEXTS at least and at most.
LEAST_SHARE = 100
LEAST_TEXTS = (3, 12)
SEED = 11
#: Words that a worker remembers before it starts afresh.
CACHE = 300_000
FOLDS = 5
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str) -> list[int]:
    """Buckets of the character n-grams of <word> and of the word itself."""
    w = f"<{word}>"
    out = [zlib.crc32(w.encode()) % BUCKETS]
    for n in NGRAMS:
        out += [zlib.crc32(w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1)]
    return out


class Model:
    """Embeddings (BUCKETS, DIM), softmax weights (DIM, 2) and bias (2)."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.vectors, self.weights, self.bias = vectors, weights, bias

    def shares(self) -> tuple[list[float], float]:
        """Logit share of each bucket, and the bias: class 1 less class 0."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).tolist(), float(self.bias[1] - self.bias[0])


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's mean vector and their weights, which sum to 1."""
    counted = Counter(words(text))
    if not counted:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    lists = [grams(w) for w in counted]
    sizes = np.array([len(g) for g in lists])
    share = np.repeat(np.array(list(counted.values())) / sizes, sizes) / sum(counted.values())
    used, at = np.unique(np.fromiter((b for g in lists for b in g), dtype=np.int32, count=int(sizes.sum())), return_inverse=True)
    return used, np.bincount(at, share).astype(np.float32)


def least_texts(n: int) -> int:
    low, high = LEAST_TEXTS
    return min(high, max(low, n // LEAST_SHARE))


def forward(params: list[np.ndarray], row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text vectors (weighted sums of bucket vectors) and class probabilities."""
    e, w, b = params
    x = np.stack([np.bincount(row, val * e[col, d], minlength=n) for d in range(e.shape[1])], axis=1)
    z = x @ w + b
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return x, p / p.sum(axis=1, keepdims=True)


def gradients(params: list[np.ndarray], x: np.ndarray, p: np.ndarray, y: np.ndarray, fitted: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the log loss weighted by `fitted`, for embeddings, softmax weights and bias."""
    e, w, _ = params
    g = (p - np.eye(2)[y]) * fitted[:, None]
    gx = g @ w.T
    ge = np.stack([np.bincount(col, val * gx[row, d], minlength=len(e)) for d in range(e.shape[1])], axis=1)
    return ge, x.T @ g, g.sum(axis=0)


def train(texts: list[str | None], labels: list[int], prior: float | None = None, rounds: int = ROUNDS, shrink: float = SHRINK) -> Model:
    """Fit embeddings and softmax together by full-batch Adam on the log loss. prior: share of label 1 in the population."""
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.02, (BUCKETS, DIM))
    weights = rng.normal(0, 0.5, (DIM, 2))
    y = np.array(labels, dtype=np.int64)
    rate1 = float(y.mean()) if len(y) else 0.0
    prior = rate1 if prior is None else prior
    bias = np.log(np.clip([1 - prior, prior], 1e-3, 1))
    if not 0 < rate1 < 1:
        return Model(np.zeros_like(vectors), weights, bias)
    bags = [_bag(t) for t in texts]
    sizes = np.array([len(b) for b, _ in bags])
    row = np.repeat(np.arange(len(bags), dtype=np.int32), sizes)
    col, val = np.concatenate([b for b, _ in bags]), np.concatenate([v for _, v in bags])
    n = len(bags)
    del bags
    # Buckets of few texts go; the others are numbered.
    counts = np.bincount(col, minlength=BUCKETS)
    used = np.flatnonzero(counts >= least_texts(n))
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    col = number[col]
    often = col >= 0
    row, col, val = row[often], col[often], val[often]
    # One scale for all buckets puts the few telling ones of a text within reach of the step size.
    scale = float(np.median(np.maximum(1, sizes)))
    val = val * np.float32(scale)
    weight = np.where(y == 1, prior / rate1, (1 - prior) / (1 - rate1))
    # Every fifth text is left out of the gradient; the round with the least loss on those is kept.
    aside = np.arange(n) % 5 == 4
    if not 0 < y[~aside].mean() < 1:
        aside[:] = False
    fitted = np.where(aside, 0.0, weight) / max(1, int((~aside).sum()))
    best = (np.inf, None)
    e = vectors[used]
    params = [e, weights, bias]
    moment = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        x, p = forward(params, row, col, val, n)
        watched = aside if aside.any() else ~aside
        loss = -(weight * np.log(np.maximum(p[np.arange(n), y], 1e-12)))[watched].mean()
        if loss < best[0]:
            best = (loss, [q.copy() for q in params])
        for i, grad in enumerate(gradients(params, x, p, y, fitted, row, col, val)):
            moment[i] = 0.9 * moment[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad * grad
            rate = RATE * min(1, step / WARM) * (1 - step / (rounds + 1))
            params[i] = params[i] - rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
        norm = np.sqrt((params[0] ** 2).sum(axis=1, keepdims=True))
        params[0] = params[0] * np.maximum(0, 1 - rate * shrink * 10 / np.maximum(norm, 1e-12))
    params = best[1]
    del row, col, val
    vectors = np.zeros((BUCKETS, DIM))
    vectors[used] = params[0] * scale
    release_memory()
    return Model(vectors, params[1], params[2])


class Scorer(dict):
    """Remembers a word's logit share."""

    def __init__(self, shares: list[float], bias: float) -> None:
        self.table, self.bias = shares, bias

    def __missing__(self, word: str) -> float:
        g, t = grams(word), self.table
        s = sum([t[b] for b in g]) / len(g)
        if len(self) >= CACHE:
            self.clear()
        self[word] = s
        return s

    def score(self, text: str | None) -> float:
        ws = words(text)
        z = self.bias + (sum([self[w] for w in ws]) / len(ws) if ws else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """Train on at most sample_rows labelled rows of each class outside the held-out fold.

    Labels that are null, of ids without a document, or of texts over sample_text_bytes are left out,
    so the driver gets 2 * sample_rows * sample_text_bytes at most.
    """
    mine = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    rates = {r.toxic: r.n for r in mine.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = F.xxhash64("doc_id", F.lit("toxicity"))
    parts = [mine.filter(F.col("toxic") == c).select("doc_id", "toxic").orderBy(pick, "doc_id").limit(sample_rows) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    short = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) <= sample_text_bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(short).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()
    prior = rates.get(1, 0) / max(1, sum(rates.values()))
    return train([r.text for r in rows], [int(r.toxic) for r in rows], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs; null and empty texts score the bias alone.

    A null id counts as held out of nothing (held_out false). Repeated rows each get a row; other
    columns are ignored. The model (one number per bucket) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.shares())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            s = [scorer.score(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])
        scorer.clear()
        release_memory()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under 0.5, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model.shares())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))
        scorer.clear()
        release_memory()

    return docs.mapInArrow(run, docs.schema)

