"""Quality scores from random-indexing word vectors and a two-layer network.

Random indexing: every token has a sparse random index vector; the vector of a
token is the sum of the index vectors of its neighbours over the whole corpus.
Tokens are hashed to a fixed number of buckets, so the vectors are a matrix of a
size that does not grow with the corpus; tasks add up their part of it and parts
are summed by Spark. A document is the mean and the spread of its tokens' vectors; a two-layer
network, trained in numpy on a bounded sample of labelled documents, scores it, and
a temperature fitted on held-back sample rows calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fit_temperature, map_batches, shared

TOKEN = regex.compile(r"\w+|[^\w\s]+")
BLOCK_ROWS = 128


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are learned from (up to 40 % more by chance)."""

    buckets: int = 8192
    dims: int = 64
    ones: int = 4
    window: int = 2
    sample: int = 8000
    hidden: int = 32
    epochs: int = 40
    rate: float = 0.003
    decay: float = 0.003
    seed: int = 7


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, float]
    temperature: float
    settings: Settings


class Tokens:
    """Bucket numbers of tokens; remembers a bounded number of them."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.seen = buckets, {}

    def __call__(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        if len(self.seen) > 1_000_000:
            self.seen = {}
        get = self.seen.get
        out = [get(w) for w in words]
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = self.seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) % self.buckets
        return np.array(out, np.int64)


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries per bucket; the last row, for gaps, is zero."""
    rng = np.random.default_rng(s.seed)
    places = np.argsort(rng.random((s.buckets + 1, s.dims)), axis=1)[:, : s.ones]
    signs = rng.choice([-1.0, 1.0], (s.buckets + 1, s.ones))
    signs[s.buckets] = 0
    return places, signs


def corpus_vectors(docs: DataFrame, settings: Settings, text_col: str = "text") -> np.ndarray:
    """Unit vectors per bucket from all documents, centred on their mean, one zero row for gaps at the end."""
    s = settings

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(s)
        total, tokens, gap = np.zeros((s.buckets + 1) * s.dims), Tokens(s.buckets), np.full(s.window, s.buckets)
        for batch in batches:
            for part in bounded(batch, 4 << 20):
                ids = np.concatenate([x for t in part.column(0).to_pylist() if t for x in (tokens(t), gap)] or [gap])
                for o in range(1, s.window + 1):
                    for a, b in ((ids[:-o], ids[o:]), (ids[o:], ids[:-o])):
                        for k in range(s.ones):
                            np.add.at(total, a * s.dims + places[b, k], signs[b, k])
        rows = total.reshape(-1, s.dims)[: s.buckets].reshape(-1, BLOCK_ROWS * s.dims)
        for i in range(len(rows)):
            if rows[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rows[i].tolist()], pa.list_(pa.float64()))], ["block", "part"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(add, "block int, part array<double>")
    found = parts.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("part")))).alias("total")).collect()
    out = np.zeros((s.buckets, s.dims))
    for r in found:
        out[r.block * BLOCK_ROWS : (r.block + 1) * BLOCK_ROWS] = np.array(r.total).reshape(-1, s.dims)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    used = size[:, 0] > 0
    if used.any():
        out[used] -= out[used].mean(axis=0)
    return np.vstack([out, np.zeros(s.dims)]).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's tokens, the mean product of neighbours' vectors and the
    log of the number of tokens; zero without tokens."""
    total, squares, near = np.zeros(vectors.shape[1]), np.zeros(vectors.shape[1]), 0.0
    for i in range(0, len(ids), 1 << 18):
        rows = vectors[ids[i : i + (1 << 18) + 1]]
        near += float(np.einsum("ij,ij->", rows[:-1], rows[1:], dtype=np.float64))
        rows = rows[: 1 << 18]
        total += rows.sum(axis=0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", rows, rows, dtype=np.float64)
    n = max(len(ids), 1)
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), [near / n, np.log1p(len(ids))]])


def logits(x: np.ndarray, model: QualityModel) -> np.ndarray:
    hidden = np.tanh((x - model.mean) / model.scale @ model.first[0] + model.first[1])
    return hidden @ model.second[0] + model.second[1]


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, s: Settings) -> QualityModel:
    """Two layers, trained by Adam on cross-entropy; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(s.seed)
    d = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
    params = [rng.normal(0, d**-0.5, (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, s.hidden), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    order = rng.permutation(len(x))
    held, train = (order[::5], np.array([i for k, i in enumerate(order) if k % 5], int)) if len(x) >= 20 else (order, order)
    z, step = (x - mean) / scale, 0
    for _ in range(s.epochs if len(x) else 0):
        shuffled = rng.permutation(train)
        for i in range(0, len(shuffled), 64):
            part = shuffled[i : i + 64]
            step += 1
            hidden = np.tanh(z[part] @ params[0] + params[1])
            off = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - y[part]) / len(part)
            back = np.outer(off, params[2]) * (1 - hidden**2)
            grads = [z[part].T @ back + s.decay * params[0], back.sum(axis=0), hidden.T @ off + s.decay * params[2], np.array([off.sum()])]
            for p, g, m in zip(params, grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                p -= s.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, mean, scale, (params[0], params[1]), (params[2], float(params[3][0])), 1.0, s)
    raw = logits(x[held], model) if len(x) else np.zeros(0)
    warm = fit_temperature(np.stack([np.zeros(len(raw)), raw], axis=1), y[held].astype(int)) if len(x) else 1.0
    return QualityModel(vectors, mean, scale, model.first, model.second, warm, s)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Vectors from all documents, the network from a bounded sample of labelled ones.

    ``labels`` holds the rows that may be learned from. Several labels of one
    document count as their rounded mean; labels of unknown documents are ignored.
    """
    vectors = corpus_vectors(docs, settings, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.round(F.avg(F.col(label_col))).cast("int").alias("label"))
    span = 1 << 30
    n = known.count()
    if n > settings.sample:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(span)) < span * settings.sample // n)
    # bounded by the sample, so every task may hold it
    sample = F.broadcast(known.limit(settings.sample * 7 // 5))
    sent = shared(docs.sparkSession, vectors)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, held = Tokens(settings.buckets), sent()
        x = [pooled(tokens(t or ""), held).tolist() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(sample, "label_id")
    found = sorted((r.label, r.x) for r in map_batches(rows.select("label", "text"), features, "label int, x array<double>").limit(settings.sample * 2).collect())
    x = np.array([f[1] for f in found]).reshape(len(found), 2 * settings.dims + 2)
    return fit_network(x, np.array([f[0] for f in found], float), vectors, settings)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` (probability of label 1) and ``predicted``.

    A null text counts as empty; a text without tokens is scored by its zero
    vector. Repeated rows are scored each; other columns are not read.
    """
    sent = shared(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        tokens = Tokens(m.settings.buckets)
        for batch in batches:
            for part in bounded(batch):
                x = np.array([pooled(tokens(t or ""), m.vectors) for t in part.column("text").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(logits(x, m) / m.temperature, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
