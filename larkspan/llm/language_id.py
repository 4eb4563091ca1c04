"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text becomes letters and single blanks; its character n-grams are hashed to
buckets, each with an embedding. The mean embedding goes through a linear layer
and a softmax. Embeddings and layer are trained by stochastic gradient descent
in numpy on a bounded sample; a temperature fitted on a part of that sample
calibrates the probabilities. A softmax is sure of languages it never learned, so
the probability is discounted where a text's n-grams are rarer in the language found
than they are in texts of that sample; a threshold fitted there rejects documents.

At scoring time the linear layer is multiplied into the embeddings beforehand,
so a text costs one lookup per n-gram. Texts of any length are read whole, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_temperature, label_sample, map_batches, shared, softmax

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"
BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``per_label`` and ``max_labels`` bound the training sample: rows per language, languages.

    The threshold refuses at most ``refused_share`` of the right answers on held-back rows;
    without any right answer it is ``least_confidence``. ``unseen`` is the share of n-grams
    expected to be new to a language."""

    bits: int = 15
    dims: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    per_label: int = 800
    max_labels: int = 200
    epochs: int = 8
    rate: float = 0.4
    seed: int = 11
    refused_share: float = 0.002
    least_confidence: float = 0.5
    unseen: float = 0.001


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    table: np.ndarray  # bucket x 2 languages: embedding times linear layer, log share of the language's n-grams
    bias: np.ndarray
    temperature: float
    typical: float  # mean log share below which a text counts as unusual
    least: float
    settings: Settings


def buckets(text: str, settings: Settings) -> np.ndarray:
    """Bucket numbers of all n-grams of the lower-cased letters of a text, in order of order."""
    clean = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(clean.encode("utf-32-le", "replace"), np.uint32)
    out = []
    for start in range(0, len(codes), BLOCK):
        block = codes[start : start + BLOCK + max(settings.orders) - 1]
        h = np.zeros(len(block), np.uint32)
        for n in range(1, max(settings.orders) + 1):
            if n > len(block):
                break
            h = h[: len(block) - n + 1] * np.uint32(0x01000193) + block[n - 1 :] + np.uint32(n)
            if n in settings.orders:
                mixed = h * np.uint32(0x85EBCA6B)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0xC2B2AE35)
                out.append((mixed >> np.uint32(32 - settings.bits))[:BLOCK])
    return np.concatenate(out)


def refusing(found: np.ndarray, share: float) -> float:
    """The value below which at most ``share`` of the rows lie; with too few rows to tell, the tail below the least goes on as an exponential one."""
    least = float(np.quantile(found, share, method="lower"))
    beyond = -np.log(len(found) * share)
    return least - max(0.0, beyond) * (float(np.median(found)) - least) / max(1.0, np.log(len(found) / 2))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings) -> LanguageModel:
    """Train on (language, bucket numbers, shares of the text) rows; order matters, so sort them."""
    labels = tuple(sorted({r[0] for r in rows}))
    n = 1 << settings.bits
    rng = np.random.default_rng(settings.seed)
    if not labels:
        return LanguageModel((), np.zeros((n, 0), np.float32), np.zeros(0), 1.0, 0.0, settings.least_confidence, settings)
    where = {name: i for i, name in enumerate(labels)}
    y = np.array([where[r[0]] for r in rows])
    emb = rng.normal(0, 0.05, (n, settings.dims))
    layer, bias = rng.normal(0, 0.3, (settings.dims, len(labels))), np.zeros(len(labels))
    order = rng.permutation(len(rows))
    held, train = (order[::5], np.array([i for k, i in enumerate(order) if k % 5])) if len(rows) >= 20 else (order, order)
    steps, step = settings.epochs * len(train), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(train):
            _, idx, share = rows[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            hidden = share @ emb[idx]
            off = softmax(hidden @ layer + bias)
            off[y[i]] -= 1
            back = layer @ off
            layer -= rate * np.outer(hidden, off)
            bias -= 0.1 * rate * off
            # the step is scaled so that the mean embedding moves by the rate, however long the text
            emb[idx] -= (rate / (share @ share)) * share[:, None] * back
    counts = np.zeros((n, len(labels)))
    for i in train:
        counts[rows[i][1], y[i]] += rows[i][2]
    shares = (1 - settings.unseen) * counts / np.maximum(counts.sum(0), 1) + settings.unseen / n
    table = np.concatenate([emb @ layer, np.log(shares)], axis=1).astype(np.float32)
    means = np.array([rows[i][2] @ table[rows[i][1]] for i in held])
    logits, usual = means[:, : len(labels)] + bias, means[:, len(labels) :]
    # with one answer in doubt (rule of succession); else a sample without errors gives every text probability 1
    temperature = fit_temperature(logits, y[held], 1 / (len(held) + 2))
    sure, best = softmax(logits / temperature), logits.argmax(1)
    usual = usual[np.arange(len(held)), best]
    right = best == y[held]
    typical, least = 0.0, settings.least_confidence
    if right.any():
        typical = refusing(usual[right], settings.refused_share)
        found = np.clip(sure.max(1)[right] * np.minimum(1, np.exp(usual[right] - typical)), 1e-9, 1 - 1e-9)
        least = float(1 / (1 + np.exp(-refusing(np.log(found / (1 - found)), settings.refused_share))))
        # the best of several is never below 1/n
        if len(labels) > 1:
            least = max(least, float(np.nextafter(1 / len(labels), 1)))
    return LanguageModel(labels, table, bias, temperature, typical, least, settings)


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of the rows that have a text with a letter and a label."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = label_sample(known, "label", ["id", "text"], settings.per_label, settings.max_labels)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        idx, share = [], []
        for text in batch.column("text").to_pylist():
            b, n = np.unique(buckets(text, settings), return_counts=True)
            idx.append(b.astype(np.int32).tobytes())
            share.append((n / n.sum()).astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(idx, pa.binary()), pa.array(share, pa.binary())], ["label", "idx", "share"])

    found = map_batches(sample.select("text", "label"), features, "label string, idx binary, share binary").collect()
    rows = sorted((r.label, bytes(r.idx), bytes(r.share)) for r in found)
    return fit([(a, np.frombuffer(b, np.int32), np.frombuffer(c, np.float32).astype(float)) for a, b, c in rows], settings)


def score(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """Language and calibrated probability, less for a text unusual in that language; ``und`` and 0 for a text without a letter."""
    if text is None or not model.labels or not LETTER.search(text):
        return UNKNOWN, 0.0
    b = buckets(text, model.settings)
    total = np.zeros(2 * len(model.labels))
    for start in range(0, len(b), BLOCK):
        total += model.table[b[start : start + BLOCK]].sum(axis=0, dtype=np.float64)
    logits, usual = np.split(total / len(b), 2)
    p = softmax((logits + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.labels[best], float(p[best] * min(1.0, np.exp(usual[best] - model.typical)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` and ``accepted``.

    A null text and a text without a letter are ``und`` with score 0 and are
    rejected, as are scores below the model's threshold. Repeated rows are
    scored each; other columns are not read.
    """
    sent = shared(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent()
        found = [score(t, model) for t in batch.column("text").to_pylist()]
        names, sure = [f[0] for f in found], [f[1] for f in found]
        ok = [n != UNKNOWN and s >= model.least for n, s in found]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(ok, pa.bool_())], ["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def accepted_rows(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is identified with confidence, all columns unchanged, in one pass without a join."""
    sent = shared(docs.sparkSession, model)
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent()
        found = [score(t, model) for t in batch.column(place).to_pylist()]
        return batch.filter(pa.array([n != UNKNOWN and s >= model.least for n, s in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)
