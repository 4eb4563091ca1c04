"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII blanks, as in the queries' contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: A staged table up to this many bytes may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def kept(key: object, make: Callable[[], object]) -> object:
    """A value made once per Python worker (tokenizers, tables of constants)."""
    store = sys.__dict__.setdefault("_larkspan_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast value of any class; executors need not have this package installed."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of values the driver knows, made without Python workers."""
    return spark.createDataFrame(pa.table(columns))


def tidied(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives unused memory back in the end; its worker goes on with other tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = kept("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
        if trim is not None:
            trim(0)

    return run


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to bounded Arrow batches; it may return nothing for a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidied(run), schema)


def bounded(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes, one row at least."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def checked(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A staged table with a broadcast hint if its counted rows fit in ``BROADCAST_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened where a column has one already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_text(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def label_sample(df: DataFrame, label: str, keys: list[str], per_label: int, max_labels: int) -> DataFrame:
    """About ``per_label`` rows of each of the ``max_labels`` most frequent labels.

    Rows are chosen by a hash of ``keys``, so the same rows give the same sample.
    No row moves: the counts per label set a threshold, and a filter applies it.
    """
    counts = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    if not counts:
        return df.limit(0)
    span = 1 << 30
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(span, span * per_label // r[1]))])
    chosen = df.where(F.pmod(F.xxhash64(*keys), F.lit(span)) < F.try_element_at(limits, F.col(label)))
    return chosen.limit(2 * per_label * len(counts) + 1000)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray, doubt: float = 0.0) -> float:
    """The temperature with the least negative log-likelihood on held-out rows.

    ``doubt`` of each row is spread over the other classes, so that rows without an
    error do not drive all probabilities to 1.
    """
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 50.0, 120)
    rows = np.arange(len(y))
    loss = []
    for t in grid:
        p = softmax(logits / t)
        right = p[rows, y]
        rest = np.log(p + 1e-12).sum(1) - np.log(right + 1e-12)
        loss.append(-((1 - doubt) * np.log(right + 1e-12) + doubt * rest / max(1, p.shape[1] - 1)).mean())
    return float(grid[int(np.argmin(loss))])
