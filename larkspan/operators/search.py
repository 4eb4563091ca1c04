"""Embedding and exact inner-product search.

The many vectors stay where they are. Queries go out as matrices of bounded
size, one matrix per pass over the vectors; each task multiplies its vectors
with the matrix block by block and keeps only its best ``k`` per query, so
neither pairs nor the index ever move. More queries than one matrix holds mean
more passes, with the same result. Many queries are first compared with a small
share of the vectors: what they find there bounds what later tasks hand on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, preview
from ..llm.common import tidied
from ..session import dropped, staged
from .lookup import lookup_join

TOP_K = 10
MIN_SCORE = 0.20
DIMENSION = 384
# Scores are shown with 9 digits. They are compared with 12, so that sums that differ only
# by the order of their terms, as for copies of a vector, are ties.
SHOWN_DIGITS = 9
COMPARED_DIGITS = 12
MATRIX_QUERIES = 10_000
MATRIX_BYTES = 64 << 20
CELLS = 2_000_000
#: Texts that are embedded before their vectors are handed on.
EMBED_TEXTS = 1_000
QUERY_BLOCK = 1_000
EXACT_SCORES = 1_000
#: With so many queries and vectors, the vectors are compared in parts that grow by this factor, the first of this size at least.
SHARED_QUERIES = 1_000
FIRST_VECTORS = 5_000
PART_GROWTH = 16

EmbedFn = Callable[[Sequence[str]], np.ndarray]

# --- embedding ---------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")


def hashed_words(dimension: int = DIMENSION) -> EmbedFn:
    """Default embedding: unit vector of word counts hashed into ``dimension`` cells."""
    cells: dict[str, int] = {}

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            ids = []
            for word in _WORD.findall(text.lower()):
                cell = cells.get(word)
                if cell is None:
                    if len(cells) > 500_000:
                        cells.clear()
                    cell = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension
                    cells[word] = cell
                ids.append(cell)
            if ids:
                out[row] = np.bincount(ids, minlength=dimension)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def embed_column(text: Column | str, make_embed: Callable[[], EmbedFn] = hashed_words) -> Column:
    """Vector per text; the model is made once per task, then fed pieces of Arrow batches."""

    def vectors_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make_embed()
        for texts in (b[at : at + EMBED_TEXTS] for b in batches for at in range(0, max(1, len(b)), EMBED_TEXTS)):
            vectors = embed(texts.tolist()) if len(texts) else np.zeros((0, 1))
            yield pd.Series(list(np.asarray(vectors, dtype="float32")), index=texts.index)

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(vectors_of)(batches)

    return run(text)


def embed(
    df: DataFrame, text: str = "content", name: str = "embedding",
    make_embed: Callable[[], EmbedFn] = hashed_words,
) -> DataFrame:
    """Attach unit vectors; blank texts are dropped first."""
    return df.filter(~is_blank(text)).withColumn(name, embed_column(F.col(text), make_embed))


# --- top-k -------------------------------------------------------------------


def _best(rows: pa.Table, ids: Sequence[str], k: np.ndarray) -> pa.Table:
    """Best ``k[q]`` per query, ties by id."""
    order = [("q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in ids]]
    rows = rows.sort_by(order)
    q = rows.column("q").to_numpy()
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return rows.filter(pa.array(np.arange(len(q)) - start < k[q]))


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(_given(vectors), dtype="float64")


def _given(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors as rows of a matrix, in single precision if they are given in it."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype="float32" if values.dtype == np.float32 else "float64").reshape(len(flat), -1)


def _single(rows: np.ndarray) -> np.ndarray:
    """The rows in single precision, without a copy if they are given in it."""
    with np.errstate(over="ignore"):
        return rows.astype("float32", copy=False)


def _lengths(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype="float64"))


def _slack(longest: float, long: np.ndarray, width: int) -> np.ndarray:
    """What a product in single precision may be off by, for rows up to a length and queries of the given lengths rounded to it; not finite where that is unknown."""
    with np.errstate(over="ignore", invalid="ignore"):
        width = width + 8
        # relative errors of the factors, products and sums, and what is lost below the least normal number
        off = width * 2.0**-23 * longest * long + width * 2.0**-125 * (1 + longest + long) + 10.0**-COMPARED_DIGITS
        return np.where(longest * long < 2.0**120, off, np.nan)


class _Queries:
    """The queries of a task in their own and in single precision, and the room for the scores of a block."""

    def __init__(self, given: np.ndarray) -> None:
        self.given, self.single = given, _single(given)
        self.long = _lengths(self.single)
        self._scores, self._marks = np.empty(0, "float32"), np.empty(0, bool)

    def scores(self, rows: np.ndarray, here: np.ndarray | slice) -> np.ndarray:
        """Products in single precision; they stay until the next are made."""
        queries = self.single[here]
        if len(self._scores) < (cells := len(rows) * len(queries)):
            self._scores, self._marks = np.empty(cells, "float32"), np.empty(cells, bool)
        return np.matmul(rows, queries.T, out=self._scores[:cells].reshape(len(rows), -1))

    def reach(self, scores: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.greater_equal(scores, _below(floor), out=self._marks[: scores.size].reshape(scores.shape))


def _candidates(
    vectors: pa.Table, queries: _Queries, ids: Sequence[str], vec: str, floor: np.ndarray, k: np.ndarray, asked: np.ndarray | None = None,
) -> Iterator[pa.Table]:
    """(q, score, ids) of the scores that reach the query's floor, in bounded blocks; ``asked`` picks queries by position.

    All scores are made in single precision; those that may reach the floor by its bound of error are made exactly. A block in
    which ``k`` scores are higher raises the floor.
    """
    n = len(queries.given) if asked is None else len(asked)
    width = min(n, QUERY_BLOCK)
    block = max(1, CELLS // max(1, width))
    for at in range(0, vectors.num_rows if n else 0, block):
        part = vectors.slice(at, block)
        given = _given(part.column(vec))
        single = _single(given)
        longest = _lengths(single).max(initial=0)
        for first in range(0, n, width):
            here = slice(first, min(n, first + width)) if asked is None else asked[first : first + width]
            off = _slack(longest, queries.long[here], given.shape[1])
            if not np.isfinite(off).all():
                scores = np.round(given.astype("float64") @ queries.given[here].astype("float64").T, COMPARED_DIGITS)
                row, q = np.nonzero(scores >= floor[here])
                yield _scored(part, ids, _named(here, q), scores[row, q], row)
                continue
            scores = queries.scores(single, here)
            reach = queries.reach(scores, floor[here] - off)
            most, found = int(k[here].max()), np.count_nonzero(reach)
            if most < len(scores) and found > 2 * most * len(off):
                floor[here] = np.maximum(floor[here], np.partition(scores, -most, axis=0)[-most] - off)
                reach = queries.reach(scores, floor[here] - off)
            elif not found:
                continue
            row, q = np.divmod(np.flatnonzero(reach), len(off))
            q = _named(here, q)
            exact = [np.zeros(0)]
            for i in range(0, len(row), EXACT_SCORES):
                r, own = given[row[i : i + EXACT_SCORES]], queries.given[q[i : i + EXACT_SCORES]]
                exact.append(np.einsum("ij,ij->i", r.astype("float64"), own.astype("float64")))
            score = np.round(np.concatenate(exact), COMPARED_DIGITS)
            kept = score >= floor[q]
            yield _scored(part, ids, q[kept], score[kept], row[kept])


def _named(here: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
    return q + here.start if isinstance(here, slice) else here[q]


def _below(values: np.ndarray) -> np.ndarray:
    """Numbers of single precision that are not greater."""
    return np.nextafter(values.astype("float32"), np.float32(-np.inf))


def _scored(part: pa.Table, ids: Sequence[str], q: np.ndarray, score: np.ndarray, row: np.ndarray) -> pa.Table:
    taken = part.select(list(ids)).take(pa.array(row)).add_column(0, "score", pa.array(score))
    return taken.add_column(0, "q", pa.array(q.astype("int64")))


def _task_best(
    batches: Iterator[pa.Table], queries: np.ndarray, ids: Sequence[str], vec: str,
    k: int | np.ndarray, min_score: float | np.ndarray, wanted: Callable[[pa.Table], np.ndarray] | None = None,
) -> pa.Table | None:
    """Best ``k`` per query over all batches; memory is bounded by the sum of k and the block size.

    ``wanted`` gives the positions of the queries that a batch is compared with; without it, all are.
    """
    k = np.broadcast_to(np.asarray(k, np.int64), len(queries))
    low_score = np.broadcast_to(np.asarray(min_score, float), len(queries))
    floor = low_score.copy()
    asked = _Queries(queries)
    best: pa.Table | None = None
    pending: list[pa.Table] = []
    waiting = 0
    for batch in batches:
        for found in _candidates(batch, asked, ids, vec, floor, k, wanted(batch) if wanted else None):
            pending.append(found)
            waiting += found.num_rows
            if waiting > CELLS // 4:
                best = _best(pa.concat_tables([*([best] if best else []), *pending]), ids, k)
                pending, waiting = [], 0
                q = best.column("q").to_numpy()
                full = np.bincount(q, minlength=len(queries)) >= k
                low = np.full(len(queries), np.inf)
                np.minimum.at(low, q, best.column("score").to_numpy())
                floor = np.maximum(floor, np.where(full, low, low_score))
    if pending:
        best = _best(pa.concat_tables([*([best] if best else []), *pending]), ids, k)
    return best


def _result_schema(vectors: DataFrame, ids: Sequence[str]) -> T.StructType:
    fields = [T.StructField("q", T.LongType()), T.StructField("score", T.DoubleType())]
    return T.StructType(fields + [T.StructField(c, vectors.schema[c].dataType) for c in ids])


def _sent(vectors: DataFrame, rows: pa.Table) -> Broadcast:
    """The queries of one matrix as all tasks get them: vectors, numbers and ``k``."""
    number, k = (rows.column(c).to_numpy() for c in ("q", "k"))
    return vectors.sparkSession.sparkContext.broadcast((_given(rows.column("query_vec")), number, k))


def _pass(vectors: DataFrame, sent: Broadcast, floor: np.ndarray, ids: Sequence[str], vec: str) -> DataFrame:
    """One pass over the vectors for the queries of one matrix: the best of every task that reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, numbers, most = sent.value
        best = _task_best((pa.Table.from_batches([b]) for b in batches), queries, ids, vec, most, floor)
        if best is not None:
            named = pa.array(numbers[best.column("q").to_numpy()])
            yield from best.set_column(0, "q", named).to_batches()

    return vectors.select(*ids, vec).mapInArrow(tidied(run), _result_schema(vectors, ids))


def _one_size(queries: DataFrame, vectors: DataFrame, vec: str) -> tuple[int, int]:
    """The numbers of queries and of vectors; both sides must hold vectors of one size."""
    sizes = lambda df, c: df.agg(F.min(F.size(c)).alias("low"), F.max(F.size(c)).alias("high"), F.count(c).alias("n")).first()
    q, v = sizes(queries, "query_vec"), sizes(vectors, vec)
    if q["n"] and q["low"] != q["high"]:
        raise ValueError("query vectors differ in size")
    if v["n"] and v["low"] != v["high"]:
        raise ValueError("vectors differ in size")
    if q["n"] and v["n"] and q["low"] != v["low"]:
        raise ValueError(f"queries have size {q['low']}, vectors have size {v['low']}")
    return q["n"], v["n"]


def _asked(queries: DataFrame, query_id: str, query_vec: str, k: int | Column, min_score: float | Column) -> DataFrame:
    """The query rows with numbers of their own: q, query_id, query_vec, k, low."""
    if isinstance(k, int) and k <= 0:
        raise ValueError(f"top_k must be a positive integer, got {k}")
    asked = queries.select(
        F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec"),
        (k if isinstance(k, Column) else F.lit(k)).cast("bigint").alias("k"),
        (min_score if isinstance(min_score, Column) else F.lit(min_score)).cast("double").alias("low"),
    ).filter(F.col("query_vec").isNotNull())
    # Written once: the row numbers must not change between passes.
    return staged(asked.withColumn("q", F.monotonically_increasing_id()), "queries")


def _unanswered(asked: DataFrame, vectors: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The result without rows."""
    name = F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id")
    return vectors.select(*ids).limit(0).select(name, F.lit(0).alias("rank"), F.lit(0.0).alias("score"), *ids)


def _blocks(asked: DataFrame, n: int, width: int, matrix_queries: int) -> Iterator[tuple[int, pa.Table]]:
    """The number of matrices of bounded size and, one by one, the queries of each that has any."""
    most = max(1, min(matrix_queries, MATRIX_BYTES // (8 * max(width, 1))))
    blocks = max(1, -(-n // most))
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow().sort_by("q")
        if rows.num_rows:
            yield blocks, rows


def _parts(vectors: DataFrame, ids: Sequence[str], n: int, size: int) -> list[DataFrame]:
    """All vectors in parts by the hash of their ids, each about ``PART_GROWTH`` times those before it.

    The best of the parts before tell which scores of the next can count, so few are handed on by its tasks. All parts but the last are
    written. Few queries or vectors are one part.
    """
    levels = 0
    while n >= SHARED_QUERIES and size >= FIRST_VECTORS * PART_GROWTH ** (levels + 1):
        levels += 1
    dealt = F.xxhash64(*ids)
    taken = [F.pmod(dealt, F.lit(PART_GROWTH ** (i + 1))) == 0 for i in range(levels)]
    shares = [vectors]
    for i in range(levels):
        share = shares[-1].filter(taken[i])
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        shares.append(staged(share.coalesce(cores) if i + 1 == levels else share, "share"))
    return [shares[levels], *(shares[i].filter(~taken[i]) for i in reversed(range(levels)))]


def _limited(found: Sequence[DataFrame], rows: pa.Table, ids: Sequence[str]) -> DataFrame:
    """The best of all tasks for the queries of one matrix, with their ``rank``, cut to each query's ``k``."""
    best = W.partitionBy("q").orderBy(F.desc("score"), *ids)
    limits = F.broadcast(found[0].sparkSession.createDataFrame(rows.select(["q", "k"])))
    return _together(found).withColumn("rank", F.row_number().over(best)).join(limits, "q").filter(F.col("rank") <= F.col("k"))


def _floors(found: Sequence[DataFrame], rows: pa.Table, ids: Sequence[str]) -> np.ndarray:
    """Score of the k-th hit so far of each query of a matrix, or its least score where it has fewer."""
    last = _limited(found, rows, ids).filter(F.col("rank") == F.col("k")).select("q", "score").toArrow()
    floor = rows.column("low").to_numpy().astype(float)
    at = np.searchsorted(rows.column("q").to_numpy(), last.column("q").to_numpy())
    floor[at] = last.column("score").to_numpy()
    return floor


def _best_of_parts(parts: Sequence[DataFrame], rows: pa.Table, ids: Sequence[str], vec: str) -> DataFrame:
    """The best of all parts for the queries of one matrix, written; a part's floors are what the parts before have found."""
    found: list[DataFrame] = []
    sent = _sent(parts[-1], rows)
    for part in parts:
        floor = _floors(found, rows, ids) if found else rows.column("low").to_numpy()
        found.append(staged(_pass(part, sent, floor, ids, vec), "best"))
    sent.destroy()
    if len(found) == 1:
        return found[0]
    best = staged(_limited(found, rows, ids).select("q", "score", *ids), "best")
    for local in found:
        dropped(local)
    return best


def _together(found: Sequence[DataFrame]) -> DataFrame:
    local = found[0]
    for more in found[1:]:
        local = local.unionByName(more)
    return local


def _ranked(found: Sequence[DataFrame], asked: DataFrame, ids: Sequence[str], few: bool) -> DataFrame:
    """The best of all tasks and passes, ranked and cut to each query's ``k``; ``few`` queries are broadcast."""
    best = W.partitionBy("q").orderBy(F.desc("score"), *ids)
    names = asked.select("q", "query_id", "k")
    ranked = _together(found).withColumn("rank", F.row_number().over(best)).join(F.broadcast(names) if few else names, "q")
    kept = ranked.filter(F.col("rank") <= F.col("k"))
    return kept.withColumn("score", F.round("score", SHOWN_DIGITS)).select("query_id", "rank", "score", *ids)


def similarity_topk(
    queries: DataFrame, vectors: DataFrame, *, query_id: str, query_vec: str,
    ids: Sequence[str], vec: str = "embedding", k: int | Column = TOP_K, min_score: float | Column = MIN_SCORE,
    matrix_queries: int = MATRIX_QUERIES,
) -> DataFrame:
    """The ``k`` highest inner products per query that reach ``min_score``.

    Columns: ``query_id``, ``rank``, ``score``, then the id columns. Equal
    scores rank by id. Every query row is answered, also if several share an
    id. ``k`` and ``min_score`` may be columns of the queries, so that each
    query has its own. Vectors of different sizes are an error; null vectors
    never match. ``vectors`` are read several times and must have the same ids
    each time.
    """
    ids = list(ids)
    asked = _asked(queries, query_id, query_vec, k, min_score)
    vectors = vectors.filter(F.col(vec).isNotNull())
    n, size = _one_size(asked, vectors, vec)
    if n == 0:
        return _unanswered(asked, vectors, ids)
    width = asked.agg(F.coalesce(F.max(F.size("query_vec")), F.lit(1))).first()[0]
    parts = _parts(vectors, ids, n, size)
    found, blocks = [], 1
    for blocks, rows in _blocks(asked, n, width, matrix_queries):
        if blocks == len(parts) == 1:
            found.append(_pass(vectors, _sent(vectors, rows), rows.column("low").to_numpy(), ids, vec))
        else:
            found.append(_best_of_parts(parts, rows, ids, vec))
    for part in parts[:-1]:
        dropped(part)
    return _ranked(found, asked, ids, few=blocks == 1)


def search(
    index: DataFrame, queries: DataFrame, *, query_id: str = "query_id", query: str = "query",
    k: int | Column = TOP_K, min_score: float | Column = MIN_SCORE, make_embed: Callable[[], EmbedFn] = hashed_words,
) -> DataFrame:
    """Search an index of chunks by text; a blank query has no result.

    The index should be a written table: it is read for the scores and for the previews.
    """
    asked = embed(queries, query, "query_vec", make_embed)
    hits = similarity_topk(
        asked, index, query_id=query_id, query_vec="query_vec", ids=["filepath", "chunk_id"],
        k=k, min_score=min_score,
    )
    shown = index.select("filepath", "chunk_id", "filename", preview("content").alias("preview"))
    found = lookup_join(shown, staged(hits, "hits"), ["filepath", "chunk_id"], "inner")
    return found.select("query_id", "rank", "score", "filename", "filepath", "chunk_id", "preview")


def mean_pool(df: DataFrame, group: str, vec: str = "embedding", name: str = "embedding") -> DataFrame:
    """Mean vector per group; partial sums are formed before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    rows = df.filter(F.col(vec).isNotNull())
    return rows.groupBy(group).agg(vector_to_array(mean).alias(name))
