"""Exact inner-product search that reads only the vectors which can win.

An index is a folder: the vectors in one subfolder per group, a table of the
groups and a table of pivots. A group holds the vectors nearest to one pivot
whose distance to it lies in one ring; its row keeps the number of its vectors,
their least and greatest distance and their greatest length. These bound the
score of every vector of the group:

* ``q.x <= q.p + |q| r`` for vectors at most ``r`` from the pivot ``p``,
* ``q.x <= |q| n`` for vectors of length at most ``n``,
* ``q.x <= (|q|^2 + n^2 - g^2) / 2`` where ``g`` is the least distance that the
  triangle inequality leaves between the query and the ring.

A search reads the most promising groups of each query first. The score of the
k-th hit is the floor for the rest: of these, only groups whose bound reaches
the floor of some query are read, and there only such queries are compared.
Pivots decide how much is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dropped, staged
from .search import (
    CELLS, MATRIX_QUERIES, MIN_SCORE, TOP_K, _asked, _blocks, _floors, _matrix, _ranked, _result_schema, _task_best, _unanswered,
)

SAMPLE_ROWS = 50_000
MAX_PIVOTS = 1_024
RINGS = 4
ROUNDS = 8
#: Group of vectors with a component that is null or not finite: nothing bounds their scores.
UNBOUNDED = -1
#: Share of a bound that is added to it for the rounding of its own sums.
SLACK = 1e-9
_OWN = ("group_no", "distance", "length")


@dataclass(frozen=True)
class VectorIndex:
    """An opened index. ``groups`` has one row per group that holds vectors, ``pivots`` one row per pivot."""

    vectors: DataFrame
    groups: pa.Table
    pivots: np.ndarray
    rings: int
    ids: tuple[str, ...]
    vec: str


def _sample(rows: DataFrame, vec: str, sample_rows: int) -> tuple[int, DataFrame]:
    """The number of rows and about ``sample_rows`` distinct finite vectors, chosen by their hashes."""
    n = rows.count()
    share = min(1.0, sample_rows / max(n, 1))
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.filter(F.pmod(F.xxhash64(vec), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    return n, some.filter(finite & (F.size(vec) > 0)).select(F.col(vec).cast("array<double>").alias("v")).distinct()


def _nearest(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    cell = np.argmax(matrix @ pivots.T - (pivots**2).sum(axis=1) / 2, axis=1)
    return cell, np.linalg.norm(matrix - pivots[cell], axis=1)


def _edges(cell: np.ndarray, distance: np.ndarray, pivots: int, rings: int) -> np.ndarray:
    """Inner borders of the rings of each pivot: quantiles of the sample's distances."""
    out = np.full((pivots, rings - 1), np.inf)
    for p in np.unique(cell):
        out[p] = np.quantile(distance[cell == p], np.arange(1, rings) / rings)
    return out


def _grouped(rows: DataFrame, vec: str, pivots: np.ndarray, edges: np.ndarray) -> DataFrame:
    """Rows with their group, their distance to its pivot and their length."""
    sent = rows.sparkSession.sparkContext.broadcast((pivots, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, borders = sent.value
        step = max(1, CELLS // max(centres.size, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = part.column(part.schema.get_field_index(vec))
                if set(vectors.value_lengths().unique().to_pylist()) != {centres.shape[1]}:
                    raise ValueError(f"vectors differ in size, the pivots have size {centres.shape[1]}")
                matrix = _matrix(vectors)
                finite = np.isfinite(matrix).all(axis=1)
                matrix[~finite] = 0.0
                cell, distance = _nearest(matrix, centres)
                ring = (distance[:, None] > borders[cell]).sum(axis=1)
                group = np.where(finite, cell * (borders.shape[1] + 1) + ring, UNBOUNDED)
                own = (group.astype("int32"), np.where(finite, distance, 0.0), np.where(finite, np.linalg.norm(matrix, axis=1), 0.0))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, own)], [*part.schema.names, *_OWN])

    fields = [T.StructField("group_no", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("length", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def write_vector_index(
    vectors: DataFrame, folder: str, ids: Sequence[str], vec: str = "embedding", *,
    pivots: int | None = None, rings: int = RINGS, sample_rows: int = SAMPLE_ROWS, seed: int = 7,
) -> None:
    """Lay out all vectors by pivot and ring below ``folder``, which must not exist.

    Pivots are k-means centres of about ``sample_rows`` distinct vectors; by default there are as many as
    a quarter of the root of the rows, 1,024 at most, and never fewer than two if there are two vectors. Every row is indexed, repeated ones as often as they
    occur; null vectors are left out, as they never match. Vectors with a null or non-finite component
    form a group that every search reads. Vectors of different sizes fail the job. An empty table makes an
    index without groups. Only ``ids`` and ``vec`` are kept; ids named like the index's own columns are an error.
    """
    ids = list(ids)
    if taken := {*ids, vec} & set(_OWN):
        raise ValueError(f"columns {sorted(taken)} have names of the index")
    if rings < 1 or (pivots is not None and pivots < 1):
        raise ValueError("pivots and rings must be positive")
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec).isNotNull()).select(*ids, vec)
    n, sample = _sample(rows, vec, sample_rows)
    sample = staged(sample, "sample")
    number = pivots or min(MAX_PIVOTS, max(1, round(n**0.5 / 4)))
    seen = sample.agg(F.count("v").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if seen["low"] != seen["high"]:
        raise ValueError("vectors differ in size")
    if seen["n"] == 0:
        first = rows.select(F.size(vec)).first()
        centres = np.zeros((1, first[0] if first else 0))
        edges = np.full((1, rings - 1), np.inf)
    else:
        points = _matrix(sample.toArrow().column("v"))
        centres = points
        if seen["n"] > max(2, number):
            features = sample.select(array_to_vector("v").alias("features"))
            centres = np.array(KMeans(k=max(2, number), maxIter=ROUNDS, seed=seed, initMode="random").fit(features).clusterCenters())
        edges = _edges(*_nearest(points, centres), len(centres), rings)
    grouped = staged(_grouped(rows, vec, centres, edges), "grouped")
    stats = grouped.groupBy("group_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("length").alias("length"),
    )
    stats.write.parquet(f"{folder}/groups")
    # The last key parts rows that are alike, so a hot group of copies is spread over tasks.
    laid = grouped.repartitionByRange("group_no", "distance", *ids, F.monotonically_increasing_id())
    laid.select("group_no", *ids, vec).write.partitionBy("group_no").parquet(f"{folder}/vectors")
    table = pa.table({"p": pa.array(range(len(centres)), pa.int32()), "pivot": pa.array(centres.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(table).withColumn("rings", F.lit(rings)).write.parquet(f"{folder}/pivots")
    kept = spark.createDataFrame([], rows.schema)
    kept.select(F.struct(*ids).alias("ids"), F.col(vec)).write.parquet(f"{folder}/columns")
    dropped(sample)
    dropped(grouped)


def open_vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    """An index that was written before. The driver holds its pivots and one row per group, both of a number set when it was written."""
    columns = spark.read.parquet(f"{folder}/columns").schema
    ids, vec = columns["ids"].dataType, columns.names[1]
    schema = T.StructType([*ids.fields, columns[vec], T.StructField("group_no", T.IntegerType())])
    pivots = spark.read.parquet(f"{folder}/pivots").toArrow().sort_by("p")
    groups = spark.read.parquet(f"{folder}/groups").toArrow().sort_by("group_no")
    return VectorIndex(
        spark.read.schema(schema).parquet(f"{folder}/vectors"), groups, _matrix(pivots.column("pivot")),
        pivots.column("rings")[0].as_py(), tuple(ids.names), vec,
    )


def score_bounds(index: VectorIndex, queries: np.ndarray) -> np.ndarray:
    """For each query and each row of ``index.groups`` a number that no score of the group exceeds."""
    group, near, far, length = (index.groups.column(c).to_numpy() for c in ("group_no", "near", "far", "length"))
    cell = np.maximum(group, 0) // index.rings
    size = np.linalg.norm(queries, axis=1)[:, None]
    at_pivot = (queries @ index.pivots.T)[:, cell]
    span = ((queries**2).sum(axis=1)[:, None] + (index.pivots**2).sum(axis=1) - 2 * (queries @ index.pivots.T))[:, cell]
    to_pivot = np.sqrt(np.maximum(span, 0.0))
    # Both distances are rounded, so the gap between them is taken a little too small.
    gap = np.maximum(np.maximum(to_pivot - far, near - to_pivot) - 1e-6 * (1.0 + size + length), 0.0)
    bound = np.minimum(np.minimum(at_pivot + size * far, size * length), (size**2 + length**2 - gap**2) / 2)
    scale = size * (length + np.linalg.norm(index.pivots, axis=1)[cell] + far) + size**2 + length**2
    # A query that is not finite has no bound and is compared with every group.
    return np.where((group == UNBOUNDED) | ~np.isfinite(scale), np.inf, bound + SLACK * (1.0 + scale))


def _first_groups(bounds: np.ndarray, sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The groups of greatest bound that together hold ``k`` vectors, as a mark per query and group."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    sizes = np.take_along_axis(sizes, order, axis=1)
    held = np.cumsum(sizes, axis=1) - sizes
    marks = np.zeros(bounds.shape, bool)
    np.put_along_axis(marks, order, held < k[:, None], axis=1)
    return marks


def _read(index: VectorIndex, rows: pa.Table, floor: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Best of every task over the marked pairs of queries and groups; folders of other groups are not opened."""
    numbers = index.groups.column("group_no").to_numpy()
    used = pairs.any(axis=0)
    column = {int(g): i for i, g in enumerate(numbers[used])}
    sent = index.vectors.sparkSession.sparkContext.broadcast((
        _matrix(rows.column("query_vec")), rows.column("q").to_numpy(), rows.column("k").to_numpy(), floor,
        column, np.packbits(pairs[:, used], axis=0),
    ))
    ids, vec = list(index.ids), index.vec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q, k, least, place, marks = sent.value

        def runs() -> Iterator[pa.Table]:
            for batch in batches:
                group = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        yield pa.Table.from_batches([batch.slice(a, b - a)])

        def wanted(part: pa.Table) -> np.ndarray:
            return np.flatnonzero(np.unpackbits(marks[:, place[part.column(0)[0].as_py()]], count=len(queries)))

        best = _task_best(runs(), queries, ids, vec, k, least, wanted)
        if best is not None:
            yield from best.set_column(0, "q", pa.array(q[best.column("q").to_numpy()])).to_batches()

    chosen = index.vectors.filter(F.col("group_no").isin([int(g) for g in numbers[used]]))
    return chosen.select("group_no", *ids, vec).mapInArrow(run, _result_schema(index.vectors, ids))


def indexed_topk(
    index: VectorIndex, queries: DataFrame, *, query_id: str, query_vec: str, k: int | Column = TOP_K,
    min_score: float | Column = MIN_SCORE, matrix_queries: int = MATRIX_QUERIES, on_read: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """The rows that ``search.similarity_topk`` gives for the indexed vectors, from the groups that can hold them.

    Queries are answered in matrices of bounded size, so that a matrix and its marks per group fit a task;
    ``on_read`` is told of each how many rows of vectors were read and how many there are. Queries without
    a vector have no result, those of another size than the index are an error.
    """
    ids = list(index.ids)
    asked = _asked(queries, query_id, query_vec, k, min_score)
    seen = asked.agg(F.count("q").alias("n"), F.min(F.size("query_vec")).alias("low"), F.max(F.size("query_vec")).alias("high")).first()
    if not seen["n"] or not index.groups.num_rows:
        return _unanswered(asked, index.vectors, ids)
    width = index.pivots.shape[1]
    if not seen["low"] == seen["high"] == width:
        raise ValueError(f"queries have sizes {seen['low']} to {seen['high']}, vectors have size {width}")
    sizes = index.groups.column("n").to_numpy()
    # The bounds of a matrix take eight bytes a group and query, a few times over.
    room = max(1, min(matrix_queries, 2 * CELLS // index.groups.num_rows))
    found, blocks = [], 1
    for blocks, rows in _blocks(asked, seen["n"], width, room):
        bounds = score_bounds(index, _matrix(rows.column("query_vec")))
        low, most = rows.column("low").to_numpy(), rows.column("k").to_numpy()
        able = bounds >= low[:, None]
        first = _first_groups(np.where(able, bounds, -np.inf), np.where(able, sizes, 0), most) & able
        read = first.any(axis=0)
        if read.any():
            found.append(staged(_read(index, rows, low, first), "best"))
            floor = _floors([found[-1]], rows, ids)
            rest = able & ~first & (bounds >= floor[:, None])
            if rest.any():
                found.append(staged(_read(index, rows, floor, rest), "best"))
            read |= rest.any(axis=0)
        if on_read:
            on_read(int(sizes[read].sum()), int(sizes.sum()))
    return _ranked(found, asked, ids, few=blocks == 1) if found else _unanswered(asked, index.vectors, ids)
