import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import search as se
from larkspan.operators import vector_index as vi
from larkspan.session import scratch_path

NAMED = dict(query_id="name", query_vec="vector")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [float(c) for c in x]) for i, x in enumerate(rows)], "id int, embedding array<float>")


def asking(spark, rows):
    return spark.createDataFrame([(f"q{i}", [float(c) for c in x]) for i, x in enumerate(rows)], "name string, vector array<float>")


def indexed(spark, vectors, ids=("id",), **how):
    folder = scratch_path(spark, "index")
    vi.write_vector_index(vectors, folder, list(ids), **how)
    return vi.open_vector_index(spark, folder)


def answers(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def clustered(spark):
    """40 clusters of 100 vectors of unequal length, a third of all rows copies of one."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 100, axis=0) * rng.uniform(0.5, 2, (4000, 1))
    v = v + rng.normal(scale=0.03, size=v.shape)
    v[1000:2300] = v[1000]
    return v, frame(spark, v).repartition(5)


@pytest.fixture(scope="module")
def laid(spark, clustered):
    return indexed(spark, clustered[1], pivots=40)


@pytest.mark.parametrize("k,low", [(1, -9.0), (10, 0.2), (1500, 0.0), (9000, -9.0)])
@pytest.mark.parametrize("matrix", [3, 10_000])
def test_same_rows_as_the_whole_search(spark, clustered, laid, k, low, matrix):
    v, vectors = clustered
    queries = asking(spark, np.concatenate([v[::401], -v[:2], np.zeros((1, 24))]))
    got = vi.indexed_topk(laid, queries, k=k, min_score=low, matrix_queries=matrix, **NAMED)
    want = se.similarity_topk(queries, vectors, ids=["id"], k=k, min_score=low, **NAMED)
    assert answers(got) == answers(want)


def test_most_vectors_are_not_read(spark, clustered, laid):
    (v, _), index = clustered, laid
    assert sum(index.groups.column("n").to_pylist()) == len(v)
    reads = []
    far = vi.indexed_topk(index, asking(spark, v[[5]]), k=10, min_score=0.2, on_read=lambda *r: reads.append(r), **NAMED)
    assert far.count() == 10
    assert reads[0][1] == len(v) and 10 <= reads[0][0] < len(v) / 4, reads
    # No group can reach the least score: nothing is read, and no file opened.
    none = vi.indexed_topk(index, asking(spark, v[[5]]), k=10, min_score=1e6, on_read=lambda *r: reads.append(r), **NAMED)
    assert none.count() == 0 and reads[1] == (0, len(v))


def test_no_score_exceeds_its_bound(spark, clustered):
    v, vectors = clustered
    index = indexed(spark, vectors, pivots=20, rings=5)
    rng = np.random.default_rng(8)
    queries = np.concatenate([v[::173], rng.normal(size=(40, 24)) * 100, np.zeros((1, 24))]).astype("float32").astype(float)
    bounds = vi.score_bounds(index, queries)
    place = {g: i for i, g in enumerate(index.groups.column("group_no").to_pylist())}
    rows = index.vectors.toArrow()
    group = np.array([place[g] for g in rows.column("group_no").to_pylist()])
    scores = queries @ se._matrix(rows.column("embedding")).T
    assert (scores <= bounds[:, group]).all()


def test_each_query_has_its_own_limits(spark, clustered, laid):
    v, vectors = clustered
    rows = [("same", v[0].tolist(), 2, -9.0), ("same", v[2500].tolist(), 3, -9.0), (None, v[3000].tolist(), 1, -9.0), ("none", v[1].tolist(), 5, 99.0), ("null", None, 5, 0.0)]
    asked = spark.createDataFrame(rows, "name string, vector array<double>, n int, low double")
    how = dict(k=F.col("n"), min_score=F.col("low"), **NAMED)
    got = vi.indexed_topk(laid, asked, **how)
    assert answers(got) == answers(se.similarity_topk(asked, vectors, ids=["id"], **how)) and got.count() == 6


def test_awkward_vectors(spark):
    odd = [[1, 0], None, [np.nan, 1], [np.inf, 0], [0, 0], [1, 0], [1, 0], [-3, 4]]
    vectors = frame(spark, odd).unionByName(frame(spark, odd[:1]))  # one row is there twice
    queries = asking(spark, [[1, 0], [0, 1], [np.nan, 0]])
    got = vi.indexed_topk(indexed(spark, vectors, pivots=2), queries, k=9, min_score=-9.0, **NAMED)
    want = se.similarity_topk(queries, vectors, ids=["id"], k=9, min_score=-9.0, **NAMED)
    assert answers(got) == answers(want) and got.count() > 8
    alike = frame(spark, [[1, 2]] * 50)
    assert vi.indexed_topk(indexed(spark, alike, pivots=8), queries.limit(1), k=3, min_score=0.0, **NAMED).count() == 3
    only = indexed(spark, frame(spark, [[np.nan, 1]]))
    assert vi.indexed_topk(only, queries, k=3, min_score=-9.0, **NAMED).count() == 0


def test_empty_tables_and_errors(spark):
    vectors, queries = frame(spark, [[1, 0], [0, 1]]), asking(spark, [[1, 0]])
    empty = indexed(spark, vectors.limit(0))
    assert empty.groups.num_rows == 0 and vi.indexed_topk(empty, queries, **NAMED).count() == 0
    index = indexed(spark, vectors)
    none = vi.indexed_topk(index, queries.limit(0), **NAMED)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "score", "id"]
    with pytest.raises(ValueError, match="size"):
        vi.indexed_topk(index, asking(spark, [[1, 0, 0]]), **NAMED)
    with pytest.raises(ValueError, match="top_k"):
        vi.indexed_topk(index, queries, k=0, **NAMED)
    with pytest.raises(ValueError, match="names of the index"):
        indexed(spark, vectors.withColumn("length", F.lit(1)), ["id", "length"])
    with pytest.raises(Exception, match="differ in size"):
        indexed(spark, frame(spark, [[1, 0], [0, 1], [1, 0, 0]]))


def test_ids_of_several_columns(spark):
    rows = [("a", 1, [1.0, 0.0], "x"), ("a", 2, [0.9, 0.1], "y"), ("b", 1, [0.0, 1.0], "z")]
    vectors = spark.createDataFrame(rows, "filepath string, chunk_id int, embedding array<float>, q string")
    got = vi.indexed_topk(indexed(spark, vectors, ["filepath", "chunk_id"]), asking(spark, [[1, 0]]), k=2, min_score=0.5, **NAMED).collect()
    assert [(r["filepath"], r["chunk_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 1, 1), ("a", 2, 2)]
