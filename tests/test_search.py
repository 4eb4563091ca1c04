import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspan.functions import vectors as vec
from larkspan.operators import search as se


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    v, q = unit(rng, 900, 16), unit(rng, 23, 16)
    v[300:600] = v[300]  # a third of all vectors are copies of one
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "name string, vector array<float>")
    return v.astype("float64"), q.astype("float64"), vectors.repartition(7), queries


def brute(v, q, k, low):
    out = {}
    for i, row in enumerate(np.round(q @ v.T, 12)):
        ids = sorted(range(len(v)), key=lambda j: (-row[j], j))[:k]
        out[f"q{i}"] = [(j, row[j]) for j in ids if row[j] >= low]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("k,low", [(1, -1.0), (10, 0.2), (350, -1.0), (2000, 0.0)])
@pytest.mark.parametrize("several", [False, True])
def test_topk_equals_brute_force(data, k, low, several):
    v, q, vectors, queries = data
    limits = dict(matrix_queries=5) if several else {}
    got = se.similarity_topk(queries, vectors, query_id="name", query_vec="vector", ids=["id"], k=k, min_score=low, **limits)
    want = {n: rows for n, rows in brute(v, q, k, low).items() if rows}
    got = as_lists(got)
    assert {n: [i for i, _ in r] for n, r in got.items()} == {n: [i for i, _ in r] for n, r in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for n in want for a, b in zip(got[n], want[n]))


def test_small_blocks_keep_memory_bounded_and_exact(data, monkeypatch):
    import pyarrow as pa

    v, q, _, _ = data
    monkeypatch.setattr(se, "CELLS", 400)
    rows = pa.table({"id": pa.array(range(len(v)), pa.int32()), "embedding": pa.array(v.astype("float32").tolist(), pa.list_(pa.float32()))})
    best = se._task_best(iter([rows.slice(0, 450), rows.slice(450)]), q, ["id"], "embedding", 10, 0.2)
    got = {}
    for n, s, i in zip(*(best.column(c).to_pylist() for c in ("q", "score", "id"))):
        got.setdefault(f"q{n}", []).append(i)
    assert got == {n: [i for i, _ in r] for n, r in brute(v, q, 10, 0.2).items() if r}


def test_arguments_and_empty_inputs(spark, data):
    _, _, vectors, queries = data
    with pytest.raises(ValueError):
        se.similarity_topk(queries, vectors, query_id="name", query_vec="vector", ids=["id"], k=0)
    none = se.similarity_topk(queries.limit(0), vectors, query_id="name", query_vec="vector", ids=["id"])
    assert none.count() == 0 and none.columns == ["query_id", "rank", "score", "id"]
    assert se.similarity_topk(queries, vectors.limit(0), query_id="name", query_vec="vector", ids=["id"]).count() == 0
    uneven = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "name string, vector array<float>")
    with pytest.raises(ValueError, match="size"):
        se.similarity_topk(uneven, vectors, query_id="name", query_vec="vector", ids=["id"])
    other = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<float>")
    with pytest.raises(ValueError, match="size"):
        se.similarity_topk(queries, other, query_id="name", query_vec="vector", ids=["id"])
    with pytest.raises(ValueError, match="size"):
        se.similarity_topk(queries, vectors.unionByName(other), query_id="name", query_vec="vector", ids=["id"])


@pytest.mark.parametrize("matrix", [1, 10_000])
def test_every_query_row_has_its_own_answer(spark, data, matrix):
    v, q, vectors, _ = data
    rows = [("same", q[0].tolist(), 2, -1.0), ("same", q[1].tolist(), 3, -1.0), (None, q[2].tolist(), 1, -1.0), ("none", q[3].tolist(), 5, 2.0)]
    asked = spark.createDataFrame(rows, "name string, vector array<float>, n int, low double")
    got = se.similarity_topk(asked, vectors, query_id="name", query_vec="vector", ids=["id"], k=F.col("n"), min_score=F.col("low"), matrix_queries=matrix).collect()
    assert sorted((r["query_id"] or "", r["rank"]) for r in got) == [("", 1), ("same", 1), ("same", 1), ("same", 2), ("same", 2), ("same", 3)]
    want = brute(v, q, 3, -1.0)
    assert {r["id"] for r in got if r["query_id"] == "same"} == {i for i, _ in want["q0"][:2] + want["q1"]}


def test_search_by_text(spark):
    chunks = spark.createDataFrame(
        [("a.txt", "/a.txt", 1, "open the resume tracker notes"), ("b.txt", "/b.txt", 1, "what is the weather like today"),
         ("c.txt", "/c.txt", 1, "  "), ("d.txt", "/d.txt", 1, "resume " * 200)],
        "filename string, filepath string, chunk_id int, content string")
    index = se.embed(chunks)
    assert index.count() == 3
    asked = spark.createDataFrame([(1, "resume notes"), (2, " "), (3, "zzz")], "query_id int, query string")
    got = se.search(index, asked, k=2).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {1}
    assert [r["filepath"] for r in got] == ["/d.txt", "/a.txt"] and len(got[0]["preview"]) == 403


def test_default_embedding_is_unit_length():
    vectors = se.hashed_words(32)(["a b b", "", "ÄÖ 12"])
    assert vectors.shape == (3, 32)
    assert np.allclose(np.linalg.norm(vectors, axis=1), [1, 0, 1])


def test_mean_pool_and_vector_functions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 0.0])], "g int, embedding array<float>")
    pooled = {r["g"]: r["embedding"] for r in se.mean_pool(df, "g").collect()}
    assert pooled == {1: [2.0, 4.0], 2: [0.0, 0.0]}
    rows = df.select("g", vec.l2_normalize("embedding").alias("u"), vec.dot("embedding", "embedding").alias("d")).collect()
    assert np.allclose(rows[0]["u"], np.array([1, 2]) / np.sqrt(5)) and rows[0]["d"] == 5.0 and rows[2]["u"] == [0.0, 0.0]
    masked = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 0]), ([[1.0, 2.0]], [0])], "v array<array<double>>, m array<int>")
    got = [r[0] for r in masked.select(vec.masked_mean("v", "m")).collect()]
    assert got == [[1.0, 2.0], [0.0, 0.0]]
    assert df.filter(vec.has_dimension("embedding", 2)).count() == 3
    assert df.select(F.size("embedding")).first()[0] == 2


def _brute(vectors, queries, k, least):
    """Row numbers of each query's best by exact scores, ties by number."""
    scores = np.round(vectors.astype(float) @ queries.T, se.COMPARED_DIGITS)
    return {q: [i for i in np.lexsort((np.arange(len(vectors)), -scores[:, q])) if scores[i, q] >= least][: k[q]] for q in range(len(queries))}


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e25])
def test_scores_that_single_precision_does_not_tell_apart(monkeypatch, scale):
    """Near ties are ranked by exact scores, whatever the size of the numbers; few rows wait to be ranked."""
    monkeypatch.setattr(se, "CELLS", 3_000)
    monkeypatch.setattr(se, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.random((1, 16))
    vectors = np.r_[base + 1e-9 * rng.random((300, 16)), rng.random((700, 16)), base.repeat(20, 0)] * scale
    queries, k = rng.random((20, 16)) / scale, np.arange(1, 21)
    table = pa.table({"i": pa.array(np.arange(len(vectors))), "v": pa.array(list(vectors), pa.list_(pa.float64()))})
    ranked = []
    best = se._best
    monkeypatch.setattr(se, "_best", lambda rows, *a: ranked.append(rows.num_rows) or best(rows, *a))
    out = se._task_best(iter([table.slice(0, 600), table.slice(600)]), queries, ["i"], "v", k, 0.2)
    got = {}
    for q, i in zip(out.column("q").to_pylist(), out.column("i").to_pylist()):
        got.setdefault(q, []).append(i)
    assert got == _brute(vectors, queries, k, 0.2)


def test_few_scores_are_made_exactly(monkeypatch):
    """After the first block a score waits to be ranked only if it may be among the best."""
    rng = np.random.default_rng(6)
    vectors, queries = rng.random((8_000, 8)).astype("float32"), rng.random((100, 8))
    table = pa.table({"i": pa.array(np.arange(8_000)), "v": pa.array(list(vectors), pa.list_(pa.float32()))})
    waited = []
    best = se._best
    monkeypatch.setattr(se, "_best", lambda rows, *a: waited.append(rows.num_rows) or best(rows, *a))
    monkeypatch.setattr(se, "CELLS", 50_000)
    se._task_best(iter([table]), queries, ["i"], "v", 5, 0.2)
    assert sum(waited) < 20 * 5 * 100


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(se, "SHARED_QUERIES", 1)
    monkeypatch.setattr(se, "FIRST_VECTORS", 20)
    monkeypatch.setattr(se, "PART_GROWTH", 4)


@pytest.mark.parametrize("k,low", [(1, -1.0), (10, 0.2), (350, -1.0)])
def test_parts_hold_every_vector_once(data, small_parts, k, low):
    v, q, vectors, queries = data
    parts = se._parts(vectors, ["id"], 23, 900)
    assert len(parts) == 3 and sorted(r["id"] for p in parts for r in p.select("id").collect()) == list(range(900))
    got = as_lists(se.similarity_topk(queries, vectors, query_id="name", query_vec="vector", ids=["id"], k=k, min_score=low, matrix_queries=9))
    want = {n: rows for n, rows in brute(v, q, k, low).items() if rows}
    assert {n: [i for i, _ in r] for n, r in got.items()} == {n: [i for i, _ in r] for n, r in want.items()}


def test_tasks_hand_on_what_earlier_parts_do_not_exceed(spark, data, small_parts, monkeypatch):
    """Fifty tasks write a few times k rows of each query, not fifty times k, and each matrix leaves k."""
    v, _, vectors, queries = data
    written = []
    staged = se.staged

    def counted(df, name):
        out = staged(df, name)
        if name == "best":
            written.append(out.count())
        return out

    monkeypatch.setattr(se, "staged", counted)
    rng = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(unit(rng, 900, 16))]
    spread = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(50)
    got = se.similarity_topk(queries, spread, query_id="name", query_vec="vector", ids=["id"], k=10, min_score=-1.0, matrix_queries=12)
    assert got.count() == 230 and sum(written) < 23 * 250
    assert len(written) % 4 == 0 and sum(written[3::4]) == 230


def test_parts_of_repeated_and_missing_ids(spark, small_parts):
    """Copies of one id and vectors without an id are in one part each, and all are found."""
    vectors = [(7, [1.0, 0.0])] * 300 + [(None, [0.6, 0.8])] * 200 + [(i, [0.0, 1.0]) for i in range(100, 140)] + [(1, None)]
    df = spark.createDataFrame(vectors, "id int, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([("a", [1.0, 0.0], 305), ("b", [0.0, 1.0], 41), ("c", [-1.0, 0.0], 3)], "name string, vector array<float>, n int")
    got = se.similarity_topk(asked, df, query_id="name", query_vec="vector", ids=["id"], k=F.col("n"), matrix_queries=2).collect()
    found = {n: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == n] for n in "abc"}
    assert found["a"] == [7] * 300 + [None] * 5 and found["b"] == [*range(100, 140), None] and found["c"] == []


@pytest.mark.parametrize("scale", [1e39, 1e-39])
def test_numbers_that_single_precision_does_not_hold(scale):
    """Such queries and vectors are compared in double precision."""
    rng = np.random.default_rng(9)
    vectors, queries = rng.random((300, 4)) * scale, rng.random((12, 4)) / scale
    table = pa.table({"i": pa.array(np.arange(300)), "v": pa.array(list(vectors), pa.list_(pa.float64()))})
    out = se._task_best(iter([table]), queries, ["i"], "v", 5, 0.2)
    got = {}
    for q, i in zip(out.column("q").to_pylist(), out.column("i").to_pylist()):
        got.setdefault(q, []).append(i)
    assert got == _brute(vectors, queries, np.full(12, 5), 0.2)
