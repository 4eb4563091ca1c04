import json

import pytest
from pyspark.sql import functions as F

from larkspan.operators import chunking, classify, clean, search
from larkspan.plans import workflows
from larkspan.session import scratch_path
from larkspan.streaming import requests

LINES = [
    " ", "{bad", "[1]", '"text"', "null", '{"query": "alpha", "top_k": "5"}', '{"query": "alpha", "top_k": "x"}', '{"query": "alpha", "top_k": 0}',
    '{"command": "ping"}', '{"command": "exit"}', '{"top_k": 3}', '{"query": 5}', '{"query": "alpha", "top_k": 2.7}',
    '{"query": "alpha", "min_score": "high"}', '{"query": "alpha", "min_score": null}', '{"query": "alpha", "top_k": true, "min_score": "0.9"}',
    '{"query": "zzz"}',
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(f"{n}.txt", f"/{n}.txt", ".txt", t) for n, t in (("a", "alpha beta"), ("b", "alpha"), ("c", "gamma"))], "filename string, filepath string, extension string, content string")
    return search.embed(chunking.chunk_text(docs)).cache()


def write_lines(path):
    path.mkdir()
    (path / "r.txt").write_text("\n".join(f"{i}\t{t}" for i, t in enumerate(LINES)))
    return str(path)


def numbered(df):
    return df.select(F.split("value", "\t")[0].cast("int").alias("id"), F.split("value", "\t")[1].alias("value"))


def check(responses):
    got = {i: json.loads(r) for i, r in responses.items()}
    assert 0 not in got and set(got) == set(range(1, len(LINES)))
    assert got[1] == {"ok": False, "error": "Invalid JSON"}
    for i in (2, 3, 4):
        assert got[i] == {"ok": False, "error": "Request must be a JSON object."}
    assert [r["filename"] for r in got[5]["results"]] == ["b.txt", "a.txt"] and [r["rank"] for r in got[5]["results"]] == [1, 2]
    assert got[6]["error"] == "'top_k' must be an integer, got 'x'."
    assert got[7]["error"] == "top_k must be a positive integer, got 0"
    assert got[8] == {"ok": True, "pong": True} and got[9] == {"ok": True, "bye": True}
    for i in (10, 11):
        assert got[i]["error"] == "Request must include a non-empty 'query' string."
    assert len(got[12]["results"]) == 2
    assert got[13]["error"] == "'min_score' must be a number, got 'high'."
    assert got[14]["error"] == "'min_score' must be a number, got None."
    assert [r["filename"] for r in got[15]["results"]] == ["b.txt"]
    assert got[16] == {"ok": True, "results": []}


def test_batch_answers(spark, index):
    df = spark.createDataFrame(list(enumerate(LINES)), "id int, value string")
    out = requests.answer_search(requests.parse_search_requests(df), index, "id")
    check({r["id"]: r["response"] for r in out.collect()})


def test_only_bad_requests(spark, index):
    df = spark.createDataFrame([(1, "{bad"), (2, '{"command": "ping"}')], "id int, value string")
    out = requests.answer_search(requests.parse_search_requests(df), index, "id")
    assert {r["id"]: json.loads(r["response"])["ok"] for r in out.collect()} == {1: False, 2: True}


def test_repeated_and_missing_ids(spark, index):
    lines = [("a", '{"query": "alpha", "top_k": 1}'), ("a", '{"query": "gamma"}'), (None, '{"query": "alpha", "top_k": 1000000000}'), ("b", '{"query": "beta"}')]
    df = spark.createDataFrame(lines, "id string, value string")
    got = requests.answer_search(requests.parse_search_requests(df), index, "id").collect()
    names = sorted((r["id"] or "", [h["filename"] for h in json.loads(r["response"])["results"]]) for r in got)
    assert names == [("", ["b.txt", "a.txt"]), ("a", ["b.txt"]), ("a", ["c.txt"]), ("b", ["a.txt"])]


def test_stream_equals_batch(spark, index, tmp_path):
    lines = numbered(spark.readStream.text(write_lines(tmp_path / "in")))
    out = scratch_path(spark, "answers")
    requests.serve_search(lines, lambda: index, "id", out, scratch_path(spark, "state"), once=True).awaitTermination()
    check({r["id"]: r["response"] for r in spark.read.parquet(out).collect()})


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ("code python loop" if i % 2 else "funny cat video"), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, text string, label int")
    return classify.fit_text_classifier(df.filter("i < 50"), df.filter("i >= 50"), cells=256, grid=(0.01,))


def test_classification_stream(spark, model, tmp_path):
    lines = ['{"id": "a", "title": "python", "channel": null, "description": "loop"}', '{"id": 7}', "{bad", "[2]", "  "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    batch = [json.loads(r["response"]) for r in requests.classify_requests(df, model).collect()]
    assert batch[0]["id"] == "a" and batch[0]["label_name"] == "coding" and set(batch[0]["probs"]) == {"coding", "entertainment"}
    assert batch[1]["id"] == "7" and "label" in batch[1]
    assert batch[2] == {"error": "invalid JSON"} and len(batch) == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text("\n".join(lines))
    out = scratch_path(spark, "labels")
    requests.serve_classification(spark.readStream.text(str(tmp_path / "in")), model, out, scratch_path(spark, "state"), once=True).awaitTermination()
    streamed = sorted(r["response"] for r in spark.read.parquet(out).collect())
    assert streamed == sorted(r["response"] for r in requests.classify_requests(df, model).collect())


def test_intent_pipeline(spark):
    rows = [(i, f"open app {i}" if i % 2 else f"mute sound {i}", "open_app" if i % 2 else "mute") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, text string, intent string")
    model = classify.fit_text_classifier(df.filter("i < 50"), df.filter("i >= 50"), label="intent", metric="f1", cells=256, grid=(0.01,))
    asked = spark.createDataFrame([("open app chrome",), ("mute sound",)], "text string")
    got = {r["text"]: r for r in workflows.run_intent_pipeline(asked, model).collect()}
    assert got["mute sound"]["intent"] == "mute" and got["open app chrome"]["entities"]["app"] == "App Chrome"
    unsure = workflows.run_intent_pipeline(asked, model, threshold=1.1).collect()
    assert {r["intent"] for r in unsure} == {"unknown"} and all(r["entities"]["app"] is None for r in unsure)
    result = workflows.reality_check(df, model)
    assert result["accuracy"].first()["total"] == 60 and clean.low_confidence(result["rows"]).count() == result["low_confidence"].count()
