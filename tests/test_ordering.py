"""Answers come out in request order over micro-batches."""

import random

import pandas as pd

from larkspan.session import scratch_path
from larkspan.streaming import ordering


def served(spark, folder, out, state, files=1):
    stream = spark.readStream.schema("s string, p long, response string").option("maxFilesPerTrigger", files).parquet(folder)
    ordering.serve_in_order(stream, "s", "p", out, state, once=True).awaitTermination()
    return [(r.s, r.p, r.out, r.response) for r in spark.read.parquet(out).collect()]


def test_mixed_arrivals_over_several_batches(spark, tmp_path):
    rows = [(f"s{i % 3}", i // 3, f"r{i}") for i in range(45)]
    random.Random(4).shuffle(rows)
    folder = str(tmp_path / "in")
    for i in range(0, 45, 9):
        spark.createDataFrame(rows[i : i + 9], "s string, p long, response string").coalesce(1).write.mode("append").parquet(folder)
    got = served(spark, folder, scratch_path(spark, "out"), scratch_path(spark, "state"))
    assert sorted(got) == sorted((s, p, p, r) for s, p, r in rows)


def test_answers_wait_over_a_restart(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), scratch_path(spark, "out"), scratch_path(spark, "state")
    write = lambda rows: spark.createDataFrame(rows, "s string, p long, response string").coalesce(1).write.mode("append").parquet(folder)
    write([("a", 2, "third"), ("a", 0, "first"), ("b", 1, "second"), (None, 0, "x"), ("a", None, "y")])
    assert served(spark, folder, out, state) == [("a", 0, 0, "first")]
    write([("a", 1, "second"), ("a", 1, "another"), ("a", 1, None)])
    want = [("a", 0, 0, "first"), ("a", 1, 1, "another"), ("a", 1, 2, "second"), ("a", 1, 3, None), ("a", 2, 4, "third")]
    assert sorted(served(spark, folder, out, state), key=lambda r: r[2]) == want
    # a copy that comes after its position is out, and a first position that was missing
    write([("a", 0, "late"), ("b", 0, "first")])
    got = served(spark, folder, out, state)
    assert sorted(r for r in got if r[0] == "b") == [("b", 0, 0, "first"), ("b", 1, 1, "second")]
    assert ("a", 0, 5, "late") in got and len(got) == 8


class _Counted:
    """A state in memory that counts its requests."""

    def __init__(self):
        self.kept, self.asked, self.put = {}, 0, 0

    def get(self):
        return self.kept.get(None)

    def exists(self):
        return None in self.kept

    def update(self, value):
        self.kept[None] = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.kept

    def getValue(self, key):
        self.asked += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.put += 1
        self.kept[key] = value

    def removeKey(self, key):
        del self.kept[key]


def test_answers_that_are_due_do_not_enter_the_state():
    step = ordering.InOrder(0)
    step.due, step.waiting = _Counted(), _Counted()
    part = lambda positions: iter([pd.DataFrame({"s": "a", "p": positions, "r": [f"r{p}" for p in positions]})])
    got = [r for df in step.handleInputRows(("a",), part([3, 1, 0, 2, 6]), None) for r in df["_response"]]
    assert got == ["r0", "r1", "r2", "r3"] and step.waiting.put == 1 and step.waiting.asked <= 6
    got = [r for df in step.handleInputRows(("a",), part([5, 4]), None) for r in df["_response"]]
    assert got == ["r4", "r5", "r6"] and step.waiting.put == 1 and not step.waiting.kept
