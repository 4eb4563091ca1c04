import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import clean, lookup, profile, ranking, splits


@pytest.fixture(scope="module")
def rows(spark):
    """One label holds far more rows than the others."""
    rng = random.Random(1)
    data = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(0, 50)) for i in range(3000)]
    data += [(3000, None, 1)]
    return data, spark.createDataFrame(data, "id int, g string, v int").repartition(9).cache()


def h(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_positional_split_is_exact_and_stable(rows):
    data, df = rows
    order = sorted((i for i, _, _ in data), key=h)
    n = len(order)
    want = {i: "train" if p < int(n * 0.8) else "val" if p < int(n * 0.9) else "test" for p, i in enumerate(order)}
    for frame in (df, df.coalesce(1)):
        assert {r["id"]: r["split"] for r in splits.positional_split(frame, ["id"]).collect()} == want


@pytest.mark.parametrize("n,share", [(1, 0.1), (9, 0.1), (10, 0.1), (101, 0.1), (7, 0.0), (7, 1.0)])
def test_validation_sizes(spark, n, share):
    df = spark.range(n)
    for rounding, size in (("floor", int(n * share)), ("ceil", int(np.ceil(n * share)))):
        out = splits.validation_split(df, ["id"], share, rounding)
        assert out.filter("split = 'val'").count() == size and out.count() == n
    with pytest.raises(ValueError):
        splits.validation_split(df, ["id"], rounding="other")


def test_split_of_empty_table(spark):
    assert splits.positional_split(spark.range(0), ["id"]).count() == 0


def test_sample_n_per_group(rows):
    data, df = rows
    got = {}
    for r in ranking.sample_n_per_group(df, "g", ["id"], F.lit(200)).collect():
        got.setdefault(r["g"], set()).add(r["id"])
    for g in ("hot", "a", "b", "c"):
        assert got[g] == set(sorted((i for i, x, _ in data if x == g), key=h)[:200])
    assert None not in got


def test_copies_of_one_key_stay_together(spark):
    df = spark.createDataFrame([(7,)] * 400 + [(i,) for i in range(100, 700)], "id int")
    out = splits.validation_split(df, ["id"], 0.3)
    sides = {r["split"] for r in out.filter("id = 7").collect()}
    assert len(sides) == 1 and out.count() == 1000
    same = spark.createDataFrame([("g", 1)] * 3000 + [("h", 2)], "g string, v int")
    assert ranking.first_n_per_group(same, ["g"], [F.col("v")], 1500).count() == 1501
    mapped = same.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert ranking.first_n_per_group(mapped, ["g"], [F.col("v").desc()], 1500).count() == 1501


def test_balance_cap_and_sample(spark):
    df = spark.createDataFrame([(i, "x" if i < 900 else "y" if i < 1010 else "z") for i in range(1130)], "id int, g string")
    assert ranking.balance_cap(df, "g").first()["cap"] == 330
    counts = {r["g"]: r["count"] for r in ranking.balanced_sample(df, "g", ["id"]).groupBy("g").count().collect()}
    assert counts == {"x": 330, "y": 110, "z": 120}


def test_favoured_sample(spark):
    df = spark.createDataFrame([(i, f"l{i % 6}") for i in range(600)], "id int, g string")
    counts = {r["g"]: r["count"] for r in ranking.favoured_sample(df, "g", "l0", ["id"], total=101).groupBy("g").count().collect()}
    assert counts == {"l0": 40, **{f"l{i}": 12 for i in range(1, 6)}}
    counts = ranking.favoured_sample(df, "g", "l0", ["id"], total=101, other_groups=5).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in counts} == {"l0": 40, **{f"l{i}": 12 for i in range(1, 6)}}


@pytest.mark.parametrize("n,fan", [(5, None), (1500, 4), (1500, 100), (1001, 1)])
def test_first_n_per_group(rows, n, fan):
    data, df = rows
    got = {}
    for r in ranking.first_n_per_group(df, ["g"], [F.col("v"), F.col("id")], n, fan).collect():
        got.setdefault(r["g"], set()).add(r["id"])
    for g in {x for _, x, _ in data}:
        assert got[g] == {i for _, i in sorted((v, i) for i, x, v in data if x == g)[:n]}


def test_dedupe_first(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None), (6, "A")] + [(i, "hot") for i in range(10, 500)]
    df = spark.createDataFrame(rows, "id int, k string").repartition(6)
    got = {(r["id"], r["k"]) for r in ranking.dedupe_first(df, ["k"], [F.col("id")]).collect()}
    assert got == {(1, "a"), (2, "b"), (4, None), (6, "A"), (10, "hot")}


def test_copies_are_reduced_before_the_shuffle(rows):
    _, df = rows
    plan = ranking.dedupe_first(df, ["g"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_positions_and_labels(rows, spark):
    data, df = rows
    got = {r["id"]: r["position"] for r in ranking.shuffled(df, ["id"]).collect()}
    assert got == {i: p for p, i in enumerate(sorted((i for i, _, _ in data), key=h))}
    words = [(w,) for w in ("b", "a", "aa", "ab", "ä", "", "Z", "a", None)]
    out = ranking.label_index([spark.createDataFrame(words, "l string"), spark.createDataFrame([("0",)], "l string")], "l")
    labels = {r["l"]: r["label_id"] for r in out.collect()}
    assert labels == {w: i for i, w in enumerate(sorted({"b", "a", "aa", "ab", "ä", "", "Z", "0"}))}


@pytest.mark.parametrize("slices", [2, 7, 200])
def test_quantiles_equal_numpy(rows, spark, slices):
    data, df = rows
    got = {(r["g"], r["point"]): r["quantile"] for r in profile.grouped_quantiles(df, "g", "v", slices=slices).collect()}
    for g in ("hot", "a", "b", "c"):
        values = [v for _, x, v in data if x == g]
        for p in (0.25, 0.5, 0.75):
            assert got[g, p] == pytest.approx(np.quantile(values, p))
    single = profile.grouped_describe(spark.createDataFrame([("x", 4.0)], "g string, v double"), "g", "v").first()
    assert (single["q25"], single["q75"], single["std"]) == (4.0, 4.0, None)


def test_profile_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", " "), (None, "x"), (None, "yy")], "k string, t string")
    assert profile.duplicate_count(df, "k").first()[0] == 2
    assert tuple(profile.blank_share(df, "t").first()) == (2, 50.0)
    assert tuple(profile.mean_length(df, ["k"], ["t"]).first()) == (1.0, 1.0)
    assert {r["column_name"]: r["nulls"] for r in profile.null_counts(df).collect()} == {"k": 2, "t": 1}
    assert [tuple(r) for r in profile.value_percentages(df, "k").collect()] == [("a", 100.0)]
    empty = df.limit(0)
    assert tuple(profile.blank_share(empty, "t").first()) == (0, None)
    assert profile.duplicate_count(empty, "k").first()[0] == 0


def test_clean(spark):
    df = spark.createDataFrame([(" a ", " x", "s"), (None, "x", "s"), ("\u3000", "x", "s"), ("b", None, "s")], "text string, intent string, slot string")
    assert [tuple(r) for r in clean.clean_labelled(df).collect()] == [("a", "x")]
    assert tuple(clean.dropped_count(df).first()) == (1, 3)
    with pytest.raises(ValueError, match="label, zzz"):
        clean.require_columns(df, ["zzz", "text", "label"])
    kept = clean.exclude_values(df, "intent", [" x", "x"]).collect()
    assert [r["intent"] for r in kept] == [None]
    assert clean.keep_values(df, "intent", ["x"]).count() == 2
    gated = clean.confidence_gate(spark.createDataFrame([("a", 0.6), ("b", 0.59), ("c", None)], "intent string, confidence double"))
    assert [tuple(r) for r in gated.collect()] == [("a", 0.6), ("unknown", 0.59), ("unknown", 0.0)]
    code = spark.createDataFrame([("", "o"), (None, ""), ("x" * 4001, "o"), ("c", None)], "code string, original_string string")
    assert [r["code"] for r in clean.usable_code(code, 4000).collect()] == ["o", "c"]
    assert clean.usable_code(code).count() == 3
    assert [r["label"] for r in clean.cast_label(spark.createDataFrame([("1",), ("x",)], "label string")).collect()] == [1, None]
    names = spark.createDataFrame([(0,), (7,)], "id int").select(clean.label_name("id", {0: "zero"}).alias("n"))
    assert [r["n"] for r in names.collect()] == ["zero", "7"]


def test_a_lookup_too_large_in_bytes_is_not_broadcast(spark, monkeypatch):
    left, right = spark.range(10).withColumnRenamed("id", "k"), spark.createDataFrame([(1, "x" * 50)], "k long, t string")
    assert lookup.settle(right)[1]
    monkeypatch.setattr(lookup, "MAX_LOOKUP_BYTES", 20)
    assert not lookup.settle(right)[1]
    assert lookup.lookup_join(left, right, ["k"], "inner").count() == 1


def test_lookups_beyond_the_bound(spark):
    left = spark.createDataFrame([(i, i % 5) for i in range(20)] + [(99, None)], "id int, k int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, name string")
    for bound in (1, 100):
        got = lookup.lookup_with_default(left, right, ["k"], {"name": F.lit("?")}, max_rows=bound)
        assert sorted(r["name"] for r in got.collect()).count("?") == 9
    semi = lookup.semi_join(left, right, ["k"])
    anti = lookup.anti_join(left, right, ["k"])
    assert semi.count() == 12 and anti.count() == 9 and {r["id"] for r in anti.collect()} >= {99}
    pairs = lookup.suffixed_values(right, "name", ["", ".x", ".x"])
    assert [r["value"] for r in pairs.collect()] == ["a", "a.x", "b", "b.x", "c", "c.x"]


def test_holdout(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "channel string")
    got = {r["channel"]: r["split"] for r in splits.holdout_split(df, "channel", ["a"], ["b"]).collect()}
    assert got == {"a": "val", "b": "test", "c": "train", None: "train"}
