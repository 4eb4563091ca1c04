"""Very many near copies of one text, and very long texts, in one bucket."""

import random

import pytest
from brute import brute_classes
from pyspark.sql import functions as F

from larkspan.llm import near_dedup


def variants(n, rng, length=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for i in range(n):
        w = list(base)
        # at the ends, where a change costs the fewest shingles
        w[rng.choice([0, 1, -1, -2])] = f"x{i}"
        yield " ".join(w)


def test_members_grow_in_proportion(spark):
    rng = random.Random(6)
    texts = list(variants(12_000, rng)) + list(variants(400, rng)) + [" ".join(f"q{rng.random()}" for _ in range(50)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    settings = near_dedup.Settings(block=64)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, settings).collect()}
    assert got == {i: 0 if i < 12_000 else 12_000 if i < 12_400 else i for i in range(len(texts))}

    rows = docs.select(F.col("doc_id").alias("id"), "text").withColumn("text_md5", F.unhex(F.md5(F.col("text").cast("binary"))))
    members = near_dedup.members_of(near_dedup._signed(rows, settings), settings).persist()
    n = near_dedup.first_meetings(members).count()
    assert n <= 26 * len(texts)
    # once the classes are known, nobody has to visit another block
    one = members.select("node").distinct().select("node", F.lit(b"0").alias("root"))
    assert near_dedup.later_meetings(members.where("blocks > 1"), one, settings).isEmpty()
    members.unpersist()


@pytest.mark.parametrize("chars, visitors", [(700, 4096), (3000, 3)])
def test_long_texts_and_few_visitors(spark, chars, visitors):
    rng = random.Random(chars)
    texts = [t for _ in range(6) for t in variants(12, rng, rng.choice([30, 60]))]
    # halves of a hot bucket: pairs around the threshold that share bands
    base = texts[0].split()
    texts += [" ".join(base[: len(base) - k] + [f"y{k}_{j}" for j in range(k)]) for k in range(2, 14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, near_dedup.Settings(block=5, block_chars=chars, visitors=visitors)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(dict(enumerate(texts)))
