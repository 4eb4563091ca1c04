import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000)) + "\n" + "x" * 5000 + " " * 3000 + "end"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing extra columns."""
    plain = "the quick brown fox jumps over the lazy dog and runs away from the angry bear. " * 3
    rows = [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain.upper(), "en", "b"), (3, "", None, "b"), (4, None, "en", None), (5, None, None, None),
        (6, LONG, "en", "a"), (7, " \n\t ", "de", "c"), (None, plain, "de", "c"), (None, None, None, None), (8, "der hund und die katze " * 20, "de", "c"),
        (9, "<|endoftext|> and then\n\n  more <|endoftext|>", "en", "a"), (10, "日本語の文章です。" * 400, "ja", "a"), (11, "one", "en", "b"), (11, "another text", "en", "b"),
        (12, "Ärger mit Raum \r\n tab\tstop don't  \n", "de", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = "id row node kept size key first s block label score shard slot rank n gone_id mix_id mix_end TEXT_md5 bucket marks number ids".split()
    return df.selectExpr("*", "cast(length(text) as bigint) AS n_chars", *[f"'x' AS {n}" for n in names])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
