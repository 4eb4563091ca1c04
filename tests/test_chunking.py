import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.operators import chunking as ch
from larkspan.operators import search


def run(spark, fn, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(fn(df, **kw).collect(), key=lambda r: (r["i"], r["chunk_id"])):
        out[r["i"]].append(r["content"])
        assert r["chunk_id"] == len(out[r["i"]])
    return [out[i] for i in range(len(texts))]


def pack_by_hand(text, target=200, overlap=40):
    """Independent statement of the packing rule: a moving window over all words."""
    sizes = [len(p.split()) for p in text.split("\n\n") if p.strip()]
    all_words = text.split()
    begin = at = unseen = 0
    out = []
    for size in sizes:
        at, unseen = at + size, unseen + size
        if at - begin >= target:
            out.append(" ".join(all_words[begin:at]))
            begin, unseen = max(begin, at - overlap), 0
    return out + ([" ".join(all_words[begin:at])] if unseen else [])


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_text_boundaries(spark):
    texts = [words(199), words(200), words(1000), words(200) + "\n\n" + words(1), words(150) + "\n\n" + words(50), " \n\n "]
    got = run(spark, ch.chunk_text, texts)
    assert got == [pack_by_hand(t) for t in texts]
    assert len(got[2]) == 1 and len(got[4]) == 1 and got[5] == []
    assert got[3][1].split()[:40] == words(200).split()[-40:]


def test_text_random(spark):
    rng = random.Random(3)
    texts = ["\n\n".join(words(rng.randint(1, 120), f"p{j}_") for j in range(rng.randint(1, 30))) for _ in range(40)]
    assert run(spark, ch.chunk_text, texts) == [pack_by_hand(t) for t in texts]


def test_chunks_keep_every_word(spark):
    text = "\n\n".join(words(37, f"p{j}_") for j in range(50))
    (chunks,) = run(spark, ch.chunk_text, [text])
    seen = set(w for c in chunks for w in c.split())
    assert seen == set(text.split())


@pytest.mark.parametrize("n", [0, 1, 299, 300, 301, 559, 560, 561, 820, 821, 1500])
def test_windows(spark, n):
    (got,) = run(spark, ch.word_windows, [words(n)])
    all_words, want, start = words(n).split(), [], 0
    while start < n:
        want.append(" ".join(all_words[start : start + 300]))
        if start + 300 >= n:
            break
        start += 260
    assert got == want


def test_markdown_sections(spark):
    text = "pre\n# A\nx y\n```\n# no\n~~~\n## B  c\n  ### in\nbody\n##### five\n#x\n# \n"
    (got,) = run(spark, ch.chunk_markdown, [text])
    assert got == ["pre", "# A\nx y\n```\n# no\n~~~", "## B  c", "### in\nbody\n##### five\n#x\n#"]


def test_markdown_long_sections(spark):
    head = "# H"
    texts = [f"{head}\n{words(298)}", f"{head}\n{words(299)}", f"{head}\n{words(561)}", "# " + words(301), "\n\n# A\n\n"]
    got = run(spark, ch.chunk_markdown, texts)
    assert got[0] == [texts[0]]
    assert got[1] == [f"{head}\n{words(299)}"]
    assert [len(c.split()) for c in got[2]] == [302, 302, 43]
    assert all(c.startswith("# H\n") for c in got[2])
    assert got[3] == []  # an over-long heading with an empty body vanishes
    assert got[4] == ["# A"]


def test_json(spark):
    texts = ['{"a": {"é": [1, 2]}, "b": null}', "{}", "[1, 2]", "3", "{bad", " "]
    got = run(spark, ch.chunk_json, texts)
    assert got[0] == ['"a"\n\n{\n  "é": [\n    1,\n    2\n  ]\n}', '"b"\n\nnull']
    assert got[1:] == [[], ["[1, 2]"], ["3"], ["{bad"], []]


def test_python(spark):
    source = (
        '"""doc"""\nimport os\nfrom a import (\n    b,\n)\n\n@x\n@y(1)\ndef f():\n    return 1\n\n'
        "async def g(): pass\n\nclass C:\n    def m(self):\n        pass\n\nprint(1)\nif x:\n    y = 2\n"
    )
    got = run(spark, ch.chunk_python, [source, "def (", "# only\n\n# comments", "\x00"])
    assert got[0] == [
        "# imports\nimport os\nfrom a import (\n    b,\n)", "@x\n@y(1)\ndef f():\n    return 1", "async def g(): pass",
        "class C:\n    def m(self):\n        pass", '# __main__\n"""doc"""\n\nprint(1)\n\nif x:\n    y = 2',
    ]
    assert got[1] == ["def ("] and got[2] == ["# only # comments"]


def test_dispatch_and_partitioning(spark):
    rows = [("a.md", "/a.md", ".md", "# T\nx"), ("b.py", "/b.py", ".PY", "x = 1"), ("c.json", "/c.json", ".json", '{"k": 1}'),
            ("d", "/d", "", "plain"), ("e.txt", "/e.txt", ".txt", "# T\nx")]
    df = spark.createDataFrame(rows, "filename string, filepath string, extension string, content string")
    first = {(r["filepath"], r["content"]) for r in ch.chunk_documents(df).collect()}
    assert first == {("/a.md", "# T\nx"), ("/b.py", "# __main__\nx = 1"), ("/c.json", '"k"\n\n1'), ("/d", "plain"), ("/e.txt", "# T x")}
    second = {(r["filepath"], r["content"]) for r in ch.chunk_documents(df.repartition(5)).collect()}
    assert first == second


def test_null_content(spark):
    df = spark.createDataFrame([(1, None)], "i int, content string")
    for fn in (ch.chunk_text, ch.chunk_markdown, ch.chunk_json, ch.chunk_python, ch.word_windows):
        assert fn(df).count() == 0
    assert df.select(F.lit(1)).count() == 1


def test_long_texts_in_linear_time(spark):
    n = 100_000
    text = "\n".join(f"# h{i}\n\n" + words(9, f"v{i}_") for i in range(n))
    got = run(spark, ch.chunk_markdown, [text, None, "# a\n```\n# b\n```\n# c\nd"])
    assert len(got[0]) == n and got[0][-1] == f"# h{n - 1}\n" + words(9, f"v{n - 1}_")
    assert got[1] == [] and got[2] == ["# a\n```\n# b\n```", "# c\nd"]
    got = run(spark, ch.chunk_text, [text, None, ""])
    assert got == [pack_by_hand(text), [], []]


@pytest.mark.parametrize("target, overlap", [(1, 0), (5, 5), (5, 9), (30, 7)])
def test_packing_bounds(spark, target, overlap):
    rng = random.Random(target + overlap)
    texts = ["\n\n".join(words(rng.randint(1, 12), f"p{j}_") for j in range(rng.randint(0, 20))) for _ in range(30)]
    want = [pack_by_hand(t, target, overlap) for t in texts]
    assert run(spark, ch.chunk_text, texts, target=target, overlap=overlap) == want


def test_batches_are_parsed_and_embedded_in_pieces(spark):
    """However many rows a batch has, few are in memory with what is made of them."""
    texts = pd.Series([f"x{i} = 1" for i in range(2_600)])
    parts = list(ch._parsed.func(iter([(pd.Series(["python"] * 2_600), texts), (texts[:0], texts[:0])])))
    assert sum(map(len, parts)) == 2_600 and max(map(len, parts)) <= 500

    def make():
        def embed(some):
            assert len(some) <= 1_000
            return np.array([[float(t[1:-4])] for t in some])

        return embed

    rows = spark.createDataFrame([(t,) for t in texts], "content string").coalesce(1)
    got = search.embed(rows, make_embed=make).filter(F.concat(F.lit("x"), F.col("embedding")[0].cast("int"), F.lit(" = 1")) == F.col("content"))
    assert got.count() == 2_600
