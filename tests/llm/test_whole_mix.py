"""The mixing stage gives whole documents."""

import re
from collections import Counter, defaultdict

from larkspan.llm import mixing


def test_mixed_documents_are_whole(documents, awkward):
    for df in (documents, awkward):
        given = Counter((r.doc_id, r.text, r.source) for r in df.collect())
        got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(df).collect())
        assert got and all(n <= 2 * given[row] for row, n in got.items())


def test_words_nearest_the_target(documents):
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    places, _ = mixing.laid_out(documents, mixing.Settings(), "doc_id", "text", "source")
    placed, got = defaultdict(list), Counter()
    for r in places.collect():
        placed[r.source].append(r)
    for r in mixing.mixed_documents(documents).collect():
        got[r.source] += words(r.text)
    for source, rows in placed.items():
        ends = {0, *(r.first + r["size"] + lap * r.source_size for r in rows for lap in range(2))}
        assert abs(got[source] - rows[0].target) == min(abs(e - rows[0].target) for e in ends)


def test_one_document_a_source(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, text, f"s{i:02}") for i in range(30)], "doc_id long, text string, source string")
    goal = mixing.targets([40] * 30)
    got = Counter(r.source for r in mixing.mixed_documents(df).collect())
    assert any(0 < t % 40 for t in goal) and all(abs(40 * got[f"s{i:02}"] - t) <= 20 for i, t in enumerate(goal))
    assert {r.text for r in mixing.mixed_documents(df).collect()} == {text}
