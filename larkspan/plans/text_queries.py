"""Chunking, embedding and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, vectors
from ..functions.text import BLANK_RE2
from ..operators import chunking, search, vector_index
from .profile_queries import sql_strip
from ..session import scratch_path, staged
from .registry import SQL, query, spread, table



def sql_words(expr: str) -> str:
    return f"regexp_split_to_array({expr}, '{BLANK_RE2}+')"


# --- plain text ----------------------------------------------------------------

# The fold of the packing rule, one recursion step per paragraph.
SQL_TEXT_CHUNKS = f"""
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i,
             len({sql_words('para')})::INT AS n
      FROM (SELECT doc_id, i, {sql_strip('raw')} AS para
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
      WHERE para <> ''),
r AS (SELECT doc_id, 0::BIGINT AS i, 0 AS start, 0 AS stop, 0 AS fresh, NULL::INT AS cs, NULL::INT AS ce
      FROM (SELECT DISTINCT doc_id FROM p)
      UNION ALL
      SELECT r.doc_id, p.i,
             CASE WHEN r.stop + p.n - r.start >= 200 THEN greatest(r.start, r.stop + p.n - 40) ELSE r.start END,
             r.stop + p.n,
             CASE WHEN r.stop + p.n - r.start >= 200 THEN 0 ELSE r.fresh + p.n END,
             CASE WHEN r.stop + p.n - r.start >= 200 THEN r.start END,
             CASE WHEN r.stop + p.n - r.start >= 200 THEN r.stop + p.n END
      FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
spans AS (SELECT doc_id, cs, ce FROM r WHERE cs IS NOT NULL
          UNION ALL
          SELECT doc_id, start, stop FROM r WHERE fresh > 0
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1
             AND i = (SELECT max(p.i) FROM p WHERE p.doc_id = r.doc_id)),
w AS (SELECT doc_id, {sql_words(sql_strip('text'))} AS words FROM documents),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ce)::INT AS chunk_id,
                  array_to_string(words[cs + 1 : ce], ' ') AS content
           FROM spans JOIN w USING (doc_id))"""


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))


@query("chunk_text_docs", f"WITH RECURSIVE {SQL_TEXT_CHUNKS} SELECT doc_id, chunk_id, content FROM chunks")
def chunk_text_docs(spark, d):
    return chunking.chunk_text(_documents(spark, d), sep="\n")


@query("word_windows", f"""
SELECT doc_id, (k + 1)::INT AS chunk_id,
       array_to_string(words[k * 260 + 1 : least(k * 260 + 300, len(words))], ' ') AS content
FROM (SELECT doc_id, words, unnest(generate_series(0, CASE WHEN len(words) <= 300 THEN 0
             ELSE ceil((len(words) - 300) / 260.0)::BIGINT END)) AS k
      FROM (SELECT doc_id, {sql_words(sql_strip('text'))} AS words FROM documents
            WHERE {sql_strip('text')} <> ''))""")
def word_windows(spark, d):
    return chunking.word_windows(_documents(spark, d))


# --- Markdown --------------------------------------------------------------------

# Documents turned into Markdown: lines with certain capitals become headings,
# others open or close a fence.
SQL_MARKDOWN = """
md AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^([A-D])', '## \\1', 'g'),
                                     '(?m)^([T-Z])', '```' || chr(10) || '\\1', 'g') AS content FROM documents)"""
SQL_SECTIONS = f"""{SQL_MARKDOWN},
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM md
            WHERE content <> '')),
f AS (SELECT *, {sql_strip('line')} AS s,
             regexp_matches({sql_strip('line')}, '^(```|~~~)') AS fence FROM l),
h AS (SELECT *, NOT fence AND regexp_matches(s, '^#{{1,4}} ')
             AND coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS heading FROM f),
n AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY i)::INT AS section_id FROM h),
sections AS (SELECT doc_id, section_id, max(CASE WHEN heading THEN s END) AS heading,
                    {sql_strip("coalesce(string_agg(CASE WHEN NOT heading THEN line END, chr(10) ORDER BY i), '')")}
                      AS body
             FROM n GROUP BY doc_id, section_id)"""


def _markdown(spark, d):
    text = F.regexp_replace("text", r"(?md)^([A-D])", "## $1")
    text = F.regexp_replace(text, r"(?md)^([T-Z])", "```\n$1")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.alias("content"))


@query("markdown_sections", f"WITH {SQL_SECTIONS} SELECT doc_id, section_id, heading, body FROM sections")
def markdown_sections(spark, d):
    return chunking.markdown_sections(_markdown(spark, d))


@query("chunk_markdown", f"""
WITH {SQL_SECTIONS},
t AS (SELECT doc_id, section_id, heading, body,
             {sql_strip("coalesce(heading || chr(10), '') || body")} AS full_text FROM sections),
z AS (SELECT *, len({sql_words(sql_strip('full_text'))}) AS n,
             CASE WHEN body = '' THEN [] ELSE {sql_words('body')} END AS words FROM t WHERE full_text <> ''),
parts AS (SELECT doc_id, section_id, 0 AS k, full_text AS content FROM z WHERE n <= 300
          UNION ALL
          SELECT doc_id, section_id, k, coalesce(heading || chr(10), '')
                 || array_to_string(words[k * 260 + 1 : least(k * 260 + 300, len(words))], ' ')
          FROM (SELECT *, unnest(generate_series(0, CASE WHEN len(words) <= 300 THEN 0
                       ELSE ceil((len(words) - 300) / 260.0)::BIGINT END)) AS k
                FROM z WHERE n > 300 AND len(words) > 0))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, k)::INT AS chunk_id, content FROM parts""")
def chunk_markdown(spark, d):
    return chunking.chunk_markdown(_markdown(spark, d))


# --- JSON and Python -------------------------------------------------------------

JSON_TEXT = (
    "'{\"lang\": \"' || lang || '\", \"source\": \"' || source || '\", \"tags\": [\"' || source || '\", '"
    " || n_chars || '], \"empty\": {}}'"
)


@query("chunk_json", """
SELECT doc_id, 1 AS chunk_id, '"lang"' || chr(10) || chr(10) || '"' || lang || '"' AS content FROM documents
UNION ALL SELECT doc_id, 2, '"source"' || chr(10) || chr(10) || '"' || source || '"' FROM documents
UNION ALL SELECT doc_id, 3, '"tags"' || chr(10) || chr(10) || '[' || chr(10) || '  "' || source || '",' || chr(10)
       || '  ' || n_chars || chr(10) || ']' FROM documents
UNION ALL SELECT doc_id, 4, '"empty"' || chr(10) || chr(10) || '{}' FROM documents""")
def chunk_json(spark, d):
    rows = spread(table(spark, d, "documents")).select("doc_id", F.expr(JSON_TEXT).alias("content"))
    return chunking.chunk_json(rows)


@query("chunk_json_props", """
SELECT event_id, 1 AS chunk_id, '"k"' || chr(10) || chr(10) || (props::JSON ->> 'k') AS content FROM events""")
def chunk_json_props(spark, d):
    rows = spread(table(spark, d, "events").select("event_id", F.col("props").alias("content")))
    return chunking.chunk_json(rows)


PYTHON_TEXT = (
    "'import m' || p_partkey || chr(10) || '@cached' || chr(10) || 'def size(x):' || chr(10) || '    return '"
    " || p_size || chr(10) || chr(10) || 'print(size(1))' || chr(10) || 'from a import b' || chr(10)"
)


@query("chunk_python", """
SELECT p_partkey, 1 AS chunk_id,
       '# imports' || chr(10) || 'import m' || p_partkey || chr(10) || 'from a import b' AS content FROM part
UNION ALL SELECT p_partkey, 2, '@cached' || chr(10) || 'def size(x):' || chr(10) || '    return ' || p_size FROM part
UNION ALL SELECT p_partkey, 3, '# __main__' || chr(10) || 'print(size(1))' FROM part""")
def chunk_python(spark, d):
    rows = spread(table(spark, d, "part")).select("p_partkey", F.expr(PYTHON_TEXT).alias("content"))
    return chunking.chunk_python(rows)


PYTHON_DOCUMENT = (
    "'import m' || doc_id || chr(10) || '@cached' || chr(10) || 'def size(x):' || chr(10) || '    return ' || n_chars"
    " || chr(10) || chr(10) || 'print(size(1))' || chr(10) || 'from a import b' || chr(10)"
)


def document_files(spark, d):
    """Documents as files of four formats, by their number: text, Markdown, JSON and Python."""
    part = F.col("doc_id") % 4
    markdown = F.regexp_replace(F.regexp_replace("text", r"(?md)^([A-D])", "## $1"), r"(?md)^([T-Z])", "```\n$1")
    kind = F.element_at(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".json"), F.lit(".py")), (part + 1).cast("int"))
    content = F.when(part == 1, markdown).when(part == 2, F.expr(JSON_TEXT)).when(part == 3, F.expr(PYTHON_DOCUMENT)).otherwise(F.col("text"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), kind)
    return table(spark, d, "documents").select(
        name.alias("filename"), F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), name).alias("filepath"),
        kind.alias("extension"), content.alias("content"),
    )


# The chunks of every format, each from the query of that format.
SQL_DOCUMENT_CHUNKS = f"""
SELECT doc_id, '.txt' AS extension, chunk_id, content FROM ({SQL["chunk_text_docs"]}) WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, '.md', chunk_id, content FROM ({SQL["chunk_markdown"]}) WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, '.json', chunk_id, content FROM ({SQL["chunk_json"]}) WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, '.py', 1, '# imports' || chr(10) || 'import m' || doc_id || chr(10) || 'from a import b' FROM documents WHERE doc_id % 4 = 3
UNION ALL SELECT doc_id, '.py', 2, '@cached' || chr(10) || 'def size(x):' || chr(10) || '    return ' || n_chars FROM documents WHERE doc_id % 4 = 3
UNION ALL SELECT doc_id, '.py', 3, '# __main__' || chr(10) || 'print(size(1))' FROM documents WHERE doc_id % 4 = 3"""


@query("chunk_documents", f"""
SELECT 'doc' || doc_id || extension AS filename, '/corpus/' || source || '/doc' || doc_id || extension AS filepath, extension,
       chunk_id::INT AS chunk_id, content
FROM ({SQL_DOCUMENT_CHUNKS}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""")
def chunk_documents(spark, d):
    return chunking.chunk_documents(spread(document_files(spark, d)), sep="\n")


# --- vectors ---------------------------------------------------------------------

SQL_CENTROIDS = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim
      FROM embeddings),
c AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY label, dim)"""


@query("mean_pool", f"WITH {SQL_CENTROIDS} SELECT label, (dim - 1)::INT AS dim, round(m, 9) AS value FROM c")
def mean_pool(spark, d):
    pooled = search.mean_pool(table(spark, d, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 9)
    )


@query("vector_topk", f"""
WITH {SQL_CENTROIDS},
q AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c),
s AS (SELECT q.label AS query_id, e.vec_id, round(sum(q.m * e.x), 12) AS score
      FROM q JOIN e ON q.dim = e.dim GROUP BY q.label, e.vec_id)
SELECT query_id, rank, round(score, 9) AS score, vec_id
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10 AND score >= 0.2""")
def vector_topk(spark, d):
    """Class centroids, as unit vectors, searched among all vectors."""
    items = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    asked = search.mean_pool(items, "label").select("label", vectors.l2_normalize("embedding").alias("q"))
    return search.similarity_topk(
        asked, items, query_id="label", query_vec="q", ids=["vec_id"], k=10, min_score=0.2
    )


@query("vector_topk_passes", f"""
WITH q AS (SELECT vec_id % 50 AS query_id, vec_id AS row, embedding FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT query_id, row, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 12) AS score
      FROM q, embeddings e)
SELECT query_id, rank, round(score, 9) AS score, vec_id
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10 AND score >= 0.2""")
def vector_topk_passes(spark, d):
    """A stated set of vectors as queries, with repeated ids, searched among all vectors in several passes."""
    items = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = items.filter("vec_id % 25 = 0").select((F.col("vec_id") % 50).alias("query_id"), F.col("embedding").alias("q"))
    n = asked.count()
    return search.similarity_topk(
        asked, items, query_id="query_id", query_vec="q", ids=["vec_id"], k=10, min_score=0.2, matrix_queries=max(1, n // 3)
    )


@query("indexed_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 12) AS score
      FROM q, embeddings e)
SELECT query_id, rank, round(score, 9) AS score, vec_id
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10 AND score >= 0.2""")
def indexed_topk(spark, d):
    """A stated set of vectors as queries, against an index of all vectors that skips what cannot win."""
    items = table(spark, d, "embeddings").select("vec_id", "embedding")
    folder = scratch_path(spark, "vector-index")
    vector_index.write_vector_index(items, folder, ["vec_id"])
    asked = items.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector_index.indexed_topk(vector_index.open_vector_index(spark, folder), asked, query_id="query_id", query_vec="q", k=10, min_score=0.2)


@query("vector_checks", """
SELECT vec_id, len(embedding) = 64 AS right_size,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm
FROM embeddings""")
def vector_checks(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", vectors.has_dimension("embedding", 64).alias("right_size"),
        F.round(vectors.l2_norm("embedding"), 9).alias("norm"),
    )


@query("softmax_argmax", """
WITH x AS (SELECT vec_id, embedding, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e
           FROM embeddings)
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS label,
       round(list_max(e) / list_sum(e), 9) AS confidence FROM x""")
def softmax_argmax(spark, d):
    rows = table(spark, d, "embeddings").withColumn("p", numeric.softmax(F.col("embedding").cast("array<double>")))
    return rows.select(
        "vec_id", numeric.argmax("embedding").alias("label"), F.round(F.array_max("p"), 9).alias("confidence")
    )


@query("masked_mean", """
WITH v AS (SELECT vec_id, embedding[1:32] AS a, embedding[33:64] AS b, (vec_id % 3 > 0)::INT AS k FROM embeddings)
SELECT vec_id, unnest(range(32))::INT AS dim,
       round(unnest(list_transform(list_zip(a, b), lambda p: (p[1]::DOUBLE + p[2]::DOUBLE * k) / (1 + k))), 9) AS value
FROM v""")
def masked_mean(spark, d):
    """Two token vectors per row; the mask hides the second in every third row."""
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("tokens"),
        F.array(F.lit(1), (F.col("vec_id") % 3 > 0).cast("int")).alias("mask"),
    )
    pooled = rows.select("vec_id", F.posexplode(vectors.masked_mean("tokens", "mask")).alias("dim", "value"))
    return pooled.withColumn("value", F.round("value", 9))


SQL_HASHED = """
{name} AS (SELECT {ids}, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY {ids})))::FLOAT::DOUBLE AS x
  FROM (SELECT {ids}, dim, count(*)::DOUBLE AS n
        FROM (SELECT {ids}, ('0x' || substr(md5(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))), 1, 8))::BIGINT
                     % 384 AS dim FROM {source})
        GROUP BY {ids}, dim))"""


@query("hashed_embed_search", f"""
WITH RECURSIVE {SQL_TEXT_CHUNKS},
{SQL_HASHED.format(name='dv', ids='doc_id, chunk_id', text='content', source='chunks')},
{SQL_HASHED.format(name='qv', ids='item_id', text='text', source='benchmark')},
s AS (SELECT item_id, doc_id, chunk_id, round(sum(qv.x * dv.x), 12) AS score
      FROM qv JOIN dv ON qv.dim = dv.dim GROUP BY item_id, doc_id, chunk_id)
SELECT item_id AS query_id, rank, round(score, 9) AS score, 'doc' || doc_id AS filename, '/corpus/doc' || doc_id AS filepath, chunk_id,
       CASE WHEN length(content) <= 400 THEN content
            ELSE regexp_replace(substr(content, 1, 400), '{BLANK_RE2}+$', '') || '...' END AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, '/corpus/doc' || doc_id, chunk_id)::INT AS rank
      FROM s) JOIN chunks USING (doc_id, chunk_id)
WHERE rank <= 10 AND score >= 0.2""")
def hashed_embed_search(spark, d):
    """Every benchmark text searched among the chunks of all documents."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    files = spread(table(spark, d, "documents").select(
        name.alias("filename"), F.concat(F.lit("/corpus/"), name).alias("filepath"), F.col("text").alias("content")
    ))
    index = staged(search.embed(chunking.chunk_text(files, sep="\n")), "index")
    return search.search(
        index, table(spark, d, "benchmark"), query_id="item_id", query="text", k=10, min_score=0.2
    )


def _layer(source: str, width: int, rectified: bool) -> str:
    total = f"sum(v * sin(j * {width} + o + 1) / 8) + sin(o + 1) / 8"
    shown = f"greatest(0, {total})" if rectified else total
    return f"(SELECT vec_id, o AS j, {shown} AS v FROM {source}, range({width}) AS r(o) GROUP BY vec_id, o)"


@query("dense_score", f"""
WITH x AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings
           UNION ALL SELECT vec_id, 64 + k, sin(label * 16 + k + 1) / 8 FROM embeddings, range(16) AS r(k))
SELECT vec_id, round(v, 6) AS prediction FROM {_layer(_layer(_layer('x', 256, True), 64, True), 1, False)}""")
def dense_score(spark, d):
    """Forward pass of a small scoring head with given weights over all vectors."""
    import numpy as np

    from ..operators.classify import DenseWeights
    from ..operators.classify import dense_score as score

    wave = lambda *shape: np.sin(np.arange(np.prod(shape)) + 1.0).reshape(shape) / 8
    weights = DenseWeights(wave(10, 16), [(wave(80, 256), wave(256)), (wave(256, 64), wave(64)), (wave(64, 1), wave(1))])
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("language_id"))
    return score(rows, weights).select("vec_id", F.round("prediction", 6).alias("prediction"))
