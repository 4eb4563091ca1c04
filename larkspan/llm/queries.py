"""One query per operator over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query, table
from ..session import scratch_path
from . import attribution, bpe_reuse, exact_dedup, id_files, language_id, line_crf, mixing, near_dedup, quality_model, scaled_sketch, sharding, source_divergence, vector_codes
from .common import crc32_text

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def remainder(of: int) -> Column:
    return crc32_text(F.col("doc_id")) % of


OP4_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""


@query("op4_exact_dedup", OP4_SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::BIGINT AS w,
    row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS i
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(2 * source_size) OVER o, 0)::BIGINT AS capped,
    (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS open_weight,
    row_number() OVER (ORDER BY source_size / w, i) AS k
  FROM s WINDOW o AS (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT min(k) AS k FROM r
  WHERE 2::HUGEINT * source_size * 2 * open_weight > w::HUGEINT * (3 * total - 2 * capped)),
t AS (
  SELECT r.source, r.source_size,
    CASE WHEN f.k IS NULL OR r.k < f.k THEN (2 * r.source_size)::DOUBLE
      ELSE (r.w * (3 * b.total - 2 * b.capped))::DOUBLE / (2 * b.open_weight)::DOUBLE END AS target
  FROM r CROSS JOIN f LEFT JOIN r b ON b.k = f.k),
p AS (
  SELECT d.doc_id, d.size, d.source, t.source_size::BIGINT AS source_size, t.target, floor(t.target)::BIGINT AS words,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT source, (floor(target)::BIGINT + 1023) // 1024 AS need FROM t WHERE floor(target) > 0),
e AS (
  SELECT source, need, ends, coalesce(lag(ends) OVER (ORDER BY source COLLATE "C" NULLS LAST), -1) AS begins FROM (
    SELECT source, need, (sum(need) OVER (ORDER BY source COLLATE "C" NULLS LAST))::HUGEINT * 18446744073709551616 // sum(need) OVER ()::HUGEINT - 1 AS ends FROM n)),
k AS (SELECT unnest(range((SELECT 2 * sum(need) + 64 FROM n)::BIGINT)) AS slot),
z AS (
  SELECT slot, source, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, (slot::HUGEINT * 11400714819323198485) % 18446744073709551616 AS point FROM k) x JOIN e ON x.point > e.begins AND x.point <= e.ends),
y AS (
  SELECT *, greatest(0, least(first + size, words) - first) AS one, greatest(0, least(first + source_size + size, words) - first - source_size) AS two FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, CASE WHEN one > 0 THEN z.slot END AS first_slot,
  (CASE WHEN one > 0 THEN (first + one - 1) // 1024 - first // 1024 + 1 ELSE 0 END
   + CASE WHEN two > 0 THEN (first + source_size + two - 1) // 1024 - (first + source_size) // 1024 + 1 ELSE 0 END)::BIGINT AS n_slots
FROM y LEFT JOIN z ON z.source IS NOT DISTINCT FROM y.source AND z.rank = y.first // 1024 AND z.rank < z.need
"""


@query("op7_mixing", OP7_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query("op8_bpe_reuse")
def op8_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.encode_digests(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(remainder(4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


@query("op1_line_crf")
def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.quality_rules(docs, line_crf.train(docs))


@query("op2_quality_model")
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels.where(remainder(3) != 1))
    found = quality_model.score(docs, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op6_attribution")
def op6_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute_sections(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op10_id_files")
def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), VOCABULARY, folder)
    return id_files.read_ids(spark, folder).withColumnRenamed("id", "doc_id")


@query("op11_scaled_sketch")
def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints_of_edits(table(spark, sf_dir, "documents"))


def op12_sql(parts: int = 4, rounds: int = 4) -> str:
    """The rounds written out, one after the other."""
    sql = f"""WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
x AS (SELECT r, p, v[1 + p * len(v) // {parts} : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p)),
xx AS (SELECT r, p, v, list_dot_product(v, v) AS vv FROM x),
c0 AS (SELECT p, r - 1 AS e, v, vv FROM xx WHERE r <= 256)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (
  SELECT r, p, any_value(xx.v) AS v, min((xx.vv - 2 * list_dot_product(xx.v, c.v) + c.vv)::BIGINT * 256 + c.e) AS m
  FROM xx JOIN (SELECT p, e, v AS v, vv FROM c{i}) c USING (p) GROUP BY r, p)"""
        if i < rounds:
            sql += f""",
s{i} AS (SELECT p, m % 256 AS e, j, sum(v[j]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM xx))) AS j) GROUP BY ALL),
m{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM s{i} GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT p, e, w AS v, list_dot_product(w, w) AS vv FROM (SELECT c.p, c.e, coalesce(m.v, c.v) AS w FROM c{i} c LEFT JOIN m{i} m USING (p, e)))"""
    sql += f""",
f AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS z, generate_subscripts(v, 1) AS j FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN f USING (r) CROSS JOIN h"""
    return sql


@query("op12_vector_codes", op12_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("scans")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total, coalesce(any_value(v.v), 0)::HUGEINT AS v
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 5)::HUGEINT // (total + 5 * g.v) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 5)::HUGEINT // (any_value(a.total) + 5 * any_value(a.v)) AS q
      FROM c JOIN (SELECT lang, sum(total)::HUGEINT AS total, any_value(v) AS v FROM g GROUP BY lang) a USING (lang) GROUP BY lang, term),
f AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INT AS rank FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q) WHERE rank <= 50
"""


@query("op13_source_divergence", OP13_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))
