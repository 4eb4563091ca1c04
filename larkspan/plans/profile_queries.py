"""Profiling, cleaning and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BLANK_RE2, preview, strip, tokens, video_text
from ..operators import clean, lookup, profile
from .registry import query, spread, table

# RE2 spelling of "blank at either end", for the SQL side.
SQL_STRIP = f"'^{BLANK_RE2}+|{BLANK_RE2}+$', '', 'g'"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {SQL_STRIP})"


@query("row_count", "SELECT count(*) AS \"rows\" FROM documents")
def row_count(spark, d):
    return profile.row_count(table(spark, d, "documents"))


@query("label_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def label_counts(spark, d):
    return profile.value_counts(table(spark, d, "labels"), "quality")


@query("label_percentages", """
SELECT quality, round(100.0 * count(*) / (SELECT count(*) FROM labels), 2)::DOUBLE AS percent
FROM labels GROUP BY quality""")
def label_percentages(spark, d):
    return profile.value_percentages(table(spark, d, "labels"), "quality")


@query("duplicate_texts", """
SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicates FROM documents WHERE text IS NOT NULL""")
def duplicate_texts(spark, d):
    return profile.duplicate_count(table(spark, d, "documents"), "text")


@query("blank_share", f"""
SELECT count(*) FILTER (WHERE coalesce({sql_strip('text')}, '') = '') AS blank,
       round(100.0 * count(*) FILTER (WHERE coalesce({sql_strip('text')}, '') = '') / count(*), 2)::DOUBLE
         AS blank_percent
FROM documents""")
def blank_share(spark, d):
    return profile.blank_share(table(spark, d, "documents"), "text")


@query("mean_lengths", """
SELECT avg(length(source)) AS source_mean_length, avg(coalesce(length(text), 0)) AS text_mean_length
FROM documents""")
def mean_lengths(spark, d):
    return profile.mean_length(table(spark, d, "documents"), ["source"], ["text"])


@query("null_counts", """
SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS nulls FROM documents
UNION ALL SELECT 'text', count(*) - count(text) FROM documents
UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents
UNION ALL SELECT 'source', count(*) - count(source) FROM documents
UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM documents""")
def null_counts(spark, d):
    return profile.null_counts(table(spark, d, "documents"))


@query("largest_groups", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10""")
def largest_groups(spark, d):
    return profile.largest_groups(table(spark, d, "orders"), "o_custkey")


@query("smallest_groups", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n, o_custkey LIMIT 10""")
def smallest_groups(spark, d):
    return profile.smallest_groups(table(spark, d, "orders"), "o_custkey")


@query("group_sizes", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def group_sizes(spark, d):
    return profile.value_counts(table(spark, d, "documents"), "source")


@query("grouped_describe", """
SELECT lang, count(n_chars) AS count, round(avg(n_chars), 6) AS mean,
       round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min,
       quantile_cont(n_chars::DOUBLE, 0.25) AS q25, quantile_cont(n_chars::DOUBLE, 0.5) AS q50,
       quantile_cont(n_chars::DOUBLE, 0.75) AS q75, max(n_chars)::DOUBLE AS max
FROM documents GROUP BY lang""")
def grouped_describe(spark, d):
    out = profile.grouped_describe(table(spark, d, "documents"), "lang", "n_chars")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("grouped_quantiles_prices", """
SELECT l_returnflag, point, round(CASE point
         WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25)
         WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5)
         ELSE quantile_cont(l_extendedprice, 0.75) END, 6) AS quantile
FROM lineitem, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS point)
GROUP BY l_returnflag, point""")
def grouped_quantiles_prices(spark, d):
    out = profile.grouped_quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.withColumn("quantile", F.round("quantile", 6))


@query("distinct_count", "SELECT count(DISTINCT event_type) AS distinct_values FROM events")
def distinct_count(spark, d):
    return profile.distinct_count(table(spark, d, "events"), "event_type")


@query("sorted_distinct", "SELECT DISTINCT source FROM documents ORDER BY source")
def sorted_distinct(spark, d):
    return profile.sorted_distinct(table(spark, d, "documents"), "source")


@query("clean_labelled", f"""
SELECT {sql_strip('text')} AS text, {sql_strip('role')} AS role FROM conversations
WHERE text IS NOT NULL AND role IS NOT NULL AND {sql_strip('text')} <> '' AND {sql_strip('role')} <> ''""")
def clean_labelled(spark, d):
    return clean.clean_labelled(table(spark, d, "conversations"), "text", "role")


@query("dropped_count", f"""
SELECT count(*) FILTER (WHERE {sql_strip('text')} <> '' AND {sql_strip('role')} <> '') AS kept,
       count(*) - count(*) FILTER (WHERE {sql_strip('text')} <> '' AND {sql_strip('role')} <> '') AS dropped
FROM conversations""")
def dropped_count(spark, d):
    return clean.dropped_count(table(spark, d, "conversations"), "text", "role")


@query("keep_values", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)""")
def keep_values(spark, d):
    orders = table(spark, d, "orders")
    top = [r[0] for r in profile.largest_groups(orders, "o_orderpriority", 2).collect()]
    return clean.keep_values(orders, "o_orderpriority", top).select("o_orderkey", "o_orderpriority")


@query("exclude_values", """
SELECT doc_id, source, lang FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src4', 'src7')""")
def exclude_values(spark, d):
    out = clean.exclude_values(table(spark, d, "documents"), "source", ["src1", "src4", "src7"])
    return out.select("doc_id", "source", "lang")


@query("semi_join", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def semi_join(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.semi_join(table(spark, d, "customer"), keys, ["c_custkey"]).select(
        "c_custkey", "c_name", "c_mktsegment"
    )


@query("anti_join", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)""")
def anti_join(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    keys = urgent.select(F.col("o_custkey").alias("c_custkey"))
    return lookup.anti_join(table(spark, d, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_name")


@query("lookup_inner", """
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def lookup_inner(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = lookup.lookup_join(table(spark, d, "customer"), names, ["c_nationkey"], "inner")
    return out.select("c_custkey", "n_name")


@query("lookup_default", """
SELECT s_suppkey, coalesce(n_name, s_name) AS n_name
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON s_nationkey = n_nationkey""")
def lookup_default(spark, d):
    names = table(spark, d, "nation").filter("n_regionkey < 2").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_name"
    )
    out = lookup.lookup_with_default(
        table(spark, d, "supplier"), names, ["s_nationkey"], {"n_name": F.col("s_name")}
    )
    return out.select("s_suppkey", "n_name")


@query("decode_label_ids", """
SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def decode_label_ids(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    out = clean.decode_label_ids(table(spark, d, "customer"), names, "c_nationkey", "nation")
    return out.select("c_custkey", "nation")


@query("label_names", """
SELECT doc_id, CASE quality WHEN 0 THEN 'entertainment' WHEN 1 THEN 'coding' ELSE quality::VARCHAR END AS label_name,
       quality = toxic AS correct
FROM labels""")
def label_names(spark, d):
    rows = table(spark, d, "labels").withColumn(
        "label_name", clean.label_name("quality", {0: "entertainment", 1: "coding"})
    )
    return clean.with_correct(rows, "quality", "toxic").select("doc_id", "label_name", "correct")


@query("confidence_gate", """
SELECT event_id, CASE WHEN c >= 0.6 THEN event_type ELSE 'unknown' END AS event_type, c AS confidence
FROM (SELECT event_id, event_type, value / (value + 10.0) AS c FROM events)""")
def confidence_gate(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "event_type", (F.col("value") / (F.col("value") + 10.0)).alias("confidence")
    )
    return clean.confidence_gate(rows, intent="event_type")


@query("low_confidence", """
SELECT event_id, event_type, confidence
FROM (SELECT event_id, event_type, value / (value + 10.0) AS confidence FROM events) WHERE confidence < 0.7""")
def low_confidence(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "event_type", (F.col("value") / (F.col("value") + 10.0)).alias("confidence")
    )
    return clean.low_confidence(rows)


@query("video_text", f"""
SELECT doc_id, '[TITLE] ' || {sql_strip("coalesce(lang, '')")} || ' [CHANNEL] ' || {sql_strip("coalesce(source, '')")}
       || ' [DESC] ' || substr({sql_strip("coalesce(text, '')")}, 1, 250) AS text
FROM documents""")
def build_video_text(spark, d):
    return table(spark, d, "documents").select("doc_id", video_text("lang", "source", "text").alias("text"))


@query("preview", f"""
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t
       ELSE regexp_replace(substr(t, 1, 400), '{BLANK_RE2}+$', '') || '...' END AS preview
FROM (SELECT doc_id, {sql_strip("coalesce(text, '')")} AS t FROM documents)""")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", preview("text").alias("preview"))


@query("tokenize", r"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)""")
def tokenize(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", tokens("text").alias("t"))
    return rows.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query("parse_props", """
SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events""")
def parse_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("stripped_lengths", f"""
SELECT conv_id, turn, length({sql_strip('text')}) AS n FROM conversations""")
def stripped_lengths(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.length(strip("text")).cast("bigint").alias("n")
    )


@query("project_rename_cast", """
SELECT item_id, try_cast(item_id::VARCHAR AS INT) AS labels FROM benchmark""")
def project_rename_cast(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("label"))
    return clean.cast_label(rows).withColumnRenamed("label", "labels")


@query("head", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 10")
def head(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(10)


@query("usable_code", """
SELECT page_id, length(code) AS chars FROM (
  SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE html END, ''), nullif(url, '')) AS code FROM pages)
WHERE code IS NOT NULL""")
def usable_code(spark, d):
    rows = table(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html")).alias("code"),
        F.col("url").alias("original_string"),
    )
    return clean.usable_code(rows).select("page_id", F.length("code").cast("bigint").alias("chars"))
