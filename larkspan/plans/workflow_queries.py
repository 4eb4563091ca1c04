"""The workflows put together in ``workflows``, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import workflows
from .profile_queries import sql_strip
from .registry import query, table

_VALIDATION, _TEST = ("src0", "src1"), ("src2", "src3")


def _videos(spark, d):
    """Documents as videos of which two share an id."""
    return table(spark, d, "documents").select(
        "doc_id", F.expr("doc_id div 2").alias("video_id"), F.col("lang").alias("title"), F.col("text").alias("description"),
        F.col("source").alias("channel"), (F.col("doc_id") % 2).cast("int").alias("label"),
    )


_VIDEOS_SQL = """
v AS (SELECT doc_id, doc_id // 2 AS video_id, lang AS title, text AS description, source AS channel, (doc_id % 2)::INT AS label FROM documents)"""


@query("prepare_videos", f"""
WITH {_VIDEOS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY doc_id DESC) AS rn FROM v WHERE title IS NOT NULL)
SELECT video_id, doc_id, label, '[TITLE] ' || {sql_strip("title")} || ' [CHANNEL] ' || {sql_strip("coalesce(channel, '')")}
       || ' [DESC] ' || {sql_strip("coalesce(description, '')")} AS text,
       CASE WHEN {sql_strip("channel")} IN {_VALIDATION} THEN 'val' WHEN {sql_strip("channel")} IN {_TEST} THEN 'test' ELSE 'train' END AS split
FROM f WHERE rn = 1""")
def prepare_videos(spark, d):
    """Whole descriptions; of repeated ids the latest document stays."""
    rows = _videos(spark, d).withColumn("latest", -F.col("doc_id"))
    found = workflows.prepare_videos(rows, _VALIDATION, _TEST, ["latest"])
    return found.select("video_id", "doc_id", "label", "text", "split")


@query("profile_videos", f"""
WITH {_VIDEOS_SQL},
c AS (SELECT channel, count(*) AS n FROM v WHERE channel IS NOT NULL GROUP BY channel)
SELECT 'rows' AS question, NULL AS key, count(*)::DOUBLE AS value FROM v
UNION ALL SELECT 'labels', label::VARCHAR, count(*) FROM v GROUP BY label
UNION ALL SELECT 'label_percent', label::VARCHAR, round(100.0 * count(*) / (SELECT count(*) FROM v), 2) FROM v GROUP BY label
UNION ALL SELECT 'per_channel', channel, n FROM c
UNION ALL SELECT 'duplicate_ids', NULL, count(*) - count(DISTINCT video_id) FROM v
UNION ALL SELECT 'empty_descriptions', NULL, count(*) FILTER (WHERE {sql_strip("coalesce(description, '')")} = '') FROM v
UNION ALL SELECT 'title_length', NULL, round(avg(length(title)), 9) FROM v
UNION ALL SELECT 'description_length', NULL, round(avg(coalesce(length(description), 0)), 9) FROM v
UNION ALL SELECT 'nulls', 'title', count(*) FILTER (WHERE title IS NULL) FROM v
UNION ALL SELECT 'nulls', 'description', count(*) FILTER (WHERE description IS NULL) FROM v
UNION ALL SELECT * FROM (SELECT 'largest_channels', channel, n FROM c ORDER BY n DESC, channel LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'smallest_channels', channel, n FROM c ORDER BY n, channel LIMIT 10)""")
def profile_videos(spark, d):
    """Every question of the profile as (question, key, value) rows."""
    found = workflows.profile_videos(_videos(spark, d))

    def rows(question, df, key, value):
        return df.select(F.lit(question).alias("question"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    none = F.lit(None)
    parts = [
        rows("rows", found["rows"], none, F.col("rows")),
        rows("labels", found["labels"], F.col("label"), F.col("n")),
        rows("label_percent", found["label_percent"], F.col("label"), F.col("percent")),
        rows("per_channel", found["per_channel"], F.col("channel"), F.col("n")),
        rows("duplicate_ids", found["duplicate_ids"], none, F.col("duplicates")),
        rows("empty_descriptions", found["empty_descriptions"], none, F.col("blank")),
        rows("title_length", found["lengths"], none, F.round("title_mean_length", 9)),
        rows("description_length", found["lengths"], none, F.round("description_mean_length", 9)),
        rows("nulls", found["nulls"].filter(F.col("column_name").isin("title", "description")), F.col("column_name"), F.col("nulls")),
        rows("largest_channels", found["largest_channels"], F.col("channel"), F.col("n")),
        rows("smallest_channels", found["smallest_channels"], F.col("channel"), F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("evaluate_classifier", """
WITH p AS (SELECT doc_id, quality AS label, toxic AS prediction FROM labels),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = prediction) AS correct,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM p)
SELECT total, correct, round(correct / total, 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 9) AS f1, (SELECT count(*) FROM (SELECT DISTINCT label, prediction FROM p)) AS cells,
       (SELECT count(*) FILTER (WHERE label = prediction) FROM p) AS marked_correct
FROM n""")
def evaluate_classifier(spark, d):
    """One given column read as the prediction of another; the whole report in one row."""
    scored = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    found = workflows.evaluate_classifier(scored)
    cells = found["confusion"].agg(F.count(F.lit(1)).alias("cells"))
    marked = found["predictions"].agg(F.count_if("correct").alias("marked_correct"))
    binary = found["binary"].select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
    # each side is an aggregate of one row
    one = found["accuracy"].select("total", "correct", F.round("accuracy", 9).alias("accuracy")).withColumn("k", F.lit(1))
    for side in (binary, cells, marked):
        one = one.join(side.withColumn("k", F.lit(1)), "k")
    return one.drop("k")
