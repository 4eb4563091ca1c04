"""Ordering, sampling, splitting, metrics and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, ranking, regression, splits
from .registry import query, table

H = "md5('42|' || doc_id::VARCHAR)"


@query("dedupe_first", """
SELECT doc_id, text, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return ranking.dedupe_first(docs, ["text"], [F.col("doc_id")])


@query("first_n_per_group", """
SELECT event_id, event_type, ts FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 200""")
def first_n_per_group(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return ranking.first_n_per_group(events, ["event_type"], [F.col("ts"), F.col("event_id")], 200)


@query("first_n_large", """
SELECT o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) <= 3000""")
def first_n_large(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    out = ranking.first_n_per_group(
        orders, ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], 3000
    )
    return out.select("o_orderkey", "o_orderstatus")


@query("balanced_sample", f"""
WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
     k AS (SELECT least(max(n), greatest(3 * min(n), 300)) AS cap FROM c)
SELECT doc_id, lang FROM documents, k WHERE lang IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H}) <= cap""")
def balanced_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ranking.balanced_sample(docs, "lang", ["doc_id"])


@query("balance_cap", """
SELECT least(max(n), greatest(3 * min(n), 300)) AS cap
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def balance_cap(spark, d):
    return ranking.balance_cap(table(spark, d, "events"), "event_type")


@query("stratified_quota", f"""
WITH t AS (SELECT count(*) // 2 AS total FROM documents),
     q AS (SELECT lang, CASE WHEN lang = 'en' THEN floor(total * 0.4::DOUBLE)
                        ELSE floor((total - floor(total * 0.4::DOUBLE)) / (count(*) OVER () - 1)) END AS quota
           FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), t)
SELECT doc_id, lang FROM documents JOIN q USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H}) <= quota""")
def stratified_quota(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ranking.favoured_sample(docs, "lang", "en", ["doc_id"], total=docs.count() // 2)


@query("hash_split_80_10_10", f"""
SELECT doc_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'val'
       ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {H}) AS rn, count(*) OVER () AS n FROM documents)""")
def hash_split(spark, d):
    return splits.positional_split(table(spark, d, "documents").select("doc_id"), ["doc_id"])


_VALIDATION = """
SELECT o_orderkey, CASE WHEN rn <= {rounding}(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey::VARCHAR)) AS rn,
             count(*) OVER () AS n FROM orders)"""


@query("validation_split_floor", _VALIDATION.format(rounding="floor"))
def validation_floor(spark, d):
    return splits.validation_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("validation_split_ceil", _VALIDATION.format(rounding="ceil"))
def validation_ceil(spark, d):
    return splits.validation_split(
        table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], rounding="ceil"
    )


@query("holdout_split", """
SELECT doc_id, source, CASE WHEN source IN ('src0', 'src5') THEN 'val' WHEN source IN ('src2', 'src9') THEN 'test'
       ELSE 'train' END AS split FROM documents""")
def holdout_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return splits.holdout_split(docs, "source", ["src0", "src5"], ["src2", "src9"])


@query("shuffled", f"SELECT doc_id, row_number() OVER (ORDER BY {H}) - 1 AS position FROM documents")
def shuffled(spark, d):
    return ranking.shuffled(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("label_index", """
SELECT event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS label_id
FROM (SELECT DISTINCT event_type FROM events)""")
def label_index(spark, d):
    return ranking.label_index([table(spark, d, "events")], "event_type")


@query("label_vocabulary", """
SELECT label FROM (SELECT lang AS label FROM documents UNION SELECT role FROM conversations
                   UNION SELECT event_type FROM events) WHERE label IS NOT NULL""")
def label_vocabulary(spark, d):
    frames = [
        table(spark, d, name).select(F.col(c).alias("label"))
        for name, c in (("documents", "lang"), ("conversations", "role"), ("events", "event_type"))
    ]
    return ranking.label_vocabulary(frames, "label")


# --- metrics -------------------------------------------------------------------

# Truth is a stored label; the prediction is a rule on the text length.
_PREDICTED = "(SELECT l.doc_id, quality AS label, (n_chars > 500)::INT AS prediction FROM labels l JOIN documents USING (doc_id))"
_CLASSES = f"""
c AS (SELECT class::VARCHAR AS class, sum(truth) AS support, sum(predicted) AS predicted, sum(tp) AS tp
      FROM (SELECT label AS class, 1 AS truth, 0 AS predicted, (label = prediction)::INT AS tp FROM {_PREDICTED}
            UNION ALL SELECT prediction, 0, 1, 0 FROM {_PREDICTED}) GROUP BY class),
s AS (SELECT class, support::BIGINT AS support, tp,
             CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
             CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (predicted + support) END AS f1
      FROM c)"""


def _predicted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("prediction")
    )


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("accuracy", f"""
SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total,
       round(avg((label = prediction)::INT::DOUBLE), 9) AS accuracy FROM {_PREDICTED}""")
def accuracy(spark, d):
    return _rounded(metrics.accuracy(_predicted(spark, d)), "accuracy")


@query("binary_metrics", f"""
WITH t AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1)::DOUBLE AS tp,
                  count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
                  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
                  avg((label = prediction)::INT::DOUBLE) AS accuracy FROM {_PREDICTED})
SELECT round(accuracy, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM t""")
def binary_metrics(spark, d):
    return _rounded(metrics.binary_metrics(_predicted(spark, d)), "accuracy", "precision", "recall", "f1")


@query("weighted_metrics", f"""
WITH {_CLASSES}
SELECT round(sum(tp)::DOUBLE / sum(support), 9) AS accuracy,
       round(sum(precision * support) / sum(support), 9) AS precision,
       round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1
FROM s""")
def weighted_metrics(spark, d):
    return _rounded(metrics.weighted_metrics(_predicted(spark, d)), "accuracy", "precision", "recall", "f1")


@query("confusion_long", f"SELECT label, prediction, count(*) AS n FROM {_PREDICTED} GROUP BY label, prediction")
def confusion_long(spark, d):
    return metrics.confusion_counts(_predicted(spark, d))


@query("confusion_matrix", f"""
SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1
FROM {_PREDICTED} GROUP BY label""")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_predicted(spark, d), [0, 1])


@query("classification_report", f"""
WITH {_CLASSES}
SELECT 0 AS kind, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
FROM s UNION ALL
SELECT 1, 'accuracy', round(sum(tp)::DOUBLE / sum(support), 9), round(sum(tp)::DOUBLE / sum(support), 9),
       round(sum(tp)::DOUBLE / sum(support), 9), sum(support)::BIGINT FROM s UNION ALL
SELECT 2, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT
FROM s UNION ALL
SELECT 3, 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       sum(support)::BIGINT FROM s""")
def classification_report(spark, d):
    return _rounded(metrics.classification_report(_predicted(spark, d)), "precision", "recall", "f1")


_PRICED = "(SELECT l_returnflag, l_extendedprice AS target, l_quantity * 1500.0 AS prediction FROM lineitem)"


def _priced(spark, d):
    return table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("target"),
        (F.col("l_quantity") * 1500.0).alias("prediction"),
    )


@query("regression_metrics", f"""
SELECT count(*) AS n, round(avg(abs(prediction - target)), 4) AS mae,
       round(sqrt(avg((prediction - target) ** 2)), 4) AS rmse,
       round(1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)), 6) AS r2 FROM {_PRICED}""")
def regression_metrics(spark, d):
    out = metrics.regression_metrics(_priced(spark, d))
    return out.select("n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("regression_metrics_rollup", f"""
SELECT coalesce(l_returnflag, 'OVERALL') AS l_returnflag, count(*) AS n,
       round(avg(abs(prediction - target)), 4) AS mae, round(sqrt(avg((prediction - target) ** 2)), 4) AS rmse,
       round(1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)), 6) AS r2
FROM {_PRICED} GROUP BY ROLLUP (l_returnflag)""")
def regression_metrics_rollup(spark, d):
    out = metrics.regression_metrics_by(_priced(spark, d), "l_returnflag")
    return out.select(
        "l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
        F.round("r2", 6).alias("r2"),
    )


# --- scaling and calibration ---------------------------------------------------


@query("scaler_fit", """
SELECT round(avg(ln(1 + l_extendedprice)), 9) AS target_mean,
       round(stddev_samp(ln(1 + l_extendedprice)), 9) AS target_std FROM lineitem""")
def scaler_fit(spark, d):
    out = regression.fit_scaler(table(spark, d, "lineitem"), "l_extendedprice")
    return _rounded(out, "target_mean", "target_std")


@query("scaler_apply_invert", """
SELECT l_orderkey, l_linenumber, round((ln(1 + l_extendedprice) - m) / s, 6) AS target_norm,
       round(l_extendedprice, 4) AS restored
FROM lineitem, (SELECT avg(ln(1 + l_extendedprice)) AS m, stddev_samp(ln(1 + l_extendedprice)) AS s FROM lineitem)""")
def scaler_apply_invert(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    scaler = regression.fit_scaler(items, "l_extendedprice")
    scaled = regression.apply_scaler(items, scaler, "l_extendedprice")
    out = regression.invert_scaler(scaled, scaler, "target_norm", "restored")
    return out.select(
        "l_orderkey", "l_linenumber", F.round("target_norm", 6).alias("target_norm"),
        F.round("restored", 4).alias("restored"),
    )


@query("calibration_fit", f"""
SELECT l_returnflag, round(regr_slope(target, prediction), 6) AS a, round(regr_intercept(target, prediction), 3) AS b,
       count(*) AS n FROM {_PRICED} GROUP BY l_returnflag""")
def calibration_fit(spark, d):
    out = regression.fit_calibration(_priced(spark, d), "l_returnflag")
    return out.select("l_returnflag", F.round("a", 6).alias("a"), F.round("b", 3).alias("b"), "n")


@query("calibration_apply", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS target, l_quantity * 1500.0 AS prediction
           FROM lineitem),
     c AS (SELECT l_returnflag, regr_slope(target, prediction) AS a, regr_intercept(target, prediction) AS b
           FROM p WHERE l_returnflag <> 'N' GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, round(coalesce(a * prediction + b, prediction), 3) AS calibrated
FROM p LEFT JOIN c USING (l_returnflag)""")
def calibration_apply(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("target"),
        (F.col("l_quantity") * 1500.0).alias("prediction"),
    )
    fitted = regression.fit_calibration(rows.filter("l_returnflag <> 'N'"), "l_returnflag")
    out = regression.apply_calibration(rows, fitted, "l_returnflag", "prediction")
    return out.select("l_orderkey", "l_linenumber", F.round("calibrated", 3).alias("calibrated"))
