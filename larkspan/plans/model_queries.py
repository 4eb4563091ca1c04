"""Queries that fit a model, choose among models and predict, with the whole computation in SQL as well."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.text import video_text
from ..operators import bayes, classify, clean, code_metrics, least_squares, metrics, ranking, regression, search, splits, synth
from ..session import scratch_path, staged
from ..sources import sinks, tables
from ..streaming import requests
from . import workflows
from .command_queries import _NAMES, _SPLIT_KEY, FIELDS_SQL, SQL_CODE, SQL_COMMANDS, TEMPLATES, _code_case, _commands, _snippets, sql_choose, sql_filler
from .profile_queries import sql_strip
from .registry import query, spread, table

# --- naive Bayes ------------------------------------------------------------------

# The weighted F1 and the accuracy of each smoothing over the validation rows of ``nb_pred``.
_BY_ACCURACY = "SELECT a, sum((label = truth)::INT)::DOUBLE / count(*) AS m FROM nb_pred WHERE split = 'val' GROUP BY a"
_BY_F1 = """SELECT a, sum(f1 * support) / sum(support) AS m FROM (
  SELECT a, class, sum(t) AS support, CASE WHEN sum(t) + sum(p) = 0 THEN 0.0 ELSE 2 * sum(h)::DOUBLE / (sum(t) + sum(p)) END AS f1 FROM (
    SELECT a, truth AS class, 1 AS t, 0 AS p, (label = truth)::INT AS h FROM nb_pred WHERE split = 'val'
    UNION ALL SELECT a, label, 0, 1, 0 FROM nb_pred WHERE split = 'val') GROUP BY a, class) GROUP BY a"""
_BY_BALANCE = """SELECT a, avg(r) AS m FROM (
  SELECT a, truth, sum((label = truth)::INT)::DOUBLE / count(*) AS r FROM nb_pred WHERE split = 'val' GROUP BY a, truth) GROUP BY a"""


def sql_bayes(keys: str, best: str = _BY_ACCURACY, smoothing=bayes.SMOOTHING, asked: str | None = None) -> str:
    """Common table expressions from ``nb_rows`` (keys, split, label, text) to ``nb`` (keys, truth, label, confidence).

    ``nb`` has the rows of the split ``test``, or those of ``asked``, with the smoothing that is best.
    """
    listed = ", ".join(f"{a}::DOUBLE" for a in smoothing)
    read = "nb_rows WHERE split <> 'train'" if asked is None else f"(SELECT * FROM nb_rows WHERE split = 'val' UNION ALL {asked})"
    same = " AND ".join(f"x.{k} = s.{k}" for k in map(str.strip, keys.split(",")))
    return rf"""
nb_read AS MATERIALIZED (SELECT {keys}, split, label, text FROM {read}),
nb_a AS (SELECT unnest([{listed}]) AS a, unnest(range({len(smoothing)})) AS nr),
nb_count AS MATERIALIZED (SELECT label, token, count(*) AS n FROM (SELECT label, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token
             FROM nb_rows WHERE split = 'train') GROUP BY ALL),
nb_docs AS (SELECT label, count(*) AS docs, sum(count(*)) OVER () AS total FROM nb_rows WHERE split = 'train' GROUP BY label),
nb_class AS (SELECT a, label, round(ln(docs / total) * 1000000)::BIGINT AS prior,
                    round(ln(a / (coalesce(n, 0) + a * v)) * 1000000)::BIGINT AS base
             FROM nb_docs LEFT JOIN (SELECT label, sum(n) AS n FROM nb_count GROUP BY label) USING (label),
                  (SELECT count(DISTINCT token) AS v FROM nb_count), nb_a),
nb_word AS (SELECT {keys}, split, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM nb_read),
nb_known AS (SELECT {keys}, split, count(*) AS t FROM nb_word WHERE token IN (SELECT token FROM nb_count) GROUP BY ALL),
nb_gain AS (SELECT {", ".join("x." + k.strip() for k in keys.split(","))}, x.split, a, c.label, sum(round(ln((n + a) / a) * 1000000)::BIGINT) AS s
            FROM nb_word x JOIN nb_count c USING (token), nb_a GROUP BY ALL),
nb_score AS (SELECT {", ".join("x." + k.strip() for k in keys.split(","))}, x.split, x.label AS truth, c.a, c.label,
                    (c.prior + coalesce(s.t, 0) * c.base + coalesce(g.s, 0))::BIGINT AS score
             FROM nb_read x CROSS JOIN nb_class c LEFT JOIN nb_known s ON {same} AND x.split = s.split
                  LEFT JOIN nb_gain g ON {same.replace("s.", "g.")} AND x.split = g.split AND g.a = c.a AND g.label = c.label),
nb_pred AS (SELECT {keys}, split, truth, a, label, 1 / total AS confidence FROM (
              SELECT *, sum(exp((score - top) / 1000000.0::DOUBLE)) OVER (PARTITION BY {keys}, split, a) AS total,
                     row_number() OVER (PARTITION BY {keys}, split, a ORDER BY score DESC, label) AS place
              FROM (SELECT *, max(score) OVER (PARTITION BY {keys}, split, a) AS top FROM nb_score)) WHERE place = 1),
nb_best AS (SELECT a FROM ({best}) JOIN nb_a USING (a) ORDER BY m DESC, nr LIMIT 1),
nb AS (SELECT {keys}, truth, label, confidence FROM nb_pred JOIN nb_best USING (a) WHERE split = 'test')"""


_HELD = [f"src{i}" for i in range(8)]
_TAGGED = "'[TITLE] ' || {} || ' [CHANNEL] ' || {} || ' [DESC] ' || {}"
SQL_VIDEOS = f"""
nb_rows AS (SELECT doc_id, label, {_TAGGED.format(sql_strip("coalesce(lang, '')"), sql_strip("coalesce(source, '')"), sql_strip("text"))} AS text,
                   CASE WHEN source IN {tuple(_HELD[:4])} THEN 'val' WHEN source IN {tuple(_HELD[4:])} THEN 'test' ELSE 'train' END AS split
            FROM (SELECT doc_id, quality::VARCHAR AS label, text, lang, source FROM labels JOIN documents USING (doc_id)
                  WHERE {sql_strip("coalesce(text, '')")} <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
            WHERE label IS NOT NULL)"""


def _labelled_videos(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    rows = ranking.dedupe_first(clean.drop_blank(rows, ["text"]), ["text"], [F.col("doc_id")])
    rows = rows.withColumn("text", video_text("lang", "source", "text", None))
    return staged(splits.holdout_split(rows, "source", _HELD[:4], _HELD[4:]), "videos")


def _video_model(spark, d, metric="accuracy"):
    rows = _labelled_videos(spark, d)
    return rows, bayes.fit_bayes(rows.filter("split = 'train'"), rows.filter("split = 'val'"), metric=metric)


def _video_scores(spark, d, metric="accuracy"):
    rows, model = _video_model(spark, d, metric)
    return classify.predict_video(rows.filter("split = 'test'"), model, keys=["doc_id"])


_NAMED = "CASE label WHEN '0' THEN 'entertainment' WHEN '1' THEN 'coding' ELSE label END"


@query("video_classifier_eval", f"""
WITH {SQL_VIDEOS}, {sql_bayes("doc_id")},
c AS (SELECT label, sum(truth) AS support, sum(predicted) AS predicted, sum(tp) AS tp
      FROM (SELECT truth AS label, 1 AS truth, 0 AS predicted, (truth = label)::INT AS tp FROM nb
            UNION ALL SELECT label, 0, 1, 0 FROM nb) GROUP BY label),
s AS (SELECT {_NAMED} AS class, support::BIGINT AS support, tp,
             CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
             CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (predicted + support) END AS f1 FROM c)
SELECT 0 AS kind, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM s
UNION ALL SELECT 1, 'accuracy', round(sum(tp)::DOUBLE / sum(support), 9), round(sum(tp)::DOUBLE / sum(support), 9),
                 round(sum(tp)::DOUBLE / sum(support), 9), sum(support)::BIGINT FROM s
UNION ALL SELECT 2, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM s
UNION ALL SELECT 3, 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
                 round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM s""")
def video_classifier_eval(spark, d):
    """Train on some sources, choose on others, report on sources never seen."""
    out = metrics.classification_report(_video_scores(spark, d), names=classify.VIDEO_LABELS)
    return out.select("kind", "class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("video_predictions", f"""
WITH {SQL_VIDEOS}, {sql_bayes("doc_id")}
SELECT doc_id, truth::INT AS label, label::INT AS prediction, {_NAMED} AS label_name, round(confidence, 6) AS confidence, truth = label AS correct FROM nb""")
def video_predictions(spark, d):
    return clean.with_correct(_video_scores(spark, d)).select(
        "doc_id", F.col("label").cast("int").alias("label"), "prediction", "label_name", F.round("confidence", 6).alias("confidence"), "correct"
    )


def _recall_sums(labels, predictions):
    """Rows and right rows of the two classes."""
    rows = [pc.equal(labels, c) for c in ("0", "1")]
    count = lambda m: pc.sum(pc.fill_null(m, False)).as_py() or 0
    return [x for c, m in zip(("0", "1"), rows) for x in (count(m), count(pc.and_(m, pc.equal(predictions, c))))]


BALANCED = metrics.UserMetric(_recall_sums, lambda s: (s[1] / max(s[0], 1) + s[3] / max(s[2], 1)) / ((s[0] > 0) + (s[2] > 0)))


@query("video_model_by_metric", f"""
WITH {SQL_VIDEOS}, {sql_bayes("doc_id", _BY_BALANCE, (0.01, 1.0, 4.0))}
SELECT (SELECT a FROM nb_best) AS smoothing, round((SELECT max(m) FROM ({_BY_BALANCE})), 9) AS score, count(*) AS rows,
       count(*) FILTER (truth = label) AS correct FROM nb""")
def video_model_by_metric(spark, d):
    """The smoothing is chosen by a caller's metric: the mean of both classes' recalls."""
    rows = _labelled_videos(spark, d)
    model = bayes.fit_bayes(rows.filter("split = 'train'"), rows.filter("split = 'val'"), metric=BALANCED, smoothing=(0.01, 1.0, 4.0))
    scored = classify.predict_video(rows.filter("split = 'test'"), model, keys=["doc_id"])
    right = metrics.accuracy(scored).select(F.col("total").alias("rows"), "correct")
    return right.select(F.lit(model.smoothing).alias("smoothing"), F.round(F.lit(model.score), 9).alias("score"), "rows", "correct")


# --- commands ----------------------------------------------------------------------

_INTENTS = {"open {x}": "open_app", "find {x}": "search_file", "please show me {x}": "open_app", "where is {x}": "search_file"}


def _intent_rows(spark, d):
    """Noisy commands over the parts, labelled by the verb of their template."""
    intents = F.create_map(*[F.lit(x) for pair in _INTENTS.items() for x in pair])
    rows = _commands(spark, d).withColumn("intent", F.element_at(intents, F.col("template")))
    return rows.select("p_partkey", "variant", "text", "intent")


_INTENT_CASE = "CASE " + sql_choose(TEMPLATES, "'template'", "'42'", "p_partkey::VARCHAR") + " " + " ".join(f"WHEN '{t}' THEN '{i}'" for t, i in _INTENTS.items()) + " END"
SQL_INTENTS = f"""{SQL_COMMANDS},
iu AS (SELECT p_partkey, variant, text, {_INTENT_CASE} AS label FROM noisy
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY p_partkey, variant) = 1),
ik AS (SELECT least(max(n), greatest(3 * min(n), 300)) AS cap FROM (SELECT count(*) AS n FROM iu GROUP BY label)),
ib AS (SELECT p_partkey, variant, text, label FROM iu, ik
       QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_SPLIT_KEY}) <= cap),
nb_rows AS MATERIALIZED (SELECT p_partkey, variant, text, label, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
            WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
            FROM (SELECT *, row_number() OVER (ORDER BY {_SPLIT_KEY}) AS rn, count(*) OVER () AS n FROM ib)),
{sql_bayes("p_partkey, variant", _BY_F1)},
gated AS (SELECT p_partkey, variant, truth, CASE WHEN confidence >= 0.6 THEN nb.label ELSE 'unknown' END AS intent, confidence,
                 {sql_filler("text")} AS s FROM nb JOIN nb_rows USING (p_partkey, variant))"""
_ENTITIES = f"""CASE WHEN intent = 'open_app' AND ({FIELDS_SQL["open_app"]["app"]}) IS NOT NULL
       THEN '{{"app":' || to_json({FIELDS_SQL["open_app"]["app"]}) || '}}' ELSE '{{}}' END"""
_INFERRED = f"""
WITH {SQL_INTENTS}
SELECT p_partkey, variant, truth, intent, round(confidence, 6) AS confidence, {_ENTITIES} AS entities FROM gated"""


def _commands_model(spark, d):
    rows = staged(synth.balance_and_split(_intent_rows(spark, d), ["p_partkey", "variant"]), "commands")
    return rows.filter("split = 'test'"), bayes.fit_bayes(rows.filter("split = 'train'"), rows.filter("split = 'val'"), label="intent", metric="f1")


@query("intent_inference", _INFERRED)
def intent_inference(spark, d):
    """Synthesized commands to a trained model, then gate and entities on the test split."""
    from ..operators.entities import extract_entities

    keys = ["p_partkey", "variant"]
    rows, model = _commands_model(spark, d)
    scored = classify.predict_text(rows, model, keys=keys)
    named = scored.withColumnRenamed("intent", "truth").withColumnRenamed("predicted", "intent")
    gated = extract_entities(clean.confidence_gate(named))
    return gated.select(*keys, "truth", "intent", F.round("confidence", 6).alias("confidence"), F.to_json("entities").alias("entities"))


@query("run_intent_pipeline", _INFERRED)
def run_intent_pipeline(spark, d):
    """Intent, confidence and entities of the held-out commands, by the workflow."""
    rows, model = _commands_model(spark, d)
    found = workflows.run_intent_pipeline(rows.withColumnRenamed("intent", "truth"), model)
    return found.select("p_partkey", "variant", "truth", "intent", F.round("confidence", 6).alias("confidence"), F.to_json("entities").alias("entities"))


@query("reality_check", f"""
WITH {SQL_INTENTS},
c AS (SELECT class, sum(t) AS support, sum(p) AS predicted, sum(h) AS tp
      FROM (SELECT truth AS class, 1 AS t, 0 AS p, (truth = label)::INT AS h FROM nb UNION ALL SELECT label, 0, 1, 0 FROM nb) GROUP BY class),
s AS (SELECT class, support, tp, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
             CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (predicted + support) END AS f1 FROM c)
SELECT 'rows' AS part, truth || ' as ' || label AS key, count(*)::DOUBLE AS value FROM nb GROUP BY truth, label
UNION ALL SELECT 'correct', truth, count(*) FILTER (truth = label) FROM nb GROUP BY truth
UNION ALL SELECT 'accuracy', 'all', round(count(*) FILTER (truth = label) / count(*), 9) FROM nb
UNION ALL SELECT 'precision', class, round(precision, 9) FROM s
UNION ALL SELECT 'recall', class, round(recall, 9) FROM s
UNION ALL SELECT 'f1', class, round(f1, 9) FROM s
UNION ALL SELECT 'f1', 'macro avg', round(avg(f1), 9) FROM s
UNION ALL SELECT 'f1', 'weighted avg', round(sum(f1 * support) / sum(support), 9) FROM s
UNION ALL SELECT 'low_confidence', 'all', count(*) FILTER (round(confidence, 9) < 0.7) FROM nb""")
def reality_check(spark, d):
    """All four tables of the check of the held-out commands as (part, key, value) rows."""
    rows, model = _commands_model(spark, d)
    found = workflows.reality_check(rows, model)
    checked = staged(found["rows"], "checked")

    def part(name, df, key, value):
        return df.select(F.lit(name).alias("part"), key.alias("key"), value.cast("double").alias("value"))

    pairs = checked.groupBy("intent", "prediction").agg(F.count(F.lit(1)).alias("n"))
    right = checked.groupBy("intent").agg(F.count_if("correct").alias("n"))
    report = staged(found["report"], "report")
    single = report.filter("kind = 0")
    out = part("rows", pairs, F.concat_ws(" as ", "intent", "prediction"), F.col("n"))
    out = out.unionByName(part("correct", right, F.col("intent"), F.col("n")))
    out = out.unionByName(part("accuracy", found["accuracy"], F.lit("all"), F.round("accuracy", 9)))
    for c in ("precision", "recall", "f1"):
        out = out.unionByName(part(c, single, F.col("class"), F.round(c, 9)))
    out = out.unionByName(part("f1", report.filter("kind > 1"), F.col("class"), F.round("f1", 9)))
    return out.unionByName(part("low_confidence", found["low_confidence"].agg(F.count(F.lit(1)).alias("n")), F.lit("all"), F.col("n")))


# --- classification requests -------------------------------------------------------


@query("stream_classification", f"""
WITH {SQL_VIDEOS.replace("nb_rows AS", "nb_docs_in AS")},
nb_rows AS (SELECT doc_id::VARCHAR AS id, split, label, text FROM nb_docs_in),
{sql_bayes("id", asked=f'''SELECT conv_id || ':' || turn AS id, 'test' AS split, '' AS label,
  {_TAGGED.format(sql_strip("coalesce(role, '')"), "''", sql_strip("coalesce(text, '')"))} AS text FROM conversations''')}
SELECT id, label::INT AS label, {_NAMED} AS label_name, round(confidence, 6) AS confidence FROM nb""")
def stream_classification(spark, d):
    """Turns as classification requests answered by the trained video model."""
    _, model = _video_model(spark, d)
    source = f"{d.rstrip('/')}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    lines = turns.select(F.to_json(F.struct(
        key.alias("id"), F.col("role").alias("title"), F.col("text").alias("description")
    )).alias("value"))
    out = scratch_path(spark, "labels")
    run = requests.serve_classification(lines, model, out, scratch_path(spark, "labels-state"), once=True)
    run.awaitTermination()
    answers = spark.read.parquet(out).select(F.from_json("response", "id STRING, label INT, label_name STRING, confidence DOUBLE").alias("r"))
    return answers.select("r.id", "r.label", "r.label_name", F.round("r.confidence", 6).alias("confidence"))


# --- complexity --------------------------------------------------------------------


def code_size():
    """A vector of one component for a snippet: the logarithm of its length."""
    return lambda texts: np.log1p(np.array([[len(t)] for t in texts], dtype="float64")).reshape(len(texts), 1)


# Per language: the line through (x, z) with one slope for all, the least absolute error on the validation rows.
SQL_COMPLEXITY = f"""{SQL_CODE},
lab AS (SELECT l_orderkey, l_linenumber, language, cyclomatic_complexity, ln(1 + length(code) - CASE language WHEN 'php' THEN 6 ELSE 0 END)::FLOAT::DOUBLE AS x
        FROM measured WHERE n_functions = 1),
sc AS (SELECT avg(ln(1 + cyclomatic_complexity::DOUBLE)) AS mean, stddev_samp(ln(1 + cyclomatic_complexity::DOUBLE)) AS std FROM lab),
z AS (SELECT l_orderkey, l_linenumber, language, x, (ln(1 + cyclomatic_complexity::DOUBLE) - mean) / std AS y,
             rank() OVER (ORDER BY md5('42|' || l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR)) <= floor(count(*) OVER () * 0.1::DOUBLE) AS val
      FROM lab, sc),
mo AS (SELECT language, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy
       FROM z WHERE NOT val GROUP BY language),
sl AS (SELECT p, nr, sum(sxy) / (sum(sxx) + sum(n) * p) AS slope
       FROM mo, (SELECT unnest([0.0::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE]) AS p, unnest([1, 2, 3]) AS nr) GROUP BY p, nr),
pr AS (SELECT z.*, sl.p, sl.nr, slope * x + my - slope * mx AS pred FROM z JOIN mo USING (language), sl),
bp AS (SELECT p FROM pr WHERE val GROUP BY p, nr ORDER BY avg(abs(pred - y)), nr LIMIT 1),
fit AS (SELECT pr.* FROM pr JOIN bp USING (p)),
cal AS (SELECT language, regr_slope(y, pred) AS a, regr_intercept(y, pred) AS b FROM fit WHERE NOT val GROUP BY language)"""


def _complexity_model(spark, d):
    """Labelled code with vectors from a written cache, the scaler, both parts, the model and the calibration."""
    rows = code_metrics.label_code(
        _snippets(spark, d).withColumn("original_string", F.lit(None).cast("string")), ["l_orderkey", "l_linenumber"])
    features = search.embed(rows, "code", make_embed=code_size).withColumn("code", F.lit(None).cast("string"))
    cached = tables.read_parquet(spark, sinks.write_parquet(features, scratch_path(spark, "code-features")))
    scaler = staged(regression.fit_scaler(cached, "cyclomatic_complexity"), "scaler")
    parts = splits.validation_split(regression.apply_scaler(cached, scaler, "cyclomatic_complexity"), ["l_orderkey", "l_linenumber"])
    train, val = parts.filter("split = 'train'"), parts.filter("split = 'val'")
    model = least_squares.fit_least_squares(train, val)
    fitted = staged(regression.fit_calibration(classify.predict_normalized(train, model), "language", target="target_norm"), "calibration")
    return scaler, val, model, fitted


@query("complexity_evaluation", f"""
WITH {SQL_COMPLEXITY},
e AS (SELECT language, a * pred + b AS pred, y FROM fit JOIN cal USING (language) WHERE val)
SELECT coalesce(language, 'OVERALL') AS language, count(*) AS n, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) ** 2)), 6) AS rmse,
       round(CASE WHEN min(y) = max(y) THEN 'nan'::DOUBLE ELSE 1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)) END, 6) AS r2
FROM e GROUP BY ROLLUP (language)""")
def complexity_evaluation(spark, d):
    """Label code, embed, scale, fit, calibrate on train, evaluate per language on validation."""
    _, val, model, fitted = _complexity_model(spark, d)
    scored = regression.apply_calibration(classify.predict_normalized(val, model), fitted, "language", "prediction")
    out = metrics.regression_metrics_by(scored, "language", "calibrated", "target_norm")
    return out.select("language", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query("predict_complexity", f"""
WITH {SQL_COMPLEXITY},
asked AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 6 THEN 'cobol' ELSE {_NAMES} END AS language,
                 ln(1 + length({_code_case("sql")}))::FLOAT::DOUBLE AS x FROM lineitem),
p AS (SELECT asked.*, slope * x + my - slope * mx AS pred, a, b, mean, std
      FROM asked LEFT JOIN mo USING (language) LEFT JOIN cal USING (language), sc, (SELECT slope FROM sl JOIN bp USING (p)))
SELECT l_orderkey, l_linenumber, language, round(exp(pred * std + mean) - 1, 2) AS raw_complexity,
       round(exp((a * pred + b) * std + mean) - 1, 2) AS calibrated_complexity,
       CASE WHEN language = 'cobol' THEN 'Unknown language ''cobol''' END AS error
FROM p""")
def predict_complexity(spark, d):
    """The fitted model on all snippets, some of them in a language it does not know."""
    scaler, _, model, fitted = _complexity_model(spark, d)
    rows = spread(table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 7 == 6, "COBOL").otherwise(F.expr(_NAMES)).alias("language"),
        F.expr(_code_case("spark")).alias("code"))
    found = workflows.predict_complexity(rows, model, scaler, fitted, make_embed=code_size)
    return found.drop("code").withColumn("language", F.lower("language"))
