"""Multinomial naive Bayes from counts that one aggregate makes.

The model is two tables: what is known of each class, and how often each of its tokens
occurs. Labels get their numbers by a join, so there may be any number of them.
Logarithms are kept as whole millionths: their sums do not depend on the order of the rows, and
a text gets the same scores wherever and however often it is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, tokens
from ..session import staged
from .lookup import MAX_LOOKUP_BYTES, MAX_LOOKUP_ROWS, lookup_join
from .metrics import UserMetric, user_metric, weighted_metrics
from .ranking import label_index

UNIT = 1_000_000
SMOOTHING = (0.1, 1.0)
#: Classes whose scores of a token lie in one row.
BLOCK = 32
#: Levels of frequency per doubling.
LEVELS = 8


@dataclass
class BayesModel:
    """``classes``: ``label_id, label, docs, n, all_docs, vocabulary``; ``counts``: ``token, label_id, n``; both written tables."""

    classes: DataFrame
    counts: DataFrame
    width: int
    smoothing: float = SMOOTHING[0]
    score: float = 0.0

    def class_blocks(self) -> DataFrame:
        """``block`` and its classes in order, each with its prior and the weight of a token that it never holds."""
        a = F.lit(self.smoothing)
        prior = _millionths(F.log(F.col("docs") / F.col("all_docs")))
        base = _millionths(F.log(a / (F.col("n") + a * F.col("vocabulary"))))
        entry = F.struct("label_id", "label", prior.alias("prior"), base.alias("base"))
        return self.classes.groupBy(F.expr(f"label_id div {BLOCK}").cast("int").alias("_block")).agg(F.array_sort(F.collect_list(entry)).alias("_classes"))


def _millionths(c: Column) -> Column:
    return F.round(c * UNIT).cast("long")


def fit_bayes(
    train: DataFrame, validation: DataFrame, text: str = "text", label: str = "label",
    metric: str | UserMetric = "accuracy", smoothing: Sequence[float] = SMOOTHING,
) -> BayesModel:
    """Count once, then choose the smoothing that scores best on the validation rows, the first of equals.

    ``metric`` is ``accuracy``, ``f1`` (support-weighted) or a caller's. Rows with a
    blank text or without a label are left out. Without training rows nothing is predicted.
    """
    usable = lambda df: df.filter(~is_blank(text) & F.col(label).isNotNull())
    rows = usable(train).select(F.col(label).cast("string").alias("label"), tokens(text).alias("_tokens"))
    counts = staged(rows.select("label", F.explode("_tokens").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    docs = staged(rows.groupBy("label").agg(F.count(F.lit(1)).alias("docs")), "label-docs")
    ids = label_index([docs], "label").select("label", "label_id")
    totals = counts.groupBy("label").agg(F.sum("n").alias("n"))
    vocabulary = counts.agg(F.count_distinct("token")).scalar()
    classes = docs.join(ids, "label").join(totals, "label", "left").select(
        "label_id", "label", "docs", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        docs.agg(F.sum("docs")).scalar().alias("all_docs"), vocabulary.alias("vocabulary"))
    classes = staged(classes, "classes")
    numbered = staged(lookup_join(counts, classes.select("label", "label_id"), ["label"], "inner").select("token", "label_id", "n"), "numbered-counts")
    width = min(BLOCK, max(1, classes.count()))
    models = [BayesModel(classes, numbered, width, float(a)) for a in smoothing]
    if len(models) == 1:
        return models[0]
    checked = usable(validation).select(F.col(label).cast("string").alias("_truth"), F.col(text).alias("_text"))
    checked = checked.withColumn("_row", F.monotonically_increasing_id())
    gained = staged(_gains(checked, numbered, width, [m.smoothing for m in models], "_text", ["_row", "_truth"]), "gains")
    best: BayesModel | None = None
    for i, model in enumerate(models):
        scored = _ranked(gained, model, ["_row", "_truth"], i).select("_truth", "predicted")
        if isinstance(metric, UserMetric):
            found = user_metric(scored, metric, "_truth", "predicted")
        else:
            found = weighted_metrics(scored, "_truth", "predicted").first()[metric]
        model.score = found if found is not None else 0.0
        if best is None or model.score > best.score:
            best = model
    return best


def _weights(counts: DataFrame, width: int, smoothing: Sequence[float]) -> DataFrame:
    """``_token``, ``_block``, how frequent the token is and what each class of the block gains by it, one column each for every smoothing."""
    gains = [_millionths(F.log((F.col("n") + F.lit(a)) / F.lit(a))).alias(f"_g{j}") for j, a in enumerate(smoothing)]
    total = F.sum("n").over(Window.partitionBy("token"))
    found = counts.withColumn("_level", F.floor(F.log2(total) * LEVELS).cast("int")).select("token", "label_id", "_level", *gains)
    own = F.expr(f"label_id div {BLOCK}").cast("int")
    # every known token has a row in the first block, where the known tokens of a text are counted
    found = found.withColumn("_block", F.explode(F.array_distinct(F.array(F.lit(0), own))))
    here = lambda i: (own == F.col("_block")) & (F.col("label_id") % BLOCK == i)
    sums = [F.coalesce(F.sum(F.when(here(i), F.col(f"_g{j}"))), F.lit(0)).alias(f"_w{j}_{i}") for j in range(len(smoothing)) for i in range(width)]
    return found.groupBy(F.col("token").alias("_token"), "_block").agg(F.max("_level").alias("_level"), *sums)


def _last_rare(weights: DataFrame) -> int:
    """The level up to which tokens are rare; the rows of those above it may be broadcast. -1: no token is rare."""
    size = F.sum(F.octet_length("_token") + 8 * len(weights.columns))
    rows = held = 0
    for r in weights.groupBy("_level").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).orderBy(F.desc("_level")).collect():
        rows, held = rows + r["n"], held + r["bytes"]
        if rows > MAX_LOOKUP_ROWS or held > MAX_LOOKUP_BYTES:
            return r["_level"]
    return -1


def _gains(df: DataFrame, counts: DataFrame, width: int, smoothing: Sequence[float], text: str, keys: Sequence[str]) -> DataFrame:
    """For every row its ``keys``, its number of known tokens and, by block, what each class gains by them under each smoothing.

    Most words of a text are frequent ones. They get their weights where they are read and are added up there;
    only rare words, once per row, travel to theirs. The texts are read once.
    """
    weights = staged(_weights(counts, width, smoothing), "weights")
    last = _last_rare(weights)
    names = [f"_w{j}_{i}" for j in range(len(smoothing)) for i in range(width)]
    # no token is empty: the empty one stands for the row itself, which may have no known token
    words = F.concat(tokens(F.coalesce(F.col(text), F.lit(""))), F.array(F.lit("")))
    read = df.select(*keys, F.explode(words).alias("_token"))
    found = read.join(F.broadcast(weights.filter(F.col("_level") > last).drop("_level")), "_token", "left")
    rare = F.when(F.col("_block").isNull() & (F.col("_token") != ""), F.col("_token"))
    cells = found.groupBy(*keys, "_block", (rare if last >= 0 else F.lit(None).cast("string")).alias("_rare")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in names])
    if last >= 0:
        cells = staged(cells, "cells")
    sums = cells.filter(F.col("_rare").isNull()).select(
        *keys, F.coalesce("_block", F.lit(0)).alias("_block"), F.when(F.col("_block").isNull(), 0).otherwise(F.col("_n")).alias("_n"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    if last >= 0:
        seldom = cells.filter(F.col("_rare").isNotNull()).select(*keys, F.col("_rare").alias("_token"), "_n")
        seldom = seldom.join(weights.filter(F.col("_level") <= last).drop("_level"), "_token")
        sums = sums.unionByName(seldom.select(*keys, "_block", "_n", *[(F.col("_n") * F.col(c)).alias(c) for c in names]))
    sums = sums.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n"), F.array(*[F.sum(c) for c in names]).alias("_sums"))
    by_block = F.map_from_entries(F.collect_list(F.struct("_block", "_sums")))
    return sums.groupBy(*keys).agg(F.max(F.when(F.col("_block") == 0, F.col("_n"))).alias("_known"), by_block.alias("_by_block"))


def predict_bayes(df: DataFrame, model: BayesModel, text: str = "text", keys: Sequence[str] | None = None) -> DataFrame:
    """Attach ``predicted``, ``confidence`` and the probability of every class; equal scores go to the lesser label.

    ``keys`` name a row and have no nulls; without them the rows are written once and numbered.
    A text without known tokens gets the class prior; without classes all three are null.
    """
    columns = df.columns
    if keys is None:
        df = staged(df.withColumn("_row", F.monotonically_increasing_id()), "asked")
        keys = ["_row"]
    keys = list(keys)
    gained = _gains(df, model.counts, model.width, [model.smoothing], text, keys)
    return df.join(_ranked(gained, model, keys), keys, "left").select(*columns, "predicted", "confidence", "probs")


def _ranked(gained: DataFrame, model: BayesModel, keys: Sequence[str], number: int = 0) -> DataFrame:
    """``keys``, ``predicted``, ``confidence`` and ``probs`` by the gains under the smoothing of that number."""
    last = model.classes.agg(F.expr(f"max(label_id) div {BLOCK}").cast("int")).scalar()
    asked = gained.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
    asked = lookup_join(asked, model.class_blocks(), ["_block"], "inner")
    own = F.try_element_at("_by_block", F.col("_block"))

    def scored(c: Column, i: Column) -> Column:
        score = c["prior"] + F.col("_known") * c["base"] + F.coalesce(F.get(own, i + number * model.width), F.lit(0))
        return F.struct((-score).alias("loss"), c["label_id"].alias("label_id"), c["label"].alias("label"))

    ranked = F.array_sort(F.flatten(F.collect_list(F.transform("_classes", scored))))
    found = asked.groupBy(*keys).agg(ranked.alias("_ranked"))
    shares = F.transform("_ranked", lambda r: F.exp((F.col("_ranked")[0]["loss"] - r["loss"]) / UNIT))
    found = found.withColumn("_shares", shares).withColumn("_all", F.aggregate("_shares", F.lit(0.0), lambda x, y: x + y))
    names = F.transform("_ranked", lambda r: r["label"])
    return found.select(
        *keys, F.col("_ranked")[0]["label"].alias("predicted"), (1 / F.col("_all")).alias("confidence"),
        F.map_from_arrays(names, F.transform("_shares", lambda x: x / F.col("_all"))).alias("probs"))
