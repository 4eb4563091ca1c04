"""Labelled command sentences made from templates, value pools and noise.

Every choice is a hash of the seed and the draw's key, so a row is the same on
any cluster and no draw needs another one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import hash_fraction, hash_pick
from ..functions.text import fill_template, strip
from ..session import staged
from .ranking import SEED, balanced_sample, dedupe_first
from .splits import positional_split

# Spoken noise around a command.
FILLERS = (
    "", "please ", "hey ", "can you ", "could you ", "would you ", "quickly ", "kindly ", "so, ", "um, ",
    "uh, ", "actually, ", "okay, ", "ok, ", "yo ", "bro ", "pls ", "plz ",
)
TAILS = (
    "", "", "", " please", " now", " asap", " for me", " if possible", " when you can", " thanks", " ty",
    " right now", " real quick", " lol",
)
REASONS = (
    "because I need Gmail", "for today's assignment", "it's lagging", "I forgot where it is",
    "for the DBMS lab", "so I can browse", "for today's work", "before the meeting", "I need it urgently",
)
POLITE = ("please", "can you", "could you", "would you")
REASON_SHARE = 0.12
# Upper bounds of the ending and letter-case draws.
MARKS = ((0.20, "."), (0.30, "!"), (0.36, "!!"), (0.40, "..."), (0.44, "??"))
LOWER_BELOW, UPPER_BELOW, MIXED_BELOW = 0.30, 0.35, 0.38
# Bounds of the one draw shared by the three kinds of substitution.
SHORT_BELOW, TYPO_BELOW, MISHEARD_BELOW = 0.15, 0.30, 0.45
CONNECTORS = (" and ", " then ", " and then ", ", ", " before ", " after ", " followed by ")
NOISE_PER_DRAW = 3


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def choose(values: Column | Sequence[str], *key: Column) -> Column:
    """Reproducible element of an array column or of a literal list."""
    options = values if isinstance(values, Column) else _literals(values)
    return F.get(options, hash_pick(F.size(options), *key))


def add_noise(sentence: Column, key: Sequence[Column], reasons: bool | Column = True) -> Column:
    """Noisy variant of a sentence; ``key`` makes the draw."""
    low = F.lower(sentence)
    polite = low.rlike("|".join(POLITE))
    filler = F.when(polite, "").otherwise(choose(FILLERS, F.lit("filler"), *key))
    text = strip(F.concat(filler, sentence, choose(TAILS, F.lit("tail"), *key)))
    allowed = reasons if isinstance(reasons, Column) else F.lit(reasons)
    with_reason = allowed & (hash_fraction(F.lit("context"), *key) < REASON_SHARE)
    text = F.when(with_reason, F.concat(text, F.lit(" "), choose(REASONS, F.lit("reason"), *key))).otherwise(text)
    r = hash_fraction(F.lit("mark"), *key)
    mark = None
    for below, sign in MARKS:
        mark = F.when(r < below, sign) if mark is None else mark.when(r < below, sign)
    text = F.concat(text, mark.otherwise(""))
    c = hash_fraction(F.lit("case"), *key)
    mixed = F.array_join(F.transform(
        F.split(text, ""),
        lambda ch, i: F.when(hash_fraction(F.lit("letter"), i, *key) < 0.5, F.upper(ch)).otherwise(F.lower(ch)),
    ), "")
    cased = (
        F.when(c < LOWER_BELOW, F.lower(text)).when(c < UPPER_BELOW, F.upper(text))
        .when(c < MIXED_BELOW, mixed).otherwise(text)
    )
    return strip(cased)


def substituted(value: Column, key: Sequence[Column], short: dict, typo: dict, misheard: dict) -> Column:
    """Abbreviation, typo or misheard form of a value, or null; one shared draw."""
    r = hash_fraction(F.lit("substitute"), *key)

    def options(table: dict) -> Column:
        if not table:
            return F.lit(None).cast("array<string>")
        pairs = [x for v, forms in table.items() for x in (F.lit(v), _literals(forms))]
        return F.try_element_at(F.create_map(*pairs), value)

    out = None
    for below, table in ((SHORT_BELOW, short), (TYPO_BELOW, typo), (MISHEARD_BELOW, misheard)):
        forms = options(table)
        test = forms.isNotNull() & (r < below)
        pick = choose(forms, F.lit("form"), *key)
        out = F.when(test, pick) if out is None else out.when(test, pick)
    return out


def fill_draws(
    draws: DataFrame, key: str, templates: Column, value: Column, seed: int | str = SEED,
) -> DataFrame:
    """Pick a template per draw and fill in the draw's value."""
    k = [F.lit(str(seed)), F.col(key)]
    rows = draws.withColumn("slot", value)
    rows = rows.withColumn("template", choose(templates, F.lit("template"), *k))
    return rows.withColumn(
        "sentence", F.coalesce(fill_template("template", "slot"), F.col("template"))
    )


def noisy_variants(
    rows: DataFrame, key: str, n: int = NOISE_PER_DRAW, seed: int | str = SEED, reasons: bool = True,
    short: dict | None = None, typo: dict | None = None, misheard: dict | None = None,
) -> DataFrame:
    """``n`` noisy texts per sentence, plus one of a substituted value where drawn."""
    k = [F.lit(str(seed)), F.col(key)]
    alt = substituted(F.col("slot"), k, short or {}, typo or {}, misheard or {})
    alt_sentence = F.when(alt.isNotNull(), fill_template("template", alt))
    sources = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("variant"), F.col("sentence").alias("s"))),
        F.array(F.struct(F.lit(n + 1).alias("variant"), alt_sentence.alias("s"))),
    )
    each = rows.withColumn("_v", F.explode(F.filter(sources, lambda v: v["s"].isNotNull())))
    return each.withColumns({
        "variant": F.col("_v.variant"),
        "text": add_noise(F.col("_v.s"), [*k, F.col("_v.variant")], reasons),
    }).drop("_v")


def intent_draws(spark: SparkSession, plan: dict[str, int]) -> DataFrame:
    """``intent, draw`` with the wanted number of draws per intent."""
    rows = spark.createDataFrame([(i, n) for i, n in plan.items()], "intent STRING, n INT")
    return rows.filter("n > 0").select("intent", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("draw")).withColumn(
        "draw_id", F.concat_ws(":", "intent", F.col("draw").cast("string"))
    )


def _choices(table: dict[str, Sequence[str]], key: Column) -> Column:
    out = None
    for name, values in table.items():
        test = key == name
        out = F.when(test, _literals(values)) if out is None else out.when(test, _literals(values))
    return out


def generate_commands(
    spark: SparkSession, templates: dict[str, Sequence[str]], pools: dict[str, Sequence[str]], *,
    slot_draws: int = 150, plain_draws: int = 50, seed: int | str = SEED, **forms: dict,
) -> DataFrame:
    """``text, intent, slot`` for every template intent.

    Intents with a value pool get ``slot_draws`` draws, the others
    ``plain_draws``; each draw yields three noisy texts.
    """
    plan = {i: slot_draws if i in pools else plain_draws for i in templates}
    draws = intent_draws(spark, plan)
    options = _choices(templates, F.col("intent"))
    pool = _choices(pools, F.col("intent"))
    value = choose(pool, F.lit("value"), F.lit(str(seed)), F.col("draw_id")) if pool is not None else F.lit(None)
    filled = fill_draws(draws, "draw_id", options, value.cast("string"), seed)
    out = noisy_variants(filled, "draw_id", seed=seed, **forms)
    return out.select("draw_id", "variant", "text", "intent", F.coalesce("slot", F.lit("")).alias("slot"))


def single_noise(rows: DataFrame, key: str, seed: int | str = SEED, reasons: bool = False) -> DataFrame:
    """One noisy text per prepared ``sentence, intent, slot`` row (chat, ambiguous, compound)."""
    return rows.withColumn("text", add_noise(F.col("sentence"), [F.lit(str(seed)), F.col(key)], reasons))


def compound_commands(
    draws: DataFrame, key: str, first: Column, second: Column, slots: Sequence[Column], seed: int | str = SEED,
) -> DataFrame:
    """Two commands joined by a connector; the slot lists both values in text order."""
    joiner = choose(CONNECTORS, F.lit("connector"), F.lit(str(seed)), F.col(key))
    rows = draws.withColumns({
        "sentence": F.concat(first, joiner, second),
        "slot": F.concat_ws(";", *[F.nullif(s, F.lit("")) for s in slots]),
        "intent": F.lit("multi_intent"),
    })
    return single_noise(rows, key, seed)


def _draws(spark: SparkSession, kind: str, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.concat(F.lit(kind + ":"), F.col("id").cast("string")).alias("draw_id"))


def plain_chat(spark: SparkSession, sentences: Sequence[str], variants: int = 6, seed: int | str = SEED) -> DataFrame:
    """Chat sentences without any target, each in several noisy forms."""
    rows = spark.createDataFrame([(f"chat:{i}", s) for i, s in enumerate(sentences)], "draw_id STRING, sentence STRING")
    rows = rows.withColumns({
        "template": F.col("sentence"), "slot": F.lit(None).cast("string"), "intent": F.lit("general_chat"),
    })
    out = noisy_variants(rows, "draw_id", variants, seed, reasons=False)
    return out.select("draw_id", "variant", "text", "intent", F.lit("").alias("slot"))


def chat_about(
    spark: SparkSession, templates: Sequence[str], values: Sequence[str], n: int = 600, seed: int | str = SEED,
) -> DataFrame:
    """Sentences that mention a target but ask for nothing."""
    value = choose(values, F.lit("value"), F.lit(str(seed)), F.col("draw_id"))
    rows = fill_draws(_draws(spark, "about", n), "draw_id", _literals(templates), value, seed)
    rows = rows.withColumns({"slot": F.lit(""), "intent": F.lit("general_chat")})
    return single_noise(rows, "draw_id", seed).select(
        "draw_id", F.lit(1).alias("variant"), "text", "intent", "slot"
    )


def ambiguous_commands(
    spark: SparkSession, shapes: Sequence[tuple[str, str, Sequence[str]]], n: int = 500, seed: int | str = SEED,
) -> DataFrame:
    """Draws over all (template, intent, value) of shapes that share their wording."""
    pairs = [(t, i, v) for t, i, values in shapes for v in values]
    listed = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(v).alias("v")) for t, i, v in pairs
    ])
    rows = _draws(spark, "ambiguous", n).withColumn(
        "_p", choose(listed, F.lit("pair"), F.lit(str(seed)), F.col("draw_id"))
    )
    rows = rows.select(
        "draw_id", fill_template("_p.t", "_p.v").alias("sentence"), F.col("_p.i").alias("intent"),
        F.col("_p.v").alias("slot"),
    )
    return single_noise(rows, "draw_id", seed, reasons=True).select(
        "draw_id", F.lit(1).alias("variant"), "text", "intent", "slot"
    )


def two_step_commands(
    spark: SparkSession, shapes: Sequence[tuple[str, Sequence[str], str, Sequence[str]]], n: int = 500,
    seed: int | str = SEED,
) -> DataFrame:
    """Two templates with a value pool each; an empty pool means a fixed command."""
    key = [F.lit(str(seed)), F.col("draw_id")]
    pick = hash_pick(len(shapes), F.lit("shape"), *key)

    def side(at: int, tag: str) -> tuple[Column, Column]:
        values = F.array(*[F.array(*[F.lit(v) for v in s[at + 1]]).cast("array<string>") for s in shapes])
        value = choose(F.get(values, F.col("_shape")), F.lit(tag), *key)
        template = F.get(_literals([s[at] for s in shapes]), F.col("_shape"))
        return F.coalesce(fill_template(template, value), template), value

    rows = _draws(spark, "two", n).withColumn("_shape", pick)
    (first, a), (second, b) = side(0, "first"), side(2, "second")
    out = compound_commands(rows, "draw_id", first, second, [a, b], seed)
    return out.select("draw_id", F.lit(1).alias("variant"), "text", "intent", "slot")


def slot_values(df: DataFrame, slot: str = "slot") -> DataFrame:
    """Inverse of the slot list: one row per value with its place."""
    return df.withColumn("_s", F.nullif(slot, F.lit(""))).select(
        *df.columns, F.posexplode(F.split("_s", ";")).alias("slot_no", "slot_value")
    )


def balance_and_split(
    df: DataFrame, keys: Sequence[str], text: str = "text", intent: str = "intent", seed: int | str = SEED,
) -> DataFrame:
    """Distinct texts, classes capped, then an 80/10/10 split.

    The distinct rows are read several times, for counts, cuts and the result,
    so they are staged once.
    """
    unique = staged(dedupe_first(df, [text], [F.col(k) for k in keys]), "unique")
    return positional_split(balanced_sample(unique, intent, keys, seed), keys, seed=seed)
