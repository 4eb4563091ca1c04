"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A normalised text is cut where its own characters say so; equal passages give
equal chunks wherever they stand, but for their ends. Distinct chunks are compared once to find
hashes that stand for more than one chunk; a chunk's identifier is its hash and,
for such a hash, its number among the chunks of that hash, so equal identifiers
mean equal chunks. A text's recipe is the ordered list of its identifiers, and
two texts are equal if their recipes are: long texts never meet, they travel
once as distinct chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import checked, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


#: ASCII characters with odd codes. A chunk ends behind nine characters that are odd (1) or not (0) in this
#: order, in prose about every 640 characters; the rule looks at these nine only, wherever they stand.
ODD = "!#%')+\\-/13579;=?ACEGIKMOQSUWY\\[\\]_acegikmoqsuwy{}"
ENDING = "010011011"


def chunks(text: Column, least: int = 64, most: int = 8192) -> Column:
    """The chunks of a text, of ``least`` to ``most`` characters but for the last one."""
    ending = "".join(f"[{ODD}]" if c == "1" else f"[^{ODD}]" for c in ENDING)
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?(?<={ending})|.{{1,{most}}}"), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null and empty texts are equal. Of equal texts the row with the largest id
    stays (a null id is smaller than any other); of repeated rows with that id
    exactly one stays. Other columns are not read. ``hash_bits`` below 64 makes
    hashes collide, for tests.
    """
    place = 64 - hash_bits

    def mark(chunk: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(chunk), place) if place else F.xxhash64(chunk)

    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    cut = rows.select("id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    recipes = staged(cut.select("id", "text_sha256", F.monotonically_increasing_id().alias("row"), F.transform("chunks", mark).alias("recipe")), "recipes")

    distinct = cut.select(F.explode("chunks").alias("chunk")).select(mark(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    # a hash with one chunk needs no number; the others, if any, are numbered
    several = staged(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first")).where("n > 1").select("h"), "several")
    ids = F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("number")))
    if several.isEmpty():
        listed = recipes.withColumn("ids", F.col("recipe"))
    else:
        number = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
        numbered = staged(distinct.join(several, "h", "left_semi").select("h", "chunk", number.alias("number")), "numbered")
        places = cut.select("text_sha256", F.posexplode("chunks").alias("place", "chunk")).select("text_sha256", "place", "chunk", mark(F.col("chunk")).alias("h"))
        places = places.join(numbered, ["h", "chunk"]).select("text_sha256", "place", "number").distinct()
        mended = places.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("place", "number"))).alias("numbers"))
        ids = F.transform("recipe", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.try_element_at("numbers", i), F.lit(0)).alias("number")))
        listed = staged(recipes.join(mended, "text_sha256", "left").withColumn("ids", ids).drop("numbers"), "listed")

    last = F.max(F.struct("id", "row")).alias("last")
    groups = staged(listed.groupBy("ids").agg(last, F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    out = listed.join(groups, "ids", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("last").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns unchanged."""
    found = staged(exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "text_sha256", "kept"), "exact")
    gone_id, gone_sha = unused(docs.columns, "gone_id", "gone_sha")
    named = F.col("id").alias(gone_id), F.col("text_sha256").alias(gone_sha)
    gone = staged(found.where("not kept").select(*named).distinct(), "gone")
    # rows whose id and text are repeated: one of them may stay
    again = staged(found.groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays")).where("n > 1 and stays").select(*named), "again")
    same = docs[id_col].eqNullSafe(F.col(gone_id)) & (F.sha2(normalised(docs[text_col]), 256) == F.col(gone_sha))
    out = docs.join(checked(gone, 128), same, "left_anti")
    if again.isEmpty():
        return out
    repeats = docs.join(checked(again, 128), same, "left_semi")
    return out.unionByName(repeats.dropDuplicates([id_col, text_col]))
