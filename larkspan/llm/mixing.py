"""Mixing sources to target weights by a low-discrepancy schedule.

Documents of a source lie end to end in a shuffled order and are cut into
blocks of equal numbers of words; a source that must give more than it has
begins anew. Slots of the output stream take golden-ratio points; a point falls
into one source's part of the cumulative weights, so every stretch of the
stream holds the sources in nearly their shares. The slots of a source are
ranked, and slot rank r takes block r of the source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import ordered_positions
from ..session import staged
from .common import WORD, checked, map_batches, small_table, unused

#: 2**64 over the golden ratio, odd: the points slot * GOLDEN mod 2**64 are evenly spread.
GOLDEN = 0x9E3779B97F4A7C15
#: Weights of sources in code point order, null last; they repeat.
WEIGHTS = (3, 1, 2)
CHUNK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """``share`` of all words is taken (numerator, denominator); at most ``most`` times a source's words."""

    weights: tuple[int, ...] = WEIGHTS
    share: tuple[int, int] = (3, 2)
    most: int = 2
    block: int = 1024
    bucket_rows: int = 1_000


def targets(sizes: list[int], settings: Settings = Settings()) -> list[float]:
    """Words to take per source: shares by weight, capped, the excess reshared by weight.

    Sources reach their cap in the order of cap over weight; after the first k
    are capped, the others share the rest by weight.
    """
    weights = [settings.weights[i % len(settings.weights)] for i in range(len(sizes))]
    up, down = settings.share
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    total, capped, open_weight, out = sum(sizes), 0, sum(weights), [0.0] * len(sizes)
    for k, i in enumerate(order):
        # whole numbers, but for the last division
        if settings.most * sizes[i] * down * open_weight > weights[i] * (up * total - down * capped):
            for j in order[k:]:
                out[j] = weights[j] * (up * total - down * capped) / (down * open_weight)
            break
        out[i] = float(settings.most * sizes[i])
        capped += settings.most * sizes[i]
        open_weight -= weights[i]
    return out


def shuffle_key(id_col: Column, text: Column) -> Column:
    """A fixed pseudo-random order: the first 60 bits of a digest of id and text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def laid_out(docs: DataFrame, settings: Settings, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> tuple[DataFrame, list[float]]:
    """Documents with their source's number, size and target and their first word's place in the shuffled source.

    ``row`` tells rows apart that are alike in id, text and source, if a column for it is given.
    Returns the staged table and the words to take per source. Names of sources stay in
    Spark; the driver knows three numbers of each.
    """
    text = F.col(text_col).cast("string")
    sized = staged(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffle_key(F.col(id_col), text).alias("key"), F.xxhash64(text).alias("text_hash"),
        (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"),
    ), "sized")
    groups = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    numbered = staged(ordered_positions(groups, [F.asc_nulls_last("source")], "s").select(F.col("s").cast("int").alias("s"), F.col("source").alias("name"), "source_size", "n"), "sources")
    held = numbered.select("s", "source_size", "n").toArrow().sort_by("s")
    goal = targets(held.column("source_size").to_pylist(), settings)
    given = small_table(docs.sparkSession, s=held.column("s").combine_chunks(), target=pa.array(goal, pa.float64()))
    sources = staged(numbered.join(given, "s").drop("n"), "targets")
    # a hash bucket holds a bounded number of rows of a source, however large the source is
    bits = max(0, math.ceil(math.log2(max(held.column("n").to_pylist(), default=1) / settings.bucket_rows)))
    named = sized.join(checked(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    named = named.withColumn("bucket", F.shiftright("key", 60 - bits))
    sums = named.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("s").orderBy("bucket")) - F.col("words")
    sums = staged(sums.select("s", "bucket", before.alias("before")), "bucket-starts")
    inside = Window.partitionBy("s", "bucket").orderBy("key", "id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.join(sums, ["s", "bucket"]).withColumn("first", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    placed = placed.select("id", "text_hash", "row", "source", "s", "size", "source_size", "target", "first")
    return staged(placed, "placed"), goal


def schedule(spark: SparkSession, words: list[int], block: int) -> DataFrame:
    """Slots of the stream: ``slot``, source number ``s`` and ``rank`` among the source's slots, as many as the sources need."""
    need = np.array([-(-w // block) for w in words], np.int64)
    if not need.sum():
        return small_table(spark, s=pa.array([], pa.int32()), rank=pa.array([], pa.int64()), slot=pa.array([], pa.int64()))
    # each source's part of the circle in proportion to the blocks it gives
    ends = [(int(c) << 64) // int(need.sum()) - 1 for c in np.cumsum(need)]
    ends = np.array([max(e, 0) for e in ends], np.uint64)
    given = np.flatnonzero(need)

    def sources_of(chunk: int, slots: int) -> np.ndarray:
        first = chunk * CHUNK
        n = min(CHUNK, slots - first)
        points = np.arange(first, first + n, dtype=np.uint64) * np.uint64(GOLDEN)
        return given[np.searchsorted(ends[given], points, side="left")]

    def counted(slots: int) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            c, s, n = [], [], []
            for chunk in batch.column(0).to_pylist():
                found, times = np.unique(sources_of(chunk, slots), return_counts=True)
                c.append(np.full(len(found), chunk)), s.append(found), n.append(times)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((c, pa.int64()), (s, pa.int32()), (n, pa.int64()))], ["chunk", "s", "n"])

        return map_batches(spark.range(-(-slots // CHUNK)), run, "chunk long, s int, n long")

    slots = int(need.sum())
    while True:
        counts = staged(counted(slots), "slot-counts")
        have = {r.s: r.n for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        if all(have.get(int(s), 0) >= need[s] for s in given):
            break
        slots += max(16, slots // 32)  # points fall a little short of a share here and there

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for chunk in batch.column(0).to_pylist():
            s = sources_of(chunk, slots)
            order = np.argsort(s, kind="stable")
            starts = np.flatnonzero(np.diff(s[order], prepend=-1))
            local = np.empty(len(s), np.int64)
            local[order] = np.arange(len(s)) - np.repeat(starts, np.diff(starts, append=len(s)))
            parts.append((np.full(len(s), chunk), chunk * CHUNK + np.arange(len(s)), s, local))
        cols = [np.concatenate(x) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["chunk", "slot", "s", "local"])

    before = F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")
    made = map_batches(spark.range(-(-slots // CHUNK)), run, "chunk long, slot long, s int, local long")
    # the planner takes what grows from a range for small, so it is told not to broadcast it
    ranked = made.hint("merge").join(counts.select("chunk", "s", before.alias("before")), ["chunk", "s"]).select("slot", "s", (F.col("before") + F.col("local")).alias("rank"))
    needed = small_table(spark, s=pa.array(given, pa.int32()), need=pa.array(need[given], pa.int64()))
    return ranked.join(checked(staged(needed, "needed"), 16), "s").where("rank < need").select("s", "rank", "slot")


def mix(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' places and the pieces of the mixed stream.

    Places: one row per document with ``size``, ``source_size``, ``target``. Pieces: ``slot``
    orders the stream, ``first`` the pieces inside a slot; a piece is words
    ``from_word`` to ``to_word`` (exclusive) of the document at place (``s``, ``first``) and
    belongs to round ``lap`` of its source. A null text has no words; documents
    without words and sources without words give nothing. Reruns agree.
    """
    places, goal = laid_out(docs, settings, id_col, text_col, source_col)
    block, words = settings.block, [math.floor(t) for t in goal]
    laps = places.where("size > 0").withColumn("words", F.floor("target")).withColumn("lap", F.explode(F.array(*[F.lit(i) for i in range(settings.most)])))
    laps = laps.withColumn("from", F.col("first") + F.col("lap") * F.col("source_size"))
    laps = laps.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words"))).where(F.col("from") < F.col("to"))
    pieces = laps.withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
    start, end = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    pieces = pieces.select("id", "text_hash", "s", "first", "size", "lap", "rank", (start - F.col("from")).alias("from_word"), (end - F.col("from")).alias("to_word"))
    return places, pieces.join(schedule(docs.sparkSession, words, block).hint("merge"), ["s", "rank"])


def mixed_sizes(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, ``first_slot`` and ``n_slots``.

    ``taken`` counts the words the mix takes of it, in ``n_slots`` pieces of which the first stands in slot
    ``first_slot`` of the stream; null and 0 if it takes none.
    """
    places, pieces = mix(docs, settings, id_col, text_col, source_col)
    # a place with words belongs to one document
    taken = pieces.groupBy("s", "first", "size").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    out = places.join(taken, ["s", "first", "size"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", count("taken"), "first_slot", count("n_slots"))


def mixed_documents(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents the mix takes, whole, in the columns of the input and in the order of the stream.

    A document appears once for every round of its source that takes it, in the slot of its first
    block. The one in which a source's target falls is taken whole or left, whichever brings the
    source's words nearer the target. Repeated rows count as often as they occur, each with
    its own columns. Documents without words are in no block and are not taken; an empty table gives no rows.
    """
    spark, block = docs.sparkSession, settings.block
    columns, (m_row,) = docs.columns, unused(docs.columns, "mix_row")
    places, _ = laid_out(docs, settings, id_col, text_col, source_col)
    alike = not places.groupBy("id", "text_hash", "source").count().where("count > 1").isEmpty()
    if alike:
        # rows that nothing else tells apart get numbers that stay
        docs = staged(docs.withColumn(m_row, F.monotonically_increasing_id()), "numbered")
        places, _ = laid_out(docs, settings, id_col, text_col, source_col, m_row)
    laps = places.where("size > 0").withColumn("lap", F.explode(F.array(*[F.lit(i) for i in range(settings.most)])))
    laps = laps.withColumn("from", F.col("first") + F.col("lap") * F.col("source_size"))
    # of two nearest ends the later one is taken if the document's middle is not beyond the target
    laps = laps.where(F.col("from") + F.col("size") / 2 <= F.col("target")).withColumn("rank", F.expr(f"`from` div {block}"))
    ends = {r["s"]: r["words"] for r in laps.groupBy("s").agg(F.max(F.col("from") + F.col("size")).alias("words")).collect()}
    words = [ends.get(i, 0) for i in range(max(ends, default=-1) + 1)]
    slots = laps.join(schedule(spark, words, block).hint("merge"), ["s", "rank"])
    names = unused(docs.columns, "mix_id", "mix_hash", "mix_source", "mix_number", "mix_at", "mix_slot", "mix_first")
    m_id, m_hash, m_source, m_number, m_at, m_slot, m_first = names
    at = F.array_sort(F.collect_list(F.struct(F.col("slot").alias(m_slot), F.col("from").alias(m_first)))).alias(m_at)
    slots = staged(slots.groupBy(F.col("id").alias(m_id), F.col("text_hash").alias(m_hash), F.col("source").alias(m_source), F.col("row").alias(m_number)).agg(at), "taken")
    if alike:
        same = docs[m_row] == F.col(m_number)
    else:
        same = docs[id_col].eqNullSafe(F.col(m_id)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(m_hash)) & docs[source_col].cast("string").eqNullSafe(F.col(m_source))
    out = docs.join(slots, same).select(*columns, F.inline(m_at))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, m_slot, m_first).sortWithinPartitions(m_slot, m_first).select(*columns)
