"""Minimax contiguous partition of documents into shards.

Documents with equal texts are an atomic group. Groups lie in a fixed order, by their
smallest document id; a shard is a run of groups. The smallest capacity that
lets the shards hold all groups is found by binary search; a capacity is checked
greedily, by filling each shard up to it. Then the groups are cut there.

The running sizes of all groups stay in a table. The driver knows some of them, at
most ``boundaries`` at first; when the search has to look between two known ones,
it notes the place, goes on with the lower one, and asks Spark for the running
sizes between all noted places before it searches again. It ends when nothing was
noted, so the result is exact and the driver's part is bounded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import small_table


@dataclass(frozen=True)
class Settings:
    """``boundaries`` is about the number of running sizes that the driver asks for at a time."""

    shards: int = 40
    row_bytes: int = 16
    boundaries: int = 1 << 18


class Known:
    """Running sizes the driver knows: group ends by the group's number, in order."""

    def __init__(self, numbers: np.ndarray, ends: np.ndarray) -> None:
        self.numbers, self.ends = [-1, *numbers.tolist()], [0, *ends.tolist()]
        #: Positions of known ends before which an unknown end may have been the right one.
        self.noted: set[int] = set()

    def floor(self, x: int) -> int:
        """The largest known end up to x; notes the gap x lies in if it holds unknown ends."""
        i = bisect_right(self.ends, x)
        if i < len(self.ends) and self.ends[i - 1] < x and self.numbers[i] - self.numbers[i - 1] > 1:
            self.noted.add(i)
        return self.ends[i - 1]


def fits(known: Known, at: int, total: int, shards: int, capacity: int) -> bool:
    """Whether the groups after ``at`` go into so many shards, each filled greedily."""
    for _ in range(shards):
        if at >= total:
            break
        end = known.floor(at + capacity)
        if end <= at:
            return False
        at = end
    return at >= total


def smallest_capacity(known: Known, total: int, largest: int, shards: int) -> int:
    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)
    while low < high:
        middle = (low + high) // 2
        if fits(known, 0, total, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def cuts_within(known: Known, total: int, shards: int, capacity: int) -> list[int]:
    """The end of each shard. Within the capacity a shard ends as soon as it has its equal share of
    what is left and the shards after it can hold the rest, so that the last ones are not left short."""
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        if at < total:
            low, high = max(at + 1, at + (total - at) // left), at + capacity
            while low < high:
                middle = (low + high) // 2
                end = known.floor(middle)
                if end > at and fits(known, end, total, left - 1, capacity):
                    high = middle
                else:
                    low = middle + 1
            at = known.floor(low)
        cuts.append(at)
    return cuts


def running(groups: DataFrame) -> DataFrame:
    """Groups with their ``part``, ``place`` in it and running sums of sizes and rows inside the part, staged.

    Parts are ranges in the order of the groups, so no task adds up all of them.
    """
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = groups.repartitionByRange(parts, "first_id", "text_key").sortWithinPartitions("first_id", "text_key")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end, rows, place = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            ends = end + np.cumsum(batch.column("bytes").to_numpy(zero_copy_only=False))
            seen = rows + np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
            if n:
                made = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(ends), pa.array(seen)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "part", "place", "part_end", "part_rows"])
                end, rows, place = int(ends[-1]), int(seen[-1]), place + n

    schema = "text_key binary, bytes long, n long, part int, place long, part_end long, part_rows long"
    return staged(ordered.select("text_key", "bytes", "n").mapInArrow(add, schema), "running")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Rows with ``rank``, their number among the rows of their group by document id, staged.

    A group is spread over ranges of document ids, so a large one is not one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "text_key", "id").sortWithinPartitions("text_key", "id")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(batch.column("text_key").to_pylist()):
                seen = seen + 1 if key == last else 0
                last, local[i] = key, seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local)], [*batch.schema.names, "part", "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, local long"
    found = staged(ordered.mapInArrow(count, schema), "copies")
    # only groups that go on in a further part need an offset there
    spans = found.groupBy("text_key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("text_key").orderBy("part")) - F.col("n")
    offsets = staged(spans.select("text_key", "part", before.alias("before")).where("before > 0"), "offsets")
    out = found.join(offsets, ["text_key", "part"], "left")
    return out.withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0))).drop("part", "local", "before")


def shard(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law`` (bytes), ``shard``, ``slot``, ``grown_shard`` (null).

    The size is the text's UTF-8 bytes plus ``row_bytes``; a null text has none
    and shares a group with the empty ones. Slots number a shard's documents
    from 0, by group and document id; of repeated rows any may be first. Shards stay
    empty if there are fewer groups than shards. Other columns are not read.
    """
    s, spark = settings, docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = staged(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + s.row_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_key"),
    ), "rows")
    groups = running(rows.groupBy("text_key").agg(F.min("id").alias("first_id"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    # one row per part on the driver
    parts = groups.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("bytes").alias("largest")).orderBy("part").collect()
    total, n_groups, largest = sum(p["bytes"] for p in parts), sum(p["groups"] for p in parts), max([p["largest"] for p in parts], default=0)
    starts, sums = [], (0, 0, 0)
    for p in parts:
        starts.append((p["part"], *sums))
        sums = (sums[0] + p["bytes"], sums[1] + p["rows"], sums[2] + p["groups"])
    before = small_table(spark, **{c: pa.array([r[i] for r in starts], pa.int64()) for i, c in enumerate(("part", "bytes_before", "rows_before", "groups_before"))})
    stride = max(1, -(-n_groups // s.boundaries))
    placed = groups.join(F.broadcast(before), "part").select(
        "text_key", "bytes", "n", (F.col("bytes_before") + F.col("part_end")).alias("end"), (F.col("rows_before") + F.col("part_rows")).alias("rows_end"),
        (F.col("groups_before") + F.col("place")).alias("number"))
    placed = placed.withColumn("block", F.expr(f"number div {stride}L"))

    def fetched(some: DataFrame) -> np.ndarray:
        return some.select("number", "end").toPandas().to_numpy(np.int64).reshape(-1, 2)

    found = fetched(placed.where((F.col("number") % stride == stride - 1) | (F.col("number") == n_groups - 1)))
    while True:
        found = found[np.argsort(found[:, 0])]
        known = Known(found[:, 0], found[:, 1])
        capacity = smallest_capacity(known, total, largest, s.shards)
        cuts = cuts_within(known, total, s.shards, capacity)
        if not known.noted:
            break
        gaps = [(known.numbers[i - 1], known.numbers[i]) for i in sorted(known.noted)]
        step = max(1, sum(b - a for a, b in gaps) // s.boundaries)
        inner = [((a + 1) // stride, a, b, max(1, min(step, (b - a) // 2))) for a, b in gaps]
        near = F.broadcast(small_table(spark, **{c: pa.array([r[i] for r in inner], pa.int64()) for i, c in enumerate(("block", "low", "high", "step"))}))
        inside = placed.join(near, "block").where("number > low and number < high and (number - low) % step = 0")
        found = np.concatenate([found, fetched(inside)])

    ends = sorted(set(cuts))
    rows_at = {r["end"]: r["rows_end"] for r in placed.where(F.col("end").isin(ends)).select("end", "rows_end").collect()}
    firsts = [0, *[rows_at.get(c, 0) for c in cuts]]
    start = F.col("end") - F.col("bytes")
    of_group = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= start))
    first_row = F.element_at(F.array(*[F.lit(f).cast("long") for f in firsts]), F.col("shard") + 1)
    homes = placed.withColumn("shard", of_group).select("text_key", "shard", (F.col("rows_end") - F.col("n") - first_row).alias("group_slot"))
    out = numbered_copies(rows).join(staged(homes, "homes"), "text_key")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("group_slot") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
