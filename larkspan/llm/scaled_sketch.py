"""Threshold-scaled sketches of word shingles.

A text is the set of its shingles of five lower-cased words. Of their hashes the
sketch retains every one below a fixed fraction of the hash range, so a sketch grows
with its text and two of them can be compared whatever their lengths: the share
of one text's retained hashes that the other retains as well estimates how much of
the one is contained in the other. A text with few hashes below the fraction keeps its
``least`` smallest ones, and the sketch says up to which bound it is whole; two
sketches are compared, and united, below the smaller of their bounds.

A fingerprint is a sketch as text: twelve hex digits of the bound, then twelve for each
retained hash, ascending.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_batches, tidied
from .near_dedup import mix64, words_of

#: Hashes have 48 bits; a bound of all ones says that nothing was left out.
WHOLE = (1 << 48) - 1
ROWS_OUT = 2000


@dataclass(frozen=True)
class Settings:
    """Hashes below 1/``scale`` of the range are retained, and the ``least`` smallest in any case."""

    words: int = 5
    scale: int = 8
    least: int = 16


@dataclass(frozen=True)
class Sketch:
    """Distinct retained hashes, ascending; every hash of the text below ``bound`` is among them."""

    bound: int
    hashes: np.ndarray

    def text(self) -> str:
        raw = np.concatenate([[np.uint64(self.bound)], self.hashes]).astype(">u8")
        return raw.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def parsed(fingerprint: str) -> Sketch:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    values = wide.view(">u8").ravel().astype(np.uint64)
    return Sketch(int(values[0]), values[1:])


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 48-bit hash per place of a shingle, copies included; fewer words than ``size`` make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = mix64(out + h[i : i + n] + np.uint64(i + 1))
    return out >> np.uint64(16)


def sketch(text: str, settings: Settings = Settings()) -> Sketch:
    hashes = shingle_hashes(words_of(text), settings.words)
    limit = (WHOLE + 1) // settings.scale
    low = np.unique(hashes[hashes < np.uint64(limit)])
    if len(low) >= settings.least:
        return Sketch(limit, low)
    every = np.unique(hashes)
    if len(every) <= settings.least:
        return Sketch(WHOLE, every)
    return Sketch(int(every[settings.least - 1]) + 1, every[: settings.least])


def united(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    bound = min(a.bound, b.bound)
    both = np.union1d(a.hashes, b.hashes)
    return Sketch(bound, both if bound == WHOLE else both[both < np.uint64(bound)])


def contained(a: Sketch, b: Sketch) -> float:
    """Estimated share of the first text's shingles that the second holds.

    1 for two texts without shingles. 0 if the first has no hash below the common bound,
    unless the sketches are equal.
    """
    if a.bound == b.bound and np.array_equal(a.hashes, b.hashes):
        return 1.0
    bound = np.uint64(min(a.bound, b.bound))
    mine = a.hashes if a.bound == b.bound else a.hashes[a.hashes < bound]
    if not len(mine):
        return 0.0
    return float(np.isin(mine, b.hashes, assume_unique=True).mean())


def containment(a: Column, b: Column) -> Column:
    """``contained`` of two columns of fingerprints; null where one is null."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist())
        return pa.array([None if x is None or y is None else contained(parsed(x), parsed(y)) for x, y in pairs], pa.float64())

    return run(a, b)


def fingerprints(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``fingerprint``. A null text counts as empty; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([sketch(t, settings).text() for t in batch.column("text").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("id"), made], ["id", "fingerprint"])

    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def merged(fingerprinted: DataFrame, keys: list[str]) -> DataFrame:
    """The united fingerprint of each key's rows, ``keys`` and ``fingerprint``.

    Hashes are counted once per task before the shuffle, which deals them by key and hash,
    so a key with many rows is not one task's work until its distinct hashes below the least bound are left.
    """
    cut = F.transform(F.sequence(F.lit(0), (F.length("fingerprint") / 12 - 1).cast("int")), lambda i: F.substr("fingerprint", i * 12 + 1, F.lit(12)))
    parts = fingerprinted.where("fingerprint IS NOT NULL").select(*keys, cut.alias("_parts"))
    bounds = parts.groupBy(*keys).agg(F.min(F.col("_parts")[0]).alias("_bound"))
    hashes = parts.select(*keys, F.explode(F.slice("_parts", F.lit(2), F.size("_parts"))).alias("_hash")).distinct()
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    below = (F.col("_hash") < F.col("_bound")) | (F.col("_bound") == f"{WHOLE:012x}")
    joined = bounds.alias("l").join(hashes.alias("r"), [*same, below], "left")
    out = joined.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], "_bound").agg(F.array_sort(F.collect_list("_hash")).alias("_all"))
    return out.select(*keys, F.concat("_bound", F.array_join("_all", "")).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints_of_edits(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the one with the next larger id, after the last the first; null
    ids come first, rows with one id are ordered by a hash of their texts, and a lone
    document is its own next one. A null text counts as empty and has the fingerprint of
    an empty text. ``near_edited`` and ``near_next`` are ``contained`` of
    the document's own sketch. Rows alike in id and text must be read in the same order each time, as
    from files. Other columns are not read.

    Documents are dealt to ranges of ids with nearly equal numbers of rows; the first document of
    each range goes to the range before it as well, so every task knows all the next
    texts it needs. The driver holds the first keys of the ranges.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["id", "tie", "row"]
    ranged = rows.select(*keys).repartitionByRange(parts, *keys)
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*keys)).alias("first")).collect()
    order = lambda i, t, r: (i is not None, i if i is not None else 0, t, r)
    bounds = sorted(order(*r["first"]) for r in firsts)

    @F.arrow_udf("array<int>")
    def homes(ids: pa.Array, ties: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for key in map(order, ids.to_pylist(), ties.to_pylist(), places.to_pylist()):
            part = max(0, bisect_right(bounds, key) - 1)
            out.append([part, (part - 1) % len(bounds)] if key == bounds[part] else [part])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.select("*", F.posexplode(homes(*keys)).alias("lent", "part"))
    dealt = dealt.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("lent", *keys).select("id", "text", "lent")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[object, str, Sketch] | None = None
        out: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("id").type
            for some in bounded(batch):
                for name, now, lent in zip(*[some.column(c).to_pylist() for c in ("id", "text", "lent")]):
                    own = sketch(now, settings)
                    if before is not None:
                        other_name, other, theirs = before
                        new = edited(other, now)
                        changed = sketch(new, settings)
                        out.append((other_name, len(other), hashlib.sha256(new.encode()).hexdigest(), theirs.text(), changed.text(), contained(theirs, changed), contained(theirs, own)))
                    before = None if lent else (name, now, own)
                    if len(out) >= ROWS_OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, *types))], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, *types))], names)

    return dealt.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)
