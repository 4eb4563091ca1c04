"""Near duplicates by DartMinHash signatures and a banded join.

A document is a weighted set: its shingles of five lower-cased words, each
weighing as often as it occurs. The plane of weight and rank is cut into unit
regions; every region of an element, that is one unit of its weight and one unit of
rank, gets Poisson(1) darts at hashed places, the same for every document that
holds the element with that weight. A dart falls into one of the signature's
coordinates and the earliest rank per coordinate is kept: two documents agree in a
coordinate with a probability equal to their weighted Jaccard similarity.
Long documents need one unit of rank; short ones take more until no coordinate is empty.

Bands of the signature join documents into buckets. A pair is compared only in its
first common band; pairs whose signatures agree enough are compared exactly, by
their shingles. A bucket is cut into blocks of bounded number and length of texts, differently
in every band, so the blocks of a large group of near copies overlap and connect it
although each member goes to one block per band only. In a second step the members
of a cut bucket that are not connected with most of it visit its other blocks; pairs that
are connected already need no comparison. So no link between classes is lost and the
work grows with the members, and beyond that only with those that share
a bucket but not the class. Only links that connect leave a task; connected links make classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded, checked, map_batches, tidied, unused


@dataclass(frozen=True)
class Settings:
    """``bands`` x ``rows`` coordinates. At similarity 0.8 a pair shares no band with probability
    (1 - 0.8**5)**26 = 3e-5, and agrees in less than ``least_agreement`` of the coordinates with probability 5e-8.

    A block has about ``block`` members of together about ``block_chars`` characters (one text may be longer);
    ``visitors`` members of other blocks are compared with a block in one task.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    least_agreement: float = 0.6
    block: int = 256
    block_chars: int = 1 << 24
    visitors: int = 4096


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between ASCII blanks."""
    return text.lower().encode("utf-8", "replace").split()


def shingles(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles of ``size`` words and how often each occurs; fewer words make one shingle."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known: dict[bytes, int] = {}
    for w in set(words):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = mix64(out + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out, return_counts=True)


#: Upper ends of the Poisson(1) counts 0, 1, 2, ... on the scale of 32 bits.
POISSON = np.array([min(2**32 - 1, int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) for k in range(12)], np.uint64)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The least rank per coordinate; all ones for an empty set."""
    best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return best
    heavy = int(weights.max())
    if heavy > 1:
        unit = np.concatenate([np.arange(w, dtype=np.uint64) for w in weights]) if heavy < 1 << 20 else np.arange(int(weights.sum()), dtype=np.uint64) - np.repeat((np.cumsum(weights) - weights).astype(np.uint64), weights)
        cells = mix64(np.repeat(elements, weights) + unit * np.uint64(0x9E3779B97F4A7C15))
    else:
        cells = mix64(elements)
    step = max(1, math.ceil(k * (math.log(k) + 2) / len(cells)))
    rank = 0
    while True:
        ranks = np.arange(rank, rank + step, dtype=np.uint64)
        regions = mix64(cells[:, None] + ranks[None, :] * np.uint64(0xD1B54A32D192ED03)).ravel() if step > 1 else mix64(cells + ranks[0] * np.uint64(0xD1B54A32D192ED03))
        darts = np.searchsorted(POISSON, regions >> np.uint64(32), side="right")
        where = np.repeat(np.arange(len(regions)), darts)
        number = np.arange(len(where)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(regions[where] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        at = ((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        value = (ranks[where % step] << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, at.astype(np.int64), value)
        rank += step
        if best.max() < np.iinfo(np.uint64).max:
            return best


def band_keys(sig: np.ndarray, settings: Settings) -> np.ndarray:
    h = np.arange(1, settings.bands + 1, dtype=np.uint64)
    for column in sig.reshape(settings.bands, settings.rows).T:
        h = mix64(h + column)
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (elements, weights)."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common) if total else 1.0


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its connected component, for the nodes of ``links`` (a, b).

    Every round each node takes the least root among its neighbours, then the root of
    its root; each round's result is a written table.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    roots = staged(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = edges.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        least = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = staged(least.join(above, "root").select("node", "old", F.least("root", "above").alias("root")), "roots")
        done = new.where("old != root").isEmpty()
        roots = new.select("node", "root")
        if done:
            return roots


def _united(parent: dict, x: bytes) -> bytes:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


#: Rows that meet have equal keys: a bucket, one of its blocks and a share of that block's visitors.
KEYS = ["bucket", "at", "share"]
MEETING = "bucket long, at int, share int, band int, block int, roams boolean, root binary, node binary, marks binary, packed binary"


class Member(NamedTuple):
    bucket: int
    at: int
    share: int
    band: int
    block: int
    roams: bool
    root: bytes
    node: bytes
    marks: bytes
    packed: bytes
    text: str | None = None


def _signed(rows: DataFrame, settings: Settings) -> DataFrame:
    """Node (digest of the words), length, short marks of the coordinates and keys of the bands per row."""
    k = settings.bands * settings.rows

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, marks, bands, packed = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            nodes.append(hashlib.md5(b" ".join(words)).digest())
            sizes.append(len(text))
            sig = signature(*shingles(words, settings.words), k)
            marks.append(mix64(sig).astype(np.uint16).tobytes())
            bands.append(band_keys(sig, settings) if words else [])
            packed.append(np.asarray(bands[-1], np.int64).tobytes())
        made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_md5"), *made], ["id", "text_md5", "node", "chars", "marks", "bands", "packed"])

    id_type = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "text_md5", "text"), sign, f"id {id_type}, text_md5 binary, node binary, chars long, marks binary, bands array<bigint>, packed binary")


def members_of(signed: DataFrame, settings: Settings) -> DataFrame:
    """One row per node and bucket that it shares: its block and the bucket's number of blocks."""
    band = signed.select("node", "chars", F.posexplode("bands").alias("band", "bucket"))
    full = band.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / settings.block), F.ceil(F.col("chars") / settings.block_chars)).cast("int")
    members = band.drop("chars").join(full.select("band", "bucket", blocks.alias("blocks")), ["band", "bucket"])
    # the bucket decides as well, so that each band cuts a group in its own way
    members = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    return members.join(signed.select("node", "marks", "packed"), "node")


def _meeting(members: DataFrame, at: Column, share: Column, roams: Column, root: Column) -> DataFrame:
    return members.select("bucket", at.alias("at"), share.cast("int").alias("share"), "band", "block", roams.alias("roams"), root.alias("root"), "node", "marks", "packed")


def first_meetings(members: DataFrame) -> DataFrame:
    """Every member in its own block."""
    return _meeting(members, F.col("block"), F.lit(0), F.lit(False), F.col("node"))


def later_meetings(members: DataFrame, roots: DataFrame, settings: Settings) -> DataFrame:
    """Members at home, and those outside their bucket's largest component in each of its other blocks."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("strangers"))
    main = main.where("strangers > 0").withColumn("shares", F.ceil(F.col("strangers") / settings.visitors).cast("int"))
    met = rooted.join(main, "bucket").withColumn("roams", F.col("root") != F.col("main"))
    home = met.withColumn("each", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    away = met.where("roams").withColumn("each", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("each != block")
    share = F.pmod(F.xxhash64("node"), F.col("shares"))
    return _meeting(home, F.col("block"), F.col("each"), F.col("roams"), F.col("root")).union(
        _meeting(away, F.col("each"), share, F.col("roams"), F.col("root"))
    )


def _met(batches: Iterable[pa.RecordBatch], settings: Settings) -> Iterator[tuple[list[Member], list[Member]]]:
    """Members at home and visitors of each key, the visitors in bounded parts."""
    homes: list[Member] = []
    visitors: list[Member] = []
    chars, key = 0, None
    for batch in batches:
        for some in bounded(batch, 16 << 20):
            for values in zip(*(some.column(c).to_pylist() for c in some.schema.names)):
                m = Member(*values)
                if m[:3] != key:
                    if homes:
                        yield homes, visitors
                    homes, visitors, chars, key = [], [], 0, m[:3]
                if m.block == m.at:
                    homes.append(m)
                    continue
                visitors.append(m)
                chars += len(m.text or "")
                if len(visitors) >= settings.block or chars >= settings.block_chars:
                    # a block may have nobody at home
                    if homes:
                        yield homes, visitors
                    visitors, chars = [], 0
    if homes:
        yield homes, visitors


def _likely(homes: list[Member], visitors: list[Member], later: bool, settings: Settings) -> Iterator[tuple[Member, Member]]:
    """Pairs of a key that share this band first and agree enough; later only pairs that are not connected."""
    k = settings.bands * settings.rows
    marks = np.frombuffer(b"".join(m.marks for m in homes), np.uint16).reshape(len(homes), k)
    # chance agreements of the short marks must not name a band that the pair does not share
    buckets = np.frombuffer(b"".join(m.packed for m in homes), np.int64).reshape(len(homes), settings.bands)
    if not later:
        for i in range(len(homes) - 1):
            ok = (marks[i + 1 :] == marks[i]).mean(axis=1) >= settings.least_agreement
            for j in i + 1 + np.flatnonzero(ok):
                if int((buckets[j] == buckets[i]).argmax()) == homes[0].band:
                    yield homes[i], homes[j]
        return
    roams = np.array([m.roams for m in homes])
    for v in visitors:
        ok = (marks == np.frombuffer(v.marks, np.uint16)).mean(axis=1) >= settings.least_agreement
        if v.block > v.at:
            # two that both roam meet in the later block only
            ok &= ~roams
        for j in np.flatnonzero(ok):
            if homes[j].root != v.root and int((buckets[j] == np.frombuffer(v.packed, np.int64)).argmax()) == v.band:
                yield v, homes[j]


def _links(meetings: DataFrame, rows: DataFrame, one: DataFrame, settings: Settings, later: bool) -> DataFrame:
    """Links ``a``, ``b`` between nodes that meet and are similar, leaving out those that connect nothing new in a key."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.repartition(*[F.col(c) for c in KEYS]).sortWithinPartitions(*KEYS, F.col("block") != F.col("at"), "node")

    def plausible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Member] = []
        key, seen = None, set()
        for homes, visitors in _met(batches, settings):
            if homes[0][:3] != key:
                key, seen = homes[0][:3], set()
            found = {m.node: m for pair in _likely(homes, visitors, later, settings) for m in pair if m.node not in seen}
            seen.update(n for n, m in found.items() if m.block == m.at)
            out += found.values()
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[Member]) -> pa.RecordBatch:
        i32, types = pa.int32(), (pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        columns = zip(list(zip(*out))[:10], (pa.int64(), i32, i32, i32, i32, *types))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], list(Member._fields[:10]))

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        parent: dict[bytes, bytes] = {}
        key = None
        for homes, visitors in _met(batches, settings):
            if homes[0][:3] != key:
                key, sets, parent = homes[0][:3], {}, {}
            links, own = [], {m.node for m in homes}
            for pair in _likely(homes, visitors, later, settings):
                a, b = (_united(parent, m.root) for m in pair)
                if a == b:
                    continue
                for m in pair:
                    if m.node not in sets:
                        sets[m.node] = shingles(words_of(m.text), settings.words)
                if similarity(sets[pair[0].node], sets[pair[1].node]) >= settings.similarity:
                    parent[max(a, b)] = min(a, b)
                    links.append((pair[0].node, pair[1].node))
            sets = {n: sets[n] for n in own & sets.keys()}
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], ["a", "b"])

    hits = staged(keyed(meetings).mapInArrow(tidied(plausible), MEETING), "plausible")
    wanted = staged(hits.select("node").distinct().join(one, "node").select("node", F.col("id").alias("one_id"), F.col("text_md5").alias("one_md5")), "wanted")
    same = F.col("id").eqNullSafe(F.col("one_id")) & (F.col("text_md5") == F.col("one_md5"))
    texts = rows.join(checked(wanted, 80), same).select("node", "text").dropDuplicates(["node"])
    with_text = hits.join(texts, "node").select(*Member._fields)
    return staged(keyed(with_text).mapInArrow(tidied(compared), "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``class_id``, ``class_size`` and ``kept``.

    Documents with the same words in the same order are one text; texts whose
    weighted Jaccard similarity is at least ``settings.similarity`` are linked,
    and connected documents form a class. Its id is its smallest document id,
    and that document stays (one row of it, if it is repeated). Texts without
    words, null or empty, form one class. Null ids count as larger than others.
    Texts may be of any length; a block holds fewer of the long ones. Other columns
    are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_md5", F.unhex(F.md5(F.col("text").cast("binary"))))
    signed = staged(_signed(rows, settings).withColumn("row", F.monotonically_increasing_id()), "signed")
    # texts with the same words meet once: the row that stands for a node
    first = F.min_by(F.struct("id", "row", "text_md5"), F.struct(F.col("id").isNull(), "id", "row"))
    nodes = staged(signed.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    one = nodes.select("node", F.col("first.id").alias("id"), F.col("first.row").alias("row"), F.col("first.text_md5").alias("text_md5"))
    members = staged(members_of(signed.join(one.select("row"), "row"), settings), "members")
    links = _links(first_meetings(members), rows, one, settings, False)
    roots = components(links)
    cut = members.where("blocks > 1")
    if not cut.isEmpty():
        more = _links(staged(later_meetings(cut, roots, settings), "visits"), rows, one, settings, True)
        roots = components(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # documents of nodes that share a root, or of one node with copies
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "n")
    order = F.struct(F.col("first.id").isNull(), F.col("first.id"), F.col("first.row"))
    classes = rooted.groupBy("root").agg(F.min_by("first", order).alias("stays"), F.sum("n").alias("class_size")).where("class_size > 1")
    classes = staged(rooted.select("node", "root").join(classes, "root").select("node", "stays", "class_size"), "classes")
    out = signed.select("id", "row", "node").join(classes, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("stays").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each class, all columns unchanged.

    A document id that occurs in several rows stays if any of its rows does;
    give unique ids for a choice per row.
    """
    found = staged(near_duplicates(docs, settings, id_col, text_col), "near")
    (gone_id,) = unused(docs.columns, "gone_id")
    stays = found.groupBy(F.col(id_col).alias(gone_id)).agg(F.max("kept").alias("stays"))
    gone = staged(stays.where("not stays").select(gone_id), "near-gone")
    return docs.join(checked(gone, 16), docs[id_col].eqNullSafe(F.col(gone_id)), "left_anti")
