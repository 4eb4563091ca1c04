"""How far the term shares of a language's sources lie apart.

A language keeps the terms that enough of its documents hold. Its sorted kept terms
become minimal acyclic transducers, one for each block of consecutive terms; their
output, the lexicographic ordinal, stands for the term from then on: the texts stream through
the transducers to be counted per source, and ordinals settle ties.

Shares are smoothed and whole. Two sources differ by the sum of the absolute differences
of their shares over all kept terms, and a source differs from its language in
single terms. Sums over terms are made in blocks of terms and of sources, so no task holds
a whole vocabulary or all sources.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded, shared, tidied
from .transducer import Transducer, built, unpacked

#: A-Z becomes a-z, every byte that no term holds a blank; bytes of other characters stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


COUNTS = "lang string, source string, ord long, n long"


@dataclass(frozen=True)
class Settings:
    """``least`` documents of a language hold a kept term; ``smooth`` is added to every count.

    A transducer holds ``block_terms`` terms; transducers of up to ``sent_bytes`` go to the tasks for one pass over the
    texts, further ones for a further pass. Differences are summed in blocks of ``pair_terms`` terms by ``pair_sources``
    sources. A task holds up to ``held`` counts before it gives them out.
    """

    least: int = 30
    smooth: int = 5
    unit: int = 1_000_000_000
    top: int = 50
    block_terms: int = 1 << 17
    sent_bytes: int = 64 << 20
    pair_terms: int = 2048
    pair_sources: int = 128
    held: int = 300_000


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(FOLD).split()


def _documents(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), part(text_col).cast("binary").alias("text"))


def kept_terms(rows: DataFrame, settings: Settings) -> DataFrame:
    """``lang``, ``term``, ``ord``, its ordinal in its language, and ``v``, how many the language keeps; staged."""
    s = settings

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for some in bounded(batch):
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                    seen.setdefault(lang, Counter()).update(set(terms_of(text)))
                if sum(map(len, seen.values())) > s.held:
                    yield counted(seen)
                    seen = {}
        if seen:
            yield counted(seen)

    def counted(seen: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, own in seen.items() for _ in own]
        terms = [t for own in seen.values() for t in own]
        n = [c for own in seen.values() for c in own.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64())], ["lang", "term", "n"])

    found = rows.select("lang", "text").mapInArrow(tidied(count), "lang string, term binary, n long")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least).select("lang", "term")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    placed = staged(ordered.select("lang", "term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "kept")
    spans = placed.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    # a row for each part of a language
    by_lang = Window.partitionBy("lang")
    spans = spans.withColumn("before", F.sum("n").over(by_lang.orderBy("part")) - F.col("n")).withColumn("v", F.sum("n").over(by_lang))
    numbered = placed.join(spans.drop("n"), ["lang", "part"]).select("lang", "term", (F.col("before") + F.col("place") - F.col("first")).alias("ord"), "v")
    return staged(numbered, "terms")


def transducers(terms: DataFrame, settings: Settings) -> DataFrame:
    """``lang``, ``first`` (ordinal of the first term), ``first_term``, ``raw`` (the packed transducer), ``bytes``; staged."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        own = table.column("term").to_pylist()
        raw = built(own).packed()
        cols = [pa.array(table.column("lang").to_pylist()[:1], pa.string()), pa.array(table.column("ord").to_pylist()[:1], pa.int64()), pa.array(own[:1], pa.binary()), pa.array([raw], pa.binary()), pa.array([len(raw)], pa.int64())]
        return pa.table(cols, ["lang", "first", "first_term", "raw", "bytes"])

    block = F.expr(f"ord div {settings.block_terms}").alias("block")
    made = terms.select("lang", "term", "ord", block).groupBy("lang", "block").applyInArrow(build, "lang string, first long, first_term binary, raw binary, bytes long")
    return staged(made, "transducers")


def recounted(rows: DataFrame, blocks: DataFrame, settings: Settings) -> DataFrame:
    """``lang``, ``source``, ``ord`` and ``n``, the occurrences of every kept term that a group holds; staged.

    The transducers that one pass takes are bounded in bytes; the driver knows the sizes of all.
    """
    spark, s = rows.sparkSession, settings
    sizes = blocks.select("lang", "first", "bytes").collect()
    passes: list[list] = []
    room = 0
    for r in sorted(sizes):
        if not passes or room + r["bytes"] > s.sent_bytes:
            passes.append([])
            room = 0
        passes[-1].append((r["lang"], r["first"]))
        room += r["bytes"]
    found = None
    for keys in passes:
        mine = blocks if len(passes) == 1 else blocks.where(F.concat_ws(":", "first", "lang").isin([f"{first}:{lang}" for lang, first in keys]))
        held: dict[str, list[tuple[bytes, int, Transducer]]] = {}
        for r in mine.orderBy("lang", "first").collect():
            held.setdefault(r["lang"], []).append((bytes(r["first_term"]), r["first"], unpacked(bytes(r["raw"]))))
        sent = shared(spark, held)

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = sent()
            seen: dict[tuple[str, str], Counter] = {}
            for batch in batches:
                for some in bounded(batch):
                    for lang, source, text in zip(*[some.column(c).to_pylist() for c in ("lang", "source", "text")]):
                        if lang in machines:
                            seen.setdefault((lang, source), Counter()).update(terms_of(text))
                    if sum(map(len, seen.values())) > s.held:
                        yield from given(seen, machines)
                        seen = {}
            yield from given(seen, machines)

        part = staged(rows.mapInArrow(tidied(count), COUNTS), "recounted")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], COUNTS)
    return staged(found.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "counts")


def given(seen: dict[tuple[str, str], Counter], machines: dict[str, list[tuple[bytes, int, Transducer]]]) -> Iterator[pa.RecordBatch]:
    """The counted strings that are kept terms, through the transducer of their block."""
    for (lang, source), own in seen.items():
        blocks = machines[lang]
        terms = sorted(own)
        times = np.fromiter((own[t] for t in terms), np.int64, len(terms))
        cuts = [0] + [bisect_left(terms, b[0]) for b in blocks[1:]] + [len(terms)]
        for (_, first, machine), a, b in zip(blocks, cuts, cuts[1:]):
            ords = machine.ordinals(terms[a:b])
            known = np.flatnonzero(ords >= 0)
            if len(known):
                n = len(known)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(ords[known] + first), pa.array(times[a:b][known])], ["lang", "source", "ord", "n"])


def share(n: Column, total: Column, v: Column, settings: Settings) -> Column:
    """1 + floor(unit * (n + smooth) / (total + smooth * v)), exactly; null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(settings.unit).cast("decimal(12,0)") * wide(n + settings.smooth)
    under = wide(total + settings.smooth * v)
    return (F.lit(1) + F.call_function("div", top, under)).cast("long")


def _difference(table: pa.Table, settings: Settings) -> pa.Table:
    """Partial differences of the sources of two source blocks over one block of terms."""
    cols = {c: table.column(c).to_numpy() for c in ("ord", "s", "p")}
    low, high, lang, tb = (table.column(c)[0].as_py() for c in ("low", "high", "lang", "tb"))
    terms = int(min(settings.pair_terms, table.column("v")[0].as_py() - tb * settings.pair_terms))
    sides = []
    for side in (low, high):
        base = (cols["s"] // settings.pair_sources == side) & (cols["ord"] < 0)
        numbers = cols["s"][base]
        order = np.argsort(numbers)
        numbers, shares = numbers[order], np.repeat(cols["p"][base][order][:, None], terms, axis=1)
        held = (cols["s"] // settings.pair_sources == side) & (cols["ord"] >= 0)
        shares[np.searchsorted(numbers, cols["s"][held]), cols["ord"][held] - tb * settings.pair_terms] = cols["p"][held]
        sides.append((numbers, shares))
    (a, pa_), (b, pb) = sides
    out_a, out_b, out_f = [], [], []
    for i, own in zip(a, pa_):
        f = np.abs(pb - own[None, :]).sum(1, dtype=np.int64)
        other = b > i if low == high else np.ones(len(b), bool)
        out_a.append(np.full(int(other.sum()), i)), out_b.append(b[other]), out_f.append(f[other])
    made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_f)]
    return pa.table([pa.array([lang] * len(made[0]), pa.string()), *[pa.array(x, pa.int64()) for x in made]], ["lang", "a", "b", "f"])


def divergence(docs: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` for every (language, source) group that occurs.

    Part ``pair``: the other sources of the language with the sum of the differences of the
    shares, all of them. Part ``term``: the kept terms whose share in the group is above the
    language's, the ``top`` largest differences. Ranks go by value, then by the item's bytes. Null
    text, language and source count as empty; empty and repeated texts count like others, a
    language without kept terms has pairs of value 0, a lone source has none; an empty table gives
    no rows. Other columns are not read.
    """
    s = settings
    rows = _documents(docs, lang_col, source_col, text_col)
    terms = kept_terms(rows, s)
    counts = recounted(rows, transducers(terms, s), s)
    vocabulary = terms.groupBy("lang").agg(F.first("v").alias("v"))
    # groups without a kept term have a total of 0; sources are numbered in the order of their bytes
    groups = rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(vocabulary, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("s"))
    groups = staged(groups, "groups")

    in_group = share(F.col("n"), F.col("total"), F.col("v"), s)
    shares = staged(counts.join(groups, ["lang", "source"]).select("lang", "source", "s", "ord", "v", in_group.alias("p")), "shares")

    # part pair: rows of ord -1 carry the share of a count of 0 to every block of terms
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(v - 1) div {s.pair_terms}")))
    none = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest(F.col("v"), F.lit(1)), s)).otherwise(F.lit(1)).cast("long")
    base = groups.select("lang", "s", F.lit(-1).cast("long").alias("ord"), "v", none.alias("p"), F.explode(blocks).alias("tb"))
    spread = shares.select("lang", "s", "ord", "v", "p", F.expr(f"ord div {s.pair_terms}").alias("tb")).unionByName(base)
    last = groups.groupBy("lang").agg(F.expr(f"max(s) div {s.pair_sources}").alias("last"))
    mine = F.expr(f"s div {s.pair_sources}")
    spread = spread.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    spread = spread.select("lang", "s", "ord", "v", "p", "tb", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"))
    partial = spread.groupBy("lang", "tb", "low", "high").applyInArrow(lambda t: _difference(t, s), "lang string, a long, b long, f long")
    sums = staged(partial.groupBy("lang", "a", "b").agg(F.sum("f").alias("value")), "differences")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "s", "source")
    pairs = both.join(names.withColumnRenamed("s", "a"), ["lang", "a"]).join(names.select("lang", F.col("s").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))

    # part term
    all_of = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    overall = counts.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(all_of, "lang").join(vocabulary, "lang")
    overall = overall.select("lang", "ord", share(F.col("n"), F.col("all"), F.col("v"), s).alias("q"))
    above = shares.join(overall, ["lang", "ord"]).where("p > q").select("lang", "source", "ord", (F.col("p") - F.col("q")).alias("value"))
    ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= s.top)
    single = ranked.join(terms.select("lang", "ord", F.col("term").cast("string").alias("item")), ["lang", "ord"])
    return pairs.unionByName(single.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
