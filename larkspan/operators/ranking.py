"""Order-dependent selection without sorting a whole table in one task.

Random choices order rows by ``md5(seed | key)``. The digest is uniform, so a
count per digest prefix tells in which prefix a wanted position falls, and only
the rows of that one prefix are ever sorted. The result is a cut digest per
group; choosing rows is then a plain filter over the wide table, whatever the
size of the largest group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .lookup import MAX_LOOKUP_ROWS, settle

SEED = 42
BEFORE_ALL = ""
AFTER_ALL = "g"  # greater than every hexadecimal digest
# Up to this many rows per group Spark limits each task's rows before the shuffle.
GROUP_LIMIT = 1000


def digest(keys: Sequence[str], seed: int | str = SEED) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def prefix_length(rows: int, bucket_rows: int = 10_000) -> int:
    """Hexadecimal digits of a digest that make buckets of about ``bucket_rows`` rows."""
    length = 2
    while rows > bucket_rows * 16**length:
        length += 1
    return length


def hash_cutoffs(
    df: DataFrame, keys: Sequence[str], takes: dict[str, Column],
    groups: Sequence[str] = (), quotas: DataFrame | None = None,
    seed: int | str = SEED, prefix: int | None = None,
) -> DataFrame:
    """Largest chosen digest per group and cut name.

    ``takes`` gives the number of rows to choose as expressions over ``total``
    (rows in the group) and the columns of ``quotas``. Result columns: the
    group columns, ``cut_name``, ``cut``. Keys should identify a row: rows that
    share a key are chosen together, so a cut may then take a few more. The digest
    prefix that makes a bucket grows with the table, so that a bucket stays small.
    """
    groups = list(groups)
    if prefix is None:
        prefix = prefix_length(df.count())
    rows = df.select(*groups, digest(keys, seed).alias("_h"))
    if not groups:
        rows, groups = rows.withColumn("_all", F.lit(0)), ["_all"]
    rows = rows.withColumn("_bucket", F.substring("_h", 1, prefix))
    running = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = (
        rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("total", F.sum("_n").over(W.partitionBy(*groups)))
    )
    if quotas is not None:
        buckets = buckets.join(quotas, groups)
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut_name"), expr.cast("bigint").alias("_take"))
        for name, expr in takes.items()
    ]))
    marks = buckets.select("*", wanted.alias("_w")).select(
        *groups, "_bucket", "_n", "_upto", "total", "_w.cut_name", "_w._take"
    )
    inside = marks.filter((F.col("_upto") - F.col("_n") < F.col("_take")) & (F.col("_take") <= F.col("_upto")))
    outside = (
        marks.filter((F.col("_take") <= 0) | (F.col("_take") > F.col("total")))
        .select(*groups, "cut_name",
                F.when(F.col("_take") <= 0, BEFORE_ALL).otherwise(AFTER_ALL).alias("cut"))
        .distinct()
    )
    place = inside.select(*groups, "_bucket", "cut_name",
                          (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_place"))
    small, fits = settle(place)
    # Equal digests are counted first, so many copies of one key are one row here.
    in_bucket = W.partitionBy(*groups, "cut_name").orderBy("_h").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = (
        rows.join(F.broadcast(small) if fits else place, [*groups, "_bucket"])
        .groupBy(*groups, "cut_name", "_place", "_h").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(in_bucket))
        .filter((F.col("_upto") - F.col("_n") < F.col("_place")) & (F.col("_place") <= F.col("_upto")))
        .select(*groups, "cut_name", F.col("_h").alias("cut"))
    )
    out = hits.unionByName(outside)
    return out.drop("_all") if groups == ["_all"] else out


def global_cuts(
    df: DataFrame, keys: Sequence[str], takes: dict[str, Column], seed: int | str = SEED,
) -> dict[str, str]:
    """Cut digests of the whole table by name: one short text each."""
    found = {r["cut_name"]: r["cut"] for r in hash_cutoffs(df, keys, takes, seed=seed).collect()}
    return {name: found.get(name, BEFORE_ALL) for name in takes}


def sample_n_per_group(
    df: DataFrame, group: str, keys: Sequence[str], take: Column,
    quotas: DataFrame | None = None, seed: int | str = SEED,
) -> DataFrame:
    """Reproducible random ``take`` rows of each group (all rows if fewer)."""
    cuts = hash_cutoffs(
        df.filter(F.col(group).isNotNull()), keys, {"take": take}, [group], quotas, seed
    ).select(group, "cut")
    small, fits = settle(cuts, MAX_LOOKUP_ROWS)
    joined = df.join(F.broadcast(small) if fits else cuts, group)
    return joined.filter(digest(keys, seed) <= F.col("cut")).drop("cut")


def balance_cap(df: DataFrame, label: str) -> DataFrame:
    """One row: ``cap = min(largest, max(3 * smallest, 300))`` over class sizes."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count()
    return counts.agg(F.least(F.max("count"), F.greatest(3 * F.min("count"), F.lit(300))).alias("cap"))


def balanced_sample(df: DataFrame, label: str, keys: Sequence[str], seed: int | str = SEED) -> DataFrame:
    """At most the balance cap of rows per class."""
    cap = balance_cap(df, label).first()["cap"]
    return sample_n_per_group(df, label, keys, F.lit(cap or 0), seed=seed)


def favoured_quotas(df: DataFrame, group: str, favoured: str, total: int, share: float = 0.4) -> DataFrame:
    """Rows wanted per group: ``share`` of the total for one, the rest split evenly."""
    first = int(total * share)
    names = df.select(group).filter(F.col(group).isNotNull()).distinct()
    others = F.greatest(names.agg(F.count(F.lit(1)) - 1).scalar(), F.lit(1))
    return names.withColumn(
        "quota",
        F.when(F.col(group) == favoured, F.lit(first))
        .otherwise(F.floor(F.lit(total - first) / others)).cast("bigint"),
    )


def favoured_sample(
    df: DataFrame, group: str, favoured: str, keys: Sequence[str],
    total: int = 60_000, share: float = 0.4, seed: int | str = SEED,
    other_groups: int | None = None,
) -> DataFrame:
    """Stratified sample leaning to one group, capped by what is there."""
    first = int(total * share)
    if other_groups:
        quota = F.when(F.col(group) == favoured, first).otherwise(int((total - first) / other_groups))
        return sample_n_per_group(df, group, keys, quota, seed=seed)
    quotas = favoured_quotas(df, group, favoured, total, share)
    return sample_n_per_group(df, group, keys, F.col("quota"), quotas, seed)


def first_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, fan_in: int | None = None,
) -> DataFrame:
    """First ``n`` rows of each group in the given order.

    A large ``n`` is taken in rounds: first within (group, slice of the input),
    then over ever fewer slices, so the biggest group is never sorted whole.
    """
    group = list(group)
    if n <= GROUP_LIMIT:
        w = W.partitionBy(*group).orderBy(*order)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    slices = fan_in or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The task number spreads exact copies, which share a hash. Any slicing gives the same
    # result, but it must not change when a task runs again, so no row counter is used.
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    hashed = [f"`{n}`" for n, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    mixed = F.pmod(F.xxhash64(*hashed), F.lit(slices)) + F.spark_partition_id()
    rows = df.withColumn("_slice", F.pmod(mixed, F.lit(slices)).cast("int"))
    while True:
        w = W.partitionBy(*group, "_slice").orderBy(*order)
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
        if slices == 1:
            return rows.drop("_rn", "_slice")
        slices = 1 if slices <= 32 else -(-slices // 32)
        rows = rows.withColumn("_slice", F.pmod("_slice", F.lit(slices)))


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key; null keys count as equal.

    Spark keeps one row per key in each task before the shuffle, so many copies
    of one key cost nothing there. The short hash in front makes the sort cheap
    for long texts.
    """
    w = W.partitionBy(F.xxhash64(*key), *key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def ordered_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position over the whole table.

    The table is dealt into ranges of the order and sorted inside each, then written, so the row numbers
    of the parts hold; each part is shifted by the sizes of those before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits of the number are the part, the lower 33 count inside it
    rows = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per part
    placed = rows.join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_offset") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_at", "_offset")


def shuffled(df: DataFrame, keys: Sequence[str], seed: int | str = SEED) -> DataFrame:
    """Reproducible random order; ``position`` is the place in it."""
    rows = df.withColumn("_h", digest(keys, seed))
    return ordered_positions(rows, [F.col("_h"), *map(F.col, keys)]).drop("_h")


def label_vocabulary(frames: Sequence[DataFrame], label: str) -> DataFrame:
    """Distinct labels over all given tables."""
    union = frames[0].select(label)
    for other in frames[1:]:
        union = union.unionByName(other.select(label))
    return union.filter(F.col(label).isNotNull()).distinct()


def label_index(frames: Sequence[DataFrame], label: str, index: str = "label_id") -> DataFrame:
    """0-based rank of each distinct label in sorted order."""
    vocabulary = label_vocabulary(frames, label)
    ranked = ordered_positions(vocabulary, [F.col(label)], index)
    return ranked.withColumn(index, F.col(index).cast("int"))
