"""Product codes of vectors, their codebooks found by k-means with norm-of-sum bounds.

Vectors of whole numbers are cut into equal parts; each part position has a codebook.
A round assigns every part to its nearest entry and moves the entries to the means of
their parts. Between rounds a part keeps its entry and, for each group of entries, a lower
bound of the distance to the group's other entries together with the round in which
that bound was measured. All earlier codebooks are kept, so a bound of round s
loses in round r only the largest distance between an entry's places then and now, the
norm of the sum of its steps, which is less than the sum of their norms. A group whose bound
stays above the distance to the own entry is left out; all others are scanned
exactly. Distances are squared, whole and exact, ties go to the lower index.

Each round writes the parts' state to the shared folder, and the sums per entry come
from Spark; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, staged
from .common import checked, map_batches, shared


@dataclass(frozen=True)
class Settings:
    """Components are floor(``scale`` * x); codebooks start as the parts of the ``entries`` rows with the least ids."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    groups: int = 8


@dataclass
class Codebooks:
    """``history`` has the entries of every round, each of shape (parts, entries, width of a part)."""

    history: list[np.ndarray] = field(default_factory=list)
    #: Group of every entry, of shape (parts, entries).
    groups: np.ndarray | None = None

    def moved(self) -> np.ndarray:
        """Largest distance between then and now, of shape (rounds so far, parts, groups)."""
        now = self.history[-1].astype(np.float64)
        steps = np.stack([np.sqrt(((now - then) ** 2).sum(-1)) for then in self.history])
        out = np.zeros((*steps.shape[:2], int(self.groups.max(initial=0)) + 1))
        for g in range(out.shape[-1]):
            out[..., g] = np.where(self.groups == g, steps, 0.0).max(-1, initial=0.0)
        return out * (1 + 1e-9)


def spread_groups(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: the nearest of ``groups`` entries that lie far apart."""
    points = entries.astype(np.float64)
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(groups, len(points)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return ((points[:, None, :] - points[None, chosen, :]) ** 2).sum(-1).argmin(1)


def whole(vectors: pa.Array, settings: Settings) -> np.ndarray:
    """Vectors as an array of shape (rows, parts, width of a part) of whole numbers."""
    n = len(vectors)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if n else 0
    if n and (lengths != width).any() or width % settings.parts:
        raise ValueError(f"vectors must have one width, a multiple of {settings.parts}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * settings.scale
    limit = 2.0 ** ((62 - max(1, width // settings.parts).bit_length()) // 2 - 1)
    if n and np.abs(flat).max(initial=0.0) >= limit:
        raise ValueError(f"components must stay below {limit / settings.scale:.6g}, so that distances are exact")
    return np.floor(flat).astype(np.int64).reshape(n, settings.parts, width // settings.parts)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # products and sums of doubles are exact
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def assigned(x: np.ndarray, books: np.ndarray, groups: np.ndarray, moved: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of the rows of one part position; ``bound`` and ``stamp`` are brought up to date.

    ``code`` is the entry of the round before, or -1 for all rows in the first round. Returns the
    squared distances and how many groups of each row were scanned; ``code`` is changed in place.
    """
    now, n, every = len(moved) - 1, len(x), np.arange(len(x))
    first = bool(n) and code[0] < 0
    best = np.full(n, np.iinfo(np.int64).max)
    if not first:
        best = ((x - books[code]) ** 2).sum(1)
    own, own_error = code.copy(), best.copy()
    held = bound - moved[stamp, np.arange(bound.shape[1])]
    need = np.ones(held.shape, bool) if first else held <= np.sqrt(best)[:, None] * (1 + 1e-9) + 1e-6
    least, at, second = (np.full(held.shape, np.iinfo(np.int64).max) for _ in range(3))
    for g in range(held.shape[1]):
        members, rows = np.flatnonzero(groups == g), np.flatnonzero(need[:, g])
        if not len(members) or not len(rows):
            continue
        found = distances(x[rows], books[members])
        where = found.argmin(1)
        low = found[np.arange(len(rows)), where]
        least[rows, g], at[rows, g] = low, members[where]
        if len(members) > 1:
            found[np.arange(len(rows)), where] = np.iinfo(np.int64).max
            second[rows, g] = found.min(1)
        better = (low < best[rows]) | ((low == best[rows]) & (members[where] < code[rows]))
        code[rows[better]], best[rows[better]] = members[where[better]], low[better]
    # of a scanned group the least distance to an entry other than the row's own is the new bound
    fresh = np.sqrt(np.where(at == code[:, None], second, least).astype(np.float64)) * (1 - 1e-9)
    held[need], stamp[need] = fresh[need], now
    bound[need] = fresh[need]
    left = every[(own != code) & (own >= 0)]
    if len(left):
        # the entry left behind belongs to its group's bound now; if that group was not scanned, the bound is made one of this round
        g = groups[own[left]]
        open_ = ~need[left, g]
        left, g = left[open_], g[open_]
        bound[left, g] = np.minimum(held[left, g], np.sqrt(own_error[left].astype(np.float64)) * (1 - 1e-9))
        stamp[left, g] = now
    return best, need.sum(1)


STATE = "vec_id {id}, label {label}, vector array<{item}>, codes binary, bounds binary, stamps binary, error long, scans long"


def compress(df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """One row per kept vector and the codebooks of all rounds.

    Rows: id, label, ``code`` (two hex digits an entry, in part order), ``error`` (squared distances
    to the entries, summed over parts) and ``scans`` (groups of entries scanned over all rounds
    and parts). Vectors that are null or hold null or non-finite components are dropped; an
    empty table, or one without a usable vector, gives no rows. Rows may be repeated; of equal ids the
    lesser vector comes first among the first entries, null ids come last. With fewer
    rows than entries the codebooks are smaller; at most 256 entries. Vectors of different widths, of a
    width that the parts do not divide, or too large for exact 64-bit distances are an
    error. Other columns are not read.
    """
    s, spark = settings, df.sparkSession
    if s.entries > 256:
        raise ValueError("two hex digits tell 256 entries")
    item = df.schema[vec_col].dataType.elementType.simpleString()
    kinds = {"id": df.schema[id_col].dataType.simpleString(), "label": df.schema[label_col].dataType.simpleString(), "item": item}
    wide = lambda x: x.cast("double")
    usable = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(wide(x)) & (F.abs(wide(x)) < float("inf")), F.lit(False)))
    kept = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector")).where(F.col(vec_col).isNotNull() & usable)

    leading = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(s.entries).select("vector").toArrow()
    if not leading.num_rows:
        return kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scans")), Codebooks([np.zeros((s.parts, 0, 0), np.int64)], np.zeros((s.parts, 0), np.int64))
    books = Codebooks([whole(leading.column("vector").combine_chunks(), s).transpose(1, 0, 2)])
    books.groups = np.stack([spread_groups(b, s.groups) for b in books.history[0]])
    n_groups, width = int(books.groups.max()) + 1, books.history[0].shape[2]

    state, old = kept, None
    for step in range(s.rounds + 1):
        sent = shared(spark, (books.history[-1], books.groups, books.moved()))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            entries, groups, moved = sent()
            x = whole(batch.column("vector"), s)
            if x.shape[0] and x.shape[2] != width:
                raise ValueError(f"vectors must have one width, here {width * s.parts}")
            n, errors, scans = len(x), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            if "codes" in batch.schema.names:
                read = lambda c, t: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, s.parts, -1).copy()
                codes, bounds, stamps = read("codes", np.uint8)[..., 0].astype(np.int64), read("bounds", np.float32).astype(np.float64), read("stamps", np.uint8)
                scans += batch.column("scans").to_numpy()
            else:
                codes, bounds, stamps = np.full((n, s.parts), -1), np.zeros((n, s.parts, n_groups)), np.zeros((n, s.parts, n_groups), np.uint8)
            for p in range(s.parts):
                code, bound, stamp = codes[:, p].copy(), bounds[:, p].copy(), stamps[:, p].copy()
                error, scanned = assigned(x[:, p], entries[p], groups[p], moved[:, p], code, bound, stamp)
                codes[:, p], bounds[:, p], stamps[:, p] = code, bound, stamp
                errors += error
                scans += scanned
            # rounded towards zero, a bound stays one
            low = np.nextafter(bounds.astype(np.float32), np.float32(-np.inf))
            packed = lambda a, t: pa.array([r.tobytes() for r in a.astype(t).reshape(n, -1)], pa.binary())
            cols = [batch.column("vec_id"), batch.column("label"), batch.column("vector"), packed(codes, np.uint8), packed(low, np.float32), packed(stamps, np.uint8), pa.array(errors), pa.array(scans)]
            return pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "vector", "codes", "bounds", "stamps", "error", "scans"])

        state = staged(map_batches(state, run, STATE.format(**kinds)), f"codes-{step}")
        if old is not None:
            dropped(old)
        old = state
        if step < s.rounds:
            books.history.append(means(state, books.history[-1], s))
    return state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error", "scans"), books


def means(state: DataFrame, entries: np.ndarray, settings: Settings) -> np.ndarray:
    """Every entry's componentwise mean of its parts, rounded down; an entry without parts stays."""
    s, (parts, size, width) = settings, entries.shape

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = whole(batch.column("vector"), s)
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
        place = (codes + np.arange(parts) * size).ravel()
        used, where, counts = np.unique(place, return_inverse=True, return_counts=True)
        sums = np.zeros((len(used), width), np.int64)
        np.add.at(sums, where, x.reshape(-1, width))
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["place", "n", "sums"])

    found = map_batches(state.select("vector", "codes"), add, "place long, n long, sums array<bigint>")
    # components are added up as a struct's columns, so that every task adds before the shuffle
    exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(width)]
    out = entries.copy().reshape(parts * size, width)
    for r in found.groupBy("place").agg(F.sum("n").alias("n"), *exact).collect():
        out[r["place"]] = [int(r[f"d{d}"]) // r["n"] for d in range(width)]
    return out.reshape(entries.shape)


def digest(entries: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``compress`` with ``label_error``, the errors of all rows of the label (null is a label), and ``codebooks_sha256``."""
    rows, books = compress(df, settings, id_col, vec_col, label_col)
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    sums = staged(rows.groupBy(F.col("label").alias("of")).agg(total), "label-errors")
    out = rows.join(checked(sums), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books.history[-1])).alias("codebooks_sha256"), "scans")
