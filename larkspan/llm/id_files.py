"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

Ids are coded in blocks that start from a fresh model. The model predicts an id
from the last two ids (order 2) and from the last one (order 1), each by the id
that followed there last and a confidence. Adaptive estimates of which prediction
holds are kept for every pair of confidences and, without context, for the
block as a whole; the two are mixed with a weight that moves to the one that has
done better. If neither prediction holds, the id is coded by adaptive counts of
its size class (order 0) and the rest of its bits. All arithmetic is in whole
numbers, so every machine decodes the same.

Blocks do not depend on each other, so numpy codes many of them in step. What the
predictions are is found for whole blocks by sorting when ids are written, and id by
id when they are read.

A file is a Parquet row set: one row per segment of whole documents, with its
part, its place in the part, the documents' ids and token counts and the coded
blocks, each with its length, its size and the CRC-32 of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import bounded, small_table, tidied

BLOCK = 1024
#: Ids of one segment (whole documents, so a long document makes a longer one) and blocks coded in step.
SEGMENT, LANES = 1 << 18, 8192
#: Blocks looked through at a time when they are written, and copied from steps to blocks when they are read.
TOGETHER = 32
SLOT_BITS = 9
MAX_BITS = 20
HEAD = "<III"
#: Frequencies add up to 2**12; counts of size classes are made into frequencies every so many ids.
SCALE, REFRESH = 12, 32
U = np.uint32


class Mixture:
    """What the predictions of many blocks are worth; lane i belongs to block i."""

    def __init__(self, lanes: int, bits: int) -> None:
        self.lanes, self.classes = lanes, bits + 1
        self.base16 = np.arange(lanes, dtype=np.int64) * 16
        # estimates (of 65536) that order 2 holds, low half, and that only order 1 holds, high half
        self.by_context = np.full(lanes * 16, 2048 | 2048 << 16, U)
        self.two_holds, self.one_holds = np.full(lanes, 2048, U), np.full(lanes, 2048, U)
        # narrow where the numbers are small; a block's counts stay below 2**16
        self.weight = np.full(lanes, 8, np.uint8)
        self.counts = np.ones((self.classes, lanes), np.uint16)
        self.cum = np.zeros((self.classes + 1, lanes), np.uint16)

    def refresh(self, step: int) -> None:
        """Frequencies of the size classes from their counts, more often in the beginning."""
        if step % REFRESH and step & (step - 1):
            return
        sums = np.cumsum(self.counts, axis=0, dtype=np.uint16)
        shares = sums * U((1 << SCALE) - self.classes) // sums[-1]
        np.add(shares, np.arange(1, self.classes + 1, dtype=U)[:, None], out=self.cum[1:], casting="unsafe")

    def predict(self, n: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies that order 2 holds and that only order 1 holds, for the first n lanes.

        A context is four times the confidence of order 2 plus that of order 1.
        """
        self.at = self.base16[:n] + contexts
        self.both = self.by_context.take(self.at, mode="clip")
        self.q2 = self.both & 0xFFFF
        w = self.weight[:n].astype(U)
        v = 16 - w
        p2 = (self.q2 * w + self.two_holds[:n] * v) >> 4
        p1 = ((self.both >> 16) * w + self.one_holds[:n] * v) >> 4
        top = U((1 << SCALE) - 16)
        return (p2 * top >> 16) + 1, (p1 * top >> 16) + 1

    def learn(self, n: int, hit2: np.ndarray, hit1: np.ndarray) -> None:
        g2, g1, w = self.two_holds[:n], self.one_holds[:n], self.weight[:n]
        w += ((self.q2 > g2) == hit2).view(np.uint8) << 1
        w -= 1
        np.minimum(w, 15, out=w)
        np.maximum(w, 1, out=w)
        # both halves at once
        self.by_context[self.at] = self.both - (self.both >> 5 & 0x07FF07FF) + (hit2 + hit1 * U(1 << 16)) * U(2047)
        g2 -= g2 >> 6
        g2 += hit2 * U(1023)
        g1 -= g1 >> 6
        g1 += hit1 * U(1023)

    def parts(self, hit2: np.ndarray, hit1: np.ndarray, held: np.ndarray, f2: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of the range begins that stands for what happened, and its frequency."""
        both, missed = f2 + f1, ~held
        return f2 * hit1 + both * missed, f2 * hit2 + f1 * hit1 + (U(1 << SCALE) - both) * missed


class Followers:
    """The ids that followed the last ids of many blocks, for a reader that gets one id after the other."""

    def __init__(self, lanes: int) -> None:
        # an entry holds the id that followed, plus one, and two bits of confidence
        self.one, self.two = np.zeros(lanes << SLOT_BITS, U), np.zeros(lanes << SLOT_BITS, U)
        self.prev, self.prev2 = np.zeros(lanes, U), np.zeros(lanes, U)
        self.base = np.arange(lanes, dtype=np.int64) << SLOT_BITS

    def look(self, n: int) -> np.ndarray:
        """The contexts of the first n lanes; ``next2`` and ``next1`` are the ids expected, plus one."""
        slot1, slot2 = slots(self.prev[:n], self.prev2[:n])
        self.at1, self.at2 = self.base[:n] + slot1, self.base[:n] + slot2
        e1, e2 = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        self.c1, self.c2 = e1.astype(np.uint8) & 3, e2.astype(np.uint8) & 3
        self.next1, self.next2 = e1 >> 2, e2 >> 2
        return self.c2 * 4 + self.c1

    def learn(self, n: int, ids: np.ndarray, plus_one: np.ndarray, hit2: np.ndarray) -> None:
        entry = plus_one << 2
        self.one[self.at1] = entry | np.minimum(self.c1 * (plus_one == self.next1) + 1, 3)
        self.two[self.at2] = entry | np.minimum(self.c2 * hit2 + 1, 3)
        self.prev2[:n] = self.prev[:n]
        self.prev[:n] = ids


def slots(prev: np.ndarray, prev2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the last id, and of the last two."""
    mixed = prev * U(0x9E3779B1)
    return mixed >> (32 - SLOT_BITS), (prev2 * U(0x85EBCA6B) + mixed * U(0xC2B2AE35)) >> (32 - SLOT_BITS)


def followed(ids: np.ndarray) -> np.ndarray:
    """What ``Followers`` would find at every id of whole blocks (rows): the context, 16 if order 2 holds, 32 if order 1 does.

    Sorted by slot and step, an id's expectation is the one before it.
    """
    lanes, steps = ids.shape
    prev, prev2 = np.zeros_like(ids), np.zeros_like(ids)
    prev[:, 1:], prev2[:, 2:] = ids[:, :-1], ids[:, :-2]
    room = max(steps - 1, 1).bit_length()
    flat, rows = ids.reshape(-1), (np.arange(lanes, dtype=np.int64) * steps)[:, None]
    out = np.zeros(ids.shape, np.uint8)
    for slot, worth, held in zip(slots(prev, prev2), (1, 4), (32, 16)):
        order = slot << room | np.arange(steps, dtype=U)
        order.sort(axis=1)
        at = rows + (order & U((1 << room) - 1))
        order >>= room
        sorted_ids = flat.take(at, mode="clip")
        known = (order[:, 1:] == order[:, :-1]).view(np.uint8)
        hit = np.zeros(ids.shape, np.uint8)
        np.multiply(known, sorted_ids[:, 1:] == sorted_ids[:, :-1], out=hit[:, 1:])
        # confidence is 1 after a miss, 2 after one hit and 3 after more
        again = known * hit[:, :-1]
        found = hit * np.uint8(held)
        found[:, 1:] += (known + again) * np.uint8(worth)
        found[:, 2:] += again[:, 1:] * hit[:, :-2] * np.uint8(worth)
        back = np.empty(ids.shape, np.uint8)
        back.reshape(-1)[at] = found
        out += back
    return out


def digit_bits(shift: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """The bits of an id after its size class, at most 16 at a time: a range may hold no more."""
    if classes <= 17:
        return (shift,)
    high = np.maximum(shift, U(16)) - U(16)
    return (high, shift - high)


class Encoder:
    """Range coder of many lanes. A digit may get a carry later, so digits are kept wide until the end.

    Lanes go on at about the same pace, so their digits of one place lie side by side.
    """

    def __init__(self, lanes: int, room: int) -> None:
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFF, U)
        self.digits, self.lanes = np.zeros(room * lanes, U), lanes
        self.at = np.arange(lanes, dtype=np.int64)

    def put(self, n: int, shift: np.ndarray | U, cum: np.ndarray, freq: np.ndarray) -> None:
        """Code the part [cum, cum + freq) of 2**shift; shift 0, cum 0 and freq 1 code nothing."""
        unit = self.range[:n] >> shift
        more = unit * cum
        low = self.low[:n] + more
        rng = unit * freq
        # a sum beyond 32 bits is less than what was added
        over = (low < more).nonzero()[0]
        if len(over):
            self.digits[self.at[:n][over] - self.lanes] += U(1)
        m = (rng < 65536).nonzero()[0]
        part, at = low[m], self.at[m]
        self.digits[at] = part >> U(16)
        self.at[m] = at + self.lanes
        low[m] = part << U(16)
        rng[m] <<= U(16)
        self.low[:n], self.range[:n] = low, rng

    def put_at(self, rows: np.ndarray, parts: list[tuple[U | np.ndarray, np.ndarray, np.ndarray | U]]) -> None:
        """Code the given (shift, cum, freq) one after the other, for some lanes only."""
        low, rng, places = self.low[rows], self.range[rows], self.at[rows]
        for shift, cum, freq in parts:
            unit = rng >> shift
            more = unit * cum
            low += more
            rng = unit * freq
            over = (low < more).nonzero()[0]
            if len(over):
                self.digits[places[over] - self.lanes] += U(1)
            due = (rng < 65536).nonzero()[0]
            part, at = low[due], places[due]
            self.digits[at] = part >> U(16)
            places[due] = at + self.lanes
            low[due] = part << U(16)
            rng[due] <<= U(16)
        self.low[rows], self.range[rows], self.at[rows] = low, rng, places

    def finish(self) -> list[np.ndarray]:
        for part in (self.low >> U(16), self.low & U(0xFFFF)):
            self.digits[self.at] = part
            self.at += self.lanes
        used = self.at // max(self.lanes, 1)
        # few digits hold a carry that is still to be passed on
        digits = self.digits[: int(used.max(initial=0)) * self.lanes]
        over = (digits > 0xFFFF).nonzero()[0]
        while len(over):
            digits[over] &= U(0xFFFF)
            over -= self.lanes
            digits[over] += U(1)
            over = over[digits[over] > 0xFFFF]
        table, out = digits.reshape(-1, max(self.lanes, 1)), []
        for first in range(0, self.lanes, TOGETHER):
            some = np.ascontiguousarray(table[:, first : first + TOGETHER].T, "<u2")
            out += [own[:n].copy() for own, n in zip(some, used[first : first + TOGETHER])]
        return out


class Decoder:
    def __init__(self, words: list[np.ndarray]) -> None:
        lanes, room = len(words), max(map(len, words)) + 4
        table = np.zeros((lanes, room), np.uint16)
        for i, w in enumerate(words):
            table[i, : len(w)] = w
        self.words, self.last = table.ravel(), lanes * room - 1
        self.range, self.code = np.full(lanes, 0xFFFFFFFF, U), table[:, 0].astype(U) << U(16) | table[:, 1]
        self.at = np.arange(lanes, dtype=np.int64) * room + 2

    def decided(self, n: int, shift: U, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the code lies below ``first`` and below ``second`` of 2**shift."""
        self.unit = self.range[:n] >> shift
        code = self.code[:n]
        return code < self.unit * first, code < self.unit * second

    def take(self, n: int, cum: np.ndarray, freq: np.ndarray) -> None:
        code, rng = self.code[:n] - self.unit * cum, self.unit * freq
        m = (rng < 65536).nonzero()[0]
        at = self.at[m]
        code[m] = code[m] << U(16) | self.words.take(at, mode="clip")
        self.at[m] = at + 1
        rng[m] <<= U(16)
        self.code[:n], self.range[:n] = code, rng

    def escaped(self, rows: np.ndarray, model: Mixture, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the size class among the counts and the id plus one, for some of the first n lanes."""
        code, rng, places = self.code[rows], self.range[rows], self.at[rows]
        unit = rng >> U(SCALE)
        targets = np.zeros(n, np.uint16)
        targets[rows] = np.minimum(code // unit, U((1 << SCALE) - 1))
        # the last class whose cumulative frequency is not beyond the target
        size = np.add.reduce((model.cum[1 : model.classes, :n] <= targets).view(np.uint8), axis=0, dtype=np.uint8)[rows]
        at = size * np.int64(model.lanes) + rows
        table = model.cum.reshape(-1)
        cum = table.take(at, mode="clip")
        freq, size, plus_one = table.take(at + model.lanes, mode="clip") - cum, size.astype(U), U(1)
        for shift in (None, *digit_bits(size, model.classes)):
            if shift is not None:
                unit = rng >> shift
                cum, freq = np.minimum(code // unit, (U(1) << shift) - U(1)), U(1)
                plus_one = plus_one << shift | cum
            code, rng = code - unit * cum, unit * freq
            due = (rng < 65536).nonzero()[0]
            ahead = places[due]
            code[due] = code[due] << U(16) | self.words.take(ahead, mode="clip")
            places[due] = ahead + 1
            rng[due] <<= U(16)
        self.code[rows], self.range[rows], self.at[rows] = code, rng, places
        return at, plus_one


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Coded blocks of at most ``BLOCK`` ids below 2**bits, with their heads."""
    if bits > MAX_BITS:
        raise ValueError(f"ids of more than {MAX_BITS} bits")
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    steps, lanes = int(sizes.max(initial=0)), len(blocks)
    if steps > BLOCK:
        raise ValueError(f"a block of more than {BLOCK} ids")
    plus_ones, states = np.ones((steps, lanes), U), np.zeros((steps, lanes), np.uint8)
    for first in range(0, lanes, TOGETHER):
        some = np.zeros((min(TOGETHER, lanes - first), steps), U)
        for row, i in zip(some, order[first : first + TOGETHER]):
            row[: len(blocks[i])] = blocks[i]
        states[:, first : first + TOGETHER] = followed(some).T
        plus_ones[:, first : first + TOGETHER] += some.T
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")
    model, coder = Mixture(lanes, bits), Encoder(lanes, 3 * steps + 4)
    size_of = (np.frexp(np.arange((1 << bits) + 1, dtype=np.float64))[1] - 1).astype(np.uint8)
    table, counts = model.cum.reshape(-1), model.counts.reshape(-1)
    for t in range(steps):
        n = int(live[t])
        state = states[t, :n]
        model.refresh(t)
        f2, f1 = model.predict(n, state & 15)
        hit2, held = state & 16 != 0, state >= 16
        hit1 = held & ~hit2
        coder.put(n, U(SCALE), *model.parts(hit2, hit1, held, f2, f1))
        rows = (~held).nonzero()[0]
        if len(rows):
            escaped = plus_ones[t].take(rows, mode="clip")
            size = size_of.take(escaped, mode="clip")
            at = size * np.int64(lanes) + rows
            cum = table.take(at, mode="clip")
            freq = table.take(at + lanes, mode="clip") - cum
            counts[at] += 24
            left = size.astype(U)
            rest, parts = escaped - (U(1) << left), [(U(SCALE), cum, freq)]
            for shift in digit_bits(left, model.classes):
                left = left - shift
                parts.append((shift, rest >> left, U(1)))
                rest = rest & ((U(1) << left) - U(1))
            coder.put_at(rows, parts)
        model.learn(n, hit2, hit1)
    out: list[bytes] = [b""] * lanes
    for words, i in zip(coder.finish(), order):
        out[i] = struct.pack(HEAD, len(blocks[i]), len(words), zlib.crc32(blocks[i].astype("<u4"))) + words.tobytes()
    return out


def split_blocks(payload: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(ids, CRC-32, words) of the coded blocks of a segment."""
    out, at = [], 0
    while at < len(payload):
        n, words, crc = struct.unpack_from(HEAD, payload, at)
        at += struct.calcsize(HEAD)
        if at + 2 * words > len(payload):
            raise ValueError("a block is cut short")
        out.append((n, crc, np.frombuffer(payload, "<u2", words, at)))
        at += 2 * words
    return out


def decode_blocks(blocks: list[tuple[int, int, np.ndarray]], bits: int) -> list[np.ndarray]:
    """The ids of coded blocks; a block whose checksum differs is an error."""
    if not blocks:
        return []
    # a damaged block may bring a range down to 0; its checksum tells
    with np.errstate(divide="ignore"):
        return _decoded(blocks, bits)


def _decoded(blocks: list[tuple[int, int, np.ndarray]], bits: int) -> list[np.ndarray]:
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    sizes = np.array([blocks[i][0] for i in order], np.int64)
    steps, lanes = int(sizes.max(initial=0)), len(blocks)
    ids = np.zeros((steps, lanes), U)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")
    model, last, coder = Mixture(lanes, bits), Followers(lanes), Decoder([blocks[i][2] for i in order])
    counts = model.counts.reshape(-1)
    for t in range(steps):
        n = int(live[t])
        model.refresh(t)
        f2, f1 = model.predict(n, last.look(n))
        hit2, held = coder.decided(n, U(SCALE), f2, f2 + f1)
        hit1 = held & ~hit2
        coder.take(n, *model.parts(hit2, hit1, held, f2, f1))
        plus_one = np.where(hit2, last.next2, last.next1)
        rows = (~held).nonzero()[0]
        if len(rows):
            at, plus_one[rows] = coder.escaped(rows, model, n)
            counts[at] += 24
        now = np.subtract(plus_one, U(1), out=ids[t, :n])
        model.learn(n, hit2, hit1)
        last.learn(n, now, plus_one, hit2)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(blocks)
    for first in range(0, lanes, TOGETHER):
        some = np.ascontiguousarray(ids[:, first : first + TOGETHER].T, "<u4")
        for row, i in zip(some, order[first : first + TOGETHER]):
            found = row[: blocks[i][0]]
            if zlib.crc32(found) != blocks[i][1]:
                raise ValueError("a block's checksum differs")
            out[i] = found
    return out


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` and write the ids in ascending order of document ids.

    Parts are ranges of document ids; a null id comes first. A null text counts as
    empty: its only id is the end id. An empty table gives a folder without segments.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # repeated ids are told apart by their texts, so that one id does not fill one part
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    id_type = rows.schema["id"].dataType

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part = bpe(path), TaskContext.get().partitionId()
        bits = max(int(len(vocab.lengths)).bit_length(), 1) if vocab.ranks is not None else MAX_BITS
        made = first = held = waiting = 0
        segments: list[tuple[list, list[int], list[np.ndarray]]] = []
        names, counts, ids = [], [], []
        arrow_type = None

        def close() -> None:
            nonlocal names, counts, ids
            if names:
                segments.append((names, counts, ids))
                names, counts, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal made, first, segments
            blocks, spans = [], []
            for _, _, own in segments:
                whole = np.concatenate(own)
                cut = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
                spans.append((len(blocks), len(blocks) + len(cut)))
                blocks += cut
            coded = encode_blocks(blocks, bits)
            out = []
            for (own_names, own_counts, _), (a, b) in zip(segments, spans):
                out.append((part, made, first, bits, own_names, own_counts, b"".join(coded[a:b])))
                made, first = made + 1, first + sum(own_counts)
            segments = []
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(arrow_type), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["part", "segment", "first", "bits", "ids", "counts", "payload"])

        for batch in batches:
            arrow_type = batch.schema.field("id").type
            for some in bounded(batch, 16 << 20):
                for name, found in zip(some.column("id").to_pylist(), vocab.encode_all(some.column("text").to_pylist())):
                    own = np.append(found, np.int32(end_id))
                    names.append(name), counts.append(len(own)), ids.append(own)
                    held += len(own)
                    if held >= SEGMENT:
                        close()
                        waiting, held = waiting + held, 0
                        if waiting >= LANES * BLOCK:
                            yield flush()
                            waiting = 0
        close()
        if segments:
            yield flush()

    kind = id_type.simpleString()
    coded = ordered.select("id", "text").mapInArrow(tidied(code), f"part int, segment long, first long, bits int, ids array<{kind}>, counts array<bigint>, payload binary")
    coded.write.mode("errorifexists").option("compression", "uncompressed").parquet(folder)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``id``, ``start``, ``n_tokens``, ``ids_crc32``, and the ids if asked for.

    ``start`` counts the ids of all documents before it. The sums per part, one row
    for each, are the only thing that goes through the driver.
    """
    segments = spark.read.parquet(folder)
    ids_in = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = segments.groupBy("part").agg(F.sum(ids_in).alias("n")).orderBy("part").collect()
    before, seen = [], 0
    for r in totals:
        before.append((r.part, seen))
        seen += r.n
    offsets = small_table(spark, part=pa.array([p for p, _ in before], pa.int32()), before=pa.array([b for _, b in before], pa.int64()))
    placed = segments.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("first")).alias("first"), "bits", "ids", "counts", "payload")
    id_type = segments.schema["ids"].dataType.elementType

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in bounded(batch, 16 << 20):
                cols = [some.column(c).to_pylist() for c in ("first", "bits", "ids", "counts", "payload")]
                split = [split_blocks(p) for p in cols[4]]
                arrow_type = some.schema.field("ids").type.value_type
                for bits in sorted(set(cols[1])):
                    mine = [i for i, b in enumerate(cols[1]) if b == bits]
                    flat = [b for i in mine for b in split[i]]
                    done = iter(d for at in range(0, len(flat), LANES) for d in decode_blocks(flat[at : at + LANES], bits))
                    out = []
                    for i in mine:
                        whole = np.concatenate([next(done) for _ in split[i]])
                        ends = np.cumsum(cols[3][i])
                        for name, n, end in zip(cols[2][i], cols[3][i], ends):
                            own = whole[end - n : end]
                            out.append((name, cols[0][i] + int(end) - n, n, zlib.crc32(own)) + ((own.astype(np.int64),) if with_ids else ()))
                    types = (arrow_type, pa.int64(), pa.int64(), pa.int64()) + ((pa.list_(pa.int64()),) if with_ids else ())
                    names = ["id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = f"id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return placed.mapInArrow(tidied(decode), schema)
