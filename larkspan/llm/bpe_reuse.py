"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text into chunks; passages that documents share give
the same chunks. The body of a chunk lies between its first and last place
where a blank follows a visible character: no token crosses such a place and no
rule looks across it, so a body's ids do not depend on its surroundings.

Shared bodies are encoded once and their ids reused, in two ways. Those that save
most, by their documents and lengths, go into a dictionary of bounded size that is
encoded beforehand and sent to all tasks. For the others, documents are dealt out by
the least key of their bodies, which copies and near copies have in common, and
each task remembers the bodies it has encoded, up to a bounded size; adaptive
execution splits what is dealt to one place too much.

The joins, that is all text between bodies, are encoded anew from one body's end to
the next body's start, over as many chunks as it takes to reach one; there the ids of
join and body agree, and all ids together are those of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, bpe
from .common import bounded, map_batches, shared, tidied

#: Rolling hash: chunks of about 2**BITS characters, LEAST at least and MOST at most.
BITS, LEAST, MOST = 10, 256, 16384
#: White space beyond ASCII, fixed values: a place after one of these is never a body's end.
WIDE_BLANKS = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
MIN_BODY = 64
#: Bodies in the dictionary, and bytes of ids that a task remembers besides.
DICTIONARY = 4096
REMEMBERED_BYTES = 16 << 20


def cuts(codes: np.ndarray) -> list[int]:
    """Ends of the chunks of a text given as code points, by a rolling hash over 16 of them."""
    h = (codes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x85EBCA6B)
    for width in (1, 2, 4, 8):  # h[i] sums the values of the last characters, each shifted by its age
        if len(h) > width:
            rolled = h.copy()
            rolled[width:] += h[:-width] << np.uint32(width)
            h = rolled
    ends, last = [], 0
    for at in np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            last = int(at)
            ends.append(last)
    while len(codes) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(codes):
        ends.append(len(codes))
    return ends


def bodies(text: str) -> list[tuple[int, int]]:
    """Character spans of the bodies of a text's chunks, in order."""
    if len(text) < MIN_BODY:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    before, at = codes[:-1], codes[1:]
    seen = (before > 0x20) & (before < 0x7F) | (before >= 0xC0) & ~np.isin(before, WIDE_BLANKS)
    safe = np.flatnonzero(seen & ((at == 32) | (at == 10))) + 1
    out, start = [], 0
    ends = cuts(codes)
    first = np.searchsorted(safe, [0, *ends[:-1]])
    last = np.searchsorted(safe, ends, side="right") - 1
    for a, b in zip(first, last):
        if a < b and safe[b] - safe[a] >= MIN_BODY:
            out.append((int(safe[a]), int(safe[b])))
    return out


def body_key(body: str) -> bytes:
    return hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=16).digest()


class Memory:
    """Ids by body: those of the dictionary for good, others until they fill the memory."""

    def __init__(self, dictionary: dict[bytes, bytes], vocab: Bpe) -> None:
        self.dictionary, self.vocab, self.own, self.held = dictionary, vocab, {}, 0

    def ids(self, body: str) -> np.ndarray:
        key = body_key(body)
        found = self.dictionary.get(key) or self.own.get(key)
        if found is not None:
            return np.frombuffer(found, np.int32)
        ids = self.vocab.encode(body)
        if self.held > REMEMBERED_BYTES:
            self.own, self.held = {}, 0
        self.own[key] = ids.tobytes()
        self.held += 4 * len(ids)
        return ids


def joined(text: str, memory: Memory) -> np.ndarray:
    """The ids of a whole text: bodies from memory, joins encoded anew."""
    ids, done = [], 0
    for start, end in bodies(text):
        ids += [memory.vocab.encode(text[done:start]), memory.ids(text[start:end])]
        done = end
    return np.concatenate([*ids, memory.vocab.encode(text[done:])])


Emit = Callable[[Iterator[np.ndarray], Bpe], list[pa.Array]]


def widely_shared(texts: DataFrame, path: str, size: int = DICTIONARY) -> dict[bytes, bytes]:
    """Ids of the ``size`` bodies whose reuse saves most characters, counted over all texts."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: dict[bytes, list[int]] = {}
        for text in batch.column("text").to_pylist():
            for key, chars in {body_key(text[a:b]): b - a for a, b in bodies(text)}.items():
                count.setdefault(key, [0, chars])[0] += 1
        made = [pa.array(count.keys(), pa.binary()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(made, ["key", "n", "chars"])

    counted = map_batches(texts, keys, "key binary, n long, chars long").groupBy("key").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))
    saves = (F.col("n") - 1) * F.col("chars")
    top = {bytes(r.key) for r in counted.where("n > 1").orderBy(saves.desc(), "key").limit(size).select("key").collect()}
    if not top:
        return {}
    wanted = shared(texts.sparkSession, top)

    def contents(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, some = {}, wanted()
        for text in batch.column("text").to_pylist():
            for a, b in bodies(text):
                key = body_key(text[a:b])
                if key in some:
                    found[key] = text[a:b]
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.string())], ["key", "body"])

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [bpe(path).encode(b).tobytes() for b in batch.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    once = map_batches(texts, contents, "key binary, body string").dropDuplicates(["key"])
    return {bytes(r.key): bytes(r.ids) for r in map_batches(once, encoded, "key binary, ids binary").collect()}


def encode_with(docs: DataFrame, path: str, emit: Emit, columns: str, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id and what ``emit(ids, vocab)`` makes of the ids of its whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    dictionary = shared(docs.sparkSession, widely_shared(rows.select("text"), path))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = [min((body_key(t[a:b])[:8] for a, b in bodies(t)), default=None) or body_key(t)[:8] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([int.from_bytes(k, "little", signed=True) for k in least], pa.int64())], [*batch.schema.names, "least"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe(path)
        memory = Memory(dictionary(), vocab)
        for batch in batches:
            for part in bounded(batch):
                texts = part.column("text").to_pylist()
                # special tokens are taken out of a text before anything else, so such a text is encoded as one
                ids = (vocab.encode(t) if vocab.has_special(t) else joined(t, memory) for t in texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), *emit(ids, vocab)], names)
        memory.dictionary, memory.own = {}, {}

    names = ["id"] + [c.split()[0] for c in columns.split(", ")]
    dealt = map_batches(rows, deal, f"id {id_type}, text string, least long").hint("rebalance", "least")
    return dealt.select("id", "text").mapInArrow(tidied(run), f"id {id_type}, {columns}").withColumnRenamed("id", id_col)


def _whole(ids: Iterator[np.ndarray], vocab: Bpe) -> list[pa.Array]:
    found = list(ids)
    lengths = np.array([len(i) for i in found], np.int64)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return [pa.array(lengths), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))]


def _whole_decoded(ids: Iterator[np.ndarray], vocab: Bpe) -> list[pa.Array]:
    found = list(ids)
    digests = [hashlib.sha256(vocab.decode(own.tolist()).encode("utf-8", "replace")).hexdigest() for own in found]
    return [*_whole(iter(found), vocab), pa.array(digests, pa.string())]


def _digest(ids: Iterator[np.ndarray], vocab: Bpe) -> list[pa.Array]:
    rows = []
    for own in ids:
        listed = own.tolist()
        sha = hashlib.sha256(vocab.listed(listed).encode()).hexdigest()
        rows.append((len(listed), sha, hashlib.sha256(vocab.decode(listed).encode("utf-8", "replace")).hexdigest()))
    return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens`` and ``ids`` (array of int) of the whole text.

    A null text counts as empty and has no ids. Repeated rows give a row each.
    Other columns are not read. ``path`` names a vocabulary file of the
    tokenizers library that every executor has.
    """
    return encode_with(docs, path, _whole, "n_tokens long, ids array<int>", id_col, text_col)


def encode_decoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with ``decoded_sha256``, the digest of the text decoded from the ids."""
    return encode_with(docs, path, _whole_decoded, "n_tokens long, ids array<int>, decoded_sha256 string", id_col, text_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with the digests of the ids and of the text decoded from them."""
    return encode_with(docs, path, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: id and ``text`` of its ids; null ids count as none."""
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = bpe(path)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([vocab.decode(i) for i in batch.column("ids").to_pylist()], pa.string())], ["id", "text"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
