"""Token counts of fields and sections: whole documents are encoded once, tokens go to sections by their spans.

The ids of a byte-level vocabulary give the bytes of every token, so the tokens'
character spans follow from the ids alone. They are joined with the spans of the
sections, both in order. A token that lies in several sections is allocated by a rule:

``majority``  to the section with most of its characters, the earlier one if equal
``start``     to the section of its first character
``end``       to the section of its last character

Besides whole tokens, every section gets its exact share: a token's characters
divided among its sections. Characters outside every section belong to section -1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, bpe
from .common import map_batches

RULES = ("majority", "start", "end")
Sections = Callable[[str], list[tuple[int, int]]]


def token_spans(text: str, vocab: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of every token; parts of one character share its span."""
    ids = vocab.encode(text)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(vocab.lengths[ids])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[np.concatenate([[0], ends[:-1]])], char[ends - 1] + 1


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines with their line feed: they tile the text."""
    out, start = [], 0
    while start < len(text):
        end = text.find("\n", start) + 1 or len(text)
        out.append((start, end))
        start = end
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str) -> list[tuple[int, int, int, int, int, float]]:
    """(section, start, end, tokens, crossing tokens, share of tokens) for the sections in order.

    Sections must be in order and not overlap. A row for section -1 follows if
    tokens have characters outside. Crossing tokens are those that also lie elsewhere.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}, known are {', '.join(RULES)}")
    spans = np.array(sections, np.int64).reshape(-1, 2)
    if (np.diff(spans.reshape(-1)) < 0).any():
        raise ValueError("sections overlap or are out of order")
    filled = np.flatnonzero(spans[:, 0] < spans[:, 1])
    edges = spans[filled].reshape(-1)
    # tile the text: the i-th section with characters is tile 2i + 1, the gap before it tile 2i
    n = len(filled)
    first = np.searchsorted(edges, starts, side="right")
    last = np.searchsorted(edges, ends - 1, side="right")
    tokens, crossing, share, outside = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1), 0
    inside = first == last
    np.add.at(tokens, first[inside], 1)
    np.add.at(share, first[inside], 1.0)
    bounds = np.concatenate([[np.iinfo(np.int64).min], edges, [np.iinfo(np.int64).max]])
    for i in np.flatnonzero(~inside):
        tiles = np.arange(first[i], last[i] + 1)
        held = np.minimum(bounds[tiles + 1], ends[i]) - np.maximum(bounds[tiles], starts[i])
        tiles, held = tiles[held > 0], held[held > 0]
        share[tiles] += held / held.sum()
        if len(tiles) > 1:
            crossing[tiles] += 1
            outside += bool((tiles % 2 == 0).any())
        tokens[{"majority": tiles[int(held.argmax())], "start": tiles[0], "end": tiles[-1]}[rule]] += 1
    out = [(i, a, b, 0, 0, 0.0) for i, (a, b) in enumerate(sections)]
    for k, i in enumerate(filled):
        out[i] = (*out[i][:3], int(tokens[2 * k + 1]), int(crossing[2 * k + 1]), float(share[2 * k + 1]))
    if share[::2].any():
        out.append((-1, None, None, int(tokens[::2].sum()), outside, float(share[::2].sum())))
    return out


COLUMNS = "section int, start_char long, end_char long, n_tokens long, n_crossing long, token_share double, doc_tokens long"
TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())


def attribute_sections(docs: DataFrame, path: str, rule: str = "majority", sections: Sections = line_sections, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section: id, ``section``, its characters, ``n_tokens``, ``n_crossing``, ``token_share``, ``doc_tokens``.

    ``n_tokens`` of a document's sections add up to ``doc_tokens``, the tokens of the
    whole text. A document without sections, null and empty texts among them,
    has one row of section -1. Repeated rows are counted each; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab, owner, out = bpe(path), [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            starts, ends = token_spans(text or "", vocab)
            rows = allocate(starts, ends, sections(text or ""), rule) or [(-1, None, None, 0, 0, 0.0)]
            owner += [i] * len(rows)
            out += [(*r, len(starts)) for r in rows]
        ids = batch.column("id").take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*out), TYPES)]], ["id"] + [c.split()[0] for c in COLUMNS.split(", ")])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}").withColumnRenamed("id", id_col)


def attribute_fields(docs: DataFrame, path: str, fields: list[str], separator: str = "\n", rule: str = "majority", id_col: str = "doc_id") -> DataFrame:
    """One row per document and field: the fields are joined by a separator and encoded as one text.

    Columns as in :func:`attribute_sections` and ``field``, the field's name. A null
    field is empty; an empty field has its row with no tokens. Separators belong to no
    field: their tokens are in the row of section -1, whose field is null.
    """
    spans = [f"field_{i}" for i in range(len(fields))]
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(s) for f, s in zip(fields, spans)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab, owner, out = bpe(path), [], []
        for i, values in enumerate(zip(*[batch.column(s).to_pylist() for s in spans])):
            at, places = 0, []
            for v in values:
                places.append((at, at + len(v)))
                at += len(v) + len(separator)
            starts, ends = token_spans(separator.join(values), vocab)
            rows = allocate(starts, ends, places, rule)
            owner += [i] * len(rows)
            out += [(*r, len(starts), fields[r[0]] if r[0] >= 0 else None) for r in rows]
        ids = batch.column("id").take(pa.array(owner, pa.int64()))
        names = ["id"] + [c.split()[0] for c in COLUMNS.split(", ")] + ["field"]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*out), (*TYPES, pa.string()))]], names)

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}, field string").withColumnRenamed("id", id_col)
