"""Format-aware chunking of documents, one row in, many chunk rows out.

Plain text and Markdown are array expressions over the row itself: no line or
paragraph ever becomes a row of its own, so nothing is shuffled. A chunk is a
window into the word list, hence only word *counts* and a mark per line travel to
the Arrow functions that find the windows, and the words are copied once, into
the chunk they belong to.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANK, col, is_blank, let, lines, paragraphs, strip, words

TARGET_WORDS = 200
OVERLAP_WORDS = 40
MARKDOWN_MAX_WORDS = 300
MARKDOWN_EXTENSIONS = (".md", ".markdown")
PYTHON_EXTENSIONS = (".py",)
JSON_EXTENSIONS = (".json",)
#: Rows that are parsed before their parts are handed on.
PIECE = 500
KEYS = ("filename", "filepath", "extension")

_SPAN = "struct<start:int,stop:int>"


def packed_spans(counts: Column, target: int, overlap: int) -> Column:
    """Word spans of greedily packed paragraphs, given each paragraph's length.

    One Arrow pass over the lengths: the end of a span is looked up in their running
    sums, so the work grows with the paragraphs and spans, however long a text is.
    """

    @F.arrow_udf(f"array<{_SPAN}>")
    def pack(lengths: pa.Array) -> pa.Array:
        starts: list[int] = []
        stops: list[int] = []
        sizes: list[int | None] = []
        for own in _lists(lengths):
            if own is None:
                sizes.append(None)
                continue
            ends, before = np.cumsum(own, dtype=np.int64), len(starts)
            start = fresh = 0
            while fresh < len(ends):
                last = max(fresh, int(np.searchsorted(ends, start + target)))
                if last >= len(ends):
                    if ends[-1] > (ends[fresh - 1] if fresh else 0):
                        starts.append(start)
                        stops.append(int(ends[-1]))
                    break
                stop = int(ends[last])
                starts.append(start)
                stops.append(stop)
                start, fresh = max(start, stop - overlap), last + 1
            sizes.append(len(starts) - before)
        fields = [pa.field("start", pa.int32()), pa.field("stop", pa.int32())]
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], fields=fields)
        return _as_lists(sizes, spans)

    return pack(counts)


def _lists(values: pa.Array) -> Iterator[np.ndarray | None]:
    """The lists of a list array as views of its numbers."""
    numbers = values.values.to_numpy(zero_copy_only=False)
    for at, n, known in zip(values.offsets.to_numpy()[:-1], values.value_lengths().to_pylist(), values.is_valid().to_pylist()):
        yield numbers[at : at + n] if known else None


def _as_lists(sizes: list[int | None], values: pa.Array) -> pa.Array:
    """A list array of ``values`` cut into the given sizes; no size is null."""
    ends = np.cumsum([0, *(n or 0 for n in sizes)])
    offsets = [None if n is None else int(at) for n, at in zip(sizes, ends)] + [int(ends[-1])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def window_spans(n: Column, size: int, overlap: int) -> Column:
    """Spans of overlapping fixed windows over ``n`` words; none for 0 words."""
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    spans = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("stop")),
    )
    return F.when(n > 0, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _join_span(all_words: Column, span: Column) -> Column:
    return F.array_join(F.slice(all_words, span["start"] + 1, span["stop"] - span["start"]), " ")


def number_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """Explode chunk texts with a 1-based ``chunk_id`` in chunk order."""
    return df.select(*keep, F.posexplode(chunks).alias("_pos", "content")).select(
        *keep, (F.col("_pos") + 1).alias("chunk_id"), "content"
    )


def _others(df: DataFrame, content: str) -> list[str]:
    return [c for c in df.columns if c != content]


def packed_chunks(text: Column, sep: str, target: int, overlap: int) -> Column:
    """Chunk texts of one plain text; null stays null."""
    paras = F.transform(paragraphs(text, sep), lambda p: F.split(p, BLANK + "+"))
    spans = packed_spans(F.transform(paras, F.size), target, overlap)
    parts = F.struct(F.flatten(paras).alias("words"), spans.alias("spans"))
    return let(parts, lambda t: F.transform(t["spans"], lambda s: _join_span(t["words"], s)))


def chunk_text(
    df: DataFrame, content: str = "content", sep: str = "\n\n",
    target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS,
) -> DataFrame:
    """Paragraphs packed to about ``target`` words with trailing context."""
    return number_chunks(df, packed_chunks(F.col(content), sep, target, overlap), _others(df, content))


def _windows(all_words: Column, size: int, overlap: int, prefix: Column | None = None) -> Column:
    def text(span: Column) -> Column:
        joined = _join_span(all_words, span)
        return joined if prefix is None else F.concat(prefix, joined)

    return F.transform(window_spans(F.size(all_words), size, overlap), text)


def word_windows(
    df: DataFrame, content: str = "content", size: int = MARKDOWN_MAX_WORDS, overlap: int = OVERLAP_WORDS,
) -> DataFrame:
    """Overlapping windows over all words of a text."""
    return number_chunks(df, let(words(content), lambda w: _windows(w, size, overlap)), _others(df, content))


# --- Markdown ----------------------------------------------------------------

FENCE = r"^(?:```|~~~)"
HEADING = r"^#{1,4} "


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _open_headings(marks: pa.Array) -> pa.Array:
    """Positions of headings (1) with an even number of fences (2) before them, per text."""
    found = [None if own is None else np.flatnonzero((own == 1) & (np.cumsum(own == 2) % 2 == 0)) for own in _lists(marks)]
    positions = np.concatenate([f for f in found if f is not None] or [np.zeros(0, np.int64)])
    return _as_lists([None if f is None else len(f) for f in found], pa.array(positions.astype(np.int32)))


def section_starts(stripped: Column) -> Column:
    """Positions of heading lines that stand outside fenced code, in one Arrow pass over a mark per line."""
    return _open_headings(F.transform(
        stripped, lambda line: F.when(line.rlike(FENCE), 2).when(line.rlike(HEADING), 1).otherwise(0).cast("tinyint")
    ))


def _sections(text: Column) -> Column:
    """Array of (id, heading or null, stripped body) of one Markdown text."""

    def build(all_lines: Column, starts: Column) -> Column:
        n = F.size(all_lines)

        def section(start: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(starts, i), n)
            body = F.slice(all_lines, start + 2, stop - start - 1)
            return F.struct(
                i.alias("id"), F.when(start >= 0, strip(F.get(all_lines, start))).alias("heading"),
                strip(F.array_join(body, "\n")).alias("body"),
            )

        # Position -1 stands for the lead before the first heading.
        return F.transform(F.concat(F.array(F.lit(-1)), starts), section)

    starts = section_starts(F.transform(lines(text), strip))
    parts = F.struct(lines(text).alias("lines"), starts.alias("starts"))
    return let(parts, lambda t: build(t["lines"], t["starts"]))


def markdown_sections(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per section: ``section_id``, ``heading`` (null in a preamble), ``body``.

    The heading keeps its marks; a lead without heading is section 0 and is
    left out when the text starts with a heading.
    """
    keep = _others(df, content)
    first = lines(content)
    starts_with_heading = F.coalesce(strip(F.get(first, F.lit(0))).rlike(HEADING), F.lit(True))
    rows = df.select(
        *keep, starts_with_heading.alias("_no_lead"), F.inline(_sections(F.col(content)))
    )
    return rows.filter((F.col("id") > 0) | ~F.col("_no_lead")).select(
        *keep, F.col("id").alias("section_id"), "heading", "body"
    )


def markdown_chunks(text: Column, max_words: int, overlap: int) -> Column:
    """Chunk texts of one Markdown text."""

    def render(full: Column, full_words: Column, heading: Column) -> Column:
        of_heading = F.size(words(heading))
        body_words = F.slice(full_words, of_heading + 1, F.size(full_words) - of_heading)
        prefix = F.when(heading == "", "").otherwise(F.concat(heading, F.lit("\n")))
        return F.when(F.size(full_words) <= max_words, F.array(full)).otherwise(
            let(body_words, lambda w: _windows(w, max_words, overlap, prefix))
        )

    def contents(section: Column) -> Column:
        heading, body = F.coalesce(section["heading"], F.lit("")), section["body"]
        full = F.when(heading == "", body).otherwise(strip(F.concat(heading, F.lit("\n"), body)))
        return let(full, lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(
            let(words(text), lambda w: render(text, w, heading))
        ))

    return F.flatten(F.transform(_sections(text), contents))


def chunk_markdown(
    df: DataFrame, content: str = "content", max_words: int = MARKDOWN_MAX_WORDS, overlap: int = OVERLAP_WORDS,
) -> DataFrame:
    """One chunk per section; a long section becomes windows under its heading."""
    chunks = markdown_chunks(F.col(content), max_words, overlap)
    return number_chunks(df.filter(~is_blank(content)), chunks, _others(df, content))


# --- JSON and Python ---------------------------------------------------------


def json_entries(text: str) -> list[str] | None:
    """One text per top-level key; ``None`` when the root is no object."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    return [f'"{key}"\n\n{json.dumps(value, indent=2, ensure_ascii=False)}' for key, value in root.items()]


def statement_spans(text: str) -> list[tuple[str, int, int]] | None:
    """Kind, first and last line of every top-level statement; ``None`` when not parseable."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    kinds = {ast.Import: "import", ast.ImportFrom: "import", ast.FunctionDef: "define", ast.AsyncFunctionDef: "define", ast.ClassDef: "define"}
    # a definition begins with its first decorator
    return [(kinds.get(type(n), "run"), min(p.lineno for p in (n, *getattr(n, "decorator_list", ()))), n.end_lineno) for n in body]


def python_chunks(text: Column, spans: Column) -> Column:
    """Chunk texts from the spans of the statements: imports together, each definition, the rest together.

    The lines are cut and joined here; null where there are no statements.
    """

    def cut(all_lines: Column, span: Column) -> Column:
        taken = F.slice(all_lines, span["first"], span["last"] - span["first"] + 1)
        return F.rtrim(F.array_join(taken, "\n"), F.lit("\n"))

    def together(all_lines: Column, kind: str, title: str, between: str) -> Column:
        parts = F.transform(F.filter(spans, lambda s: s["kind"] == kind), lambda s: cut(all_lines, s))
        joined = F.concat(F.lit(title), F.array_join(parts, between))
        return F.when(F.size(parts) > 0, F.array(joined)).otherwise(F.array().cast("array<string>"))

    chunks = let(lines(text), lambda all_lines: F.concat(
        together(all_lines, "import", "# imports\n", "\n"),
        F.transform(F.filter(spans, lambda s: s["kind"] == "define"), lambda s: cut(all_lines, s)),
        together(all_lines, "run", "# __main__\n", "\n\n"),
    ))
    return F.when(F.size(spans) > 0, chunks)


_PARSED = T.StructType([
    T.StructField("entries", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
    ]))),
])


@F.pandas_udf(_PARSED)
def _parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Entries of JSON texts and statement spans of Python texts; null where a text does not parse."""
    # a batch is answered in pieces, so what is made of it is never in memory whole
    pieces = ((kinds[at : at + PIECE], texts[at : at + PIECE]) for kinds, texts in batches for at in range(0, max(1, len(texts)), PIECE))
    for kinds, texts in pieces:
        known = [None if t is None else k for k, t in zip(kinds, texts)]
        yield pd.DataFrame({
            "entries": pd.Series([json_entries(t) if k == "json" else None for k, t in zip(known, texts)], dtype=object),
            "spans": pd.Series([
                [{"kind": a, "first": b, "last": c} for a, b, c in found] if found is not None else None
                for found in (statement_spans(t) if k == "python" else None for k, t in zip(known, texts))
            ], dtype=object),
        })


def _number_parsed(
    rows: DataFrame, content: str, sep: str, kind: Column, markdown: Column | None = None, flag: str | None = None,
) -> DataFrame:
    """One pass for all formats: a row that does not parse is packed as plain text, which ``flag`` tells."""
    keep = _others(rows, content)
    # Only texts of a parsed format travel to Python.
    handed = F.when(kind.isNotNull(), F.col(content))
    parsed = rows.filter(~is_blank(content)).withColumn("_parts", _parsed(kind, handed))
    found = F.coalesce(F.col("_parts")["entries"], python_chunks(F.col(content), F.col("_parts")["spans"]))
    chunks = F.coalesce(found, packed_chunks(F.col(content), sep, TARGET_WORDS, OVERLAP_WORDS))
    if markdown is not None:
        special = markdown_chunks(F.col(content), MARKDOWN_MAX_WORDS, OVERLAP_WORDS)
        chunks = F.when(markdown, special).otherwise(chunks)
    if flag is not None:
        both = F.col("_parts")["entries"].isNull() & F.col("_parts")["spans"].isNull()
        parsed, keep = parsed.withColumn(flag, kind.isNull() | ~both), [*keep, flag]
    return number_chunks(parsed, chunks, keep)


def chunk_json(df: DataFrame, content: str = "content", sep: str = "\n\n") -> DataFrame:
    """One chunk per top-level key, pretty-printed; other text is packed."""
    return _number_parsed(df, content, sep, F.lit("json"))


def chunk_python(df: DataFrame, content: str = "content", sep: str = "\n\n") -> DataFrame:
    """Imports, each function or class, the rest; unparseable text is packed."""
    return _number_parsed(df, content, sep, F.lit("python"))


def chunk_documents(
    df: DataFrame, content: str = "content", extension: str = "extension", sep: str = "\n\n", flag: str | None = None,
) -> DataFrame:
    """Dispatch by extension inside each row, so the documents are read once.

    ``flag`` names a further column, false where a JSON or Python text did not parse.
    """
    ext = F.lower(F.coalesce(col(extension), F.lit("")))
    kind = F.when(ext.isin(*JSON_EXTENSIONS), "json").when(ext.isin(*PYTHON_EXTENSIONS), "python")
    return _number_parsed(df, content, sep, kind, ext.isin(*MARKDOWN_EXTENSIONS), flag)
