"""Quality rules with line labels from a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and repeated word windows of the
whole text. The lines of a text, those without a word left out, are a chain
whose states are content and boilerplate; the Viterbi path of a conditional
random field labels them, and the share of word characters on content lines
decides whether the document is kept.

The field's weights are trained in numpy on a bounded sample of documents. Its
lines are labelled in part: evident content and evident boilerplate by the seed
rules below, the others not at all; training maximises the likelihood of the
evident labels, summed over all labels of the other lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .near_dedup import mix64

CONTENT, BOILERPLATE = 0, 1
SYMBOLS = "#*$%&|<>"
#: Wording of notices, menus and links.
NOTICE = regex.compile(
    r"https?://|www\.|©|\bcopyright\b|\ball rights reserved\b|\blicen[cs]ed?\b|\bprivacy policy\b|\bterms of (?:use|service)\b"
    r"|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b|\bclick here\b|\bread more\b|\bshare (?:this|on)\b|\badvertisement\b",
    regex.IGNORECASE)
ENDINGS = np.array([ord(c) for c in ".!?…。！？\"”»"], np.uint32)
TABLE = np.zeros(128, np.uint8)
for c in SYMBOLS:
    TABLE[ord(c)] |= 1
for c in "0123456789":
    TABLE[ord(c)] |= 2
for c in " \t\n\v\f\r":
    TABLE[ord(c)] |= 4
FEATURES = ("bias", "log words", "few words", "ends a sentence", "symbols", "digits", "capitals", "repeated", "notice", "mean word")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents that are learned from; ``least_content`` is the share that keeps a document."""

    sample: int = 400
    rounds: int = 120
    rate: float = 1.0
    momentum: float = 0.9
    least_content: float = 0.5
    least_words: int = 20
    most_repeated_percent: int = 30
    window: int = 8
    seed_symbols: float = 0.08
    seed_capitals: float = 0.6


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # feature x state
    move: np.ndarray  # state x state


@dataclass(frozen=True)
class Lines:
    """The lines of a text that hold a word: their features and word characters, and the text's counts."""

    features: np.ndarray
    chars: np.ndarray
    n_words: int
    n_symbols: int
    n_dup_lines: int


def read_lines(text: str) -> Lines:
    lines = text.split("\n")
    codes = np.frombuffer((text + "\n").encode("utf-32-le", "replace"), np.uint32)
    lower = text.lower() + "\n"
    kind = np.zeros(len(codes), np.uint8)
    plain = codes < 128
    kind[plain] = TABLE[codes[plain]]
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    visible = (kind & 4) == 0
    first = visible.copy()
    first[1:] &= ~visible[:-1]
    if len(lower) == len(codes):
        capital = np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32) != codes
    else:
        capital = np.fromiter((c != c.lower() for c in text + "\n"), bool, len(codes))
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    words, chars, symbols = total(first), total(visible), total((kind & 1) > 0)
    digits, capitals = total((kind & 2) > 0), total(capital)
    last = np.maximum.reduceat(np.where(visible, np.arange(len(codes)), 0), starts)
    seen: set[str] = set()
    repeated = np.zeros(len(lines), bool)
    for i in np.flatnonzero(words):
        if lines[i] in seen:
            repeated[i] = True
        seen.add(lines[i])
    notice = np.zeros(len(lines), bool)
    for m in NOTICE.finditer(text):
        notice[np.searchsorted(ends, m.start())] = True
    live = words > 0
    w, c = words[live], np.maximum(chars[live], 1)
    features = np.stack([
        np.ones(len(w)), np.log1p(w) / 3, w < 4, np.isin(codes[last[live]], ENDINGS), np.minimum(1, 5 * symbols[live] / c),
        np.minimum(1, 3 * digits[live] / c), capitals[live] / c, repeated[live], notice[live], np.minimum(3, c / np.maximum(w, 1) / 6),
    ], axis=1).astype(float)
    return Lines(features, chars[live], int(words.sum()), int(symbols.sum()), int(repeated.sum()))


def repeated_words(text: str, window: int) -> int:
    """Words that lie in a window of words found twice or more, every occurrence counted."""
    words = text.encode("utf-8", "replace").split()
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = mix64(h + ids[i : i + n] + np.uint64(1))
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    if not equal.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    places = np.flatnonzero(again)
    # equal hashes are only candidates; the windows themselves decide
    found = np.lib.stride_tricks.sliding_window_view(ids, window)[places]
    _, which, times = np.unique(found, axis=0, return_inverse=True, return_counts=True)
    places = places[times[which.ravel()] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def seeds(features: np.ndarray, s: Settings) -> np.ndarray:
    """Evident labels: content, boilerplate, or -1."""
    f = {name: features[:, i] for i, name in enumerate(FEATURES)}
    bad = (f["symbols"] >= 5 * s.seed_symbols) | (f["repeated"] > 0) | (f["notice"] > 0) | (f["capitals"] >= s.seed_capitals)
    good = ~bad & (f["few words"] == 0) & (f["ends a sentence"] > 0) & (f["symbols"] < 0.1) & (f["digits"] < 0.3) & (f["capitals"] < 0.3)
    return np.where(bad, BOILERPLATE, np.where(good, CONTENT, -1))


def _sums(scores: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all paths, state probabilities per line, expected moves."""
    n = len(scores)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = scores[0]
    for t in range(1, n):
        fore[t] = scores[t] + np.logaddexp(fore[t - 1, 0] + move[0], fore[t - 1, 1] + move[1])
    for t in range(n - 2, -1, -1):
        onward = scores[t + 1] + back[t + 1]
        back[t] = np.logaddexp(move[:, 0] + onward[0], move[:, 1] + onward[1])
    z = float(np.logaddexp(fore[-1, 0], fore[-1, 1]))
    moves = np.zeros((2, 2))
    if n > 1:
        moves = np.exp(np.maximum(-700, fore[:-1, :, None] + move + (scores[1:] + back[1:])[:, None, :] - z)).sum(axis=0)
    return z, np.exp(np.maximum(-700, fore + back - z)), moves


def fit(chains: list[np.ndarray], s: Settings = Settings()) -> Field:
    """Gradient ascent with momentum on the likelihood of the evident labels; without any the field starts and stays at its prior."""
    emit, move = np.zeros((len(FEATURES), 2)), np.array([[0.5, 0.0], [0.0, 0.5]])
    marked = [(x, seeds(x, s)) for x in chains if len(x)]
    marked = [(x, y) for x, y in marked if (y >= 0).any()]
    lines = sum(len(x) for x, _ in marked)
    step_emit, step_move = np.zeros_like(emit), np.zeros_like(move)
    for _ in range(s.rounds):
        up_emit, up_move = -1e-3 * emit, -1e-3 * move
        for x, y in marked:
            scores = x @ emit
            clamped = scores.copy()
            clamped[y == CONTENT, BOILERPLATE] = -1e6
            clamped[y == BOILERPLATE, CONTENT] = -1e6
            _, free, free_moves = _sums(scores, move)
            _, held, held_moves = _sums(clamped, move)
            up_emit = up_emit + x.T @ (held - free) / lines
            up_move = up_move + (held_moves - free_moves) / lines
        step_emit, step_move = s.momentum * step_emit + s.rate * up_emit, s.momentum * step_move + s.rate * up_move
        emit, move = emit + step_emit, move + step_move
    return Field(emit, move)


def viterbi(features: np.ndarray, field: Field) -> np.ndarray:
    """The best states of a chain; equal scores go to content."""
    scores = (features @ field.emit).tolist()
    (cc, cb), (bc, bb) = field.move.tolist()
    content, boiler = scores[0]
    steps = []
    for c, b in scores[1:]:
        steps.append((content + cc < boiler + bc, content + cb < boiler + bb))
        content, boiler = c + max(content + cc, boiler + bc), b + max(content + cb, boiler + bb)
    state = int(content < boiler)
    out = [state]
    for step in reversed(steps):
        state = int(step[state])
        out.append(state)
    return np.array(out[::-1])


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on the line features of a bounded hash sample of the documents."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    n, span = known.count(), 1 << 30
    if n > settings.sample:
        known = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(span)) < span * settings.sample // n)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        # a chain of the sample is learned from in windows of bounded length
        x = [f[i : i + 2000].tobytes() for t in batch.column(0).to_pylist() for f in [read_lines(t).features] for i in range(0, len(f), 2000)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], ["x"])

    rows = map_batches(known.limit(2 * settings.sample).select("text"), features, "x binary").limit(4 * settings.sample).collect()
    chains = sorted(bytes(r.x) for r in rows)
    return fit([np.frombuffer(c, float).reshape(-1, len(FEATURES)) for c in chains], settings)


def quality_rules(docs: DataFrame, field: Field, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, the four base counts, ``base_failed``, ``kept`` and the line counts.

    ``lines`` and ``content_lines`` count lines with a word; ``content_share`` is the share of
    word characters on content lines. A null text counts as empty: no words,
    base failed, not kept, share 0. Repeated rows are judged each; other columns are not read.
    """
    s = settings

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            found = read_lines(text or "")
            again = repeated_words(text or "", s.window)
            failed = found.n_words < s.least_words or 100 * again > s.most_repeated_percent * found.n_words
            chars, share, good = int(found.chars.sum()), 0.0, 0
            if chars:
                content = viterbi(found.features, field) == CONTENT
                good, share = int(content.sum()), float(found.chars[content].sum() / chars)
            out.append((found.n_words, chars, found.n_symbols, found.n_dup_lines, again, failed, not failed and share >= s.least_content, len(found.chars), good, share))
        types = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], names)

    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines long, content_lines long, content_share double"
    names = ["id"] + [c.split()[0] for c in columns.split(", ")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)


def line_labels(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: id, ``line`` (from 0, all lines counted), ``label`` and the line's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, number, label, content = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            lines = [(n, x) for n, x in enumerate((text or "").split("\n")) if x.encode("utf-8", "replace").split()]
            if lines:
                owner += [i] * len(lines)
                number += [n for n, _ in lines]
                content += [x for _, x in lines]
                label += ["content" if s == CONTENT else "boilerplate" for s in viterbi(read_lines(text).features, field)]
        ids = batch.column("id").take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int64()), pa.array(label, pa.string()), pa.array(content, pa.string())], ["id", "line", "label", "content"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, line long, label string, content string").withColumnRenamed("id", id_col)
