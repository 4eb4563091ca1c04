"""Size and branching of source code, counted by regular expressions.

Complexity is one plus the decision points left after comments and string
texts are removed. A full parser may count a few constructs differently.

ASCII code is counted in Arrow batches by patterns of linear time and a table of characters; other code,
where blanks and words mean more, by Spark's own expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col, let, php_prelude
from .clean import usable_code
from .ranking import first_n_per_group

# Language ids shared by labelling, training and scoring.
LANGUAGE_IDS = {"python": 0, "java": 1, "javascript": 2, "php": 3, "ruby": 4, "go": 5}

# Possessive repeats: a string has one reading, and a long one must not be a deep recursion.
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_BACKTICK = r"`[^`]*`"
_TRIPLE = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
_HASH = r"#[^\n]*"
_SLASH = r"//[^\n]*|/\*[\s\S]*?\*/"
_PHP_TAG = r"<\?php|\?>"
_RUBY_BLOCK = r"=begin[\s\S]*?=end"

STRINGS = {
    "python": f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}",
    "java": f"{_DOUBLE}|{_SINGLE}",
    "javascript": f"{_DOUBLE}|{_SINGLE}|{_BACKTICK}",
    "php": f"{_DOUBLE}|{_SINGLE}",
    "ruby": f"{_DOUBLE}|{_SINGLE}",
    "go": f"{_DOUBLE}|{_SINGLE}|{_BACKTICK}",
}
COMMENTS = {
    "python": _HASH, "java": _SLASH, "javascript": _SLASH, "php": f"{_SLASH}|{_HASH}|{_PHP_TAG}",
    "ruby": f"{_RUBY_BLOCK}|{_HASH}", "go": _SLASH,
}
DECISIONS = {
    "python": r"\b(?:if|elif|for|while|and|or|except|finally)\b",
    "java": r"\b(?:if|for|while|catch|case)\b|&&|\|\||\?",
    "javascript": r"\b(?:if|for|while|catch|case)\b|&&|\|\||\?",
    "php": r"\b(?:if|elseif|for|foreach|while|catch|case)\b|&&|\|\||\?",
    "ruby": r"\b(?:if|elsif|unless|until|for|while|and|or|rescue|ensure|when)\b|&&|\|\||\s\?\s",
    "go": r"\b(?:if|for|case)\b|&&|\|\|",
}
_CALL_BLOCK = r"\s*\([^(){};]*\)\s*(?:throws\s+[\w.,\s]+)?\{"
FUNCTIONS = {
    "python": r"\bdef\s", "java": r"\b\w+" + _CALL_BLOCK, "javascript": r"\bfunction\b(?:\s+\w+)?|=>|\b\w+" + _CALL_BLOCK,
    "php": r"\bfunction\b", "ruby": r"\bdef\s", "go": r"\bfunc\b",
}
# What the patterns above take for a function of its own: control blocks, calls of ``new`` with a class body.
NOT_FUNCTIONS = {
    "java": r"\b(?:if|for|while|switch|catch|synchronized|try|new\s+[\w.]+)" + _CALL_BLOCK,
    "javascript": r"\b(?:if|for|while|switch|catch|with)" + _CALL_BLOCK,
}
TOKEN = r"\w+|[^\w\s]"
# One match per line that is not blank.
CODE_LINE = r"\S[^\n]*"
# Characters a match can start with; tested first, they rule out most positions at once.
_QUOTES = "\"'`#/=<?"
_DECISION_STARTS = "iefwaocruw&|?\\s"


def by_language(language: Column | str, choose) -> Column:
    out = None
    for name in LANGUAGE_IDS:
        test = col(language) == name
        out = F.when(test, choose(name)) if out is None else out.when(test, choose(name))
    return out


def without_comments(code: Column | str, language: Column | str) -> Column:
    """Strings are matched along with comments, so a mark inside a string is safe."""
    return by_language(
        language,
        lambda n: F.regexp_replace(col(code), f"(?=[{_QUOTES}])(?:({STRINGS[n]})|{COMMENTS[n]})", "$1"),
    )


def without_strings(code: Column | str, language: Column | str) -> Column:
    return by_language(language, lambda n: F.regexp_replace(col(code), f"(?=[\"'`])(?:{STRINGS[n]})", "s"))


def re2(pattern: str) -> str:
    """The same pattern for an engine without possessive repeats, which never recurses."""
    return pattern.replace("*+", "*")


def function_count(plain: Column | str, language: Column | str) -> Column:
    def count(name: str) -> Column:
        n = F.regexp_count(col(plain), F.lit(FUNCTIONS[name]))
        return n - F.regexp_count(col(plain), F.lit(NOT_FUNCTIONS[name])) if name in NOT_FUNCTIONS else n

    return by_language(language, count)


COUNTS = ("n_functions", "cyclomatic_complexity", "nloc", "token_count")
#: Text that is cut and counted at a time.
SLICE_BYTES = 4 << 20
_BLANK, _WORD, _MARK = 0, 1, 2
_KINDS = np.array([_BLANK if i in b"\t\n\x0b\f\r " else _WORD if chr(i).isalnum() and i < 128 or i == 95 else _MARK for i in range(256)], np.uint8)


def _arrow(pattern: str) -> str:
    """The same pattern in Arrow's dialect, where a dot takes a carriage return."""
    return re2(pattern).replace(r"\\.", r"\\[^\n\r]")


def _code_lines_and_tokens(bare: pa.Array, plain: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Matches of ``CODE_LINE`` in the one, of ``TOKEN`` in the other, by a table of characters."""
    counts = []
    for texts, lines in ((bare, True), (plain, False)):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, kinds = ends - ends[0], _KINDS[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[ends[:-1]] = True
        first = first[:-1]
        if lines:
            found = np.flatnonzero(kinds != _BLANK)
            line = np.cumsum((raw == 10).astype(np.int8) + first, dtype=np.int64)[found]
            found = found[np.r_[True, line[1:] != line[:-1]]] if len(found) else found
            marks = np.zeros(len(raw), bool)
            marks[found] = True
        else:
            marks = (kinds == _MARK) | (kinds == _WORD) & (first | (np.r_[np.uint8(_BLANK), kinds[:-1]] != _WORD)[: len(raw)])
        total = np.r_[0, np.cumsum(marks, dtype=np.int64)]
        counts.append(total[ends[1:]] - total[ends[:-1]])
    return counts[0], counts[1]


def _counts_of(language: str, code: pa.Array) -> list[np.ndarray]:
    """All counts of texts of one language, none null."""
    bare = pc.replace_substring_regex(code, pattern=f"({_arrow(STRINGS[language])})|{COMMENTS[language]}", replacement=r"\1")
    plain = pc.replace_substring_regex(bare, pattern=_arrow(STRINGS[language]), replacement="s")
    count = lambda pattern: pc.count_substring_regex(plain, pattern=pattern).to_numpy(zero_copy_only=False)
    functions = count(FUNCTIONS[language])
    if language in NOT_FUNCTIONS:
        functions = functions - count(NOT_FUNCTIONS[language])
    return [functions, 1 + count(DECISIONS[language]), *_code_lines_and_tokens(bare, plain)]


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in COUNTS]))
def _ascii_counts(language: pa.Array, code: pa.Array) -> pa.Array:
    """The counts of each ASCII text; null for a null and a language that is not known."""
    out, known = np.zeros((len(COUNTS), len(code)), np.int32), np.zeros(len(code), bool)
    for name in LANGUAGE_IDS:
        rows = np.flatnonzero(pc.fill_null(pc.and_(pc.equal(language, name), code.is_valid()), False).to_numpy(zero_copy_only=False))
        texts = code.take(pa.array(rows))
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(sizes)) + 1):
            if len(part):
                out[:, rows[part]] = _counts_of(name, texts.slice(part[0], len(part)))
        known[rows] = True
    return pa.StructArray.from_arrays([pa.array(c) for c in out], names=list(COUNTS), mask=pa.array(~known))


def _any_counts(code: Column, lang: Column) -> Column:
    """The counts of any text by Spark's expressions."""
    def counted(bare: Column, plain: Column) -> Column:
        decisions = by_language(lang, lambda n: 1 + F.regexp_count(plain, F.lit(f"(?=[{_DECISION_STARTS}])(?:{DECISIONS[n]})")))
        found = function_count(plain, lang), decisions, F.regexp_count(bare, F.lit(CODE_LINE)), F.regexp_count(plain, F.lit(TOKEN))
        return F.struct(*[c.alias(name) for name, c in zip(COUNTS, found)])

    return let(without_comments(code, lang), lambda bare: let(without_strings(bare, lang), lambda plain: counted(bare, plain)))


def code_metrics(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Attach function count, complexity, code lines and token count."""
    lang, text = F.col(language), F.col("_text")
    rows = df.withColumn("_text", php_prelude(F.col(code), lang))
    # blanks are the same in both dialects but for one
    is_ascii = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("\x0b"))
    rows = rows.withColumn("_ascii", F.when(is_ascii, text))
    fast = F.col("_ascii")
    counts = F.when(fast.isNotNull(), _ascii_counts(lang, fast)).otherwise(_any_counts(text, lang))
    return rows.select("*", F.inline(F.array(counts))).drop("_text", "_ascii")


def label_code(df: DataFrame, order: list[str], max_per_language: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Labelled single-function snippets of the known languages, on demand capped per language.

    ``order`` names the columns that give file and line order; the cap counts
    rows that passed every filter.
    """
    ids = F.create_map(*[F.lit(x) for pair in LANGUAGE_IDS.items() for x in pair])
    rows = usable_code(df.filter(F.col("language").isin(list(LANGUAGE_IDS))), max_chars)
    labelled = code_metrics(rows).filter(F.col("n_functions") == 1)
    if max_per_language is not None:
        labelled = first_n_per_group(labelled, ["language"], [F.col(c) for c in order], max_per_language)
    return labelled.select(
        *order, "code", "language", F.element_at(ids, F.col("language")).alias("language_id"),
        "cyclomatic_complexity", "nloc", "token_count",
    )
