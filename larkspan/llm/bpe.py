"""A byte-level BPE vocabulary file as an exact and fast encoder and decoder.

The file is that of the tokenizers library. If its merges are in id order, as
byte-level BPE files have them, encoding with ranks gives the same ids several
times faster; texts with a special token or with very long runs, and files of
another kind, go through the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from .common import kept

# The word pattern of byte-level BPE, and the characters that stand for bytes in its files.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pieces where no blank follows another; without a look ahead they are found faster.
PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: First bytes of the blanks beyond ASCII.
BLANK_STARTS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Longer runs of blanks or of anything else are left to the library, whose cost stays in proportion.
LONG_RUN = 1000


def byte_of_char() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab, merges = file["model"].get("vocab", {}), file["model"].get("merges", [])
        self.ranks = None
        if self._in_order(file, vocab, merges):
            place = byte_of_char()
            ranks = {bytes(place[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
            self.plain = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens=self.special)
            self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
            self.names = {i: str(i) for i in self.bytes_of}
            self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
            for i, b in self.bytes_of.items():
                self.lengths[i] = len(b)

    def _in_order(self, file: dict, vocab: dict, merges: list) -> bool:
        pre = file.get("pre_tokenizer") or {}
        plain = file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        flags = any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not plain or flags or len(vocab) - len(merges) - 256 not in range(0, 1 + len(self.special)):
            return False
        joined = ("".join(m.split(" ") if isinstance(m, str) else m) for m in merges)
        return all(vocab.get(t) == 256 + i for i, t in enumerate(joined)) and not file["model"].get("ignore_merges")

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without special tokens added."""
        raw = text.encode("utf-8", "replace")
        if self.ranks is None or self.has_special(text) or long_run(raw):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return self._ranked(raw, text)

    def _ranked(self, raw: bytes, text: str) -> np.ndarray:
        return (self.plain if single_blanks(raw) else self.ranks).encode_to_numpy(text, disallowed_special=()).view(np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of each text.

        No piece of the pattern has a blank after another character, so texts are cut before their
        runs of blanks, and every distinct part is encoded once.
        """
        raws = [text.encode("utf-8", "replace") for text in texts]
        plain = [self.ranks is not None and not self.has_special(t) and not long_run(r) for t, r in zip(texts, raws)]
        bounds = np.cumsum([0, *(len(r) for r, p in zip(raws, plain) if p)], dtype=np.int64)
        found = iter(self._by_parts(b"".join(r for r, p in zip(raws, plain) if p), bounds))
        return [next(found) if p else self.encode(text) for text, p in zip(texts, plain)]

    def _by_parts(self, raw: bytes, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts that lie in ``raw`` between neighbouring ``bounds``."""
        begins = np.zeros(len(raw) + 1, bool)
        begins[cuts(raw)] = True
        begins[bounds] = True
        starts = np.flatnonzero(begins).astype(np.int32)
        del begins
        parts = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        ids, first = self._of_parts(parts.dictionary)
        which = parts.indices.to_numpy()
        counts = np.diff(first)[which]
        after = np.append(np.int32(0), np.cumsum(counts, dtype=np.int32))
        # each id's place among those of the parts
        at = np.ones(after[-1], np.int32)
        if len(at):
            at[0] = first[which[0]]
            at[after[1:-1]] = first[which[1:]] - first[which[:-1] + 1] + 1
            ids = ids.take(np.cumsum(at, dtype=np.int32, out=at), mode="clip")
        ends = after[np.searchsorted(starts, bounds.astype(np.int32))]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, and where those of each begin."""
        if not len(parts):
            return np.zeros(0, np.int32), np.zeros(1, np.int32)
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        raw, ends = parts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
        # parts follow each other as in no text; neighbours that a text would be cut between are encoded together
        begins = np.zeros(len(raw) + 1, bool)
        begins[cuts(raw)] = True
        whole = [0, *ends[~begins[ends]].tolist()]
        flat = np.concatenate([self._ranked(raw[a:b], raw[a:b].decode()) for a, b in zip(whole[:-1], whole[1:])])
        return flat, np.append(0, np.searchsorted(np.cumsum(self.lengths[flat]), ends) + 1).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids, special tokens included."""
        if self.ranks is None:
            return self.library.decode(ids, skip_special_tokens=False)
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join([self.names[i] for i in ids] if self.ranks is not None else map(str, ids))


def cuts(raw: bytes) -> np.ndarray:
    """Where runs of ASCII blanks begin, each after a character that surely is no blank."""
    codes = np.frombuffer(raw, np.uint8)
    blank = codes == 32
    blank |= codes - np.uint8(9) < 5
    at = np.flatnonzero(blank[1:] > blank[:-1]) + 1
    before = codes[at - 1]
    sure = before > 32
    # a character beyond ASCII that begins like a blank may be one
    wide = np.flatnonzero(before > 127)
    for back, starts in ((2, BLANK_STARTS[:1]), (3, BLANK_STARTS[1:])):
        sure[wide[np.isin(codes[np.maximum(at[wide] - back, 0)], [s[0] for s in starts])]] = False
    return at[sure]


def single_blanks(raw: bytes) -> bool:
    """Whether surely no blank follows another; control characters count as blanks, texts that may hold other blanks are not looked into."""
    if any(start in raw for start in BLANK_STARTS):
        return False
    blank = np.frombuffer(raw, np.uint8) <= 32
    return not (blank[1:] & blank[:-1]).any()


def long_run(raw: bytes) -> bool:
    """Whether a run of ASCII blanks, or of other bytes, is longer than ``LONG_RUN``."""
    if len(raw) <= LONG_RUN:
        return False
    # such a run fills one of the pieces of half its length; most texts have none that is filled by one kind
    half = LONG_RUN // 2
    for at in range(0, len(raw), half):
        first = raw[at : at + half].split(None, 1)
        if not first or len(first[0]) == half:
            break
    else:
        return False
    codes = np.frombuffer(raw, np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return int(np.diff(turns, prepend=-1, append=len(codes) - 1).max()) > LONG_RUN


def bpe(path: str) -> Bpe:
    """The vocabulary of a file, loaded once per worker."""
    return kept(("bpe", path), lambda: Bpe(path))
