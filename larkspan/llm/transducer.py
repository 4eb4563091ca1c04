"""A minimal acyclic transducer from terms to their lexicographic ordinals.

Built from sorted byte strings: states with the same endings are one state. An edge
carries how many terms leave its state before it, so the sum along a term's path is the
number of terms before it. Many strings walk at once in numpy.
"""

from __future__ import annotations

import io
from collections.abc import Iterable
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """Edges in the order of ``keys`` (state * 256 + byte) with ``targets`` and ``skips``; ``final`` marks the ends of terms."""

    keys: np.ndarray
    targets: np.ndarray
    skips: np.ndarray
    final: np.ndarray
    root: int
    longest: int

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.targets, self.skips, self.final))

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each string among the terms, -1 for one that is no term."""
        out = np.full(len(terms), -1, np.int64)
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        rows = np.flatnonzero(lengths <= self.longest)
        if not len(rows) or not len(self.final):
            return out
        lengths = lengths[rows]
        raw = np.frombuffer(b"".join([terms[i] for i in rows]), np.uint8)
        at = np.cumsum(lengths) - lengths
        state, number = np.full(len(rows), self.root, np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        for step in range(int(lengths.max()) + 1):
            ended = lengths[left] == step
            done = left[ended]
            out[rows[done]] = np.where(self.final[state[done]], number[done], -1)
            left = left[~ended]
            if not len(left) or not len(self.keys):
                break
            key = state[left] * 256 + raw[at[left] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[edge] == key
            left, edge = left[known], edge[known]
            number[left] += self.skips[edge]
            state[left] = self.targets[edge]
        return out

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, targets=self.targets, skips=self.skips, final=self.final, root=self.root, longest=self.longest)
        return out.getvalue()


def unpacked(raw: bytes) -> Transducer:
    held = np.load(io.BytesIO(raw))
    return Transducer(held["keys"], held["targets"], held["skips"], held["final"], int(held["root"]), int(held["longest"]))


def built(terms: Iterable[bytes]) -> Transducer:
    """The transducer of distinct byte strings given in ascending order."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[tuple[list[bool], list[list[int]]]] = [([False], [])]
    last, longest = None, 0

    def close(depth: int) -> int:
        """Make states of the path below ``depth``; returns the state of its last node."""
        state = -1
        while len(path) > depth:
            (end,), edges = path.pop()
            key = (end, tuple(map(tuple, edges)))
            state = register.get(key, -1)
            if state < 0:
                state = register[key] = len(states)
                states.append(key)
            if path:
                path[-1][1][-1][1] = state
        return state

    for term in terms:
        if last is not None and term <= last:
            raise ValueError("terms must ascend")
        same = len(commonprefix([last, term])) if last is not None else 0
        close(same + 1)
        for byte in term[same:]:
            path[-1][1].append([byte, -1])
            path.append(([False], []))
        path[-1][0][0] = True
        last, longest = term, max(longest, len(term))
    root = close(0)
    # targets are made before the states that lead to them
    below = np.zeros(len(states), np.int64)
    keys, targets, skips = [], [], []
    for number, (end, edges) in enumerate(states):
        seen = int(end)
        for byte, target in edges:
            keys.append(number * 256 + byte)
            targets.append(target)
            skips.append(seen)
            seen += int(below[target])
        below[number] = seen
    final = np.fromiter((end for end, _ in states), bool, len(states))
    return Transducer(np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), final, root, longest)
