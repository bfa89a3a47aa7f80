"""Acyclic automata over word sequences with a count on every path.

Words are the arc labels, in byte order; each path from the root has DEPTH arcs, the last of
which may be END, the empty label. States of one depth are numbered in path order, so a state
is a label and the stretch of paths below it, and the weight of a state, the number of
occurrences of its prefix, is the sum over that stretch. Automata grow from sorted paths,
are cut into prefix ranges, united by merging their sorted paths and adding weights, and
composed by walking the product of their states depth by depth.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from postmill.llm.arrays import squeeze, unsqueeze

DEPTH = 4
END = b""


def _arranged(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the paths (columns), and their two halves as sorted keys."""
    high, low = (paths[i].astype(np.uint64) << np.uint64(32) | paths[i + 1].astype(np.uint64) for i in (0, 2))
    order = np.lexsort((low, high))
    return order, high[order], low[order]


@dataclass
class Automaton:
    """words: labels, sorted, END first. labels[d], firsts[d]: of each state at depth d its label and its first path."""

    words: list[bytes]
    labels: list[np.ndarray]
    firsts: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def of_sorted(cls, words: list[bytes], paths: np.ndarray, weights: np.ndarray) -> "Automaton":
        """One more path at a time opens a state at each depth from the first label that differs."""
        fresh = np.zeros(len(weights), bool)
        fresh[:1] = True
        labels, firsts = [], []
        for column in paths:
            fresh[1:] |= column[1:] != column[:-1]
            firsts.append(np.flatnonzero(fresh))
            labels.append(column[firsts[-1]])
        return cls(words, labels, firsts, weights)

    @classmethod
    def of(cls, words: list[bytes], paths: np.ndarray, weights: np.ndarray | None = None) -> "Automaton":
        """From paths (DEPTH rows of word numbers) in any order; weights of equal ones are added."""
        if not paths.shape[1]:
            return cls(words, [np.zeros(0, np.uint32)] * DEPTH, [np.zeros(0, np.int64)] * DEPTH, np.zeros(0, np.int64))
        order, high, low = _arranged(paths)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        starts = np.flatnonzero(fresh)
        sums = np.diff(np.append(starts, len(order))) if weights is None else np.add.reduceat(weights[order], starts)
        return cls.of_sorted(words, paths[:, order[starts]], sums.astype(np.int64))

    @classmethod
    def of_phrases(cls, phrases: list[bytes], weights: np.ndarray) -> "Automaton":
        cut = [p.split(b" ") for p in phrases]
        words = sorted({END}.union(*cut))
        rank = {w: i for i, w in enumerate(words)}
        paths = np.array([[rank[w] for w in c] + [0] * (DEPTH - len(c)) for c in cut], np.uint32).reshape(len(cut), DEPTH)
        return cls.of(words, np.ascontiguousarray(paths.T), weights)

    @classmethod
    def union(cls, parts: Sequence["Automaton"]) -> "Automaton":
        words = sorted({END}.union(*(p.words for p in parts)))
        rank = {w: i for i, w in enumerate(words)}
        paths = [np.fromiter(map(rank.__getitem__, p.words), np.uint32, len(p.words))[p.paths()] for p in parts]
        return cls.of(words, np.concatenate(paths, axis=1), np.concatenate([p.weights for p in parts]))

    def paths(self) -> np.ndarray:
        ends = len(self.weights)
        return np.stack([np.repeat(label, np.diff(np.append(first, ends))) for label, first in zip(self.labels, self.firsts)])

    def state_weights(self, depth: int) -> np.ndarray:
        return np.add.reduceat(self.weights, self.firsts[depth]) if len(self.weights) else self.weights

    def parents(self, depth: int) -> np.ndarray:
        """The state one up of each state at a depth; the root is 0."""
        here = self.firsts[depth]
        return np.searchsorted(self.firsts[depth - 1], here, side="right") - 1 if depth else np.zeros(len(here), np.int64)

    def place(self, paths: np.ndarray, cut: tuple[bytes, ...]) -> int:
        """How many of its paths lie before a sequence of words."""
        low, high = 0, paths.shape[1]
        for column, word in zip(paths, cut):
            rank = bisect_left(self.words, word)
            below = low + int(np.searchsorted(column[low:high], rank))
            if rank == len(self.words) or self.words[rank] != word:
                return below
            low, high = below, low + int(np.searchsorted(column[low:high], rank, side="right"))
        return low

    def ranges(self, cuts: list[tuple[bytes, ...]]):
        """(number, automaton) of each prefix range that has paths; cut i begins range i + 1."""
        paths = self.paths()
        places = [0, *(self.place(paths, c) for c in cuts), paths.shape[1]]
        for number, (a, b) in enumerate(zip(places[:-1], places[1:])):
            if a < b:
                own = paths[:, a:b]
                used = np.unique(own)
                used = used if used[0] == 0 else np.append(np.uint32(0), used)
                yield number, Automaton.of_sorted([self.words[i] for i in used], np.searchsorted(used, own).astype(np.uint32), self.weights[a:b])

    def compose(self, asked: "Automaton") -> np.ndarray:
        """This automaton's weight of each path of another; 0 where it has none."""
        rank = {w: i for i, w in enumerate(self.words)}
        known = np.array([rank.get(w, -1) for w in asked.words], np.int64)
        state = np.zeros(1, np.int64)
        for depth in range(DEPTH):
            arcs = self.parents(depth) << 32 | self.labels[depth].astype(np.int64)
            above, label = state[asked.parents(depth)], known[asked.labels[depth]]
            wanted = above << 32 | label
            at = np.searchsorted(arcs, wanted)
            met = (above >= 0) & (label >= 0) & (at < len(arcs))
            met[met] = arcs[at[met]] == wanted[met]
            state = np.where(met, at, -1)
        out = np.zeros(len(state), np.int64)
        out[state >= 0] = self.weights[state[state >= 0]]
        return out

    def pack(self) -> tuple[bytes, list[bytes]]:
        text = b"\n".join(self.words)
        words = len(text).to_bytes(8, "little") + bytes(pa.compress(text, codec="zstd", asbytes=True))
        spans = [np.diff(np.append(f, len(self.weights))).astype(np.uint32) for f in self.firsts[:-1]]
        return words, [squeeze(a) for a in (*(x.astype(np.uint32) for x in self.labels), *spans, self.weights)]

    @classmethod
    def unpack(cls, words: bytes, arrays: list[bytes]) -> "Automaton":
        text = pa.decompress(words[8:], int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True)
        numbers = [unsqueeze(a, np.uint32) for a in arrays[:-1]]
        weights = unsqueeze(arrays[-1], np.int64)
        firsts = [np.cumsum(s, dtype=np.int64) - s for s in numbers[DEPTH:]]
        return cls(bytes(text).split(b"\n"), numbers[:DEPTH], [*firsts, np.arange(len(weights))], weights)
