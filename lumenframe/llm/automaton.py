"""Generalised suffix automata of word sequences, bounded in depth, built from sorted arrays.

The suffix links of an automaton form the suffix tree of the reversed
sequences.  So sorting every position by the words before it, nearest first,
lays that tree out: a run of positions that share their last d words is the
endpos set of one substring of d words, and runs of different d that are the
same set are one state.
"""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """States of all substrings of at most `depth` symbols of a sequence; negative symbols separate strings.

    longest, shortest: lengths of the substrings of each state; count: size of
    its endpos set; end: one position in it; link: the state of the longest
    suffix that is in another one, -1 for the start.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        symbols = np.asarray(symbols, np.int64)
        self.symbols = symbols
        base = int(symbols.max(initial=0)) + 2
        back = [symbols.astype(np.int32)]
        for _ in range(depth - 1):
            back.append(np.where(back[-1] >= 0, self._before(back[0], len(back)), np.int32(-1)))
        keys = []  # two symbols in each sort key
        for d in range(0, depth, 2):
            pair = (back[d] + np.int64(1)) * base
            keys.append(pair + (back[d + 1] + 1 if d + 1 < depth else 0))
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        del keys
        order = order[symbols[order] >= 0]
        new = np.zeros(len(order), bool)
        new[:1] = True
        starts, counts = [], []
        for d in range(depth):
            column = back[d][order]
            new[1:] |= column[1:] != column[:-1]
            there = np.flatnonzero(new)
            size = np.diff(np.append(there, len(order)))
            whole = column[there] >= 0  # the last d + 1 symbols are all of one string
            starts.append(there[whole])
            counts.append(size[whole])
        self._states(order, starts, counts)

    @staticmethod
    def _before(symbols: np.ndarray, d: int) -> np.ndarray:
        out = np.full(len(symbols), -1, symbols.dtype)
        out[d:] = symbols[: max(0, len(symbols) - d)]
        return out

    def _states(self, order: np.ndarray, starts: list[np.ndarray], counts: list[np.ndarray]) -> None:
        depth, total = len(starts), 0
        state = [np.empty(0, np.int64)] * depth
        longest, count, end = [], [], []
        for d in range(depth - 1, -1, -1):
            ids = np.full(len(starts[d]), -1, np.int64)
            if d + 1 < depth and len(starts[d + 1]):
                at = np.searchsorted(starts[d], starts[d + 1], "right") - 1  # each longer run lies in the run of its suffix
                same = counts[d][at] == counts[d + 1]
                ids[at[same]] = state[d + 1][same]
            fresh = np.flatnonzero(ids < 0)
            ids[fresh] = total + np.arange(len(fresh))
            total += len(fresh)
            state[d] = ids
            longest.append(np.full(len(fresh), d + 1, np.int64))
            count.append(counts[d][fresh])
            end.append(order[starts[d][fresh]])
        self.longest, self.count, self.end = np.concatenate(longest), np.concatenate(count), np.concatenate(end)
        self.shortest, self.link = np.ones(total, np.int64), np.full(total, -1, np.int64)
        for d in range(1, depth):
            above = state[d - 1][np.searchsorted(starts[d - 1], starts[d], "right") - 1] if len(starts[d]) else np.empty(0, np.int64)
            other = state[d] != above
            self.link[state[d][other]], self.shortest[state[d][other]] = above[other], d + 1

    def substrings(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, end of one occurrence, number of occurrences) of every distinct substring of `least` symbols or more."""
        low = np.maximum(self.shortest, least)
        each = np.maximum(self.longest - low + 1, 0)
        first = np.cumsum(each) - each
        lengths = np.repeat(low - first, each) + np.arange(each.sum())
        return lengths, np.repeat(self.end, each), np.repeat(self.count, each)
