"""Double-array tries over sequences of numbers, built and walked by numpy.

A word number is read as ``digits`` bytes, the highest first, so that a node has
at most 256 children.  Node and slot are the same number: the child of node s by
byte c is ``base[s] + c`` if ``check`` of that slot is s.  A walk advances all
places of a text at once, one byte a step, and drops the places that leave the trie.
"""

from __future__ import annotations

import numpy as np

#: Nodes with more children than this get 256 slots of their own, whose gaps others fill.
WIDE = 16
#: Slots that are searched at once for a place.
REACH = 4096


class DoubleArray:
    """A trie of phrases: rows of word numbers above 0, filled up with 0 on the right."""

    def __init__(self, phrases: np.ndarray):
        size, longest = phrases.shape
        self.digits = max(1, -(-int(phrases.max(initial=1)).bit_length() // 8))
        order = np.lexsort(phrases.T[::-1])
        rows = phrases[order]
        shifts = 8 * np.arange(self.digits - 1, -1, -1)
        symbols = ((rows[:, :, None] >> shifts) & 255).reshape(size, longest * self.digits).astype(np.int64)
        lengths = (rows > 0).sum(1) * self.digits
        parent, symbol, last = self._nodes(symbols, lengths)
        slots, base = self._placed(parent, symbol)
        self.base = np.zeros(int(base.max(initial=0)) + 257, dtype=np.int32)
        self.check = np.full(len(self.base), -1, dtype=np.int32)
        self.accept = np.full(len(self.base), -1, dtype=np.int32)
        self.base[slots] = base
        self.check[slots[1:]] = slots[parent[1:]]
        # The root is nobody's child.
        self.accept[slots[last]] = order

    @staticmethod
    def _nodes(symbols: np.ndarray, lengths: np.ndarray):
        """(parent, symbol) of each node, the root first, and each row's last node; rows are sorted and distinct."""
        n, depth = symbols.shape
        same = np.ones(n, dtype=bool)
        same[:1] = False
        parent, symbol = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
        at, last, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 1
        for d in range(depth):
            has = lengths > d
            # A row shares its node with the row before as long as all their symbols agree.
            agree = np.zeros(n, dtype=bool)
            agree[1:] = (symbols[1:, d] == symbols[:-1, d]) & has[:-1]
            same &= agree & has
            new = has & ~same
            parent.append(at[new])
            symbol.append(symbols[new, d])
            at = np.where(has, total + np.cumsum(new) - 1, at)
            total += int(new.sum())
            last[has] = at[has]
        return np.concatenate(parent), np.concatenate(symbol), last

    @staticmethod
    def _placed(parent: np.ndarray, symbol: np.ndarray):
        """(slot of each node, base of each node); children of a node are neighbours in the list."""
        n = len(parent)
        slots, base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if n == 1:
            return slots, base
        starts = np.flatnonzero(np.concatenate([[True], parent[2:] != parent[1:-1]])) + 1
        sizes = np.diff(np.append(starts, n))
        wide = sizes > WIDE
        base[parent[starts[wide]]] = 256 + 256 * np.arange(int(wide.sum()))
        # Twice the slots that all nodes need, and room behind them.
        used = np.zeros(512 + 256 * int(wide.sum()) + 2 * n + REACH, dtype=bool)
        used[:256] = True
        spread = np.repeat(wide, sizes)
        inside = np.flatnonzero(spread) + 1
        used[base[parent[inside]] + symbol[inside]] = True
        free = 256
        middle = np.flatnonzero((sizes > 1) & ~wide)
        for i in middle[np.argsort(-sizes[middle], kind="stable")].tolist():
            wanted = symbol[starts[i] : starts[i] + sizes[i]]
            begin = free
            while True:
                if begin + REACH + 256 > len(used):
                    used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
                taken = used[begin + wanted[0] : begin + wanted[0] + REACH].copy()
                for c in wanted[1:].tolist():
                    taken |= used[begin + c : begin + c + REACH]
                found = int(taken.argmin())
                if not taken[found]:
                    break
                begin += REACH
            base[parent[starts[i]]] = begin + found
            used[begin + found + wanted] = True
            # Where places are found late, the slots before them are nearly full.
            if found > REACH // 2 or begin > free:
                free += REACH // 4
        single = starts[sizes == 1]
        gaps = np.flatnonzero(~used)
        while len(gaps) < len(single):
            used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
            gaps = np.flatnonzero(~used)
        base[parent[single]] = gaps[: len(single)] - symbol[single]
        slots[1:] = base[parent[1:]] + symbol[1:]
        return slots, base

    def _advance(self, at: np.ndarray, states: np.ndarray, words: np.ndarray):
        """The places at which the trie goes on by the word that follows."""
        for shift in range(8 * (self.digits - 1), -1, -8):
            step = self.base[states] + ((words >> shift) & 255)
            on = self.check[step] == states
            at, states, words = at[on], step[on], words[on]
        return at, states

    def walk(self, text: np.ndarray, longest: int):
        """For 1 to ``longest`` words: (places, phrase or -1) of the places that are still in the trie."""
        at = np.flatnonzero(text > 0)
        top = 1 << (8 * self.digits)
        # Numbers beyond the digits are in no phrase.
        at = at[text[at] < top]
        states = np.zeros(len(at), dtype=np.int32)
        for k in range(longest):
            inside = at + k < len(text)
            at, states = at[inside], states[inside]
            words = text[at + k]
            fits = words < top
            at, states = self._advance(at[fits], states[fits], words[fits])
            yield at, self.accept[states]
