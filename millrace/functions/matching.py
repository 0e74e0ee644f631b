"""How alike two texts are by their matching blocks: the longest common block, then the same to its left and right.

Blocks are found by a suffix automaton of the second text, in time linear in both, where looking at all places of each
character takes their product on repetitive texts. Characters that make up more than a hundredth of a second text of 200
characters or more begin no block, but extend one. Of equally long blocks the first in the first text counts, then the
first in the second. Results are those of the standard library's sequence matcher, which the tests compare with.
"""

from __future__ import annotations

from collections import Counter

#: Characters from which a second text has frequent ones, which share makes them so (fixed values).
LONG, SHARE = 200, 100


class _Automaton:
    """The substrings of a text as states; of each, where it ends first."""

    def __init__(self, symbols: list, offset: int) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at, symbol in enumerate(symbols, offset):
            last = self._extend(last, symbol, at)

    def _state(self, length: int, first: int, edges: dict, link: int = 0) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, symbol: object, at: int) -> int:
        new = self._state(self.length[last] + 1, at, {})
        p = last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            if self.length[q] != self.length[p] + 1:
                twin = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
                while p != -1 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = twin
                    p = self.link[p]
                self.link[q] = q = twin
            self.link[new] = q
        return new

    def longest_in(self, text: str, start: int, end: int) -> tuple[int, int, int]:
        """Length of the longest substring that the text has between two places, and where it ends there and here."""
        state = length = 0
        best = (0, 0, 0)
        for at in range(start, end):
            symbol = text[at]
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(symbol, 0)
            length = length + 1 if state else 0
            if length > best[0]:
                best = (length, at, self.first[state])
        return best


def matching_size(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts."""
    frequent = {c for c, n in Counter(b).items() if n > len(b) // SHARE + 1} if len(b) >= LONG else set()
    symbols = [at if c in frequent else c for at, c in enumerate(b)]  # a place is no character, and equals nothing
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        size, a_end, b_end = _Automaton(symbols[b_from:b_to], b_from).longest_in(a, a_from, a_to)
        i, j = (a_end - size + 1, b_end - size + 1) if size else (a_from, b_from)
        k, m = i + size, j + size
        while i > a_from and j > b_from and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while k < a_to and m < b_to and a[k] == b[m]:
            k, m = k + 1, m + 1
        if k > i:
            total += k - i
            todo += [x for x in ((a_from, i, b_from, j), (k, a_to, m, b_to)) if x[0] < x[1] and x[2] < x[3]]
    return total


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all; 1 for two empty texts."""
    return 2 * matching_size(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratio_bound(a: str, b: str) -> float:
    """What their lengths let the ratio be at most."""
    return 2 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0
