"""How like two texts are: twice the signs in matching blocks over all signs.

The longest run that both texts share is a block (of equally long ones the first of the left text, and then of the right); what lies
before it on both sides and what lies after are matched in the same way. In a right text of 200 signs or more, signs that make up over a
hundredth of it start no block and only lengthen one.

Runs are found with a suffix automaton of the right text's window: it reads the left window once, sign by sign, and knows at each the
longest run that ends there, so a block takes time in proportion to both windows, not to their product. Bounds from lengths and from
counts of signs settle most pairs before that.
"""

from __future__ import annotations

from collections import Counter

#: From this length on frequent signs start no block; the share, in hundredths, beyond which a sign is frequent.
LONG, HUNDREDTH = 200, 100


def frequent(right: str) -> set[str]:
    if len(right) < LONG:
        return set()
    most = len(right) // HUNDREDTH + 1
    return {c for c, n in Counter(right).items() if n > most}


class Automaton:
    """All runs of a text without certain signs; each state knows its longest run and where that first ends."""

    def __init__(self, text: str, without: set[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for at, sign in enumerate(text):
            if sign in without:
                last = 0
                continue
            last = self._grow(last, sign, at)

    def _state(self, edges: dict, link: int, size: int, end: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def _grow(self, last: int, sign: str, at: int) -> int:
        """The state of the run `last` lengthened by a sign, which may be there already where texts are added after a break."""
        known = self.next[last].get(sign)
        if known is not None and self.size[known] == self.size[last] + 1:
            return known
        new = self._state({}, 0, self.size[last] + 1, at) if known is None else -1
        p = last
        while new >= 0 and p >= 0 and sign not in self.next[p]:
            self.next[p][sign] = new
            p = self.link[p]
        if new >= 0 and p < 0:
            return new
        q = self.next[p][sign]
        if self.size[q] == self.size[p] + 1:
            copy = q
        else:
            copy = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.end[q])
            while p >= 0 and self.next[p].get(sign) == q:
                self.next[p][sign] = copy
                p = self.link[p]
            self.link[q] = copy
        if new < 0:
            return copy
        self.link[new] = copy
        return new

    def longest(self, text: str) -> tuple[int, int, int]:
        """(size, end in the text, end in the automaton's text) of the longest shared run, the first of such; ends are exclusive."""
        best, state, size = (0, 0, 0), 0, 0
        for at, sign in enumerate(text):
            while state and sign not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if sign in self.next[state]:
                state = self.next[state][sign]
                size += 1
                if size > best[0]:
                    best = (size, at + 1, self.end[state] + 1)
        return best


def matching(left: str, right: str) -> int:
    """How many signs lie in matching blocks."""
    rare = frequent(right)
    total, windows = 0, [(0, len(left), 0, len(right))]
    while windows:
        a0, a1, b0, b1 = windows.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        size, a, b = Automaton(right[b0:b1], rare).longest(left[a0:a1])
        a, b = a + a0 - size, b + b0 - size
        if not size:  # frequent signs alone lengthen nothing from the window's start on
            a, b = a0, b0
        while a > a0 and b > b0 and left[a - 1] == right[b - 1]:
            a, b, size = a - 1, b - 1, size + 1
        while a + size < a1 and b + size < b1 and left[a + size] == right[b + size]:
            size += 1
        if size:
            total += size
            windows += [(a0, a, b0, b), (a + size, a1, b + size, b1)]
    return total


def likeness(left: str, right: str, least: float = 0.0) -> float:
    """The share of matching signs; 0 where bounds show that it is below `least`."""
    both = len(left) + len(right)
    if not both:
        return 1.0
    if 2 * min(len(left), len(right)) / both < least:
        return 0.0
    if least and 2 * (Counter(left) & Counter(right)).total() / both < least:
        return 0.0
    return 2 * matching(left, right) / both
