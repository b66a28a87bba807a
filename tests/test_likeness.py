import random
import time
from difflib import SequenceMatcher

import pytest

from lucerna.functions import likeness as L


def some(rng, signs, n):
    return "".join(rng.choice(signs) for _ in range(n))


@pytest.mark.parametrize("signs", ["ab", "abc", "abcdefgh ", "é漢ab", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))])
def test_ratio(signs):
    """The same share as the standard library's, also where frequent signs start no block."""
    rng = random.Random(signs)
    for k in range(400):
        n = rng.choice([0, 1, 3, 8, 20, 60, 199, 200, 260]) if k % 4 == 0 else rng.choice([0, 1, 3, 8, 20])
        left = some(rng, signs, rng.randint(0, n))
        right = left[: len(left) // 2] + some(rng, signs, rng.randint(0, n))
        want = SequenceMatcher(None, left, right).ratio()
        assert L.likeness(left, right) == want
        assert L.likeness(left, right, 0.8) == want or want < 0.8


def test_bounds():
    assert L.likeness("abc", "abcdefgh", 0.8) == 0 and L.likeness("abcd", "efgh", 0.8) == 0 and L.likeness("", "", 0.8) == 1


def test_long_texts():
    """A hundred thousand signs, few of them frequent, with scattered changes."""
    rng = random.Random(7)
    signs = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    left = some(rng, signs, 100_000)
    right = list(left)
    for _ in range(60):
        right[rng.randrange(len(right))] = "y"
    began = time.thread_time()
    assert L.likeness(left, "".join(right), 0.8) > 0.999
    assert time.thread_time() - began < 20


def test_runs_after_a_break():
    """The automaton of a text cut by frequent signs knows the runs of each part, and where they first end."""
    rng = random.Random(3)
    for _ in range(300):
        text, other = some(rng, "aabc|", 30), some(rng, "abc|", 20)
        size, end, at = L.Automaton(text, {"|"}).longest(other)
        runs = {(i, j): text[i:j] for i in range(30) for j in range(i + 1, 31) if "|" not in text[i:j]}
        best = max((j - i for (i, j), r in runs.items() if r in other), default=0)
        assert size == best
        if size:
            first = min(k for k in range(21 - size) if other[k : k + size] in runs.values())
            assert end == first + size and at == text.index(other[first : first + size]) + size
