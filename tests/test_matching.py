"""Matching blocks against the standard library's."""

import random
from difflib import SequenceMatcher

import pytest

from millrace.functions.matching import matching_size, ratio, ratio_bound


def expected(a, b):
    return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def pairs(rng, count, sizes, letters):
    for _ in range(count):
        a = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(4)] = [rng.choice(letters) for _ in range(rng.randrange(4))]
        yield a, "".join(b)


@pytest.mark.parametrize(("count", "sizes", "letters"), [(6000, (0, 1, 5, 12), "ab"), (3500, (20, 60), "abcde()= "), (400, (190, 199, 201, 260), "abc de"), (300, (180, 230), [chr(c) for c in range(40, 120)] + ["x"] * 9)])
def test_ten_thousand_pairs(count, sizes, letters):
    rng = random.Random(count)
    for a, b in pairs(rng, count, sizes, letters):
        assert matching_size(a, b) == expected(a, b), (a, b)
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio() <= ratio_bound(a, b)


def test_long_repetitive_texts():
    a, b = "x = y\n" * 400, "x = z\n" * 400
    assert matching_size(a, b) == expected(a, b)
    assert ratio("", "") == 1 and ratio("a", "") == 0
