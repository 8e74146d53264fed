"""Thousands of short pieces in one sequence."""

from collections import Counter

import pytest

from noteskein.llm import packing


@pytest.mark.parametrize("histogram", [{3: 8001, 2: 1}, {2500: 7, 1400: 4, 3: 8000}, {1500: 9, 2: 6000, 1: 3}])
def test_search_is_as_deep_as_pieces_are_many(histogram):
    plan = packing.bin_completion(histogram, 4096)
    packed = Counter()
    for uses, filling in plan:
        assert sum(length * n for length, n in filling) <= 4096
        for length, n in filling:
            packed[length] += uses * n
    assert packed == histogram
    assert sum(uses for uses, _ in plan) == -(-sum(length * n for length, n in histogram.items()) // 4096)
