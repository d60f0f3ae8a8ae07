"""The local search of packing ends where no move or exchange is left, not earlier."""

from itertools import combinations

import numpy as np
import pytest

from retailforge.llm import packing


@pytest.mark.parametrize("lengths", [(205, 340, 341, 515), (300, 350, 400, 450, 520, 700), (90, 333, 350, 610)])
def test_no_step_is_left(lengths):
    rng = np.random.default_rng(6)
    sizes, capacity = rng.choice(lengths, 400).tolist(), 1024
    bins = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    held = [[sizes[i] for i in b] for b in bins]
    fill = [sum(b) for b in held]
    assert max(fill) <= capacity
    if len(bins) == -(-sum(sizes) // capacity):
        return
    kinds = {tuple(sorted(b)) for b in held}
    under = [b for b in kinds if sum(b) < capacity]
    for a in under:
        for b in under:
            if a == b and held.count(list(a)) < 2 and sum(tuple(sorted(h)) == a for h in held) < 2:
                continue
            go = {n for n in a} | {m + n for m, n in combinations(a, 2)}
            for d in {n - m for n in go for m in b} | set(a):
                room = capacity - sum(b)
                assert not (0 < d <= room and sum(b) + d > sum(a)), (a, b, d)


def test_partial_exchanges_empty_bins():
    sizes = np.random.default_rng(0).choice([205, 340, 341, 515], 3000).tolist()
    assert len(packing.pack(sizes, 1024)) < len(packing.best_fit(sizes, 1024)) - 20
