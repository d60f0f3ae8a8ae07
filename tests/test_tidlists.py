"""Vertical mining against brute force, and against published rules rebuilt from their counts."""

import random
from itertools import combinations

import pytest

from retailforge.operators.tidlists import basket_rules, frequent_sets, least_count


def brute(baskets, floor, max_len):
    """Supports of all sets by counting every subset of every basket."""
    out = {}
    for b in baskets.values():
        for k in range(1, max_len + 1):
            for s in combinations(sorted(b), k):
                out[s] = out.get(s, 0) + 1
    return {s: c for s, c in out.items() if c >= floor}


def frame(spark, baskets):
    rows = [(b, i) for b, items in baskets.items() for i in items]
    return spark.createDataFrame(rows, "basket string, item string")


@pytest.mark.parametrize("seed,items,share,floor", [(1, 9, 0.25, 3), (2, 7, 0.85, 12), (3, 8, 0.6, 6)])
def test_sets_equal_brute_force(spark, seed, items, share, floor):
    """Sparse, dense (differences from the second level on) and mixed baskets."""
    rng = random.Random(seed)
    baskets = {f"b{i}": {f"i{j}" for j in range(items) if rng.random() < (share if j % 3 else 0.95 * share)} for i in range(40)}
    baskets = {b: s for b, s in baskets.items() if s}
    got = {tuple(r["items"]): r["count"] for r in frequent_sets(frame(spark, baskets), "basket", "item", 0.0, floor, 6).collect()}
    assert got == brute(baskets, floor, 6)


def test_rules_equal_brute_force(spark):
    rng = random.Random(5)
    baskets = {f"b{i}": {f"i{j}" for j in range(7) if rng.random() < 0.55} | {"all"} for i in range(30)}
    sets = brute(baskets, 4, 8)
    want = {}
    for s, c in sets.items():
        for right in s if len(s) > 1 else ():
            left = tuple(x for x in s if x != right)
            conf = c / sets[left]
            lift = conf / (sets[(right,)] / 30)
            if conf >= 0.4 and lift > 1:
                want["{%s} => {%s}" % (",".join(left), right)] = (c / 30, conf, (c / 30) / conf, lift, c)
    got = {r["rules"]: tuple(r)[1:] for r in basket_rules(frame(spark, baskets), "basket", "item", 0.0, 0.4, 4).collect()}
    assert want and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_edges(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "x"), ("b", "x"), ("b", "y"), ("c", None)],
                               "basket string, item string")
    got = {tuple(r["items"]): (r["support"], r["count"]) for r in frequent_sets(df, "basket", "item", 0.0).collect()}
    assert got == {("x",): (1.0, 2), ("y",): (0.5, 1), ("x", "y"): (0.5, 1)}
    empty = df.limit(0)
    assert frequent_sets(empty, "basket", "item", 0.1).count() == 0
    assert basket_rules(empty, "basket", "item", 0.1, 0.1).count() == 0
    one = frequent_sets(df, "basket", "item", 0.0, max_len=1)
    assert sorted(tuple(r["items"]) for r in one.collect()) == [("x",), ("y",)]
    assert least_count(92844, 5e-5) == 5 and least_count(10, 5e-5, 2) == 2
