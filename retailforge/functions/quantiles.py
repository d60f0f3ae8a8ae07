"""Exact quantiles without gathering a column in one task.

``percentile`` merges a value->count map of the whole column in one task;
for a high-cardinality double column that map is unbounded.  Here each pass
is one grouped aggregate (count/min/max per bucket of the current interval
around every target rank) whose result is at most ``targets × buckets``
rows; the interval shrinks by ``buckets`` per pass.  Once a target's
interval holds at most ``gather`` rows (or a single distinct value) those rows
are fetched and ranked.  Interpolation is linear between order statistics
at h = (n−1)·p, the convention of pandas ``describe`` and SQL
``percentile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order_stats(df: DataFrame, col: str, ranks: list[int], n: int, lo: float, hi: float,
                 buckets: int = 1024, gather: int = 50000, max_passes: int = 64) -> dict[int, float]:
    x = F.col(col)
    todo = {k: (lo, hi, 0) for k in sorted(set(ranks))}  # rank -> (lo, hi, rows below lo)
    found: dict[int, float] = {}
    for _ in range(max_passes):
        if not todo:
            break
        items = list(todo.items())
        # rank the pending targets; one explode row per (target, value in its interval)
        cands = []
        for i, (k, (a, b, _)) in enumerate(items):
            width = (b - a) / buckets if b > a else 1.0
            bucket = F.least(F.greatest(F.floor((x - F.lit(a)) / F.lit(width)), F.lit(0)),
                             F.lit(buckets - 1)).cast("int")
            cands.append(F.when((x >= F.lit(a)) & (x <= F.lit(b)), F.struct(F.lit(i).alias("t"), bucket.alias("b"))))
        hits = (df.where(x.isNotNull()).select(F.explode(F.array(*cands)).alias("h"), x.alias("v"))
                  .where(F.col("h").isNotNull())
                  .groupBy("h.t", "h.b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"),
                                              F.max("v").alias("mx"))
                  .collect())
        per_t: dict[int, list] = {}
        for r in hits:
            per_t.setdefault(r["t"], []).append((r["b"], r["c"], r["mn"], r["mx"]))
        nxt = {}
        gathers = []
        for i, (k, (a, b, below)) in enumerate(items):
            acc = below
            for bkt, c, mn, mx in sorted(per_t.get(i, [])):
                if acc + c > k:
                    if mn == mx:
                        found[k] = mn
                    elif c <= gather:
                        gathers.append((k, mn, mx, acc))
                    else:
                        nxt[k] = (mn, mx, acc)
                    break
                acc += c
        for k, a, b, below in gathers:
            vals = sorted(r[0] for r in df.where((x >= F.lit(a)) & (x <= F.lit(b))).select(x).collect())
            found[k] = vals[k - below]
        todo = nxt
    return found


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> dict[float, float | None]:
    """Exact linear-interpolated quantiles of ``col`` for each ``p`` in ``probs``."""
    stats = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    if not n:
        return {p: None for p in probs}
    lo, hi = float(lo), float(hi)
    ranks = []
    for p in probs:
        h = (n - 1) * p
        ranks += [math.floor(h), math.ceil(h)]
    got = _order_stats(df.select(F.col(col).cast("double").alias(col)), col, ranks, n, lo, hi)
    out = {}
    for p in probs:
        h = (n - 1) * p
        a, b = got[math.floor(h)], got[math.ceil(h)]
        out[p] = a + (h - math.floor(h)) * (b - a)
    return out


def kth_smallest(df: DataFrame, col: str, k: int) -> float:
    """Value of 0-based rank ``k`` of ``col`` (exact, same passes as ``exact_quantiles``)."""
    stats = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    n = stats["n"]
    if not 0 <= k < n:
        raise ValueError(f"rank {k} outside 0..{n - 1}")
    d = df.select(F.col(col).cast("double").alias(col))
    return _order_stats(d, col, [k], n, float(stats["lo"]), float(stats["hi"]))[k]
