"""Frequent itemsets and rules at very low support by vertical lists (operators 85-91, 132).

For baskets over millions of items (sellers, products) at supports of a few baskets.  A set is a prefix and a
last item; its vertical list is one row ``(prefix, last, basket)`` per basket that holds it, so no list is an
array in one row.  A level joins the lists of a prefix basket by basket: rows are dealt by (prefix, basket), an
item in a third of all baskets is spread over as many keys as it has baskets.  Support is a grouped count of the
meeting rows, summed map-side.

Classes (sets of one prefix) whose members hold more than half of the prefix's baskets go on as differences:
``d(Px) = t(P) \\ t(Px)`` is the shorter list there, and ``|t(Pxy)| = |t(Px)| + |t(Py)| - |t(P)| + |d(Px) ∩ d(Py)|``.
Below such a class all lists stay differences.

Items are numbered by rising support, so that classes of frequent prefixes have few later members.  Each level is
written under the checkpoint folder; list tables are deleted once the next level stands.  The driver sees row counts only.

Repeated (basket, item) rows count once; rows with a NULL basket or item are left out, as is a basket of NULL
items alone.  An empty frame gives no sets and no rules.  Pairs that meet in a basket are counted one by one, so
the work of the second level grows with the sum of squared basket sizes over frequent items.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailforge.functions.ordering import sequential_index
from retailforge.session import release, stage

#: Share of the prefix's baskets above which the members of a class go on as differences.
DENSE = 0.5


class Mined(NamedTuple):
    """``sets`` (ranks array<bigint> ascending, freq), ``items`` (item, freq, rank), number of baskets, least count."""

    sets: DataFrame
    items: DataFrame
    n: int
    floor: int


def least_count(n: int, min_support: float, min_count: int = 1) -> int:
    """Baskets that a frequent set needs: ``ceil(min_support * n)``, at least ``min_count``."""
    return max(1, min_count, math.ceil(min_support * n))


def _extend(sets: DataFrame, lists: DataFrame, floor: int, dense: bool) -> tuple[DataFrame, DataFrame | None, bool] | None:
    """Sets and lists of the next level; ``dense`` says whether any class of this level holds differences."""
    x_rows = lists.withColumnRenamed("last", "x")
    y_rows = lists.withColumnRenamed("last", "y")
    meeting = x_rows.join(y_rows, ["prefix", "basket"]).where("x < y")
    met = meeting.groupBy("prefix", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    sx = sets.select("prefix", F.col("last").alias("x"), F.col("freq").alias("fx"), "above", "diff")
    found = (met.where(F.col("c") >= floor).join(sx.where("not diff"), ["prefix", "x"])
             .select("prefix", "x", "y", F.col("c").alias("freq"), F.col("fx").alias("above"), "diff"))
    if dense:
        sy = sets.select("prefix", F.col("last").alias("y"), F.col("freq").alias("fy"))
        freq = F.col("fx") + F.col("fy") - F.col("above") + F.coalesce("c", F.lit(0))
        found = found.unionByName(
            sx.where("diff").join(sy, "prefix").where("x < y").join(met, ["prefix", "x", "y"], "left")
            .select("prefix", "x", "y", freq.alias("freq"), F.col("fx").alias("above"), "diff")
            .where(F.col("freq") >= floor))
    found = stage(found, "tidlist-found")
    half = F.sum("freq") > F.lit(DENSE) * F.count(F.lit(1)) * F.first("above")
    classes = (found.groupBy("prefix", "x").agg(F.count(F.lit(1)).alias("members"), (F.first("diff") | half).alias("to_diff")))
    grown = stage(found.join(classes, ["prefix", "x"]), "tidlist-grown")
    state = grown.agg(F.count(F.lit(1)), F.max((F.col("members") > 1).cast("int")),
                      F.max(((F.col("members") > 1) & F.col("to_diff")).cast("int"))).first()
    if not state[0]:
        release(found, grown)
        return None
    child = F.concat("prefix", F.array("x")).alias("prefix")
    out = stage(grown.select(child, F.col("y").alias("last"), "freq", "above", F.col("to_diff").alias("diff")), "tidlist-sets")
    nxt = None
    if state[1]:
        live = grown.where("members > 1").select("prefix", "x", "y", "diff", "to_diff")
        kept = meeting.join(live.where("not to_diff").drop("diff", "to_diff"), ["prefix", "x", "y"])
        parts = kept.select(child, F.col("y").alias("last"), "basket")
        if state[2]:
            turned = (x_rows.join(live.where("to_diff and not diff"), ["prefix", "x"])
                      .join(y_rows, ["prefix", "y", "basket"], "left_anti"))
            again = y_rows.join(live.where("diff"), ["prefix", "y"]).join(x_rows, ["prefix", "x", "basket"], "left_anti")
            for p in (turned, again):
                parts = parts.unionByName(p.select(child, F.col("y").alias("last"), "basket"))
        nxt = stage(parts, "tidlist-lists")
    release(found, grown)
    return out, nxt, bool(state[2])


def mine(df: DataFrame, basket: str | Column, item: str | Column, min_support: float, min_count: int = 1,
         max_len: int = 10) -> Mined:
    """All sets of up to ``max_len`` items that at least ``least_count`` baskets hold (87)."""
    b = F.col(basket) if isinstance(basket, str) else basket
    i = F.col(item) if isinstance(item, str) else item
    pairs = stage(df.select(b.alias("basket"), i.cast("string").alias("item")).dropna().distinct(), "tidlist-pairs")
    n = pairs.agg(F.countDistinct("basket")).first()[0]
    floor = least_count(n, min_support, min_count)
    counts = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= floor)
    items = stage(sequential_index(counts, ["freq", "item"], "rank"), "tidlist-items")
    root = F.array().cast("array<bigint>").alias("prefix")
    sets = stage(items.select(root, F.col("rank").alias("last"), "freq", F.lit(n).cast("long").alias("above"),
                              F.lit(False).alias("diff")), "tidlist-sets")
    lists = stage(pairs.join(items, "item").select(root, F.col("rank").alias("last"), "basket"), "tidlist-lists")
    release(pairs)
    levels, dense = [sets], False
    for _ in range(max_len - 1):
        step = _extend(sets, lists, floor, dense)
        release(lists)
        lists = None
        if step is None:
            break
        sets, lists, dense = step
        levels.append(sets)
        if lists is None:
            break
    if lists is not None:
        release(lists)
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    mined = stage(union.select(F.concat("prefix", F.array("last")).alias("ranks"), "freq"), "tidlist-mined")
    release(*levels)
    return Mined(mined, items, n, floor)


def _named(df: DataFrame, ranks: str, items: DataFrame, name: str) -> DataFrame:
    """Replace the array ``ranks`` by the sorted array of item texts ``name``; every other column is part of the key."""
    names = items.select(F.col("rank").alias("__r"), F.col("item").alias("__i"))
    rest = [c for c in df.columns if c != ranks]
    return (df.select("*", F.explode(ranks).alias("__r")).join(names, "__r").groupBy(*df.columns)
            .agg(F.array_sort(F.collect_list("__i")).alias(name)).select(*rest, name))


def frequent_sets(df: DataFrame, basket: str | Column, item: str | Column, min_support: float, min_count: int = 1,
                  max_len: int = 10) -> DataFrame:
    """(items array<string> sorted, size, support, count) of every frequent set (87)."""
    m = mine(df, basket, item, min_support, min_count, max_len)
    out = _named(m.sets, "ranks", m.items, "items")
    return out.select("items", F.size("items").alias("size"), (F.col("freq") / F.lit(float(max(m.n, 1)))).alias("support"),
                      F.col("freq").alias("count"))


def basket_rules(df: DataFrame, basket: str | Column, item: str | Column, min_support: float, min_confidence: float,
                 min_count: int = 1, max_len: int = 10, min_lift: float | None = 1.0) -> DataFrame:
    """Rules ``{a,b} => {c}`` with support, confidence, coverage, lift and count (88-91, 132).

    One item on the right, as the study's rules; ``min_lift`` keeps rules with lift strictly above it (None: all).
    """
    m = mine(df, basket, item, min_support, min_count, max_len)
    n = F.lit(float(max(m.n, 1)))
    whole = m.sets.where(F.size("ranks") > 1).select("ranks", "freq", F.explode("ranks").alias("right"))
    whole = whole.select(F.array_except("ranks", F.array("right")).alias("left"), "right", "freq")
    left = m.sets.select(F.col("ranks").alias("left"), F.col("freq").alias("left_freq"))
    single = m.items.select(F.col("rank").alias("right"), F.col("item").alias("right_item"), F.col("freq").alias("right_freq"))
    confidence = F.col("freq") / F.col("left_freq")
    scored = (whole.join(left, "left").where(confidence >= F.lit(float(min_confidence))).join(single, "right")
              .select("left", "right_item", (F.col("freq") / n).alias("support"), confidence.alias("confidence"),
                      (confidence / (F.col("right_freq") / n)).alias("lift"), F.col("freq").alias("count")))
    if min_lift is not None:
        scored = scored.where(F.col("lift") > F.lit(float(min_lift)))
    text = F.concat(F.lit("{"), F.concat_ws(",", "left_items"), F.lit("} => {"), F.col("right_item"), F.lit("}"))
    return _named(scored, "left", m.items, "left_items").select(
        text.alias("rules"), "support", "confidence", (F.col("support") / F.col("confidence")).alias("coverage"), "lift", "count")
