"""Baskets, frequent itemsets and association rules (operators 85-91, 132).

Baskets are arrays of distinct items (never the dense basket × item 0/1
matrix, whose width is unbounded).  Mining is MLlib's parallel FP-growth:
frequent single items are counted in one aggregate, conditional trees are
sharded by item across ``num_partitions`` tasks, so no basket list is
gathered anywhere; only the frequent-item list (at most Σ|basket| / floor
entries) reaches the driver.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailforge.functions.calendar import year_quarter_label


def basket_lists(df: DataFrame, basket: str | Column, item: str | Column) -> DataFrame:
    """(basket, items) with ``items`` the sorted distinct items of the basket (85, 86).

    Items below the support floor are left in: FP-growth drops them itself
    after its frequent-item count, and every basket must stay in the
    denominator of the support.
    """
    b = F.col(basket) if isinstance(basket, str) else basket
    it = F.col(item) if isinstance(item, str) else item
    pairs = df.select(b.alias("basket"), it.cast("string").alias("item")) \
              .where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()
    return pairs.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))


def customer_quarter_key(customer: str, ts: str) -> Column:
    """``customerUID-yy/0Q`` basket key (86)."""
    return F.concat(F.col(customer).cast("string"), F.lit("-"), year_quarter_label(ts))


def _fit(baskets: DataFrame, min_support: float, min_confidence: float, num_partitions: int | None):
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    return fp.fit(baskets)


def rule_text(antecedent: Column, consequent: Column) -> Column:
    """``{a,b} => {c}`` as arules prints a rule (91)."""
    return F.concat(F.lit("{"), F.concat_ws(",", F.array_sort(antecedent)), F.lit("} => {"),
                    F.concat_ws(",", F.array_sort(consequent)), F.lit("}"))


def frequent_itemsets(baskets: DataFrame, min_support: float, max_len: int = 10,
                      num_partitions: int | None = None) -> DataFrame:
    """Frequent itemsets with support and count, sizes up to ``max_len`` (87)."""
    from retailforge.session import stage
    baskets = stage(baskets.select("items"), "baskets")  # counted, mined and re-read by the rules
    n = baskets.count()
    model = _fit(baskets, min_support, 1.0, num_partitions)
    fi = model.freqItemsets.where(F.size("items") <= max_len)
    return fi.select(F.concat(F.lit("{"), F.concat_ws(",", F.array_sort("items")), F.lit("}")).alias("items"),
                     F.size("items").alias("size"), (F.col("freq") / F.lit(float(n))).alias("support"),
                     F.col("freq").alias("count"))


def association_rules(baskets: DataFrame, min_support: float, min_confidence: float, min_len: int = 2,
                      max_len: int = 10, min_lift: float | None = 1.0,
                      num_partitions: int | None = None) -> DataFrame:
    """Rules with support, confidence, coverage, lift and count (88-91).

    ``min_lift`` keeps rules with lift strictly above it (the reference's
    ``lift > 1`` subset); coverage = support / confidence is the antecedent's
    support and count = support · n (89).
    """
    from retailforge.session import stage
    baskets = stage(baskets.select("items"), "baskets")
    n = baskets.count()
    model = _fit(baskets, min_support, min_confidence, num_partitions)
    r = model.associationRules.where((F.size("antecedent") + F.size("consequent") >= min_len)
                                     & (F.size("antecedent") + F.size("consequent") <= max_len))
    if min_lift is not None:
        r = r.where(F.col("lift") > min_lift)
    return r.select(rule_text("antecedent", "consequent").alias("rules"), "support", "confidence",
                    (F.col("support") / F.col("confidence")).alias("coverage"), "lift",
                    F.round(F.col("support") * F.lit(float(n))).cast("long").alias("count"))


def basket_matrix(baskets_long: DataFrame, basket: str, item: str, items: list[str]) -> DataFrame:
    """Long -> wide 0/1 matrix for an explicit item list (71); mining never uses it.

    One aggregate with a number per item and basket: repeated pairs need no
    pass of their own, and a task holds one small row per basket.
    """
    has = F.col(item).cast("string")
    return baskets_long.groupBy(basket).agg(*[F.max(F.coalesce((has == F.lit(i)).cast("int"), F.lit(0))).alias(i) for i in items])
