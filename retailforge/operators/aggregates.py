"""Grouped aggregates of the reference (operators 42-62, 136)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailforge.functions.calendar import year_month


def monthly_clv(df: DataFrame, ts: str, revenue: Column | str, customer: str,
                purchases: Column | str | None = None, series: list[str] | None = None,
                drop_months: list[str] | None = None, money_decimals: int | None = None) -> DataFrame:
    """Monthly CLV table per series (42-44, 55, 56).

    One aggregation computes revenue, purchases and distinct customers per
    (series, month) - the reference's three summaries and two merges fused.
    ``purchases=None`` counts rows (``n()``); otherwise it is summed (ΣQuantity).
    ``money_decimals`` sums revenue exactly as a decimal of that scale (amounts
    in cents), so the total does not depend on the order of the partial sums.
    Lines without a customer count towards revenue and purchases; only the
    number of customers leaves them out.
    """
    series = list(series or [])
    rev = F.col(revenue) if isinstance(revenue, str) else revenue
    total = F.sum(rev)
    if money_decimals is not None:
        total = F.sum(rev.cast(f"decimal(24,{money_decimals})")).cast("double")
    pur = F.count(F.lit(1)) if purchases is None else F.sum(
        F.col(purchases) if isinstance(purchases, str) else purchases)
    g = (df.withColumn("MnthYr", year_month(ts))
           .groupBy(*series, "MnthYr")
           .agg(total.alias("total_Rev"), pur.alias("total_Pur"),
                F.countDistinct(customer).alias("total_Cust")))
    if drop_months:
        g = g.where(~F.col("MnthYr").isin(list(drop_months)))
    val = F.try_divide(F.col("total_Rev"), F.col("total_Pur"))
    freq = F.try_divide(F.col("total_Pur"), F.col("total_Cust"))
    return (g.withColumn("AVG_PUR_VAL", val).withColumn("AVG_PUR_FREQ", freq)
             .withColumn("total_CLV", F.col("AVG_PUR_VAL") * F.col("AVG_PUR_FREQ")))


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair in one pass, long form (var1, var2, corr) (58)."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                           F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return row.select(stacked.alias("p")).select("p.*")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Contingency table ``table(actual, predicted)`` in long form (59)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``mean(pred == actual)`` (60), optionally per group."""
    hit = F.coalesce((F.col(actual) == F.col(predicted)).cast("double"), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def item_frequency(baskets: DataFrame, basket: str, item: str, top: int = 10) -> DataFrame:
    """Relative frequency of items over baskets, top ``top`` (61, 64).

    Distinct (basket, item) pairs, a count per item and the global basket
    count as a scalar subquery; the top-k is the feature, ties broken by item.
    """
    pairs = baskets.select(basket, item).where(F.col(item).isNotNull()).distinct()
    n = baskets.select(F.countDistinct(basket)).scalar()
    return (pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n_baskets"))
                 .withColumn("support", F.col("n_baskets") / n)
                 .orderBy(F.desc("n_baskets"), F.asc(item)).limit(top))


def token_counts(df: DataFrame, col: str) -> DataFrame:
    """Word counts over the *distinct* values of a text column (62)."""
    words = F.explode(F.split(F.trim(F.col(col)), r"\s+", -1))
    return (df.select(col).where(F.col(col).isNotNull()).distinct().select(words.alias("token"))
              .where(F.col("token") != "").groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def top_n_per_group(df: DataFrame, group: str, value: str, n: int, tiebreak: str) -> DataFrame:
    """Rows ranked ``<= n`` by ``value`` desc within ``group`` (136).

    Meant for small per-model tables (importance lists); the window groups by model.
    """
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc(tiebreak))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pivot_wide(df: DataFrame, row: str, col: str, value: str, levels: list[str] | None = None) -> DataFrame:
    """Long -> wide with one column per ``col`` level (71, 136)."""
    return df.groupBy(row).pivot(col, levels).agg(F.first(value))


def schema_report(df: DataFrame) -> DataFrame:
    """``position, column, type, n_rows, n_null``: one row per column, in column order (134).

    The types are Spark's simple names.  The counts of all columns come from
    one aggregate over the rows, turned into rows afterwards; an empty table
    reports its columns with counts of 0, columns of one name each have a row.
    """
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    counts = named.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in named.columns])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col("n").alias("n_rows"),
                     (F.col("n") - F.col(f"c{i}")).alias("n_null")) for i, (name, kind) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))
