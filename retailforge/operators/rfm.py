"""Recency, frequency, monetary value and lifetime value (operators 28, 29, 45-54, 129).

Per-customer numbers are one ``groupBy`` each (partial aggregation map-side,
so a customer holding a third of the rows is pre-combined before the
shuffle).  Global scalars (max date, min/max for scaling) are scalar
subqueries: Spark computes them once and inlines the value, no cross join and
no collect.  ``rfm`` reads its lines once for the customers' sums, which are
written, and once more to attach the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailforge.session import stage

DAY_MICROS = 86400.0 * 1e6


def _as_ts(c: Column) -> Column:
    return c.cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Time difference in (fractional) days, as ``difftime(units='days')`` (78)."""
    return (F.unix_micros(_as_ts(later)) - F.unix_micros(_as_ts(earlier))) / F.lit(DAY_MICROS)


def month_end_close(ts: Column) -> Column:
    """Last second of the month of ``ts``: ``last_day`` + 23:59:59 (77)."""
    return F.to_timestamp(F.concat(F.last_day(ts).cast("string"), F.lit(" 23:59:59")))


def recency_by_customer(df: DataFrame, date_col: str, id_col: str, name: str = "RECENCY") -> DataFrame:
    """Days from each customer's last purchase to the close of the last month in the data (47)."""
    ref = df.select(month_end_close(F.max(date_col))).scalar()
    per = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(date_col).alias("__last"))
    return per.select(id_col, days_between(ref, F.col("__last")).alias(name))


def frequency_by_customer(df: DataFrame, date_col: str, id_col: str, name: str = "FREQUENCY",
                          distinct_on: str | None = None) -> DataFrame:
    """Lines per customer (count of non-null ``date_col``), or distinct ``distinct_on`` values (48)."""
    agg = F.countDistinct(distinct_on) if distinct_on else F.count(date_col)
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(agg.cast("long").alias(name))


def money_by_customer(df: DataFrame, price_col: str, qty_col: str | None, id_col: str,
                      name: str = "MONEY") -> DataFrame:
    """Σ price·quantity per customer; ``qty_col=None`` means quantity 1 (49)."""
    amount = F.col(price_col) * (F.col(qty_col) if qty_col else F.lit(1.0))
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sum(amount).alias(name))


def rfm_table(df: DataFrame, date_col: str, id_col: str, price_col: str,
              qty_col: str | None) -> DataFrame:
    """RECENCY, FREQUENCY, MONEY per customer; ``df`` is read once.

    The customers' sums are a written table, and the last date of all lines is
    the largest of its dates: lines without a customer are a row of their own
    there, which the result leaves out.
    """
    amount = F.col(price_col) * (F.col(qty_col) if qty_col else F.lit(1.0))
    per = stage(df.groupBy(id_col).agg(F.max(date_col).alias("__last"), F.count(date_col).alias("FREQUENCY"),
                                       F.sum(amount).alias("MONEY")), "customers")
    ref = per.select(month_end_close(F.max("__last"))).scalar()
    return per.where(F.col(id_col).isNotNull()).select(id_col, days_between(ref, F.col("__last")).alias("RECENCY"), "FREQUENCY", "MONEY")


def invert_recency_if_needed(df: DataFrame, col: str = "RECENCY") -> DataFrame:
    """``if min(RECENCY) > 1: RECENCY = 1/RECENCY`` (29), decided on the global minimum."""
    df = df.withColumn("__lo", df.select(F.min(col)).scalar())
    return df.withColumn(col, F.when(F.col("__lo") > 1, F.lit(1.0) / F.col(col))
                         .otherwise(F.col(col))).drop("__lo")


def _scaled(c: Column, lo: Column, hi: Column, low: float, high: float) -> Column:
    span = hi - lo
    return F.when(span != 0, (c - lo) / span * F.lit(high - low) + F.lit(low))


def normalise(df: DataFrame, col: str, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Min-max scaling of ``col`` into [low, high] as ``<col>_normalised`` (50).

    A constant column (max = min) yields NULL, as 0/0 does in the reference.
    """
    return normalise_columns(df, [col], low, high)


def normalise_columns(df: DataFrame, cols: list[str], low: float = 1.0, high: float = 5.0) -> DataFrame:
    """``normalise`` for several columns with one global min/max aggregate.

    The one-row aggregate is attached once as a struct column (a single
    scalar subquery) and read field by field.
    """
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    out = df.withColumn("__mm", df.select(F.struct(*aggs)).scalar())
    for i, c in enumerate(cols):
        out = out.withColumn(f"{c}_normalised",
                             _scaled(F.col(c), F.col(f"__mm.lo{i}"), F.col(f"__mm.hi{i}"), low, high))
    return out.drop("__mm")


def rfm(df: DataFrame, date_col: str, id_col: str, price_col: str, qty_col: str | None,
        attach: bool = True) -> DataFrame:
    """Full RFM scoring (129): raw scores, recency inversion, 1-5 scaling.

    Scaling runs on the customer table: every customer owns at least one line,
    so the min/max equal the row-level min/max of the reference.  One global
    aggregate serves both the inversion test and the scaling bounds, since
    1/x maps [lo, hi] onto [1/hi, 1/lo].  With ``attach`` the scores are
    joined back to every line (32) on the customer key.
    """
    scores = rfm_table(df, date_col, id_col, price_col, qty_col)
    mm = F.struct(*[f(c).alias(f"{f.__name__}_{c}") for c in ("RECENCY", "FREQUENCY", "MONEY")
                    for f in (F.min, F.max)])
    s = scores.withColumn("__mm", scores.select(mm).scalar())
    inv = F.col("__mm.min_RECENCY") > 1
    r = F.when(inv, F.lit(1.0) / F.col("RECENCY")).otherwise(F.col("RECENCY"))
    r_lo = F.when(inv, F.lit(1.0) / F.col("__mm.max_RECENCY")).otherwise(F.col("__mm.min_RECENCY"))
    r_hi = F.when(inv, F.lit(1.0) / F.col("__mm.min_RECENCY")).otherwise(F.col("__mm.max_RECENCY"))
    s = s.select(id_col, r.alias("RECENCY"), "FREQUENCY", "MONEY",
                 _scaled(r, r_lo, r_hi, 1.0, 5.0).alias("RECENCY_normalised"),
                 _scaled(F.col("FREQUENCY"), F.col("__mm.min_FREQUENCY"), F.col("__mm.max_FREQUENCY"),
                         1.0, 5.0).alias("FREQUENCY_normalised"),
                 _scaled(F.col("MONEY"), F.col("__mm.min_MONEY"), F.col("__mm.max_MONEY"),
                         1.0, 5.0).alias("MONEY_normalised"))
    if not attach:
        return s
    base = df.drop(*[c for c in s.columns if c != id_col and c in df.columns])
    return base.join(s, on=id_col, how="left")


def clv_global(df: DataFrame, price_col: str, qty_col: str | None, date_col: str,
               id_col: str) -> DataFrame:
    """Average order value, purchase frequency and CLV over the whole frame (46, 51-53)."""
    amount = F.col(price_col) * (F.col(qty_col) if qty_col else F.lit(1.0))
    g = df.agg(F.sum(amount).alias("total_revenue"), F.count(date_col).alias("total_orders"),
               F.countDistinct(id_col).alias("total_customers"))
    return g.select(
        "total_revenue", "total_orders", "total_customers",
        (F.col("total_revenue") / F.col("total_orders")).alias("avg_order_value"),
        (F.col("total_orders") / F.col("total_customers")).alias("purchase_frequency"),
        (F.col("total_revenue") / F.col("total_orders") * (F.col("total_orders") / F.col("total_customers"))).alias("clv"))


def clv_score(df: DataFrame, name: str = "clv") -> DataFrame:
    """Row-level score F_norm·M_norm·R_norm (54)."""
    return df.withColumn(name, F.col("FREQUENCY_normalised") * F.col("MONEY_normalised")
                         * F.col("RECENCY_normalised"))


def add_if_absent(df: DataFrame, name: str, build) -> DataFrame:
    """Guarded, idempotent column add (28): ``build(df)`` runs only when ``name`` is missing."""
    return df if name in df.columns else build(df)
