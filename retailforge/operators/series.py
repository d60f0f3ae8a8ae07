"""Monthly series operators (55, 66-68, 116, 124, 31).

A series collection is a long frame ``(keys..., month, t, value)``; each
series is a handful of rows per month, so per-series windows and arrays are
bounded by the length of the calendar, not by the data volume.  The axis that
grows with data is the *number* of series, and every operator here is a
grouped job over series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_series(df: DataFrame, keys: list[str], month_col: str, value_col: str,
                   gap: str = "zero") -> DataFrame:
    """Regular monthly series (116): every month from first to last per series, t = 1..n.

    ``gap``: 'zero' fills missing months with 0, 'null' leaves NULL.
    """
    m = df.select(*keys, F.to_date(F.concat(F.col(month_col), F.lit("-01"))).alias("month"),
                  F.col(value_col).cast("double").alias("value"))
    bounds = m.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    grid = bounds.select(*keys, "first", F.explode(F.sequence("first", "last", F.expr("interval 1 month")))
                         .alias("month"))
    dense = grid.join(m, on=keys + ["month"], how="left")
    val = F.coalesce(F.col("value"), F.lit(0.0)) if gap == "zero" else F.col("value")
    return dense.select(*keys, F.date_format("month", "yyyy-MM").alias(month_col),
                        (F.months_between("month", "first").cast("int") + 1).alias("t"), val.alias("value"))


def series_length(keys: list[str]) -> F.Column:
    return F.max("t").over(Window.partitionBy(*keys))


def series_split(df: DataFrame, keys: list[str], h: int) -> DataFrame:
    """Tag the last ``h`` points of each series as 'test' (31)."""
    n = series_length(keys)
    return df.withColumn("set", F.when(F.col("t") <= n - F.lit(h), "train").otherwise("test"))


def series_diff(df: DataFrame, keys: list[str], d: int = 1, value: str = "value") -> DataFrame:
    """``diff(x, differences=d)`` per series (66): lag applied d times; first d points dropped."""
    w = Window.partitionBy(*keys).orderBy("t")
    out = df
    for i in range(d):
        out = out.withColumn(value, F.col(value) - F.lag(value, 1).over(w))
    return out.where(F.col(value).isNotNull())


def acf(df: DataFrame, keys: list[str], max_lag: int | None = None, value: str = "value") -> DataFrame:
    """Autocorrelation per series for k = 0..K, K = floor(10·log10 n) by default (67).

    A self-join on (series, t = t' + k) over the lag-exploded rows: linear in
    n·K, no per-series collection.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    lim = F.lit(max_lag) if max_lag is not None else F.floor(F.lit(10.0) * F.log10("n")).cast("int")
    x = df.join(stats, keys).select(*keys, "t", (F.col(value) - F.col("m")).alias("xc"), "n",
                                    F.least(lim, F.col("n") - 1).alias("K"))
    lagged = x.select(*keys, "t", "xc", F.explode(F.sequence(F.lit(0), F.col("K"))).alias("k"))
    other = x.select(*keys, F.col("t").alias("t2"), F.col("xc").alias("xc2"))
    prod = lagged.join(other, on=keys).where(F.col("t2") == F.col("t") - F.col("k"))
    num = prod.groupBy(*keys, "k").agg(F.sum(F.col("xc") * F.col("xc2")).alias("num"))
    den = x.groupBy(*keys).agg(F.sum(F.col("xc") * F.col("xc")).alias("den"), F.first("n").alias("n"))
    return num.join(den, keys).select(*keys, "k", F.try_divide("num", "den").alias("acf"), "n")


def _durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations 1..K from autocorrelations r[0..K]."""
    K = len(r) - 1
    out = np.zeros(K)
    phi = np.zeros(K + 1)
    for k in range(1, K + 1):
        if k == 1:
            a = r[1]
        else:
            a = (r[k] - np.dot(phi[1:k], r[1:k][::-1])) / (1 - np.dot(phi[1:k], r[1:k]))
        new = phi.copy()
        new[k] = a
        for j in range(1, k):
            new[j] = phi[j] - a * phi[k - j]
        phi = new
        out[k - 1] = a
    return out


def pacf(acf_df: DataFrame, keys: list[str]) -> DataFrame:
    """Partial autocorrelation and the ±1.96/√n significance flag per series (68)."""
    schema = ", ".join([f"{k} {t}" for k, t in acf_df.select(*keys).dtypes] +
                       ["k int", "pacf double", "bound double", "significant boolean"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        r = pdf["acf"].to_numpy()
        p = _durbin_levinson(r) if len(r) > 1 else np.zeros(0)
        n = int(pdf["n"].iloc[0])
        bound = 1.96 / math.sqrt(n)
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(len(p)))
        out["k"] = np.arange(1, len(p) + 1, dtype="int32")
        out["pacf"] = p
        out["bound"] = bound
        out["significant"] = np.abs(p) > bound
        return out
    return acf_df.groupBy(*keys).applyInPandas(fn, schema)


def forecast_accuracy(df: DataFrame, keys: list[str], actual: str = "value", forecast: str = "forecast",
                      scale: str = "scale") -> DataFrame:
    """ME, RMSE, MAE, MPE, MAPE, MASE, ACF1 and Theil's U over the rows of each series (124).

    ``scale`` is the in-sample naive MAE of the series (MASE denominator).
    """
    w = Window.partitionBy(*keys).orderBy("t")
    e = F.col(actual) - F.col(forecast)
    d = df.withColumn("e", e).withColumn("y_prev", F.lag(actual, 1).over(w)) \
          .withColumn("e_next", F.lag("e", -1).over(w))
    g = d.groupBy(*keys).agg(
        F.avg("e").alias("ME"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("RMSE"),
        F.avg(F.abs("e")).alias("MAE"), F.avg(F.try_divide(F.col("e") * 100, F.col(actual))).alias("MPE"),
        F.avg(F.abs(F.try_divide(F.col("e") * 100, F.col(actual)))).alias("MAPE"),
        F.first(scale).alias("__scale"),
        F.sum(F.pow(F.try_divide(F.col(forecast) - F.col(actual), F.col("y_prev")), 2)).alias("__u1"),
        F.sum(F.pow(F.try_divide(F.col(actual) - F.col("y_prev"), F.col("y_prev")), 2)).alias("__u2"))
    me = d.groupBy(*keys).agg(F.avg("e").alias("__m"))
    a1 = d.join(me, keys).groupBy(*keys).agg(
        F.sum((F.col("e") - F.col("__m")) * (F.col("e_next") - F.col("__m"))).alias("__an"),
        F.sum((F.col("e") - F.col("__m")) * (F.col("e") - F.col("__m"))).alias("__ad"))
    return g.join(a1, keys).select(
        *keys, "ME", "RMSE", "MAE", "MPE", "MAPE", F.try_divide("MAE", "__scale").alias("MASE"),
        F.try_divide(F.col("__an"), F.col("__ad")).alias("ACF1"),
        F.sqrt(F.try_divide(F.col("__u1"), F.col("__u2"))).alias("TheilU"))


def accuracy_by_set(df: DataFrame, keys: list[str], lags: dict[str, int], set_col: str = "set", train: str = "train",
                    actual: str = "value", forecast: str = "forecast") -> DataFrame:
    """Accuracy of each series on its training rows and on its test rows (124): one row per (series, set).

    ``forecast`` holds the fitted values on training rows; rows without one
    (the start of a path) count in no error measure.  ``lags`` names the MASE
    columns and the lag of the naive forecast that scales each: 1 for the
    last value, 12 for the same month of the year before; the scale comes from
    the training rows alone and is NULL where they are no longer than the
    lag.  Theil's U compares with the last value and is given for test rows.
    All windows and the grouping share the partitioning by series.
    """
    by_t, whole = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    d = df.select(*keys, F.col(set_col).alias("set"), "t", F.col(actual).alias("y"), F.col(forecast).alias("f")).repartition(*keys)
    for name, lag in lags.items():
        step = F.when(F.col("set") == train, F.abs(F.col("y") - F.lag("y", lag).over(by_t)))
        d = d.withColumn(f"__step_{name}", step).withColumn(f"__scale_{name}", F.avg(f"__step_{name}").over(whole))
    part = Window.partitionBy(*keys, "set")
    d = d.withColumn("e", F.col("y") - F.col("f")).withColumn("m", F.avg("e").over(part))
    d = d.withColumn("e_next", F.lead("e").over(part.orderBy("t"))).withColumn("y_prev", F.lag("y").over(part.orderBy("t")))
    e, off = F.col("e"), F.col("e") - F.col("m")
    relative = F.try_divide(e * 100, F.col("y"))
    u = [F.when(F.col("set") != train, F.pow(F.try_divide(x, F.col("y_prev")), 2)) for x in (e, F.col("y") - F.col("y_prev"))]
    out = d.groupBy(*keys, "set").agg(
        F.count("e").alias("n"), F.avg("e").alias("ME"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"),
        F.avg(relative).alias("MPE"), F.avg(F.abs(relative)).alias("MAPE"),
        *[F.try_divide(F.avg(F.abs(e)), F.max(f"__scale_{name}")).alias(name) for name in lags],
        F.try_divide(F.sum(off * (F.col("e_next") - F.col("m"))), F.sum(off * off)).alias("ACF1"),
        F.sqrt(F.try_divide(F.sum(u[0]), F.sum(u[1]))).alias("TheilU"))
    return out.withColumnRenamed("set", set_col)
