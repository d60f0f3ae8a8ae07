"""Order lines -> monthly CLV -> forecasts with bounds, and the files that the dashboards read (125, 133)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailforge.operators import smoothing as SM
from retailforge.operators.aggregates import monthly_clv
from retailforge.operators.series import monthly_series
from retailforge.session import stage

#: Column names of the exported forecast files, by the names used here.
EXPORT_NAMES = {"point": "Point.Forecast", "lo80": "Lo.80", "hi80": "Hi.80", "lo95": "Lo.95", "hi95": "Hi.95"}
BOUNDS = list(EXPORT_NAMES)


def forecast_clv(lines: DataFrame, ts: str, revenue: Column | str, customer: str, keys: list[str], h: int = 12,
                 model: str = "arima", order=(0, 0, 1), seasonal=(0, 0, 0), period: int = 12,
                 purchases: Column | str | None = None, drop_months: list[str] | None = None,
                 money_decimals: int | None = None) -> DataFrame:
    """Forecasts of monthly CLV per key from order lines (133): keys, step, month, point and 80/95 % bounds, status.

    ``model``: 'arima' (the given order, as the study's refit), 'auto' (order
    by stepwise search), 'ses' or 'holt'.  ``month`` is ``MMM yyyy``.  A series
    that cannot be fitted keeps one row without step, month and values and
    with its status.  Lines without a timestamp belong to no month and are left
    out; a month without lines, or without a customer in any line, is 0; a NULL
    key is a series like any other.
    """
    if model not in ("arima", "auto", "ses", "holt"):
        raise ValueError(f"unknown model {model!r}: 'arima', 'auto', 'ses' or 'holt'")
    table = monthly_clv(lines.where(F.col(ts).isNotNull()), ts, revenue, customer, purchases, keys, drop_months, money_decimals)
    coded = stage(table, "clv-months")
    # the series operators join on their keys: one text key per series, the keys themselves come back at the end
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("all")
    months = coded.select(key.alias("__series"), "MnthYr", "total_CLV")
    series = stage(monthly_series(months, ["__series"], "MnthYr", "total_CLV"), "clv-series")
    if model in ("arima", "auto"):
        fit = (SM.auto_arima_forecasts(series, ["__series"], h, period) if model == "auto" else
               SM.arima_forecasts(series, ["__series"], h, order, seasonal, period))
        out = fit.select("__series", "step", *BOUNDS, "status")
    else:
        trend = model == "holt"
        fit = stage((SM.holt if trend else SM.ses)(series, ["__series"]), "clv-fit")
        ahead = SM.smoothing_bounds(series, fit, ["__series"], h, trend=trend)
        out = fit.select("__series", "status").join(ahead, "__series", "left").select("__series", "step", *BOUNDS, "status")
    last = months.groupBy("__series").agg(F.max("MnthYr").alias("__last"))
    names = coded.select(key.alias("__series"), *keys).distinct()
    when = F.date_format(F.add_months(F.to_date(F.concat("__last", F.lit("-01"))), F.col("step")), "MMM yyyy")
    return (out.join(last, "__series").join(names, "__series")
            .select(*keys, "step", when.alias("month"), *BOUNDS, "status"))


def write_forecasts(forecasts: DataFrame, path: str, keys: list[str]) -> None:
    """Forecast files in the published layout: an unnamed month label, then point and bounds (125).

    One folder per series (``key=value/``); rows stand in the order of the
    steps.  Series without a fit have no file.
    """
    rows = forecasts.where("step is not null")
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*keys, "step")
    layout = rows.select(*keys, F.col("month").alias("_c0"), *[F.col(c).alias(n) for c, n in EXPORT_NAMES.items()])
    # CSV has no nameless column in Spark; the header line reads "_c0" as Spark itself names a column without one
    writer = layout.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*keys) if keys else writer).csv(path)


def write_fitted(fitted: DataFrame, path: str, keys: list[str]) -> None:
    """Fitted values in the published layout: the position in the series, then ``x`` (125); one folder per series."""
    rows = fitted.where(F.col("fitted").isNotNull())
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*keys, "t")
    writer = rows.select(*keys, F.col("t").alias("_c0"), F.col("fitted").alias("x")).write.mode("overwrite").option("header", True)
    (writer.partitionBy(*keys) if keys else writer).csv(path)
