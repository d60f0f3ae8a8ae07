"""Calendar features and binning (operators 75, 76, 80, 81, 83, 84)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_month(ts: str | Column) -> Column:
    """``format(as.Date(ts), "%Y-%m")`` (76)."""
    return F.date_format(_c(ts), "yyyy-MM")


def year_quarter_label(ts: str | Column) -> Column:
    """``yy/0Q`` basket period label, e.g. ``17/04`` (76, 86)."""
    return F.concat(F.date_format(_c(ts), "yy/"), F.lit("0"), F.quarter(_c(ts)).cast("string"))


def parse_timestamp(c: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss", zone: str | None = None) -> Column:
    """Text -> timestamp with a format; ``zone`` gives the wall-clock zone of the text (75)."""
    ts = F.to_timestamp(_c(c), fmt)
    return F.to_utc_timestamp(ts, zone) if zone else ts


def calendar_features(df: DataFrame, ts: str, prefix: str) -> DataFrame:
    """Weekday name, day of month, month name, hour, weekday number (Sunday = 1) (76)."""
    t = F.col(ts)
    return (df.withColumn(f"{prefix}_DayofWeek", F.date_format(t, "EEEE"))
              .withColumn(f"{prefix}_DayofMonth", F.dayofmonth(t))
              .withColumn(f"{prefix}_MonthName", F.date_format(t, "MMMM"))
              .withColumn(f"{prefix}_HourofDay", F.hour(t))
              .withColumn(f"{prefix}_WeekdayNumber", F.dayofweek(t)))


def cut(c: str | Column, breaks: list[float], labels: list[str]) -> Column:
    """R ``cut`` with right-closed intervals (a, b]; outside -> NULL (80)."""
    x = _c(c)
    out = None
    for (a, b), lab in zip(zip(breaks[:-1], breaks[1:]), labels):
        cond = (x > F.lit(a)) & (x <= F.lit(b))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


# Bin edges and labels of the reference's calendar bins (fixed values).
MONTH_PERIOD_BREAKS = [0, 10, 20, 31]
MONTH_PERIOD_LABELS = ["Beginning of Month", "Middle of Month", "End of Month"]
DAY_PERIOD_BREAKS = [-1, 6, 12, 18, 24]
DAY_PERIOD_LABELS = ["Midnight", "Morning", "Afternoon", "Evening"]


def month_period(day: str | Column) -> Column:
    return cut(day, MONTH_PERIOD_BREAKS, MONTH_PERIOD_LABELS)


def day_period(hour: str | Column) -> Column:
    return cut(hour, DAY_PERIOD_BREAKS, DAY_PERIOD_LABELS)


def score_bin(pred: str | Column) -> Column:
    """Round a predicted 1-5 score: <=1.4 -> 1, <=2.4 -> 2, <=3.4 -> 3, <=4.4 -> 4, else 5 (81)."""
    x = _c(pred)
    return (F.when(x <= 1.4, 1).when(x <= 2.4, 2).when(x <= 3.4, 3).when(x <= 4.4, 4)
             .when(x.isNotNull(), 5))


def argmax_label(scores: dict[str, str | Column], tie: str = "NA") -> Column:
    """Label whose score is strictly greater than every other; ties give ``tie`` (83)."""
    out = None
    items = list(scores.items())
    for lab, sc in items:
        cond = None
        for other, osc in items:
            if other == lab:
                continue
            c = _c(sc) > _c(osc)
            cond = c if cond is None else (cond & c)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.otherwise(F.lit(tie))


def one_hot(df: DataFrame, col: str, levels: list[str] | None = None, drop_first: bool = True,
            max_levels: int = 1000) -> DataFrame:
    """Treatment-coded 0/1 columns ``<col>_<level>`` (84), first level dropped as in ``model.matrix``.

    Levels are discovered with a bounded distinct query (refusing more than
    ``max_levels``) unless given.
    """
    if levels is None:
        got = [r[0] for r in df.select(col).distinct().where(F.col(col).isNotNull())
               .limit(max_levels + 1).collect()]
        if len(got) > max_levels:
            raise ValueError(f"{col} has more than {max_levels} levels")
        levels = sorted(got)
    keep = levels[1:] if drop_first else levels
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{col}_{v}") for v in keep])
