"""Exponential smoothing and ARIMA over many series (operators 117-123).

SES and Holt are folds over the sorted values of a series, evaluated for a
whole parameter grid in the JVM (``aggregate`` / ``transform`` higher-order
functions): one row per series in, one row per series out, no Python.  The
grid minimum of the one-step squared error picks the parameters.
Holt–Winters and ARIMA need numeric optimisation and run per series in
``applyInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailforge.operators import arima as AR
from retailforge.session import release, stage


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by the group keys over ~2× the cluster's cores before a CPU-heavy grouped pandas step.

    The shuffle of a few months per series is tiny, so adaptive execution
    would coalesce it into one or two tasks and serialise the fits; an
    explicit partition count keeps them spread.
    """
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, 1)
    return df.repartition(n, *keys)


def series_arrays(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., x) with x the values ordered by t; one bounded array per series."""
    s = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", value))).alias("__s"))
    return s.select(*keys, F.transform("__s", lambda e: e[value]).alias("x"))


#: parts that a parameter grid is split into, each a row of its own
GRID_PARTS = 25


def _status(least: int) -> F.Column:
    """Why a series has no fit; every month must have a finite value."""
    whole = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.when(~whole, "missing values").when(F.size("x") < least, f"fewer than {least} months").otherwise("ok")


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the series keys, NULL keys included; ``right`` adds its other columns."""
    named = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    return left.join(named, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def _grid_fit(df: DataFrame, keys: list[str], value: str, least: int, steps: int, cells) -> DataFrame:
    """Best cell per series: rows of (series, part of the grid) spread over the cluster, joined by a minimum.

    ``cells(a)`` are the candidate structs of the α values ``a``; the smallest
    (sse, parameters) wins.  Series without a fit keep one row, with NULL
    parameters and their status.
    """
    arr = stage(series_arrays(df, keys, value).withColumn("status", _status(least)), "fit-series")  # read twice
    n, wide = max(1, -(-steps // GRID_PARTS)), steps
    part = F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))).alias("part")
    rows = spread(arr.where("status = 'ok'").select(*keys, "x", part), [*keys, "part"])
    ks = F.filter(F.sequence(F.col("part") * n + 1, F.col("part") * n + n), lambda k: k <= wide)
    alphas = F.transform(ks, lambda k: k.cast("double") / F.lit(float(steps)))
    best = rows.select(*keys, F.array_min(cells(alphas)).alias("best")).groupBy(*keys).agg(F.min("best").alias("best"))
    return _beside(arr, best, keys, "left").select(*keys, F.size("x").alias("n"), "best.*", "status")


def _one_step(prev, x, a, b=None):
    """Next (level, trend) of a state, the forecast it made, and its error; without ``b`` there is no trend."""
    f = prev["l"] if b is None else prev["l"] + prev["b"]
    level = f + a * (x - f) if b is None else a * x + (F.lit(1.0) - a) * f
    trend = None if b is None else b * (level - prev["l"]) + (F.lit(1.0) - b) * prev["b"]
    return level, trend, f, x - f


def ses(df: DataFrame, keys: list[str], value: str = "value", steps: int = 1000) -> DataFrame:
    """Simple exponential smoothing, α on the grid k/steps minimising Σ one-step errors² (117, 120).

    Level starts at x₁; fitted x̂ₜ = ℓₜ₋₁ for t ≥ 2; forecasts are the final
    level.  ``status`` tells why a series has no fit.
    """
    def fold(a):
        init = F.struct(F.col("x")[0].alias("l"), F.lit(0.0).alias("sse"))
        st = F.aggregate(F.slice("x", 2, 1 << 30), init, lambda acc, x: F.struct(
            (acc["l"] + a * (x - acc["l"])).alias("l"), (acc["sse"] + (x - acc["l"]) * (x - acc["l"])).alias("sse")))
        return F.struct(st["sse"].alias("sse"), a.alias("alpha"), st["l"].alias("level"))
    return _grid_fit(df, keys, value, 1, steps, lambda alphas: F.transform(alphas, fold)).select(*keys, "n", "alpha", "sse", "level", "status")


def holt(df: DataFrame, keys: list[str], value: str = "value", steps: int = 50) -> DataFrame:
    """Holt's linear trend, (α, β) on a steps×steps grid (118, 120).

    Start ℓ₂ = x₂, b₂ = x₂ − x₁; fitted x̂ₜ = ℓₜ₋₁ + bₜ₋₁ from t = 3.
    ``status`` tells why a series has no fit.
    """
    betas = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda g: g.cast("double") / F.lit(float(steps)))

    def fold_ab(a, b):
        init = F.struct(F.get("x", F.lit(1)).alias("l"), (F.get("x", F.lit(1)) - F.get("x", F.lit(0))).alias("b"),
                        F.lit(0.0).alias("sse"))

        def step(acc, x):
            level, trend, _, e = _one_step(acc, x, a, b)
            return F.struct(level.alias("l"), trend.alias("b"), (acc["sse"] + e * e).alias("sse"))
        st = F.aggregate(F.slice("x", 3, 1 << 30), init, step)
        return F.struct(st["sse"].alias("sse"), a.alias("alpha"), b.alias("beta"), st["l"].alias("level"), st["b"].alias("trend"))
    fit = _grid_fit(df, keys, value, 2, steps, lambda alphas: F.flatten(F.transform(alphas, lambda a: F.transform(betas, lambda b: fold_ab(a, b)))))
    return fit.select(*keys, "n", "alpha", "beta", "sse", "level", "trend", "status")


def smoothing_path(df: DataFrame, fit: DataFrame, keys: list[str], value: str = "value", trend: bool = False) -> DataFrame:
    """Every state of the fitted SES or Holt fold (120, 125): t, x, fitted, residual, level (and trend) per month.

    The start months have a state but no fitted value.  Series without a fit
    have no rows.
    """
    start = 2 if trend else 1
    arr = series_arrays(df, keys, value)
    params = fit.where("status = 'ok'").select(*keys, "alpha", *(["beta"] if trend else []))
    rows = _beside(arr, params, keys)
    a, b = F.col("alpha"), F.col("beta") if trend else None
    none = F.lit(None).cast("double")
    first = F.get("x", F.lit(start - 1))
    slope = first - F.get("x", F.lit(0)) if trend else none
    state = F.struct(first.alias("l"), slope.alias("b"), none.alias("fitted"), none.alias("residual"))
    # one step appends the next state; the array is as long as the calendar
    def step(acc, x):
        prev = F.element_at(acc, -1)
        level, t, f, e = _one_step(prev, x, a, b)
        return F.concat(acc, F.array(F.struct(level.alias("l"), (none if t is None else t).alias("b"), f.alias("fitted"), e.alias("residual"))))
    path = F.aggregate(F.slice("x", start + 1, 1 << 30), F.array(state), step)
    out = rows.select(*keys, "x", F.posexplode(path).alias("i", "s"))
    t = F.col("i") + start
    return out.select(*keys, t.cast("int").alias("t"), F.col("x")[t - 1].alias("x"), "s.fitted", "s.residual", F.col("s.l").alias("level"),
                      *([F.col("s.b").alias("trend")] if trend else []))


def smoothing_forecasts(fit: DataFrame, keys: list[str], h: int, trend: bool = False) -> DataFrame:
    """h-step point forecasts of a SES (flat) or Holt (level + k·trend) fit (121)."""
    k = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
    out = fit.select(*keys, "level", *(["trend"] if trend else []), k)
    point = F.col("level") + (F.col("step") * F.col("trend") if trend else F.lit(0.0))
    return out.select(*keys, "step", point.alias("forecast"))


def smoothing_bounds(df: DataFrame, fit: DataFrame, keys: list[str], h: int, value: str = "value", trend: bool = False) -> DataFrame:
    """h-step forecasts with 80 and 95 % bounds (121).

    The variance of step k is s²·(1 + Σ_{j<k} ψⱼ²), with s² the sample
    variance of the one-step errors and ψⱼ = α (SES) or α(1 + jβ) (Holt).
    With fewer than two errors the bounds are NULL.
    """
    path = smoothing_path(df, fit, keys, value, trend)
    spread_of = path.groupBy(*keys).agg(F.var_samp("residual").alias("s2"))
    psi = (lambda j: F.col("alpha") * (F.lit(1.0) + j * F.col("beta"))) if trend else (lambda j: F.col("alpha") + j * F.lit(0.0))
    good = fit.where("status = 'ok'")
    joined = _beside(good, spread_of, keys).select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    later = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(h)), lambda j: (j > 0) & (j < F.col("step"))), F.lit(0.0), lambda acc, j: acc + psi(j) * psi(j))
    point = F.col("level") + (F.col("step") * F.col("trend") if trend else F.lit(0.0))
    out = joined.select(*keys, "step", point.alias("point"), F.sqrt(F.col("s2") * (F.lit(1.0) + later)).alias("se"))
    return out.select(*keys, "step", "point", *[(F.col("point") + F.lit(sign * z) * F.col("se")).alias(f"{name}{level}")
                                                for level, z in ((80, AR.Z80), (95, AR.Z95)) for name, sign in (("lo", -1), ("hi", 1))])


# ------------------------------------------------------------------ Holt-Winters (119)

def _decompose_start(x: np.ndarray, f: int):
    """Start values from a multiplicative decomposition of the first two seasons."""
    y = x[:2 * f]
    w = np.r_[0.5, np.ones(f - 1), 0.5] / f if f % 2 == 0 else np.ones(f) / f
    half = len(w) // 2
    trend = np.full(len(y), np.nan)
    for i in range(half, len(y) - half):
        trend[i] = np.dot(w, y[i - half:i + half + 1])
    ratio = y / trend
    fig = np.array([np.nanmean(ratio[j::f]) for j in range(f)])
    fig = fig / fig.mean()
    dat = trend[~np.isnan(trend)]
    tt = np.arange(1, len(dat) + 1)
    b, a = np.polyfit(tt, dat, 1)
    return a, b, fig


def _hw_sse(x, f, a, b, g, l0, b0, s0):
    lev, tr, s = l0, b0, list(s0)
    sse = 0.0
    for t in range(f, len(x)):
        si = s[t - f]
        fc = (lev + tr) * si
        e = x[t] - fc
        sse += e * e
        nl = a * x[t] / si + (1 - a) * (lev + tr)
        tr = b * (nl - lev) + (1 - b) * tr
        s.append(g * x[t] / nl + (1 - g) * si)
        lev = nl
    return sse, lev, tr, s


#: what a fit raises on a series that it cannot take; the series keeps a row with the message as its status
_NO_FIT = (ValueError, ZeroDivisionError, OverflowError, FloatingPointError, np.linalg.LinAlgError)


def _values(pdf: pd.DataFrame, value: str) -> np.ndarray:
    """Values of a series; NULL becomes NaN."""
    return pd.to_numeric(pdf[value]).to_numpy(dtype=float, na_value=np.nan)


def holt_winters_fit(x, f: int = 12):
    """Multiplicative Holt–Winters; (α, β, γ) by grid then Nelder–Mead on the one-step SSE."""
    x = np.asarray(x, float)
    if not np.isfinite(x).all():
        raise ValueError("missing values")
    if len(x) < 2 * f:
        raise ValueError(f"Holt-Winters needs two seasons, {2 * f} values; the series has {len(x)}")
    with np.errstate(all="ignore"):
        l0, b0, s0 = _decompose_start(x, f)
    if not (np.isfinite([l0, b0]).all() and np.isfinite(s0).all()):
        raise ValueError("no multiplicative season: the trend has zeros")

    def obj(p):
        a, b, g = p
        if not (0 <= a <= 1 and 0 <= b <= 1 and 0 <= g <= 1):
            return 1e300
        return _hw_sse(x, f, a, b, g, l0, b0, s0)[0]
    grid = np.linspace(0.05, 0.95, 7)
    start = min(((a, b, g) for a in grid for b in grid for g in grid), key=obj)
    best, sse = AR.nelder_mead(obj, np.array(start), step=0.05, tol=1e-12)
    _, lev, tr, s = _hw_sse(x, f, *best, l0, b0, s0)
    if not np.isfinite([sse, lev, tr]).all():
        raise ValueError("no finite fit")
    return best, sse, lev, tr, s


def holt_winters(df: DataFrame, keys: list[str], h: int = 3, period: int = 12, value: str = "value") -> DataFrame:
    """Per-series multiplicative Holt–Winters fit and h-step forecasts (119, 121)."""
    key_types = df.select(*keys).dtypes
    schema = ", ".join([f"{k} {t}" for k, t in key_types] +
                       ["alpha double", "beta double", "gamma double", "sse double", "step int", "forecast double",
                        "status string"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = _values(pdf, value)
        base = {k: pdf[k].iloc[0] for k in keys}
        try:
            (a, b, g), sse, lev, tr, s = holt_winters_fit(x, period)
            n = len(x)
            rows = [dict(base, alpha=a, beta=b, gamma=g, sse=sse, step=i,
                         forecast=(lev + i * tr) * s[n - period + (i - 1) % period], status="ok")
                    for i in range(1, h + 1)]
        except _NO_FIT as e:  # reported, not dropped
            rows = [dict(base, status=str(e))]
        return _table(rows, keys + ["alpha", "beta", "gamma", "sse", "step", "forecast", "status"])
    return spread(df, keys).groupBy(*keys).applyInPandas(fn, schema)


# ------------------------------------------------------------------ ARIMA (122, 123)

FORECAST_COLS = ["order", "step", "point", "lo80", "hi80", "lo95", "hi95", "sigma2", "aicc", "status"]
_FORECAST_SCHEMA = ["order string", "step int", "point double", "lo80 double", "hi80 double", "lo95 double", "hi95 double", "sigma2 double", "aicc double",
                    "status string"]


def _table(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Result rows of one series as plain objects, missing cells as None."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def _forecast_rows(base: dict, keys: list[str], fit, h: int, s2: float, period: int) -> pd.DataFrame:
    label = f"({fit.order[0]},0,{fit.order[2]})({fit.seasonal[0]},0,{fit.seasonal[2]})[{period}]"
    rows = [dict(base, order=label, step=i + 1, point=p, lo80=a, hi80=b, lo95=c, hi95=d, sigma2=s2,
                 aicc=fit.aicc if math.isfinite(fit.aicc) else None, status="ok")
            for i, (p, a, b, c, d) in enumerate(fit.forecast(h, s2))]
    return _table(rows, keys + FORECAST_COLS)


def arima_forecasts(df: DataFrame, keys: list[str], h: int = 12, order=(0, 0, 1), seasonal=(0, 0, 0),
                    period: int = 12, auto: bool = False, value: str = "value",
                    df_correction: bool | None = None) -> DataFrame:
    """Fit ARIMA (given order, or by AICc search with ``auto``) per series; h-step forecasts with bounds.

    A series that cannot be fitted (missing values, constant, too short)
    keeps one row with the reason as its ``status``.
    """
    schema = ", ".join([f"{k} {t}" for k, t in df.select(*keys).dtypes] + _FORECAST_SCHEMA)
    corr = auto if df_correction is None else df_correction

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = _values(pdf, value)
        base = {k: pdf[k].iloc[0] for k in keys}
        try:
            fit = AR.auto_arima(x, period) if auto else AR.fit_arima(x, order, seasonal, period)
            return _forecast_rows(base, keys, fit, h, AR.sigma2_of(fit, corr), period)
        except _NO_FIT as e:
            return _table([dict(base, status=str(e))], keys + FORECAST_COLS)
    return spread(df, keys).groupBy(*keys).applyInPandas(fn, schema)


def arima_fitted(df: DataFrame, keys: list[str], order=(0, 0, 1), seasonal=(0, 0, 0), period: int = 12,
                 value: str = "value") -> DataFrame:
    """In-sample fitted values as the reference exports them: x − standardised innovation (125).

    ``fitted`` is NULL, and ``status`` tells why, for series that cannot be fitted.
    """
    key_types = df.select(*keys).dtypes
    schema = ", ".join([f"{k} {t}" for k, t in key_types] + ["t int", "x double", "fitted double", "status string"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = _values(pdf, value)
        out = pdf[keys + ["t"]].copy()
        out["t"] = out["t"].astype("int32")
        out["x"] = x
        try:
            out["fitted"], status = x - AR.fit_arima(x, order, seasonal, period).resid, "ok"
        except _NO_FIT as e:
            out["fitted"], status = np.nan, str(e)
        out["status"] = pd.Series([status] * len(out), index=out.index, dtype=object)
        return out.astype({k: object for k in keys})  # one chunk, whatever the batches were
    return spread(df, keys).groupBy(*keys).applyInPandas(fn, schema)


#: where the order search starts: (p, q, P, Q)
START_ORDERS = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
_MOVES = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]


def _neighbours(order: F.Column, largest: tuple) -> F.Column:
    """Orders one move away (one term, or both of a kind, up or down), inside 0..largest."""
    moves = F.array(*[F.array(*[F.lit(sign * d) for d in m]) for m in _MOVES for sign in (1, -1)])
    all_of = F.transform(moves, lambda m: F.zip_with(order, m, lambda a, b: a + b))
    top = F.array(*[F.lit(v) for v in largest])
    return F.filter(all_of, lambda o: F.forall(F.zip_with(o, top, lambda a, b: (a >= 0) & (a <= b)), lambda x: x))


def auto_arima_forecasts(df: DataFrame, keys: list[str], h: int = 3, period: int = 12, max_p: int = 5, max_q: int = 5, max_P: int = 2,
                         max_Q: int = 2, value: str = "value") -> DataFrame:
    """Order (p, 0, q)(P, 0, Q)[period] with mean by a stepwise search for every series at once, then forecasts (123, 121).

    The search starts from four orders and moves to the neighbour of least
    AICc until none is better.  A round fits the neighbours of all series
    still searching that were not visited yet, each a row of its own, spread
    over the cluster; the walk's state (best order, orders visited) is a
    written table between rounds.  Fits with a root near the unit circle do
    not count; seasonal terms need two seasons.  ``steps`` and ``tried``
    report the walk; a series without an admissible model keeps one row with
    its status.
    """
    key_types = df.select(*keys).dtypes
    kschema = [f"`{k}` {t}" for k, t in key_types]
    arr = stage(series_arrays(df, keys, value), "order-series")
    n_tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, 1)

    def score(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                x = np.array([np.nan if v is None else v for v in r.x], float)
                p, q, a, b = map(int, r.order)
                aicc = None
                if not ((a or b) and len(x) < 2 * period):
                    try:
                        f = AR.fit_arima(x, (p, 0, q), (a, 0, b), period, tol=1e-7, polish=False)
                        aicc = f.aicc if math.isfinite(f.aicc) and AR.away_from_unit_roots(f) else None
                    except _NO_FIT:
                        aicc = None
                rows.append((*[getattr(r, k) for k in keys], [p, q, a, b], aicc))
            yield pd.DataFrame(rows, columns=[*keys, "order", "aicc"])

    starts = F.array(*[F.array(*[F.lit(min(v, m)) for v, m in zip(o, (max_p, max_q, max_P, max_Q))]) for o in START_ORDERS])
    state = stage(arr.select(*keys, F.lit(None).cast("double").alias("aicc"), F.lit(None).cast("array<int>").alias("best"),
                             F.expr("cast(array() as array<array<int>>)").alias("visited"), starts.alias("todo"), F.lit(0).alias("steps")), "order-walk")
    while not state.where(F.size("todo") > 0).isEmpty():
        walking = state.where(F.size("todo") > 0).select(*keys, F.explode("todo").alias("order"))
        rows = _beside(arr, walking, keys).repartition(n_tasks, *keys, "order")
        found = rows.select(*keys, "order", "x").mapInPandas(score, ", ".join(kschema + ["order array<int>", "aicc double"]))
        found = found.groupBy(*keys).agg(F.min(F.when(F.col("aicc").isNotNull(), F.struct("aicc", "order"))).alias("new"))
        joined = _beside(state, found, keys, "left")
        better = F.col("new").isNotNull() & (F.col("aicc").isNull() | (F.col("new.aicc") < F.col("aicc") - 1e-6))
        seen = F.array_union("visited", "todo")
        best = F.when(better, F.col("new.order")).otherwise(F.col("best"))
        todo = F.when(better, F.array_except(_neighbours(F.col("new.order"), (max_p, max_q, max_P, max_Q)), seen)).otherwise(
            F.expr("cast(array() as array<array<int>>)"))
        new = stage(joined.select(*keys, F.when(better, F.col("new.aicc")).otherwise(F.col("aicc")).alias("aicc"), best.alias("best"),
                                  seen.alias("visited"), todo.alias("todo"), (F.col("steps") + F.when(better, 1).otherwise(0)).alias("steps")), "order-walk")
        release(state)
        state = new

    def refit(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                base = {k: getattr(r, k) for k in keys}
                x = np.array([np.nan if v is None else v for v in r.x], float)
                try:
                    if r.best is None:
                        AR.fit_arima(x, (0, 0, 0), (0, 0, 0), period)  # tells why, if the series itself cannot be fitted
                        raise ValueError("no admissible model")
                    p, q, a, b = map(int, r.best)
                    fit = AR.fit_arima(x, (p, 0, q), (a, 0, b), period)
                    rows = _forecast_rows(base, keys, fit, h, AR.sigma2_of(fit, True), period)
                except _NO_FIT as e:
                    rows = _table([dict(base, order="no admissible model", status=str(e))], keys + FORECAST_COLS)
                out.append(rows.assign(steps=int(r.steps), tried=len(r.visited)))
            if out:
                yield pd.concat(out, ignore_index=True)
    schema = ", ".join(kschema + _FORECAST_SCHEMA + ["steps int", "tried int"])
    data = _beside(arr, state.select(*keys, "best", "steps", "visited"), keys).repartition(n_tasks, *keys)
    return data.select(*keys, "x", "best", "steps", "visited").mapInPandas(refit, schema)
