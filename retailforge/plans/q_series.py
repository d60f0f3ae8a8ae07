"""Series and forecasting queries (66-68, 116-125, 133).

Input: the monthly CLV table per series (nation and market-segment families)
from ``q_aggs.monthly_clv_series``; smoothing and ARIMA run on all of them.  Oracles: recursive CTEs fold the same parameter grids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.operators import series as TS
from retailforge.operators import smoothing as SM
from retailforge.plans.oracle_views import CLV_LINES, with_views
from retailforge.plans.forecasting import BOUNDS, forecast_clv, write_forecasts
from retailforge.plans.q_aggs import CLV_SERIES_SQL, PARTIAL_MONTHS, monthly_clv_series, series_keys
from retailforge.plans.registry import query
from retailforge.session import stage, stage_path
from retailforge.sources.views import clv_lines

KEYS = ["series_kind", "series_key"]
H = 3

DENSE_SQL = f"""{with_views(CLV_LINES)},{CLV_SERIES_SQL},
bnd AS (SELECT series_kind, series_key, min(strptime(MnthYr || '-01', '%Y-%m-%d')) AS first,
               max(strptime(MnthYr || '-01', '%Y-%m-%d')) AS last FROM clv GROUP BY 1, 2),
grid AS (SELECT series_kind, series_key, first, unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS m FROM bnd),
dense AS (
  SELECT g.series_kind, g.series_key, strftime(g.m, '%Y-%m') AS MnthYr,
         CAST(datediff('month', g.first, g.m) + 1 AS INTEGER) AS t, coalesce(c.total_CLV, 0.0) AS value
  FROM grid g LEFT JOIN clv c ON c.series_kind = g.series_kind AND c.series_key = g.series_key
                              AND c.MnthYr = strftime(g.m, '%Y-%m')),
s AS (SELECT series_kind, series_key, t, value AS v, max(t) OVER (PARTITION BY series_kind, series_key) AS n
      FROM dense)"""

DENSE_SQL_REC = DENSE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def dense_series(spark, sf):
    return TS.monthly_series(monthly_clv_series(spark, sf), KEYS, "MnthYr", "total_CLV")


def all_series(spark, sf):
    """All series: nations and market segments."""
    return dense_series(spark, sf)


@query("q_monthly_series", f"""{DENSE_SQL}
SELECT series_kind, series_key, MnthYr, t, value FROM dense""")
def q_monthly_series(spark, sf):
    return dense_series(spark, sf)


@query("q_series_split", f"""{DENSE_SQL}
SELECT series_kind, series_key, MnthYr, t, value,
       CASE WHEN t <= max(t) OVER (PARTITION BY series_kind, series_key) - {H} THEN 'train' ELSE 'test' END AS "set"
FROM dense""")
def q_series_split(spark, sf):
    return TS.series_split(dense_series(spark, sf), KEYS, H)


@query("q_series_diff", f"""{DENSE_SQL},
d1 AS (SELECT series_kind, series_key, MnthYr, t,
              value - lag(value) OVER (PARTITION BY series_kind, series_key ORDER BY t) AS value FROM dense),
d2 AS (SELECT series_kind, series_key, MnthYr, t,
              value - lag(value) OVER (PARTITION BY series_kind, series_key ORDER BY t) AS value FROM d1)
SELECT series_kind, series_key, MnthYr, t, round(value, 6) AS value FROM d2 WHERE value IS NOT NULL""")
def q_series_diff(spark, sf):
    return TS.series_diff(dense_series(spark, sf), KEYS, d=2).withColumn("value", F.round("value", 6))


@query("q_acf", f"""{DENSE_SQL},
st AS (SELECT series_kind, series_key, avg(value) AS m, count(*) AS n FROM dense GROUP BY 1, 2),
x AS (SELECT d.series_kind, d.series_key, d.t, d.value - st.m AS xc, st.n,
             least(CAST(floor(10 * log10(st.n)) AS INTEGER), st.n - 1) AS maxlag
      FROM dense d JOIN st USING (series_kind, series_key)),
lags AS (SELECT x.*, unnest(range(0, maxlag + 1)) AS k FROM x),
num AS (SELECT a.series_kind, a.series_key, a.k, sum(a.xc * b.xc) AS num FROM lags a JOIN x b
        ON a.series_kind = b.series_kind AND a.series_key = b.series_key AND b.t = a.t - a.k GROUP BY 1, 2, 3),
den AS (SELECT series_kind, series_key, sum(xc * xc) AS den, first(n) AS n FROM x GROUP BY 1, 2)
SELECT series_kind, series_key, CAST(k AS INTEGER) AS k, round(num / den, 9) AS acf, n
FROM num JOIN den USING (series_kind, series_key)""")
def q_acf(spark, sf):
    return TS.acf(dense_series(spark, sf), KEYS).withColumn("acf", F.round("acf", 9)) \
             .withColumn("k", F.col("k").cast("int"))


@query("q_pacf", f"""{DENSE_SQL_REC},
st AS (SELECT series_kind, series_key, avg(value) AS m, count(*) AS n FROM dense GROUP BY 1, 2),
x AS (SELECT d.series_kind, d.series_key, d.t, d.value - st.m AS xc, st.n,
             least(CAST(floor(10 * log10(st.n)) AS INTEGER), st.n - 1) AS maxlag
      FROM dense d JOIN st USING (series_kind, series_key)),
lags AS (SELECT x.*, unnest(range(0, maxlag + 1)) AS k FROM x),
num AS (SELECT a.series_kind, a.series_key, a.k, sum(a.xc * b.xc) AS num FROM lags a JOIN x b
        ON a.series_kind = b.series_kind AND a.series_key = b.series_key AND b.t = a.t - a.k GROUP BY 1, 2, 3),
den AS (SELECT series_kind, series_key, sum(xc * xc) AS den, first(n) AS n FROM x GROUP BY 1, 2),
rs AS (SELECT series_kind, series_key, any_value(n) AS n, list(num / den ORDER BY k) AS r FROM num JOIN den USING (series_kind, series_key) GROUP BY 1, 2),
dl AS (SELECT series_kind, series_key, n, r, 1 AS k, [r[2]] AS phi, r[2] AS a FROM rs WHERE len(r) > 1
       UNION ALL
       SELECT series_kind, series_key, n, r, k + 1,
              list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b
       FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) /
                       (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS b FROM dl WHERE k + 1 < len(r)))
SELECT series_kind, series_key, CAST(k AS INTEGER) AS k, round(a, 8) AS pacf, round(1.96 / sqrt(n), 9) AS bound, abs(a) > 1.96 / sqrt(n) AS significant FROM dl""")
def q_pacf(spark, sf):
    p = TS.pacf(TS.acf(dense_series(spark, sf), KEYS), KEYS)
    return p.withColumn("pacf", F.round("pacf", 8)).withColumn("bound", F.round("bound", 9))


SES_STEPS, HOLT_STEPS = 1000, 50


def _ses_sql(src: str) -> str:
    return f"""
ga AS (SELECT CAST(g AS DOUBLE) / 1000.0 AS alpha FROM range(1, {SES_STEPS + 1}) r(g)),
rec AS (
  SELECT s.series_key, ga.alpha, s.t, s.v AS l, CAST(0.0 AS DOUBLE) AS sse FROM {src} s, ga WHERE s.t = 1
  UNION ALL
  SELECT r.series_key, r.alpha, s.t, r.l + r.alpha * (s.v - r.l), r.sse + (s.v - r.l) * (s.v - r.l)
  FROM rec r JOIN {src} s ON s.series_key = r.series_key AND s.t = r.t + 1),
fin AS (SELECT rec.*, s.n FROM rec JOIN {src} s USING (series_key, t) WHERE rec.t = s.n),
best AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY sse, alpha) AS rn FROM fin),
ses AS (SELECT series_key, n, alpha, sse, l AS level FROM best WHERE rn = 1)"""


@query("q_ses", f"""{DENSE_SQL_REC},{_ses_sql('s')}
SELECT (SELECT any_value(d.series_kind) FROM dense d WHERE d.series_key = ses.series_key) AS series_kind, series_key, CAST(n AS INTEGER) AS n, alpha, CAST(printf('%.11e', sse) AS DOUBLE) AS sse,
       round(level, 6) AS level FROM ses""")
def q_ses(spark, sf):
    f = SM.ses(all_series(spark, sf), KEYS, steps=SES_STEPS)
    return f.withColumn("sse", F.format_string("%.11e", "sse").cast("double")).withColumn("level", F.round("level", 6)).drop("status")


@query("q_holt", f"""{DENSE_SQL_REC},
gr AS (SELECT CAST(g AS DOUBLE) / 50.0 AS v FROM range(1, {HOLT_STEPS + 1}) r(g)),
rec AS (
  SELECT s2.series_key, a.v AS alpha, bb.v AS beta, s2.t, s2.v AS l, s2.v - s1.v AS b, CAST(0.0 AS DOUBLE) AS sse
  FROM s s1 JOIN s s2 ON s1.series_key = s2.series_key AND s1.t = 1 AND s2.t = 2, gr a, gr bb
  UNION ALL
  SELECT r.series_key, r.alpha, r.beta, s.t,
         r.alpha * s.v + (1.0 - r.alpha) * (r.l + r.b),
         r.beta * ((r.alpha * s.v + (1.0 - r.alpha) * (r.l + r.b)) - r.l) + (1.0 - r.beta) * r.b,
         r.sse + (s.v - (r.l + r.b)) * (s.v - (r.l + r.b))
  FROM rec r JOIN s ON s.series_key = r.series_key AND s.t = r.t + 1),
fin AS (SELECT rec.*, s.n FROM rec JOIN s USING (series_key, t) WHERE rec.t = s.n),
best AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY sse, alpha, beta) AS rn FROM fin)
SELECT (SELECT any_value(d.series_kind) FROM dense d WHERE d.series_key = best.series_key) AS series_kind, series_key, CAST(n AS INTEGER) AS n, alpha, beta, CAST(printf('%.11e', sse) AS DOUBLE) AS sse,
       round(l, 6) AS level, round(b, 6) AS trend FROM best WHERE rn = 1""")
def q_holt(spark, sf):
    f = SM.holt(all_series(spark, sf), KEYS, steps=HOLT_STEPS)
    return (f.withColumn("sse", F.format_string("%.11e", "sse").cast("double")).withColumn("level", F.round("level", 6))
             .withColumn("trend", F.round("trend", 6)).drop("status"))


_KIND = "(SELECT any_value(d.series_kind) FROM dense d WHERE d.series_key = {0}.series_key) AS series_kind, {0}.series_key"
_Z80, _Z95 = 1.2815515655446004, 1.959963984540054


@query("q_ses_path", f"""{DENSE_SQL_REC},{_ses_sql('s')},
p AS (SELECT s.series_key, s.t, s.v AS x, s.v AS level, CAST(NULL AS DOUBLE) AS fitted, CAST(NULL AS DOUBLE) AS residual, alpha
      FROM s JOIN ses USING (series_key) WHERE s.t = 1
      UNION ALL
      SELECT p.series_key, s.t, s.v, p.level + p.alpha * (s.v - p.level), p.level, s.v - p.level, p.alpha
      FROM p JOIN s ON s.series_key = p.series_key AND s.t = p.t + 1)
SELECT {_KIND.format('p')}, CAST(t AS INTEGER) AS t, round(x + 1e-7::DOUBLE, 4) AS x, round(fitted + 1e-7::DOUBLE, 4) AS fitted, round(residual + 1e-7::DOUBLE, 4) AS residual, round(level + 1e-7::DOUBLE, 4) AS level FROM p""")
def q_ses_path(spark, sf):
    """Level, fitted value and error of every month under the SES fit (120, 125)."""
    x = stage(all_series(spark, sf), "series")
    return _rounded(SM.smoothing_path(x, SM.ses(x, KEYS, steps=SES_STEPS), KEYS), ["x", "fitted", "residual", "level"])


def _rounded(df, cols):
    """Four decimals; the offset puts amounts that end half-way on one side in either engine."""
    return df.select(*[F.round(F.col(c) + F.lit(1e-7), 4).alias(c) if c in cols else c for c in df.columns])


_HOLT_SQL = """
gr AS (SELECT CAST(g AS DOUBLE) / 50.0 AS v FROM range(1, 51) r(g)),
rec AS (
  SELECT s2.series_key, a.v AS alpha, bb.v AS beta, s2.t, s2.v AS l, s2.v - s1.v AS b, CAST(0.0 AS DOUBLE) AS sse
  FROM s s1 JOIN s s2 ON s1.series_key = s2.series_key AND s1.t = 1 AND s2.t = 2, gr a, gr bb
  UNION ALL
  SELECT r.series_key, r.alpha, r.beta, s.t, r.alpha * s.v + (1.0 - r.alpha) * (r.l + r.b),
         r.beta * ((r.alpha * s.v + (1.0 - r.alpha) * (r.l + r.b)) - r.l) + (1.0 - r.beta) * r.b,
         r.sse + (s.v - (r.l + r.b)) * (s.v - (r.l + r.b))
  FROM rec r JOIN s ON s.series_key = r.series_key AND s.t = r.t + 1),
fin AS (SELECT rec.*, s.n FROM rec JOIN s USING (series_key, t) WHERE rec.t = s.n),
holt AS (SELECT series_key, alpha, beta, l AS level, b AS trend FROM (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY sse, alpha, beta) AS rn FROM fin) WHERE rn = 1),
p AS (SELECT s2.series_key, s2.t, s2.v AS x, s2.v AS level, s2.v - s1.v AS trend, CAST(NULL AS DOUBLE) AS fitted, alpha, beta
      FROM s s1 JOIN s s2 ON s1.series_key = s2.series_key AND s1.t = 1 AND s2.t = 2 JOIN holt ON holt.series_key = s2.series_key
      UNION ALL
      SELECT p.series_key, s.t, s.v, p.alpha * s.v + (1.0 - p.alpha) * (p.level + p.trend),
             p.beta * ((p.alpha * s.v + (1.0 - p.alpha) * (p.level + p.trend)) - p.level) + (1.0 - p.beta) * p.trend, p.level + p.trend, p.alpha, p.beta
      FROM p JOIN s ON s.series_key = p.series_key AND s.t = p.t + 1)"""


@query("q_holt_path", f"""{DENSE_SQL_REC},{_HOLT_SQL}
SELECT {_KIND.format('p')}, CAST(t AS INTEGER) AS t, round(x + 1e-7::DOUBLE, 4) AS x, round(fitted + 1e-7::DOUBLE, 4) AS fitted, round(x - fitted + 1e-7::DOUBLE, 4) AS residual,
       round(level + 1e-7::DOUBLE, 4) AS level, round(trend + 1e-7::DOUBLE, 4) AS trend FROM p""")
def q_holt_path(spark, sf):
    """Level, trend, fitted value and error of every month under the Holt fit (120, 125)."""
    x = stage(all_series(spark, sf), "series")
    return _rounded(SM.smoothing_path(x, SM.holt(x, KEYS, steps=HOLT_STEPS), KEYS, trend=True), ["x", "fitted", "residual", "level", "trend"])


def _bounds_sql() -> str:
    return ", ".join(f"round(f {sign} {z} * sqrt(s2 * (1 + later)) + 1e-7::DOUBLE, 4) AS {name}" for name, sign, z in
                     (("lo80", "-", _Z80), ("hi80", "+", _Z80), ("lo95", "-", _Z95), ("hi95", "+", _Z95)))


@query("q_ses_bounds", f"""{DENSE_SQL_REC},{_ses_sql('s')},
p AS (SELECT s.series_key, s.t, s.v AS level, CAST(NULL AS DOUBLE) AS e, alpha FROM s JOIN ses USING (series_key) WHERE s.t = 1
      UNION ALL
      SELECT p.series_key, s.t, p.level + p.alpha * (s.v - p.level), s.v - p.level, p.alpha FROM p JOIN s ON s.series_key = p.series_key AND s.t = p.t + 1),
v AS (SELECT series_key, var_samp(e) AS s2 FROM p GROUP BY 1),
o AS (SELECT ses.series_key, step, level AS f, s2, (step - 1) * alpha * alpha AS later FROM ses JOIN v USING (series_key), range(1, {H} + 1) r(step))
SELECT {_KIND.format('o')}, CAST(step AS INTEGER) AS step, round(f + 1e-7::DOUBLE, 4) AS point, {_bounds_sql()} FROM o""")
def q_ses_bounds(spark, sf):
    """SES forecasts with 80 and 95 % bounds (121)."""
    x = stage(all_series(spark, sf), "series")
    out = SM.smoothing_bounds(x, stage(SM.ses(x, KEYS, steps=SES_STEPS), "ses"), KEYS, H)
    return _rounded(out, ["point", "lo80", "hi80", "lo95", "hi95"])


@query("q_holt_bounds", f"""{DENSE_SQL_REC},{_HOLT_SQL},
v AS (SELECT series_key, var_samp(x - fitted) AS s2 FROM p GROUP BY 1),
o AS (SELECT holt.series_key, step, level + step * trend AS f, s2,
             coalesce((SELECT sum(alpha * (1 + j * beta) * alpha * (1 + j * beta)) FROM range(1, {H} + 1) q(j) WHERE j < step), 0) AS later
      FROM holt JOIN v USING (series_key), range(1, {H} + 1) r(step))
SELECT {_KIND.format('o')}, CAST(step AS INTEGER) AS step, round(f + 1e-7::DOUBLE, 4) AS point, {_bounds_sql()} FROM o""")
def q_holt_bounds(spark, sf):
    """Holt forecasts with 80 and 95 % bounds (121)."""
    x = stage(all_series(spark, sf), "series")
    out = SM.smoothing_bounds(x, stage(SM.holt(x, KEYS, steps=HOLT_STEPS), "holt"), KEYS, H, trend=True)
    return _rounded(out, ["point", "lo80", "hi80", "lo95", "hi95"])


@query("q_holt_winters")
def q_holt_winters(spark, sf):
    return SM.holt_winters(all_series(spark, sf), KEYS, h=H)


@query("q_arima")
def q_arima(spark, sf):
    """ARIMA(0,0,1) with mean per series, refit on all months, h = 12 (122, 121, 125)."""
    return SM.arima_forecasts(all_series(spark, sf), KEYS, h=12, order=(0, 0, 1))


@query("q_auto_arima")
def q_auto_arima(spark, sf):
    """Order chosen by AICc per series on the training months, h = 3 (123)."""
    tr = TS.series_split(all_series(spark, sf), KEYS, H).where(F.col("set") == "train")
    return SM.auto_arima_forecasts(tr, KEYS, h=H)


@query("q_forecast_accuracy", f"""{DENSE_SQL_REC},
tr AS (SELECT series_kind, series_key, t, v, n - {H} AS n FROM s WHERE t <= n - {H}),
te AS (SELECT * FROM s WHERE t > n - {H}),{_ses_sql('tr')},
sc AS (SELECT series_key, avg(abs(d)) AS scale FROM (
         SELECT series_key, v - lag(v) OVER (PARTITION BY series_key ORDER BY t) AS d FROM tr) WHERE d IS NOT NULL
       GROUP BY 1),
e AS (SELECT te.series_key, te.t, te.v, ses.level AS f, te.v - ses.level AS e,
             lag(te.v) OVER (PARTITION BY te.series_key ORDER BY te.t) AS y_prev
      FROM te JOIN ses USING (series_key)),
e2 AS (SELECT e.*, lead(e.e) OVER (PARTITION BY series_key ORDER BY t) AS e_next,
              avg(e.e) OVER (PARTITION BY series_key) AS m FROM e)
SELECT (SELECT any_value(d.series_kind) FROM dense d WHERE d.series_key = e2.series_key) AS series_kind, e2.series_key, round(avg(e), 6) AS ME, round(sqrt(avg(e * e)), 6) AS RMSE,
       round(avg(abs(e)), 6) AS MAE, round(avg(e * 100 / nullif(v, 0)), 6) AS MPE, round(avg(abs(e * 100 / nullif(v, 0))), 6) AS MAPE,
       round(avg(abs(e)) / first(sc.scale), 6) AS MASE,
       round(sum((e - m) * (e_next - m)) / sum((e - m) * (e - m)), 6) AS ACF1,
       round(sqrt(sum(((f - v) / y_prev) * ((f - v) / y_prev)) / sum(((v - y_prev) / y_prev) * ((v - y_prev) / y_prev))), 6) AS TheilU
FROM e2 JOIN sc USING (series_key) GROUP BY e2.series_key""")
def q_forecast_accuracy(spark, sf):
    return forecast_accuracy_ses(all_series(spark, sf))


def forecast_accuracy_ses(series):
    """SES on the training months, flat forecast over the last H, accuracy measures (124, 133)."""
    split = TS.series_split(series, KEYS, H)
    train, test = split.where(F.col("set") == "train"), split.where(F.col("set") == "test")
    fit = SM.ses(train, KEYS, steps=SES_STEPS)
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(*KEYS).orderBy("t")
    scale = (train.withColumn("d", F.col("value") - F.lag("value").over(w)).where(F.col("d").isNotNull())
                  .groupBy(*KEYS).agg(F.avg(F.abs("d")).alias("scale")))
    rows = test.join(fit.select(*KEYS, F.col("level").alias("forecast")), KEYS).join(scale, KEYS)
    acc = TS.forecast_accuracy(rows, KEYS)
    return acc.select(*KEYS, *[F.round(c, 6).alias(c) for c in
                               ["ME", "RMSE", "MAE", "MPE", "MAPE", "MASE", "ACF1", "TheilU"]])


_SET_MEASURES = ["ME", "RMSE", "MAE", "MPE", "MAPE", "MASE", "MASE_seasonal", "ACF1", "TheilU"]


def _scale_sql(lag: int) -> str:
    return (f"SELECT series_key, avg(abs(d)) AS scale FROM (SELECT series_key, v - lag(v, {lag}) OVER (PARTITION BY series_key ORDER BY t) AS d FROM tr)"
            " GROUP BY 1")


@query("q_accuracy_by_set", f"""{DENSE_SQL_REC},
tr AS (SELECT series_kind, series_key, t, v, n - {H} AS n FROM s WHERE t <= n - {H}),
te AS (SELECT * FROM s WHERE t > n - {H}),{_ses_sql('tr')},
p AS (SELECT tr.series_key, tr.t, tr.v, tr.v AS level, CAST(NULL AS DOUBLE) AS f, alpha FROM tr JOIN ses USING (series_key) WHERE tr.t = 1
      UNION ALL
      SELECT p.series_key, tr.t, tr.v, p.level + p.alpha * (tr.v - p.level), p.level, p.alpha
      FROM p JOIN tr ON tr.series_key = p.series_key AND tr.t = p.t + 1),
both_sets AS (SELECT series_key, 'train' AS part, t, v, f FROM p
              UNION ALL SELECT te.series_key, 'test', te.t, te.v, ses.level FROM te JOIN ses USING (series_key)),
e AS (SELECT *, v - f AS e, lag(v) OVER (PARTITION BY series_key, part ORDER BY t) AS y_prev,
             avg(v - f) OVER (PARTITION BY series_key, part) AS m FROM both_sets),
e2 AS (SELECT *, lead(e) OVER (PARTITION BY series_key, part ORDER BY t) AS e_next FROM e),
sc1 AS ({_scale_sql(1)}), sc12 AS ({_scale_sql(12)})
SELECT {_KIND.format('e2')}, part AS "set", count(e) AS n, round(avg(e), 6) AS ME, round(sqrt(avg(e * e)), 6) AS RMSE, round(avg(abs(e)), 6) AS MAE,
       round(avg(e * 100 / nullif(v, 0)), 6) AS MPE, round(avg(abs(e * 100 / nullif(v, 0))), 6) AS MAPE,
       round(avg(abs(e)) / any_value(sc1.scale), 6) AS MASE, round(avg(abs(e)) / any_value(sc12.scale), 6) AS MASE_seasonal,
       round(sum((e - m) * (e_next - m)) / sum((e - m) * (e - m)), 6) AS ACF1,
       CASE WHEN part = 'test' THEN round(sqrt(sum(((f - v) / nullif(y_prev, 0)) * ((f - v) / nullif(y_prev, 0)))
            / sum(((v - y_prev) / nullif(y_prev, 0)) * ((v - y_prev) / nullif(y_prev, 0)))), 6) END AS TheilU
FROM e2 LEFT JOIN sc1 USING (series_key) LEFT JOIN sc12 USING (series_key) GROUP BY e2.series_key, part""")
def q_accuracy_by_set(spark, sf):
    """SES of the training months: accuracy of its fitted values and of its forecasts, naive and seasonal scales (124)."""
    split = stage(TS.series_split(all_series(spark, sf), KEYS, H), "split")
    train, test = split.where(F.col("set") == "train"), split.where(F.col("set") == "test")
    fit = stage(SM.ses(train, KEYS, steps=SES_STEPS), "ses")
    path = SM.smoothing_path(train, fit, KEYS).select(*KEYS, F.lit("train").alias("set"), "t", F.col("x").alias("value"), F.col("fitted").alias("forecast"))
    ahead = test.join(fit.select(*KEYS, F.col("level").alias("forecast")), KEYS).select(*KEYS, "set", "t", "value", "forecast")
    acc = TS.accuracy_by_set(path.unionByName(ahead), KEYS, {"MASE": 1, "MASE_seasonal": 12})
    return acc.select(*KEYS, "set", "n", *[F.round(c, 6).alias(c) for c in _SET_MEASURES])


@query("q_ses_forecast", f"""{DENSE_SQL_REC},
tr AS (SELECT series_kind, series_key, t, v, n - {H} AS n FROM s WHERE t <= n - {H}),{_ses_sql('tr')}
SELECT (SELECT any_value(d.series_kind) FROM dense d WHERE d.series_key = ses.series_key) AS series_kind, series_key, CAST(step AS INTEGER) AS step, round(level, 6) AS forecast
FROM ses, range(1, {H} + 1) r(step)""")
def q_ses_forecast(spark, sf):
    """SES on the training months, flat h-step forecasts (117, 121)."""
    tr = TS.series_split(all_series(spark, sf), KEYS, H).where(F.col("set") == "train")
    fc = SM.smoothing_forecasts(SM.ses(tr, KEYS, steps=SES_STEPS), KEYS, H)
    return fc.withColumn("forecast", F.round("forecast", 6))


@query("q_arima_fitted")
def q_arima_fitted(spark, sf):
    """Fitted-value export of the ARIMA(0,0,1) refit per series (125)."""
    return SM.arima_fitted(all_series(spark, sf), KEYS)


_CLV_AHEAD_SQL = f"""{DENSE_SQL_REC},{_ses_sql('s')},
p AS (SELECT s.series_key, s.t, s.v AS level, CAST(NULL AS DOUBLE) AS e, alpha FROM s JOIN ses USING (series_key) WHERE s.t = 1
      UNION ALL
      SELECT p.series_key, s.t, p.level + p.alpha * (s.v - p.level), s.v - p.level, p.alpha FROM p JOIN s ON s.series_key = p.series_key AND s.t = p.t + 1),
v AS (SELECT series_key, var_samp(e) AS s2 FROM p GROUP BY 1),
o AS (SELECT ses.series_key, step, level AS f, s2, (step - 1) * alpha * alpha AS later FROM ses JOIN v USING (series_key), range(1, 13) r(step))
SELECT o.series_key, strftime((SELECT any_value(b.last) FROM bnd b WHERE b.series_key = o.series_key) + to_months(CAST(step AS INTEGER)), '%b %Y') AS month,
       round(f + 1e-7::DOUBLE, 4) AS point, {_bounds_sql()} FROM o"""


@query("q_forecast_clv", _CLV_AHEAD_SQL.replace("SELECT o.series_key, strftime", f"SELECT {_KIND.format('o')}, CAST(step AS INTEGER) AS step, strftime"))
def q_forecast_clv(spark, sf):
    """From order lines to 12 months of smoothed CLV with bounds for every nation and segment (133)."""
    return _rounded(_clv_ahead(spark, sf).drop("status"), BOUNDS)


def _clv_ahead(spark, sf):
    return forecast_clv(series_keys(clv_lines(spark, sf)), "order_ts", "revenue", "customer_id", KEYS, 12, "ses",
                        drop_months=PARTIAL_MONTHS, money_decimals=4)


@query("q_forecast_export", _CLV_AHEAD_SQL)
def q_forecast_export(spark, sf):
    """The forecasts as files of the published layout, one folder per series, read back (125)."""
    path = stage_path(spark, "forecasts")
    write_forecasts(_clv_ahead(spark, sf), path, ["series_kind", "series_key"])
    names = "month string, " + ", ".join(f"{c} double" for c in BOUNDS) + ", series_kind string, series_key string"
    return _rounded(spark.read.schema(names).option("header", True).option("enforceSchema", True).csv(path), BOUNDS).select("series_key", "month", *BOUNDS)
