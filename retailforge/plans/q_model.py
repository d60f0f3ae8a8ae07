"""Sampling, segmentation, classification and regression queries (92-115)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.operators import sampling as SP
from retailforge.plans.registry import query
from retailforge.sources.tables import read_table


def _hash_sql(key: str, seed: int = 3) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"


@query("q_train_test_split", f"""
WITH o AS (SELECT o_orderkey AS order_id, {_hash_sql('o_orderkey')} AS h FROM orders),
r AS (SELECT order_id, row_number() OVER (ORDER BY h, order_id) AS rn, count(*) OVER () AS n FROM o)
SELECT order_id, CASE WHEN rn <= floor(CAST(0.7 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS "set" FROM r""")
def q_train_test_split(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("order_id"))
    return SP.train_test_split(o, "order_id", 0.7, seed=3)


@query("q_balance_classes", f"""
WITH o AS (SELECT o_orderkey AS order_id, o_orderstatus AS status, {_hash_sql('o_orderkey')} AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY h, order_id) AS rn FROM o),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM o GROUP BY status))
SELECT order_id, status FROM r WHERE rn <= (SELECT m FROM m)""")
def q_balance_classes(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderstatus").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    return SP.balance_classes(o, "status", "order_id", seed=3)


# ---------------------------------------------------------------- segments (94-97)
from retailforge.operators import rfm as R  # noqa: E402
from retailforge.operators import segments as SG  # noqa: E402
from retailforge.plans.oracle_views import RETAIL_LINES, with_views  # noqa: E402
from retailforge.plans.q_retail import CLEAN_SQL, _netting_sql, rfm_norm_sql  # noqa: E402
from retailforge.sources.views import retail_lines  # noqa: E402


def scored_lines(spark, sf):
    """Retail lines with the row-level CLV score F·M·R of their customer (54)."""
    df = R.rfm(retail_lines(spark, sf), "InvoiceDate", "CustomerID", "UnitPrice", "Quantity", attach=True)
    return R.clv_score(df)


def scored_sql(prefix: str, src: str) -> str:
    """Lines of ``src`` with their customer's CLV score, then weighted points with prefix sums."""
    return f"""{prefix},{rfm_norm_sql(src)},
scored AS (SELECT r.*, n.FREQUENCY_normalised * n.MONEY_normalised * n.RECENCY_normalised AS clv
           FROM {src} r JOIN normed n ON r.CustomerID = n.CustomerID),
pts AS (SELECT clv AS v, count(*) AS w FROM scored GROUP BY 1),
mu AS (SELECT sum(w * v) / sum(w) AS m FROM pts),
pre AS (SELECT v, row_number() OVER (ORDER BY v) AS i,
               sum(w) OVER (ORDER BY v) AS W, sum(w * (v - (SELECT m FROM mu))) OVER (ORDER BY v) AS S,
               sum(w * (v - (SELECT m FROM mu)) * (v - (SELECT m FROM mu))) OVER (ORDER BY v) AS Q FROM pts),
p0 AS (SELECT 0 AS i, NULL::DOUBLE AS v, 0.0 AS W, 0.0 AS S, 0.0 AS Q UNION ALL SELECT i, v, W, S, Q FROM pre),
d AS (SELECT max(i) AS n FROM pre)"""


SCORED_SQL = scored_sql(with_views(RETAIL_LINES), "retail_lines")


def _cost(a, b):
    return f"(({b}.Q - {a}.Q) - ({b}.S - {a}.S) * ({b}.S - {a}.S) / ({b}.W - {a}.W))"


def _segments_sql(k: int, base: str | None = None) -> str:
    if k == 2:
        search = f"""best AS (SELECT a.v AS b1, NULL::DOUBLE AS b2 FROM p0 z, p0 a, p0 e
            WHERE z.i = 0 AND e.i = (SELECT n FROM d) AND a.i >= 1 AND a.i < e.i
            ORDER BY {_cost('z', 'a')} + {_cost('a', 'e')} LIMIT 1)"""
        label = "CASE WHEN clv <= b1 THEN 1 ELSE 2 END"
    else:
        search = f"""best AS (SELECT a.v AS b1, b.v AS b2 FROM p0 z, p0 a, p0 b, p0 e
            WHERE z.i = 0 AND e.i = (SELECT n FROM d) AND a.i >= 1 AND b.i > a.i AND b.i < e.i
            ORDER BY {_cost('z', 'a')} + {_cost('a', 'b')} + {_cost('b', 'e')} LIMIT 1)"""
        label = "CASE WHEN clv <= b1 THEN 1 WHEN clv <= b2 THEN 2 ELSE 3 END"
    return f"""{base or SCORED_SQL},
{search},
lab AS (SELECT clv, {label} AS cluster FROM scored, best)
SELECT cluster, count(*) AS size, round(avg(clv), 6) AS center, round(var_pop(clv) * count(*), 4) AS withinss,
       round(min(clv), 9) AS lower, round(max(clv), 9) AS upper
FROM lab GROUP BY cluster"""


def _segment_table(spark, sf, k):
    from retailforge.session import stage
    df = stage(scored_lines(spark, sf).select("clv"), "scored")  # two passes: distinct values, labels
    lab = SG.optimal_1d_segments(df, "clv", k)
    q = SG.cluster_quality(lab, "clv")
    return q.select(F.col("cluster").cast("int").alias("cluster"), "size", F.round("center", 6).alias("center"),
                    F.round("withinss", 4).alias("withinss"), F.round("lower", 9).alias("lower"),
                    F.round("upper", 9).alias("upper"))


@query("q_optimal_1d_segments", _segments_sql(3))
def q_optimal_1d_segments(spark, sf):
    return _segment_table(spark, sf, 3)


@query("q_withinss", _segments_sql(2))
def q_withinss(spark, sf):
    return _segment_table(spark, sf, 2)


def _elbow_sql(most: int) -> str:
    """Least within-cluster sum of squares of the first i points in k clusters, k by k."""
    steps = [f"e1 AS (SELECT b.i, {_cost('z', 'b')} AS c FROM p0 z, p0 b WHERE z.i = 0 AND b.i > 0)"]
    for k in range(2, most + 1):
        steps.append(f"e{k} AS MATERIALIZED (SELECT b.i, min(e.c + {_cost('a', 'b')}) AS c FROM e{k - 1} e JOIN p0 a ON a.i = e.i "
                     "JOIN p0 b ON b.i > a.i GROUP BY b.i)")
    out = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, c FROM e{k} WHERE i = (SELECT n FROM d)" for k in range(1, most + 1))
    return f"""{SCORED_SQL},
{", ".join(steps)}
SELECT k, CAST(printf('%.6e', c) AS DOUBLE) AS tot_withinss FROM ({out})"""


@query("q_elbow", _elbow_sql(10))
def q_elbow(spark, sf):
    """Exact within-cluster sums of squares of 1 to 10 clusters (94)."""
    e = SG.elbow(scored_lines(spark, sf), "clv", ks=range(1, 11))
    return e.withColumn("tot_withinss", F.format_string("%.6e", "tot_withinss").cast("double"))


@query("q_kmeans_segments")
def q_kmeans_segments(spark, sf):
    lines = stage(retail_lines(spark, sf).select("InvoiceDate", "CustomerID", "UnitPrice", "Quantity"), "score-lines")  # the joins run once
    scored = stage(R.clv_score(R.rfm(lines, "InvoiceDate", "CustomerID", "UnitPrice", "Quantity")).select("clv"), "scored")
    lab = SG.kmeans_segments(scored, "clv", k=3, restarts=3)
    return SG.cluster_quality(lab, "clv")


CLEANED_PREFIX = (with_views(RETAIL_LINES) + "," + CLEAN_SQL + _netting_sql("s7")
                  + ",\ncleaned AS (SELECT * FROM netting WHERE Quantity > 0)")


@query("q_segments_end_to_end", _segments_sql(3, scored_sql(CLEANED_PREFIX, "cleaned")))
def q_segments_end_to_end(spark, sf):
    """clean -> RFM -> score -> exact 1-D segments -> quality (130)."""
    lab = segment_customers(retail_lines(spark, sf), columns=["clv"])
    q = SG.cluster_quality(lab, "clv")
    return q.select(F.col("cluster").cast("int").alias("cluster"), "size", F.round("center", 6).alias("center"),
                    F.round("withinss", 4).alias("withinss"), F.round("lower", 9).alias("lower"),
                    F.round("upper", 9).alias("upper"))


# ---------------------------------------------------------------- regression (106-112)
from retailforge.operators import regress as RG  # noqa: E402
from retailforge.plans.oracle_views import MERGED  # noqa: E402
from retailforge.plans.pipelines import marketplace_lines, review_model_inputs, segment_customers  # noqa: E402
from retailforge.plans.q_market import DELIVERY_SQL  # noqa: E402

#: the v2 model inputs in SQL
FRAME_SQL = """
frame AS (SELECT review_score, payment_type, payment_installments, payment_value, price, freight_value, product_photos_qty, del_time, est_del_time,
                 delta_time, CASE WHEN delta_time < 0 THEN 1 ELSE 0 END AS Late, total_price, freight_ratio, purchase_day_of_week
  FROM feat WHERE review_score IS NOT NULL AND payment_type IS NOT NULL AND payment_installments IS NOT NULL AND payment_value IS NOT NULL
   AND freight_value IS NOT NULL AND product_photos_qty IS NOT NULL AND freight_ratio IS NOT NULL)"""

REVIEW_X = ["payment_installments", "payment_value", "freight_value", "product_photos_qty", "del_time",
            "est_del_time", "delta_time", "Late", "total_price", "freight_ratio", "purchase_day_of_week"]


def review_frame(spark, sf):
    return review_model_inputs(marketplace_lines(spark, sf), version=2)


@query("q_ols_simple", f"""{with_views(MERGED)}
SELECT round(regr_intercept(price, freight_value), 6) AS intercept, round(regr_slope(price, freight_value), 6) AS slope,
       round(regr_r2(price, freight_value), 6) AS r2, count(*) AS n FROM merged""")
def q_ols_simple(spark, sf):
    t = RG.ols(marketplace_lines(spark, sf), "price", ["freight_value"])
    row = t.groupBy("r2", "n").pivot("term", ["(Intercept)", "freight_value"]).agg(F.first("estimate"))
    return row.select(F.round("`(Intercept)`", 6).alias("intercept"), F.round("freight_value", 6).alias("slope"),
                      F.round("r2", 6).alias("r2"), F.col("n").cast("long").alias("n"))


#: the factor first, as in the study's frame
OLS_X = ["payment_type", *REVIEW_X]
_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _ols_sql(table: str = "frame", xs: list[str] = REVIEW_X, name: str = "fit") -> str:
    """CTEs with the sweep of the scaled cross-products, column by column: ``{name}`` has one row (m, kept, s, means, n, gyy)."""
    q = len(_LEVELS) + len(xs) + 1
    dummies = ", ".join(f"CAST(payment_type = '{v}' AS DOUBLE)" for v in _LEVELS[1:])
    means = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS a{i}" for i, c in enumerate([*xs, "review_score"]))
    z = ", ".join(f"CAST({c} AS DOUBLE) - a{i}" for i, c in enumerate([*xs, "review_score"]))
    return f"""
{name}_mean AS (SELECT count(*) AS n, {means} FROM {table}),
{name}_z AS (SELECT [1.0, {dummies}, {z}] AS z FROM {table}, {name}_mean),
{name}_g AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS r FROM (
  SELECT i, j, sum(z[i] * z[j]) AS v FROM {name}_z, range(1, {q + 1}) a(i), range(1, {q + 1}) b(j) GROUP BY i, j) GROUP BY i)),
{name}_s AS (SELECT g, list_transform(range(1, {q + 1}), lambda i: CASE WHEN g[i][i] > 0 THEN sqrt(g[i][i]) ELSE 1.0 END) AS s FROM {name}_g),
{name}_r AS (
  SELECT 1 AS k, [0] AS kept, list_transform(range(1, {q + 1}), lambda i: list_transform(range(1, {q + 1}), lambda j: g[i][j] / (s[i] * s[j]))) AS m FROM {name}_s
  UNION ALL
  SELECT k + 1, CASE WHEN m[k][k] > 1e-11::DOUBLE THEN list_append(kept, k) ELSE kept END,
         CASE WHEN m[k][k] > 1e-11::DOUBLE THEN list_transform(range(1, {q + 1}), lambda i: list_transform(range(1, {q + 1}), lambda j:
           CASE WHEN i = k AND j = k THEN -1.0 / m[k][k] WHEN i = k OR j = k THEN m[i][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) ELSE m END
  FROM {name}_r WHERE k < {q}),
{name} AS (SELECT m, kept, s, n, [{", ".join(["1.0"] + ["0.0"] * (len(_LEVELS) - 1) + [f"-a{i}" for i in range(len(xs))])}] AS shift,
                  a{len(xs)} AS ybar, g[{q}][{q}] AS tss FROM {name}_r, {name}_s, {name}_mean WHERE k = {q})"""


def _ols_table_sql() -> str:
    names = ["(Intercept)"] + [f"payment_type{v}" for v in _LEVELS[1:]] + REVIEW_X
    q = len(names) + 1
    return f"""{with_views(MERGED).replace("WITH ", "WITH RECURSIVE ", 1)},{DELIVERY_SQL},{FRAME_SQL},{_ols_sql()},
b AS (SELECT *, list_transform(range(1, {q}), lambda j: CASE WHEN list_contains(kept, j) THEN m[j][{q}] * s[{q}] / s[j] END) AS b,
      list_transform(range(1, {q}), lambda i: list_transform(range(1, {q}), lambda j:
        CASE WHEN list_contains(kept, i) AND list_contains(kept, j) THEN -m[i][j] / (s[i] * s[j]) ELSE 0.0 END)) AS c,
      m[{q}][{q}] * tss AS rss, len(kept) - 1 AS k FROM fit),
t AS (SELECT j, [{", ".join(f"'{x}'" for x in names)}][j] AS term, r2, r2_adj, n,
             CASE WHEN j = 1 THEN ybar + list_sum(list_transform(range(1, {q}), lambda i: shift[i] * coalesce(b[i], 0.0))) ELSE b[j] END AS e,
             CASE WHEN j = 1 THEN list_sum(list_transform(range(1, {q}), lambda i: list_sum(list_transform(range(1, {q}), lambda l: shift[i] * shift[l] * c[i][l]))))
                  ELSE c[j][j] END AS v, s2
      FROM (SELECT *, rss / (n - k) AS s2, 1 - rss / tss AS r2, 1 - (rss / tss) * (n - 1) / (n - k) AS r2_adj FROM b), range(1, {q}) r(j))
SELECT term, round(e, 8) AS estimate, CASE WHEN e IS NOT NULL THEN round(sqrt(s2 * v), 8) END AS std_error,
       CASE WHEN e IS NOT NULL THEN round(e / sqrt(s2 * v), 5) END AS t_value, e IS NULL AS aliased,
       round(r2, 8) AS r2, round(r2_adj, 8) AS r2_adj, CAST(n AS INTEGER) AS n FROM t"""


@query("q_ols", _ols_table_sql())
def q_ols(spark, sf):
    """Least squares of the review score on the v2 inputs, the payment type a factor (106)."""
    t = RG.ols(review_frame(spark, sf), "review_score", OLS_X)
    return t.select("term", F.round("estimate", 8).alias("estimate"), F.round("std_error", 8).alias("std_error"),
                    F.round("t_value", 5).alias("t_value"), "aliased", F.round("r2", 8).alias("r2"), F.round("r2_adj", 8).alias("r2_adj"), "n")


DIAGNOSTIC_X = ["payment_installments", "payment_value", "freight_value", "del_time"]


@query("q_ols_diagnostics", f"""{with_views(MERGED).replace("WITH ", "WITH RECURSIVE ", 1)},{DELIVERY_SQL},{FRAME_SQL},{_ols_sql(xs=DIAGNOSTIC_X)},
e AS (SELECT z, m, s, kept, n, tss, ybar, z[10] AS y,
             list_sum(list_transform(range(1, 10), lambda i: z[i] * m[i][10] * s[10] / s[i])) AS f,
             list_sum(list_transform(range(1, 10), lambda i: list_sum(list_transform(range(1, 10), lambda j: -z[i] * z[j] * m[i][j] / (s[i] * s[j]))))) AS h
      FROM fit_z, fit)
SELECT CAST(round(y + ybar, 0) AS INTEGER) AS review_score, count(*) AS n, round(avg(f + ybar), 6) AS mean_fitted, round(sum((y - f) * (y - f)), 4) AS rss,
       round(sum(h), 6) AS leverage, round(max(h), 8) AS max_leverage,
       round(max(abs((y - f) / sqrt(m[10][10] * tss / (n - len(kept) + 1) * (1 - h)))), 6) AS max_std_residual
FROM e GROUP BY 1""")
def q_ols_diagnostics(spark, sf):
    """Diagnostics of every row (107), summed up per observed score."""
    d = RG.ols_diagnostics(review_frame(spark, sf), "review_score", ["payment_type", *DIAGNOSTIC_X])
    return d.groupBy(F.col("review_score").cast("int").alias("review_score")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fitted"), 6).alias("mean_fitted"), F.round(F.sum(F.col("residual") * F.col("residual")), 4).alias("rss"),
        F.round(F.sum("leverage"), 6).alias("leverage"), F.round(F.max("leverage"), 8).alias("max_leverage"),
        F.round(F.max(F.abs("std_residual")), 6).alias("max_std_residual"))


@query("q_aliased_columns", f"""{with_views(MERGED).replace("WITH ", "WITH RECURSIVE ", 1)},{DELIVERY_SQL},{FRAME_SQL},{_ols_sql()}
SELECT x AS aliased FROM (SELECT kept, [{", ".join(f"'{x}'" for x in REVIEW_X)}][i] AS x, i FROM fit, range(1, {len(REVIEW_X) + 1}) r(i))
WHERE NOT list_contains(kept, i + {len(_LEVELS)})""")
def q_aliased_columns(spark, sf):
    names = RG.aliased_columns(review_frame(spark, sf), OLS_X, "review_score")
    return spark.createDataFrame([(c,) for c in names], "aliased string")


TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("q_quantile_fit", f"""{with_views(MERGED)},
r AS (SELECT price, row_number() OVER (ORDER BY price) AS rn, count(*) OVER () AS n FROM merged),
t AS (SELECT * FROM (VALUES {", ".join(f"({t})" for t in TAUS)}) v(tau))
SELECT CAST(t.tau AS DOUBLE) AS tau, r.price AS estimate
FROM r, t WHERE r.rn = greatest(ceil(r.n * CAST(t.tau AS DOUBLE)), 1)""")
def q_quantile_fit(spark, sf):
    m = stage(marketplace_lines(spark, sf).select("price"), "prices")  # every search reads it several times, the merge runs once
    return spark.createDataFrame([(t, RG.intercept_quantile(m, "price", t)) for t in TAUS],
                                 "tau double, estimate double")


@query("q_quantile_regression")
def q_quantile_regression(spark, sf):
    """Coefficients per τ with the optimality gap of each fit; the payment type a factor (109-111)."""
    xs = ["payment_type", "payment_installments", "payment_value", "freight_value", "del_time"]
    return RG.quantile_table(review_frame(spark, sf), "review_score", xs, taus=TAUS)


@query("q_score_accuracy", f"""{with_views(MERGED).replace("WITH ", "WITH RECURSIVE ", 1)},{DELIVERY_SQL},{FRAME_SQL},
{_ols_sql(xs=["payment_installments", "payment_value", "price", "freight_value", "product_photos_qty"], name="one")},
{_ols_sql(name="two")},
p AS (SELECT 'orders_all_1' AS Data, z[11] + ybar AS y, ybar + list_sum(list_transform(range(1, 11), lambda i: CASE WHEN list_contains(kept, i) THEN z[i] * m[i][11] * s[11] / s[i] ELSE 0 END)) AS f FROM one_z, one
      UNION ALL SELECT 'orders_all_2', z[17] + ybar, ybar + list_sum(list_transform(range(1, 17), lambda i: CASE WHEN list_contains(kept, i) THEN z[i] * m[i][17] * s[17] / s[i] ELSE 0 END)) FROM two_z, two)
SELECT Data, round(avg(CAST(least(greatest(ceil(f - 0.4::DOUBLE), 1), 5) = round(y, 0) AS DOUBLE)), 9) AS accuracy, count(*) AS n FROM p GROUP BY Data""")
def q_score_accuracy(spark, sf):
    """Accuracy table of the least-squares models on both versions of the review inputs (108, 131)."""
    from functools import reduce
    lines = marketplace_lines(spark, sf)
    tables = []
    for version in (1, 2):
        frame = review_model_inputs(lines, version)
        xs = [c for c in frame.columns if c != "review_score"]
        acc = RG.score_accuracy(RG.ols_predict(frame, "review_score", xs, frame), "review_score")
        tables.append(acc.select(F.lit(f"orders_all_{version}").alias("Data"), F.round("accuracy", 9).alias("accuracy"), "n"))
    return reduce(lambda a, b: a.unionByName(b), tables)


@query("q_model_accuracy")
def q_model_accuracy(spark, sf):
    """Test accuracy of least squares, median regression and hinge models of degree 1 and 2 on both input versions (108)."""
    lines = marketplace_lines(spark, sf)
    rows = []
    for version in (1, 2):
        frame = review_model_inputs(lines, version).withColumn("row_id", F.monotonically_increasing_id())
        frame = stage(frame.withColumn("row_hash", SP.seeded_hash("row_id", 3)), "accuracy-frame")  # every pass of the split reads the hash
        split = SP.train_test_split(frame, "row_id", 0.7, seed=3, hashed="row_hash")
        train, test = split.where(F.col("set") == "train"), split.where(F.col("set") == "test")
        xs = [c for c in frame.columns if c not in ("review_score", "row_id", "row_hash", "set")]
        fitted = {"least squares": RG.ols_predict(train, "review_score", xs, test),
                  "median": RG.quantile_predict(RG.quantile_regression(train, "review_score", xs, 0.5, iters=40), xs, test)}
        for degree in (1, 2):
            kept, coef, _, _ = HG.mars(train, "review_score", xs, degree=degree, max_terms=9)
            fitted[f"hinge, degree {degree}"] = HG.mars_predict(test, kept, coef)
        for model, scored in fitted.items():
            r = RG.score_accuracy(scored, "review_score").first()
            rows.append((f"orders_all_{version}", model, float(r.accuracy or 0.0), int(r.n)))
    return spark.createDataFrame(rows, "Data string, model string, accuracy double, n long")


# ---------------------------------------------------------------- classification (98-105)
from retailforge.functions import calendar as K  # noqa: E402
from retailforge.operators import aggregates as AG  # noqa: E402
from retailforge.operators import classify as CL  # noqa: E402
from retailforge.session import stage  # noqa: E402

SEG_NUM = ["Quantity", "UnitPrice", "InvoiceDate_DayofMonth"]
SEG_CAT = ["Country", "InvoiceDate_DayofWeek", "InvoiceDate_MonthPeriod", "InvoiceDate_MonthName"]


def segment_model_frame(spark, sf):
    """Cleaned lines -> scores -> exact 1-D segments (130) -> calendar features, staged with a row id and its hash, split 70/30 (S5 flow)."""
    lab = segment_customers(retail_lines(spark, sf), columns=["Quantity", "UnitPrice", "Country", "InvoiceDate", "clv"])
    feat = K.calendar_features(lab, "InvoiceDate", "InvoiceDate")
    feat = feat.withColumn("InvoiceDate_MonthPeriod", K.month_period("InvoiceDate_DayofMonth")) \
               .withColumn("cluster", F.col("cluster").cast("string"))
    feat = feat.select(*SEG_NUM, *SEG_CAT, "cluster").withColumn("row_id", F.monotonically_increasing_id())
    frame = stage(feat.withColumn("row_hash", SP.seeded_hash("row_id", 3)), "segment_frame")
    split = SP.train_test_split(frame, "row_id", 0.7, seed=3, hashed="row_hash")
    return (CL.fit_ready(split.where(F.col("set") == "train")).cache(),
            CL.fit_ready(split.where(F.col("set") == "test")).cache())


@query("q_rf_segments")
def q_rf_segments(spark, sf):
    train, test = segment_model_frame(spark, sf)
    pred = CL.forest_holdout(train, test, "cluster", SEG_NUM, SEG_CAT, num_trees=500, mtry="sqrt")
    return AG.confusion(pred, "cluster", "predicted")


@query("q_rf_grid")
def q_rf_grid(spark, sf):
    train, test = segment_model_frame(spark, sf)
    return CL.rf_grid(train, test, "cluster", SEG_NUM, SEG_CAT, trees=(25, 100, 500), mtry=("1", "sqrt", "all"))


@query("q_rf_importance")
def q_rf_importance(spark, sf):
    train, test = segment_model_frame(spark, sf)
    model = CL.random_forest(train, "cluster", SEG_NUM, SEG_CAT, num_trees=25, mtry="sqrt", max_depth=8)
    return CL.permutation_importance(model, test, SEG_NUM + SEG_CAT)


@query("q_rf_oob")
def q_rf_oob(spark, sf):
    """Out-of-bag confusion of a bootstrap forest (99)."""
    train, _ = segment_model_frame(spark, sf)
    votes, _ = CL.oob_forest(train, "cluster", SEG_NUM, SEG_CAT, num_trees=10)
    return AG.confusion(votes, "cluster", "predicted")


@query("q_multinomial")
def q_multinomial(spark, sf):
    train, _ = segment_model_frame(spark, sf)
    num, cat = ["Quantity", "UnitPrice"], ["InvoiceDate_MonthPeriod"]
    model = CL.multinomial(train, "cluster", num, cat)
    return CL.multinomial_table(model, train, CL.design_names(num, cat, model))


#: largest difference of an expected from an observed sum, as a share of the column's absolute sum
MOMENT_TOLERANCE = 1e-4
_SEGMENT_LINES_SQL = _segments_sql(3).split("lab AS (")[0] + """
lab AS (SELECT CASE WHEN clv <= b1 THEN '1' WHEN clv <= b2 THEN '2' ELSE '3' END AS class, Quantity, UnitPrice,
               CASE WHEN day(InvoiceDate) <= 10 THEN 'Beginning of Month' WHEN day(InvoiceDate) <= 20 THEN 'Middle of Month'
                    ELSE 'End of Month' END AS period FROM scored, best)"""


@query("q_multinomial_moments", f"""{_SEGMENT_LINES_SQL}
SELECT c.class, t.term, round(coalesce(sum(CASE WHEN l.class = c.class THEN
         CASE t.term WHEN '(Intercept)' THEN 1.0 WHEN 'Quantity' THEN l.Quantity WHEN 'UnitPrice' THEN l.UnitPrice
                     ELSE CASE WHEN t.term = 'period' || l.period THEN 1.0 ELSE 0.0 END END END), 0), 3) AS observed, true AS balanced
FROM lab l, (SELECT DISTINCT class FROM lab) c,
     (SELECT unnest(['(Intercept)', 'Quantity', 'UnitPrice']) AS term UNION ALL SELECT DISTINCT 'period' || period FROM lab) t
GROUP BY 1, 2""")
def q_multinomial_moments(spark, sf):
    """First-order conditions of the multinomial fit on all lines: expected sums equal observed ones (102)."""
    from retailforge.session import stage
    lab = SG.optimal_1d_segments(stage(scored_lines(spark, sf), "scored"), "clv", 3)
    frame = stage(lab.select("Quantity", "UnitPrice", K.month_period(F.dayofmonth("InvoiceDate")).alias("period"),
                             F.col("cluster").cast("string").alias("cluster")), "moment-frame")
    train = CL.fit_ready(frame)
    model = CL.multinomial(train, "cluster", ["Quantity", "UnitPrice"], ["period"])
    m = CL.multinomial_moments(model, train, "cluster", ["Quantity", "UnitPrice"], ["period"])
    near = F.abs(F.col("expected") - F.col("observed")) <= F.lit(MOMENT_TOLERANCE) * F.col("scale")
    return m.select("class", "term", F.round("observed", 3).alias("observed"), near.alias("balanced"))


@query("q_stepwise_aic")
def q_stepwise_aic(spark, sf):
    train, _ = segment_model_frame(spark, sf)
    return CL.stepwise_aic(train, "cluster", ["Quantity", "UnitPrice", "InvoiceDate_DayofMonth"],
                           ["InvoiceDate_MonthPeriod"], max_iter=30)


@query("q_multinomial_accuracy")
def q_multinomial_accuracy(spark, sf):
    train, test = segment_model_frame(spark, sf)
    model = CL.multinomial(train, "cluster", SEG_NUM, SEG_CAT)
    tr = CL.predict_labels(model, train).withColumn("data", F.lit("train"))
    te = CL.predict_labels(model, test).withColumn("data", F.lit("test"))
    return AG.accuracy(tr.unionByName(te), "cluster", "predicted", by=["data"])


# ---------------------------------------------------------------- hinge models (113-115)
from retailforge.operators import hinge as HG  # noqa: E402

MARS_X = ["payment_type", "payment_installments", "payment_value", "freight_value", "del_time", "freight_ratio"]


@query("q_mars_regression")
def q_mars_regression(spark, sf):
    df = review_frame(spark, sf)
    kept, coef, _, n = HG.mars(df, "review_score", MARS_X, degree=2)
    return spark.createDataFrame([(HG.term_label(t), float(c)) for t, c in zip(kept, coef[:, 0])],
                                 "term string, coefficient double")


@query("q_mars_importance")
def q_mars_importance(spark, sf):
    _, _, imp, _ = HG.mars(review_frame(spark, sf), "review_score", MARS_X, degree=1)
    return spark.createDataFrame(imp, "col string, used int, nsubsets int, gcv double, rss double")


@query("q_mars_classifier")
def q_mars_classifier(spark, sf):
    train, test = segment_model_frame(spark, sf)
    score, _, _ = HG.mars_classifier(train, "cluster", ["Quantity", "UnitPrice", "InvoiceDate_DayofMonth", "InvoiceDate_MonthPeriod"])
    pred = score(test)
    return AG.confusion(pred, "cluster", "predicted")
